"""Similar texts against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from benefica.operators import near_texts


def grams(s):
    return {f"  {w} "[i:i + 3] for w in s.split() for i in range(len(w) + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [0.35, 0.6, 0.9, 1.0])
def test_a_trigram_in_all_texts(spark, monkeypatch, least):
    monkeypatch.setattr(near_texts, "LIST", 16)  # the list of the frequent trigrams is many blocks
    rnd = random.Random(3)
    part = ["ana", "anna", "hanna", "maria", "mario", "silva", "silvas", "costa"]
    texts = {"zzz"} | {"zzz " + " ".join(rnd.choice(part) for _ in range(rnd.randint(1, 4))) for _ in range(150)}
    df = spark.createDataFrame([(t, 1) for t in [*texts, None, "zzz"]], "name string, id int")
    got = {(r.text_a, r.text_b): round(r.similarity, 9) for r in near_texts.similar_texts(df, "name", least).collect()}
    want = {(a, b): round(jaccard(grams(a), grams(b)), 9) for a in texts for b in texts if a == b or jaccard(grams(a), grams(b)) >= least - 1e-12}
    assert got == want


def test_only_ids_meet(spark):
    grams_ = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"])], "id long, grams array<string>")
    assert near_texts.candidate_pairs(grams_, 0.3).columns == ["a", "b"]
    assert near_texts.candidate_pairs(grams_.where("false"), 0.3).count() == 0


def long_texts(seed, n=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(60, 300))]
        rows.append(" ".join(base))
        for _ in range(3):  # about 0.7 to 0.95 of the runs in common
            other = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 40))):
                other[rnd.randrange(len(other))] = f"x{rnd.randint(0, 5000)}"
            rows.append(" ".join(other))
    return rows


def runs(t):
    w = t.lower().split()
    return frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_long_texts_recall_against_all_pairs(spark):
    texts = [*long_texts(1), "", None, "one", "ONE", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").withColumn("id", F.lit("x"))
    near, members = near_texts.similar_long_texts(df, "doc", "text")
    sets = {i: runs(t) for i, t in enumerate(texts) if t and runs(t)}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    assert {r.key: r.id for r in members.collect()} == {i: first[s] for i, s in sets.items()}
    ids = sorted(first.values())
    want = {(a, b): jaccard(sets[a], sets[b]) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    got = {(r.a, r.b): r.similarity for r in near.collect()}
    assert set(got) <= set(want) and all(got[p] == pytest.approx(want[p]) for p in got)  # decided exactly
    close = [p for p, s in want.items() if s < 0.85]
    assert len(close) > 10 and sum(p in got for p in close) >= 0.9 * len(close) and len(got) >= 0.99 * len(want)


def test_no_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, " \n")], "doc int, text string")
    near, members = near_texts.similar_long_texts(df, "doc", "text")
    assert near.count() == 0 and members.count() == 0


def test_long_sets_move_by_digest(spark):
    """Hashes are never a key of a group or of a join: what is dealt for a text that is in no pair has a fixed size."""
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[1] + " z", texts[0]])] + [(1, texts[1])], "doc int, text string")
    assert "digest" in near_texts.run_sets(df, "doc", "text", 5).columns
    near, members = near_texts.similar_long_texts(df, "doc", "text")
    assert [(r.a, r.b) for r in near.collect()] == [(1, 21)]
    assert sorted((r.key, r.id) for r in members.collect()) == sorted([(i, i) for i in range(20)] + [(1, 1), (20, 0), (21, 21), (22, 0)])
