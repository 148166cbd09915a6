"""Duplicate operators against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from benefica.llm import embedding_dedup, exact_dedup, phrase_dedup, simhash_dedup
from benefica.llm.common import connected_components


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, None)] + [(2000, 3), (3, 4), (4, 2000), (4, 2000)]
    rows = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {n for a, b in links if b is not None and a != b for n in (a, b)}
    assert {r.node: r.component_id for r in rows} == components(nodes, [x for x in links if x[1] is not None and x[0] != x[1]])
    assert len(rows) == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact(spark, corpus, nothing):
    rows = exact_dedup.mark_duplicates(corpus).collect()
    given = [(r.doc_id, r.text) for r in corpus.collect()]
    groups = {}
    for i, t in given:
        groups.setdefault(normal(t), []).append(i)
    want = Counter((i, min([x for x in groups[normal(t)] if x is not None]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in given)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({k: 1 for k in {r.text_sha256 for r in rows}})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact_dedup.mark_duplicates(nothing).count() == 0
    # A filter of one block is full of false alarms and changes nothing.
    assert Counter(exact_dedup.mark_duplicates(corpus, filter_bits=1).collect()) == Counter(rows)


def test_exact_drop_keeps_columns(corpus, nothing):
    kept = exact_dedup.drop_duplicates(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in exact_dedup.mark_duplicates(corpus).where("kept").collect())
    assert exact_dedup.drop_duplicates(nothing).count() == 0


def plain_fingerprint(text, size=3):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not ws:
        return 0
    n = min(size, len(ws))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + n]).encode(), seed=42) for i in range(len(ws) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(spark, corpus, nothing):
    rows = simhash_dedup.near_duplicates(corpus).collect()
    texts = {(r.doc_id, r.text) for r in corpus.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts if i is not None}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    part = components(prints, linked)
    assert len(rows) == corpus.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", part[r.doc_id])
    assert simhash_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_vantage_tree_finds_every_pair(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in rng.integers(1, 7, 1500)])
    fps = np.unique(np.concatenate([base, base ^ flips, base[0] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    tree = simhash_dedup.build_tree(fps[::5], 4)
    found = set()
    for _, rows, home in simhash_dedup.visits(tree, fps, radius):
        for a, b in simhash_dedup.links_within(fps[rows], home, radius):
            found |= {(min(x, y), max(x, y)) for x, y in zip(rows[a].tolist(), rows[b].tolist())}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    assert found == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(near))) if a < b}


def test_simhash_with_similarity(spark):
    rng = random.Random(3)
    base = [[f"v{rng.randrange(5000)}" for _ in range(400)] for _ in range(6)]
    rows = []
    for k, ws in enumerate(base):
        rows.append((10 * k, " ".join(ws)))
        for j, edits in enumerate((1, 4, 60)):  # the last one is far below 0.8
            copy = list(ws)
            for at in rng.sample(range(400), edits):
                copy[at] = f"z{rng.randrange(5000)}"
            rows.append((10 * k + 1 + j, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs, shingle=5, radius=16, similarity=0.8).collect()}
    assert found == {i: i // 10 * 10 if i % 10 < 3 else i for i, _ in rows}


def shingle_set(text):
    return set(simhash_dedup.shingle_hashes(text, 5).tolist())


def test_similarity_is_decided_by_the_whole_sets(spark):
    rng, rows = random.Random(8), []
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    for n in (40, 90, 225, 900):
        for k in range(24):  # from the end of each text, so that it is the last shingles that differ
            ws = fresh(n + 4)
            apart = round(n / 9) if k % 2 else round(n / 7.7)  # 0.8 or just over, and 0.77
            rows += [ws, ws[:-apart] + fresh(apart)]
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs, shingle=5, radius=40, similarity=0.8).collect()}
    sets = [shingle_set(" ".join(ws)) for ws in rows]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert 20 < len(linked) < 80
    assert found == components(range(len(rows)), linked)


def test_similarity_in_large_groups_needs_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "ASKED", 1)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [" ".join([*base[:100 + rng.randrange(20)], *(f"e{rng.randrange(10**6)}" for _ in range(rng.randrange(20)))]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs, shingle=5, radius=64, similarity=0.8).collect()}
    sets = [shingle_set(t) for t in rows]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert found == components(range(len(rows)), linked)


def test_large_groups_make_no_table_of_pairs(spark, monkeypatch):
    sizes, stage = {}, simhash_dedup.stage

    def counted(df, label="llm"):
        out = stage(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(simhash_dedup, "stage", counted)
    rng = random.Random(14)
    base, rows = [f"b{i}" for i in range(160)], []
    for _ in range(400):  # two of them have a similarity of about 0.7 to 0.9
        ws = list(base)
        for at in rng.sample(range(160), rng.randrange(1, 4)):
            ws[at] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(ws))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    run = lambda: {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs, shingle=5, radius=64, similarity=0.8).collect()}
    found = run()
    sets = [shingle_set(t) for t in rows]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert found == components(range(len(rows)), linked) and len(linked) > 5000
    assert max(sizes.values()) <= 2 * len(rows)  # a document lives in one ring and visits another
    monkeypatch.setattr(simhash_dedup, "SET_HASHES", 2000)
    assert run() == found


def test_repeated_lines_do_not_hide_a_similar_text(spark):
    rng, rows = random.Random(10), []
    for _ in range(8):
        line, rest = (" ".join(f"r{rng.randrange(10**9)}" for _ in range(n)) for n in (20, 200))
        rows += [f"{line} {line} {rest}", f"{' '.join([line] * 30)} {rest}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs, shingle=5, radius=16, similarity=0.8).collect()}
    assert found == {i: i // 2 * 2 for i in range(len(rows))}


def test_sets_of_a_text_are_hashed_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f"), (3, None)], "doc_id long, text string")
    sets = simhash_dedup.shingle_sets(docs, "doc_id", "text", 2)
    named = sets.select("id", "whole").localCheckpoint()
    joined = named.join(sets.groupBy("id", "whole").count(), ["id", "whole"])
    assert joined._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # not once more for a filter on whole
    assert sorted(joined.select("id", "count").collect()) == [(1, 1), (2, 1), (3, 1)]


def test_blocks_of_a_shard_are_bounded_and_meet_once():
    rng = np.random.default_rng(12)
    home, ask, salt = rng.random(3000) < 0.5, rng.random(3000) < 0.9, rng.integers(0, 1 << 40, 3000, dtype=np.uint64)
    met = np.zeros((3000, 3000), np.int8)
    for _, at, here, there in simhash_dedup.cells(home, ask, salt, 8, 14):
        assert len(at) < 2 * (1500 / 8 + 2700 / 14)
        met[np.ix_(at[there], at[here])] += 1
    assert (met == (ask[:, None] & home[None, :])).all()


def test_blocks_change_no_result(spark):
    rng, rows = random.Random(13), []
    for _ in range(40):
        ws = [f"v{rng.randrange(10**6)}" for _ in range(60)]
        rows += [" ".join(ws), " ".join([*ws, "more"]), " ".join(ws[:50])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for options in ({}, {"shingle": 5, "radius": 16, "similarity": 0.8}):
        one, many = ({tuple(r) for r in simhash_dedup.near_duplicates(docs, shard_rows=n, **options).collect()} for n in (16384, 25))
        assert one == many and len({r[2] for r in one}) < len(rows)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(160):
        v = (base[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.6])).astype(np.float32).tolist()
        rows.append((i, v, int(i % 3)))
    rows += [(200 + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, rows[1][1], None),
             (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] * 16, 2), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS n")
    ok = [(i, np.array(v, np.float64), x) for i, v, x in rows if i is not None and x is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / np.sqrt(a[1] @ a[1]) / np.sqrt(b[1] @ b[1]) >= 0.93]
    degree = Counter(x for pair in links for x in pair)
    part = components([r[0] for r in rows if r[0] is not None], links)
    want = {i: (degree[i], part[i], part[i] == i) for i in part}
    for block in (16384, 16):  # one block a label, and many
        got = embedding_dedup.near_duplicates(df, block_rows=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == want
        assert len(got) == len(rows)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def plain_removal(texts, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(ws[s:s + window]) for ws in lists for s in range(len(ws) - window + 1))
    out = []
    for ws in lists:
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            if seen[tuple(ws[s:s + window])] > 1:
                gone[s:s + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_passages(spark, corpus, nothing):
    given = corpus.collect()
    got = phrase_dedup.remove_repeats(corpus).collect()
    want = [(r.doc_id, *x) for r, x in zip(given, plain_removal([r.text for r in given], 35))]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want)
    assert phrase_dedup.remove_repeats(nothing).count() == 0


def test_passages_of_few_words_and_periodic_texts(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 150))) for _ in range(40)]
    texts += ["a b " * 60, "b a " * 50, "x " * 80, "x " * 34, "x " * 35, " ".join(f"q{i}" for i in range(300)), " ".join(f"q{i}" for i in range(100, 180))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in phrase_dedup.remove_repeats(docs, window=12, anchor=4, texts=True).collect()}
    want = plain_removal(texts, 12)
    assert {i: x[:3] for i, x in got.items()} == dict(enumerate(want))
    assert all(hashlib.sha256(x[3].encode()).hexdigest() == x[2] for x in got.values())
