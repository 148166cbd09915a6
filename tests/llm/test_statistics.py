"""Collocations, whitening and order-preserving packing against plain versions."""

import math
import random
import re
import struct
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from benefica.llm import collocations, whitening, window_packing
from benefica.llm.double_array import DoubleArray

TOKENIZER = path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "a  b\t\n c", "it's  don't\r\n\r\nx", "tail  ", "  head", "é à ü   x 　y z\x85 w", "日本語 テキスト。 次", "<|endoftext|> a <|endoftext|>b", "x\x1c y\x1f\x1f z",
       "Dr. Who? \"Yes.\" (No!) 3.14 ... end", "ÿ À ́ a", "word " * 700, "x" * 5000, "\U0001f44d \U0001f44d"]


# --- collocations ---------------------------------------------------------------------------------------------

def plain_collocations(rows, least, top, share=50):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for lang in {r[0] for r in rows}:
        f = [Counter() for _ in range(4)]
        for _, text in (r for r in rows if r[0] == lang):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
                w = re.findall(r"[^\x20\x09]+", piece)
                for k in (1, 2, 3):
                    f[k].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        found = []
        for k in (2, 3):
            for p, a in f[k].items():
                if a < least or any(x >= least and 100 * x >= share * a for q, x in f[3].items() if k == 2 and p in (q[:2], q[1:])):
                    continue
                score, _, left, right = min((10**6 * a * a // (f[c][p[:c]] * f[k - c][p[c:]]), c, f[c][p[:c]], f[k - c][p[c:]]) for c in range(1, k))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang or "und", rank, p.decode(), -a, left, right, sum(f[1].values()), -s))
    return sorted(out)


def found_collocations(spark, rows, **kw):
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, word string, n int")
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).collect())


def test_collocations_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 7)  # many tries
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "b", "ü", "Ü", "cc", "d'", "\x1f", "日本"])
    rows = [(rng.choice(["en", "de", None]), "".join(word() + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","]) for _ in range(60))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, " \t"), ("fr", "..."), ("fr", "one word")] + [("en", "hot phrase here now")] * 300
    want = plain_collocations(rows, 10, 2000)
    assert found_collocations(spark, rows) == want and {r[0] for r in want} == {"en", "de", "und"}
    assert found_collocations(spark, rows, least=4, top=5, share=90) == plain_collocations(rows, 4, 5, 90)


def test_collocations_of_nothing(spark, corpus, nothing):
    assert collocations.collocations(nothing).collect() == []
    assert found_collocations(spark, [("en", "a b"), (None, None)]) == []
    rows = [(r.lang, r.text) for r in corpus.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(corpus).collect()) == plain_collocations(rows, 10, 2000)


def test_counters_and_rows_of_codes_stay_few_and_small(spark, monkeypatch):
    """Counters of pairs come once from each task over codes, not from each partition of the texts; rows of codes have 64 KB."""
    given, longest = [], []
    reached, candidates = collocations.reached, collocations.candidates

    def of_blocks(blocks, *more):
        given.append(blocks.groupBy("block").count().agg({"count": "max"}).first()[0])
        return reached(blocks, *more)

    def of_codes(coded, *more):
        longest.append(coded.selectExpr("max(length(codes))").first()[0])
        return candidates(coded, *more)

    monkeypatch.setattr(collocations, "reached", of_blocks)
    monkeypatch.setattr(collocations, "candidates", of_codes)
    rng = random.Random(5)
    rows = [("en", "".join(rng.choice("abcdefghijklmnopqrst") + rng.choice([" "] * 9 + [". "]) for _ in range(20_000))) for _ in range(40)]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(40)
    assert sorted(tuple(r) for r in collocations.collocations(texts).collect()) == plain_collocations(rows, 10, 2000)
    assert len(given) == len(longest) == 2
    assert max(given) <= spark.sparkContext.defaultParallelism
    assert max(longest) <= 1 << 17


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000
    words = spark.createDataFrame([(1, "en", 4 * big), (2, "en", 2 * big), (3, "en", 3 * big)], "h long, lang string, n long")
    pairs = spark.createDataFrame([(1, 2, big), (2, 3, big)], "h1 long, h2 long, a long")
    triples = spark.createDataFrame([(1, 2, 3, big // 3)], "h1 long, h2 long, h3 long, a long")
    got = {(r.h1, r.h2, r.h3): (r.a, r.l, r.r, r.score) for r in collocations.phrase_scores(words, pairs, triples).collect()}
    third = big // 3
    assert got == {(1, 2, None): (big, 4 * big, 2 * big, 125000), (2, 3, None): (big, 2 * big, 3 * big, 10**6 // 6),
                   (1, 2, 3): (third, 4 * big, big, 10**6 * third * third // (4 * big * big))}


def test_double_array_finds_exactly_its_rows():
    rng = np.random.default_rng(5)
    rows = np.unique(np.column_stack([rng.integers(1, 4, 20000), rng.zipf(1.3, 20000) % 70000 + 1, rng.integers(1, 300, 20000)]), axis=0)
    rng.shuffle(rows)
    trie = DoubleArray(rows)
    ask = np.concatenate([rows, rng.integers(0, 300, (20000, 3))])
    at, state = np.arange(len(ask)), np.zeros(len(ask), np.int32)
    for k in range(3):
        on, state = trie.advance(state, ask[at, k])
        at = at[on]
    number = {tuple(r): i for i, r in enumerate(rows.tolist())}
    want = {i: number[tuple(r)] for i, r in enumerate(ask.tolist()) if tuple(r) in number}
    assert dict(zip(at.tolist(), trie.row(state).tolist())) == want


# --- whitening ------------------------------------------------------------------------------------------------

def check_whitening(spark, rows, components=4):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, _id string, component string")
    got = whitening.whiten(df, components=components).collect()
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (d - len(v)) for _, v in kept]
    fit = sorted(set(x))
    if not d:
        assert got == []
        return
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * a - s for a, s in zip(v, sums)] for v in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(components, d)
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c + 1) for i, _ in kept for c in range(k))
    dev = {(i, tuple(a)): sum((n * p - s) ** 2 for p, s in zip(a, sums)) for (i, _), a in zip(kept, x)}
    by_id = defaultdict(set)
    for (i, _), far in dev.items():
        by_id[i].add(far if far < 1 << 63 else None)
    white = defaultdict(dict)
    for r in got:
        assert r.n == n and r.deviation in by_id[r.vec_id]
        e = max(values[r.component - 1], 0)
        assert r.explained is None if np.trace(v) == 0 else r.explained == pytest.approx(e / np.trace(v), rel=1e-9, abs=1e-12)
        white[r.vec_id][r.component] = r.whitened
        assert (r.whitened is None) == (e <= np.trace(v) * d * 2.3e-16)
        assert r.identity_error is None or r.identity_error < 1e-9
    return {i: [w[c] for c in sorted(w)] for i, w in white.items()}, dict(zip([i for i, _ in kept], x)), fit


def test_whitening_against_exact_fractions(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(200)] + [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [1.0]), (904, [1.0]),
                                                           (None, rows[1][1]), (905, [])]
    white, x, fit = check_whitening(spark, rows)
    w = np.array([white[{v: k for k, v in x.items() if k is not None}[v]] for v in fit], float)
    assert np.abs(w.T @ w / len(fit) - np.eye(4)).max() < 1e-9 and np.abs(w.mean(axis=0)).max() < 1e-9


def test_whitening_of_little(spark):
    check_whitening(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    check_whitening(spark, [(1, [0.5, 0.25]), (2, [1.5, 0.25]), (3, [2.5, 0.25])])
    check_whitening(spark, [(1, None), (2, [])])
    check_whitening(spark, [(i, [3e15 * i, -2.0**50, float(i * i)]) for i in range(7)], components=2)
    check_whitening(spark, [(1, None)])


def test_square_sums_are_exact():
    rng = np.random.default_rng(4)
    for bits in (5, 20, 21, 30, 45, 61):
        v = rng.integers(-(1 << bits), 1 << bits, (500, 3))
        assert whitening.square_sums(v) == [sum(int(a) ** 2 for a in col) for col in v.T]
    assert whitening.square_sums(np.array([[1 << 70, -3]], object)) == [1 << 140, 9]


# --- packing in order -----------------------------------------------------------------------------------------

def plain_cost(at, cost, size):
    best = [0] + [None] * (len(at) - 1)
    for t in range(1, len(at)):
        best[t] = cost[t] + min(best[s] + (0 if at[t] - at[s] & at[t] - at[s] - 1 == 0 else size - at[t] + at[s]) for s in range(t) if at[t] - at[s] <= size)
    return best


@pytest.mark.parametrize("size", [64, 48, 16])
def test_cuts_are_the_cheapest(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        docs = np.unique(np.concatenate([[0], np.cumsum(rng.geometric(0.02, 12))]))
        sentences = np.setdiff1d(rng.integers(1, docs[-1] + 1, 30), docs)
        at, cost = window_packing.places(docs, sentences, size, 3, 9)
        assert np.diff(at).max() <= size and set(docs) | set(sentences) <= set(at.tolist())
        plain = plain_cost(at.tolist(), cost.tolist(), size)
        cuts, total = window_packing.best_cuts(at, cost, size)
        lengths = np.diff(at[cuts])
        assert total == plain[-1] == cost[cuts[1:]].sum() + sum(0 if n & n - 1 == 0 else size - n for n in lengths.tolist()) and cuts[-1] == len(at) - 1
        cuts, total = window_packing.best_cuts(at, cost, size, open_end=True)
        assert at[-1] - at[cuts[-1]] <= size and total == min(p for p, a in zip(plain, at) if at[-1] - a <= size)


def check_packing(rows, got, size):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for key, text in rows:
        want[key, struct.pack("<%dI" % (n := len(ids := [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])), *ids)] += 1
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in got:
        assert 1 <= r.length <= size and len(r.ids) == 4 * r.length
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        filled[r.sequence_id].append((r.offset, r.length))
    for some in filled.values():
        some.sort()
        assert [o for o, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))] and sum(n for _, n in some) <= size
    by_key = defaultdict(Counter)
    for (key, ids), n in want.items():
        by_key[key, len(ids) // 4][ids] += n
    assert pieces.keys() == by_key.keys()
    for key, some in pieces.items():
        some.sort()
        if sum(by_key[key].values()) == 1:
            assert b"".join(i for _, i in some) == next(iter(by_key[key])) and [s for s, _ in some] == [sum(len(i) // 4 for _, i in some[:k]) for k in range(len(some))]
    assert sum(r.length for r in got) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    return sum(0 if n & n - 1 == 0 else size - n for n in (sum(x for _, x in f) for f in filled.values())), len(filled)


def test_packing_in_order(spark, corpus, nothing, monkeypatch):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    for size in (2048, 100):
        got = window_packing.pack_in_order(corpus.coalesce(1), TOKENIZER, seq_len=size).collect()
        padding, sequences = check_packing(rows, got, size)
        assert padding <= 0.01 * size * sequences + size
    assert window_packing.pack_in_order(nothing, TOKENIZER).count() == 0
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string").withColumnRenamed("doc_id", "key")
    got = window_packing.pack_in_order(df.repartition(3), TOKENIZER, id_col="key", seq_len=64).withColumnRenamed("key", "doc_id").collect()
    check_packing(list(enumerate(ODD)), got, 64)


def test_stretches_carry_the_open_sequence(monkeypatch):
    monkeypatch.setattr(window_packing, "CHAIN", 1000)
    ids_of = window_packing.ChunkIds(TOKENIZER)
    stream, seen, rng = window_packing.Stream(ids_of, 64, 2, 16), [], np.random.default_rng(1)
    docs = [rng.integers(0, 50000, n).astype("<u4") for n in rng.geometric(0.01, 100)] + [np.zeros(0, "<u4"), rng.integers(0, 50000, 5000).astype("<u4")]
    cuts = []
    for k, ids in enumerate(docs):
        stream.add(k, ids)
        if stream.n >= 1000:
            cuts.append(stream.cut(True))
            assert stream.n <= 64
    cuts.append(stream.cut(False))
    whole, used = defaultdict(list), Counter()
    for c in cuts:
        for key, start, ids, total, seq, length in zip(c["key"], c["start"], c["ids"].to_pylist(), c["doc_tokens"], c["sequence"], c["length"]):
            assert start == sum(len(i) // 4 for i in whole[key]) and total == len(docs[key]) + 1
            whole[key].append(ids)
            used[seq] += length
    assert [b"".join(whole[k]) for k in range(len(docs))] == [d.tobytes() + b"\1\0\0\0" for d in docs]
    assert max(used.values()) <= 64 and sorted(used) == list(range(len(used)))


def test_chunk_ids_are_the_ids_of_whole_texts():
    ids_of, tokenizer = window_packing.ChunkIds(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rng = random.Random(7)
    signs = [" ", "  ", "\n", "\t", "a", "é", "ÿ", " ", "　", " ", "\x85", "\x1c", "'s", ".", "日", "1", "<|endoftext|>", "́", "×", "÷", ",", "!?", " Word", " über", "x.", " ", "﻿", "​"]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    data = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, data)])
    ids, at = ids_of(np.frombuffer(b"".join(data), np.uint8), starts)
    for t, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_shard_of_phrases_becomes_a_trie_in_little_memory():
    """The driver builds the trie of a shard: beside the trie itself it holds less than 200 bytes a phrase."""
    rng = np.random.default_rng(0)
    p = 1 / np.arange(1, 20_001)
    codes = np.unique(rng.integers(1, 1 << 63, 20_000, dtype=np.uint64)[rng.choice(20_000, size=(120_000, 3), p=p / p.sum())], axis=0)
    tracemalloc.start()
    built = collocations.PhraseTrie(codes)
    own, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (peak - own) / len(codes) < 200
    text = np.column_stack([codes[:500], np.zeros(500, np.uint64)]).ravel()
    assert (built.count(text)[:500] == 1).all()
