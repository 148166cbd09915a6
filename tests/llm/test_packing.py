"""Packing against its constraints, and the pipeline on a small table."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from benefica.llm import stages
from benefica.llm import packing, queries
from benefica.llm.common import stage

TOKENIZER = path("word_bpe_49k.json")


@pytest.mark.parametrize(("docs", "cost", "score"), [(None, None, "norm"), (3, None, "norm"), (None, 64 * 40, "norm"), (5, 64 * 50, "dot")])
def test_best_fit_holds_every_capacity(docs, cost, score):
    rng = random.Random(1)
    counts = Counter(min(48, int(rng.lognormvariate(2, 1)) + 1) for _ in range(5000))
    used, ranks = defaultdict(list), defaultdict(list)
    for length, lo, hi, first, per, base in packing.best_fit(counts, 64, docs, cost, score):
        ranks[length] += range(lo, hi)
        for k in range(hi - lo):
            used[first + k // per].append((base + k % per * length, length))
    assert {k: len(v) for k, v in ranks.items()} == counts and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    for got in used.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 64 and len(got) <= (docs or 64) and sum(n * n for _, n in got) <= (cost or 64 * 64)
    least = max(-(-sum(k * n for k, n in counts.items()) // 64), -(-sum(counts.values()) // (docs or 64)), sum(k * k * n for k, n in counts.items()) / (cost or 64 * 64))
    assert len(used) <= (1.3 if docs or cost else 1.01) * least + 1


def test_one_length_holds_most_rows():
    runs = packing.best_fit({1: 1_000_000, 7: 3}, 64)
    assert sum(hi - lo for _, lo, hi, *_ in runs) == 1_000_003 and max(f + -(-(hi - lo) // per) for _, lo, hi, f, per, _ in runs) == -(-1_000_021 // 64)


def test_pieces(spark, corpus, nothing):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(stage(packing.token_pieces(corpus, TOKENIZER, seq_len=512)), 512).collect()
    want = Counter()
    for r in corpus.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 512)):
            some = ids[start:start + 512]
            want[r.doc_id, k, start, len(some), struct.pack(f"<{len(some)}I", *some)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for some in filled.values():
        some.sort()
        assert [o for o, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 512
    assert len(filled) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack(stage(packing.token_pieces(nothing, TOKENIZER))).count() == 0


def test_pipeline(spark):
    """Every stage returns the columns of documents and what it keeps; clean documents come through whole."""
    folder = "/root/testdata/sf0.001"
    docs = start = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, folder), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == start.columns
    texts = [r.text for r in seen["exact_duplicates"][1].collect()]
    squeeze = lambda t: " ".join((t or "").split())
    assert len(texts) == len({squeeze(t) for t in texts}) == len({squeeze(r.text) for r in seen["exact_duplicates"][0].collect()})
    before, after = ({r.doc_id: r for r in x.collect()} for x in seen["secrets"])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text) and ("[SECRET]" in r.text or r.text == before[i].text)
        assert not __import__("benefica.llm.secret_scan", fromlist=["x"]).base_spans(r.text)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(after)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    whole = defaultdict(bytes)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        whole[r.doc_id] += bytes(r.ids)
    for i, r in after.items():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        assert whole[i] == struct.pack(f"<{len(ids)}I", *ids)


def test_ids_of_words_are_the_ids_of_whole_texts():
    ids = packing.WordIds(TOKENIZER)
    odd = ["", " \t\n", "Don't stop, it's 12.5%!", "É́ éa, \u212aK İstanbul ŒUVRE ß. ﬁ", "a<|endoftext|>b <|STARTOFTEXT|> c", "日本語\u3000x\xa0y z\x1cw",
           "don't. U.S.A., naïve,, x!?;: ¡hola! ÿ \x85q", "Ünïcödé, ÀÉ.", "word, Word. WORD! word", "x" * 5000]
    for texts in (odd, odd[::-1], ["word?", ""]):
        want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids(texts) == want
    ids.letters.clear()
    assert ids(odd) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in ids.tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_few_words_are_encoded_together(monkeypatch):
    texts = [" ".join(f"{a}{b}lo{c}," for a in "klmn" for b in "aeiou" for c in "rst"), "Kalor lanos " * 9]
    whole, sizes = packing.WordIds(TOKENIZER)(texts), []
    monkeypatch.setattr(packing, "ENCODED", 7, raising=False)
    ids = packing.WordIds(TOKENIZER)
    encode = ids._encode_letters
    ids._encode_letters = lambda units: (sizes.append(len(units)), encode(units))[1]
    assert ids(texts) == whole
    assert max(sizes) <= 7 and sum(sizes) > 50


def test_together_changes_no_piece(spark, corpus):
    def pieces(n):
        return sorted(map(tuple, packing.token_pieces(corpus.where("doc_id IS NOT NULL"), TOKENIZER, seq_len=64, together=n).drop("nth", "part").collect()))

    assert pieces(2) == pieces(512)


def test_query_digests(spark):
    rows = queries.op7_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert all(r.ids_crc32 >= 0 for r in rows) and zlib.crc32(b"") == 0
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_stages_hand_python_few_texts_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    largest = lambda: spark.range(5000, numPartitions=1).mapInPandas(lambda parts: (p.assign(id=len(p)) for p in parts), "id long").agg({"id": "max"}).first()[0]
    try:
        for given, most in (("10000", stages.ROWS), ("300", 300), ("0", stages.ROWS)):
            spark.conf.set(name, given)
            stages.short_batches(spark)
            assert largest() == most
    finally:
        spark.conf.set(name, before)
