"""Best-fit packing of token pieces into fixed-size sequences under several capacities at once.

A piece weighs (tokens, 1 document, tokens squared as attention cost), so its weight depends on its length alone and a
count per length, at most ``seq_len`` numbers however large the corpus, is all the packer needs.  Lengths are placed
from long to short; bins with the same content form groups, and each length goes to the groups where it fits best until
it is used up.  The plan is a short table of runs (length, rank range, first bin, pieces per bin, offset); pieces find
their place in it by their rank among pieces of their length, which needs no ordered shuffle of the pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benefica.llm.common import stage

SEQ_LEN = 4096
END = 1
KNOWN_WORDS = 300_000  # words a worker process remembers the ids of, about 70 MB
ENCODED = 4096  # words that are encoded together as one text, whose tokens and offsets are held beside the ids


# A word of Latin-1 letters with punctuation behind it: the letters are one unit before the merges, the marks are another.
PLAIN = re.compile("([a-zà-öø-ÿ]+)([,.;:!?]*)")


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases and whose tokens cross neither white space nor the end of letters.

    Words of plain letters are remembered, one entry for all their spellings, and up to ``ENCODED`` new ones are encoded
    together as one text; its ids are cut behind every token that ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.letters, self.whole = Tokenizer.from_file(path), {}, {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, units: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, "<u4")
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) != len(units):
            return self._encode(units)
        whole, cuts = ids.tobytes(), [0, *cuts.tolist()]
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def _ids(self, vocabulary: list[bytes]) -> list[bytes]:
        """The ids of distinct words; known ones are not decoded again."""
        if len(self.whole) > KNOWN_WORDS:
            self.whole.clear()
        whole = self.whole
        new = [w for w in vocabulary if w not in whole]
        whole.update(zip(new, self._new_ids(new)))
        return [whole[w] for w in vocabulary]

    def _new_ids(self, vocabulary: list[bytes]) -> list[bytes]:
        """The ids of distinct words, by way of their letters."""
        if len(self.letters) > KNOWN_WORDS:
            self.letters.clear()
        letters, parts, other = self.letters, [], []
        for w in vocabulary:
            w = w.decode()
            m = PLAIN.fullmatch(w) or PLAIN.fullmatch(w.lower())
            if m:
                parts.append(m.groups())
            else:
                parts.append((w, None))
                other.append(w)
        units = list({u for u, m in parts if m is not None and u not in letters})
        for at in range(0, len(units), ENCODED):
            some = units[at:at + ENCODED]
            letters.update(zip(some, self._encode_letters(some)))
        marks = list({m for _, m in parts if m and m not in letters})
        letters.update(zip(marks, self._encode(marks)))
        rest = dict(zip(other, self._encode(other)))
        return [rest[u] if m is None else letters[u] + letters[m] if m else letters[u] for u, m in parts]

    def __call__(self, texts: list) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; every distinct word of ``texts`` is looked up once."""
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.string()))
        coded = split.flatten().dictionary_encode()
        found = self._ids(coded.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        borders = ends[split.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(borders, borders[1:])]


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table of known words per worker process, kept from task to task."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
                 together: int = 512) -> DataFrame:
    """Pieces of at most ``seq_len`` tokens: id, piece, start, length, ids (little-endian unsigned 32-bit), part, nth.

    The ids of a text are followed by id 1; a null text is empty.  Only texts with more tokens are cut, every
    ``seq_len`` tokens.  ``nth`` counts the pieces of one length within the scan task ``part``; stage the result before
    it is used twice.  A worker holds the ids of ``together`` texts at a time; fewer need less memory, more look up fewer words.
    """
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, seen = word_ids(tokenizer), np.zeros(seq_len + 1, np.int64)
        for rows in parts:
            keys, texts = rows["id"].tolist(), rows["text"].tolist()
            for at in range(0, len(keys), together):
                out = []
                for key, ids in zip(keys[at:at + together], ids_of(texts[at:at + together])):
                    ids += END.to_bytes(4, "little")
                    for k, start in enumerate(range(0, len(ids) // 4, seq_len)):
                        some = ids[4 * start:4 * (start + seq_len)]
                        n = len(some) // 4
                        out.append((key, k, start, n, some, seen[n]))
                        seen[n] += 1
                yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return (
        rows.mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids binary, nth long")
        .withColumn("part", F.spark_partition_id()).withColumnRenamed("id", id_col)
    )


def best_fit(counts: dict[int, int], seq_len: int = SEQ_LEN, max_docs: int | None = None, max_cost: int | None = None,
             score: str = "norm") -> list[tuple]:
    """Runs (length, from_rank, to_rank, first_bin, per_bin, offset) for ``counts`` pieces of each length.

    ``score`` names the rule for the best bin among those that hold the piece under every capacity: "norm", the smallest
    norm of what is left (each capacity counts as 1), or "dot", the largest product of the piece's weights with what is left.
    """
    cap = np.array([seq_len, max_docs or seq_len, max_cost or seq_len * seq_len], np.float64)
    left = np.zeros((0, 3))  # of each group of equal bins: what one of its bins has left
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        weight = np.array([length, 1, float(length) * length])
        if (weight > cap).any():
            raise ValueError(f"a piece of {length} tokens does not fit into an empty sequence")

        def put(at: int, base: int, count: int, room: np.ndarray) -> tuple[int, list]:
            """Place pieces in ``count`` equal bins from ``base`` on; the groups that they turn into."""
            nonlocal rank
            per = int((room / weight).min())
            full = min(count, (n - rank) // per)
            groups = []
            offset = seq_len - int(room[0])
            if full:
                runs.append((length, rank, rank + full * per, base, per, offset))
                rank += full * per
                groups.append((room - per * weight, base, full))
            rest = n - rank
            if full < count and 0 < rest:
                runs.append((length, rank, n, base + full, rest, offset))
                rank = n
                groups.append((room - rest * weight, base + full, 1))
                full += 1
            if full < count:
                groups.append((room, base + full, count - full))
            return at, groups

        fits = np.flatnonzero((left >= weight).all(axis=1))
        if len(fits):
            after = (left[fits] - weight) / cap
            rated = (after * after).sum(axis=1) if score == "norm" else -((left[fits] / cap) @ (weight / cap))
            gone, fresh = [], []
            for at in fits[np.argsort(rated, kind="stable")].tolist():
                if rank == n:
                    break
                at, groups = put(at, int(first[at]), int(many[at]), left[at])
                gone.append(at)
                fresh += groups
            left = np.vstack([np.delete(left, gone, axis=0), *[g[0][None] for g in fresh]])
            first = np.append(np.delete(first, gone), np.array([g[1] for g in fresh], np.int64))
            many = np.append(np.delete(many, gone), np.array([g[2] for g in fresh], np.int64))
        if rank < n:
            per = int((cap / weight).min())
            count = -(-(n - rank) // per)
            _, groups = put(-1, bins, count, cap)
            bins += count
            left = np.vstack([left, *[g[0][None] for g in groups]])
            first = np.append(first, np.array([g[1] for g in groups], np.int64))
            many = np.append(many, np.array([g[2] for g in groups], np.int64))
        open_ = (left[:, 0] > 0) & (left[:, 1] > 0)
        left, first, many = left[open_], first[open_], many[open_]
    return runs


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN, max_docs: int | None = None, max_cost: int | None = None, score: str = "norm") -> DataFrame:
    """Add sequence_id and offset to staged pieces (length from 1 to ``seq_len``, part, nth); both helper columns go.

    Every sequence holds at most ``seq_len`` tokens, ``max_docs`` pieces and ``max_cost`` squared tokens, without gaps
    from offset 0.  All lengths are known before any is placed, so the result does not depend on row order.  No pieces
    give no rows.
    """
    spark = pieces.sparkSession
    by_part = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(best_fit(counts, seq_len, max_docs, max_cost, score),
                                 "length long, from_rank long, to_rank long, first_bin long, per_bin long, base long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    placed = pieces.join(starts, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    # The plan has a few rows per length at most, so it may be broadcast.
    runs = runs.withColumnRenamed("length", "_length")
    hit = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank"))
    k = F.col("_rank") - F.col("from_rank")
    return placed.join(F.broadcast(runs), hit).select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in ("part", "nth")],
        (F.col("first_bin") + F.floor(k / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("base") + k % F.col("per_bin") * F.col("length")).cast("long").alias("offset"))
