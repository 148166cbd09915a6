"""Removal of passages that recur anywhere in the corpus, by repeated-phrase automata.

Discovery.  Of the ``w`` phrases of ``anchor`` words in a window, the one with the smallest hash (the leftmost of
equals) is the window's anchor, so equal windows have equal anchors at equal places.  Neighbouring windows with one
anchor form a segment.  Only anchors and segment hashes are shuffled, about one per 15 words.  An anchor that occurs
once has no recurring window; a segment that occurs twice recurs as a whole; where an anchor has different segments,
their windows are compared one by one, each distinct segment once.

Confirmation turns the recurring windows of a document into passages, the longest runs of such windows.  Each shard of
documents compiles its passages into an Aho-Corasick automaton over word numbers, streams all its documents through it
and removes the words of every occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import drop_stage, stage, words

WINDOW = 35
ANCHOR = 8
KNOWN_WORDS = 300_000
TEXTS = 256  # documents of one shard
MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words, remembered for a bounded number of words."""

    def __init__(self):
        self.known, self.hashes = {}, np.zeros(1024, np.uint64)

    def __call__(self, lists: list[list[bytes]]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known = self.known
        new = {w for ws in lists for w in ws if w not in known}
        while len(known) + len(new) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        for at, w in enumerate(new, len(known)):
            known[w] = at
            self.hashes[at] = xxhash.xxh64_intdigest(w, 7)
        return self.hashes[np.fromiter((known[w] for ws in lists for w in ws), np.int64, sum(map(len, lists)))]


class Ranges:
    """Hashes of word ranges, equal for equal words wherever they start."""

    def __init__(self, hashes: np.ndarray):
        powers = np.ones(len(hashes) + 1, np.uint64)
        powers[1:] = MULT
        back = np.ones(len(hashes) + 1, np.uint64)
        back[1:] = INVERSE
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * np.multiply.accumulate(powers)[:-1])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def anchors(ranges: Ranges, n: int, window: int, anchor: int) -> np.ndarray:
    """For each window start in ``n`` words the place of its anchor: the smallest phrase hash, leftmost of equals."""
    starts = np.arange(n - anchor + 1)
    value, place, span = ranges(starts, starts + anchor), starts, 1
    w = window - anchor + 1

    def merge(by: int) -> None:
        nonlocal value, place
        a, b = value[:-by], value[by:]
        later = b < a
        value, place = np.where(later, b, a), np.where(later, place[by:], place[:-by])

    while span * 2 <= w:
        merge(span)
        span *= 2
    if span < w:
        merge(w - span)
    return place


def segments(lists: list[list[bytes]], hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor hash, segment hash) of all segments of a batch of documents."""
    sizes = np.array([len(x) for x in lists])
    n = len(hashes)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    ranges = Ranges(hashes)
    place = anchors(ranges, n, window, anchor)
    doc = np.repeat(np.arange(len(lists)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1:])  # windows within one document
    if not len(at):
        return segments([], hashes[:0], window, anchor)
    place, doc = place[at], doc[at]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    first, many = at[new], np.diff(np.append(new, len(at)))
    p = place[new]
    return doc[new], first - begin[doc[new]], many, ranges(p, p + anchor), ranges(first, first + many - 1 + window)


def _digest(ws: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(ws)).hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                   texts: bool = False) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_sha256 of the kept words joined by one space, and with ``texts`` the kept text.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in the same document or
    another; repeated rows are places of their own.  A null text has no words; documents shorter than a window keep
    everything; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row"))

    def discover(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for some in parts:
            for lo in range(0, len(some), TEXTS):
                part = some.iloc[lo:lo + TEXTS]
                lists = [words(t) for t in part["text"]]
                doc, first, many, h, seg = segments(lists, known(lists), window, anchor)
                cut = np.searchsorted(doc, np.arange(len(lists) + 1))
                h, seg = h.view(np.int64), seg.view(np.int64)
                yield pd.DataFrame({
                    "id": part["id"], "row": part["row"], "n_words": [len(x) for x in lists], "sha": [_digest(x) for x in lists],
                    **{name: [v[a:b] for a, b in zip(cut, cut[1:])] for name, v in (("h", h), ("seg", seg), ("first", first), ("many", many))}})

    found = stage(rows.mapInPandas(
        discover, f"id {kind}, row long, n_words long, sha string, h array<long>, seg array<long>, first array<int>, many array<int>"), "found")
    segs = found.select("row", F.explode(F.arrays_zip("h", "seg", "first", "many")).alias("s")).select("row", "s.*")
    # Everything that is joined back is staged first, so both sides are plain shuffles and a hot anchor can be split.
    twice = stage(segs.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    shared = stage(segs.join(twice, "h"), "shared")
    drop_stage(twice)
    distinct = stage(shared.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("one")), "distinct")
    mixed = stage(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h", F.lit(True).alias("mixed")), "mixed")
    judged = stage(distinct.join(mixed, "h", "left").select(
        "h", "seg", "one", (F.col("n") > 1).alias("whole"), F.coalesce("mixed", F.lit(False)).alias("mixed")).where("whole OR mixed"), "judged")
    drop_stage(distinct), drop_stage(mixed)
    marked = stage(shared.join(judged, ["h", "seg"]).select(
        "row", "h", "seg", "first", "many", "whole", (F.col("mixed") & (F.col("row") == F.col("one"))).alias("ask")), "marked")
    drop_stage(shared), drop_stage(judged)

    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for some in parts:
            for lo in range(0, len(some), TEXTS):
                part = some.iloc[lo:lo + TEXTS]
                lists = [words(t) for t in part["text"]]
                sizes = np.array([len(x) for x in lists])
                doc = np.repeat(np.arange(len(lists)), [len(x) for x in part["first"]])
                h, seg, first, many, whole = (np.concatenate(part[c].tolist()) for c in ("h", "seg", "first", "many", "whole"))
                each = np.repeat(np.arange(len(doc)), many)
                start = first[each] + np.arange(len(each)) - (np.cumsum(many) - many)[each]
                at = start + (np.cumsum(sizes) - sizes)[doc[each]]
                yield pd.DataFrame({
                    "row": part["row"].to_numpy()[doc[each]], "h": h[each], "seg": seg[each], "whole": whole[each].astype(bool),
                    "first": start.astype(np.int32), "win": Ranges(known(lists))(at, at + window).view(np.int64)})

    asked = marked.where("ask").groupBy("row").agg(F.collect_set(F.struct("h", "seg", "first", "many", "whole")).alias("s"))
    asked = stage(asked.select("row", *[F.col(f"s.{c}").alias(c) for c in ("h", "seg", "first", "many", "whole")]), "asked")
    opened = stage(rows.select("row", "text").join(asked, "row").mapInPandas(
        windows, "row long, h long, seg long, whole boolean, first int, win long"), "opened")
    again = stage(opened.groupBy("h", "win", "seg").agg(F.lit(1).alias("x")).groupBy("h", "win").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "win"), "again")
    edges = opened.where("NOT whole").join(again, ["h", "win"]).select("row", "first", F.lit(1).alias("many"))
    runs = stage(marked.where("whole").select("row", "first", "many").unionByName(edges)
                 .groupBy("row").agg(F.collect_set(F.struct("first", "many")).alias("r"))
                 .select("row", F.col("r.first").alias("first"), F.col("r.many").alias("many")), "runs")
    drop_stage(opened), drop_stage(again), drop_stage(marked), drop_stage(asked)

    def locate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in parts:
            for lo in range(0, len(some), TEXTS):
                part = some.iloc[lo:lo + TEXTS]
                lists, kept = [words(t) for t in part["text"]], []
                for ws, gone in zip(lists, occurrences(lists, list(zip(part["first"], part["many"])), window)):
                    kept.append([w for w, g in zip(ws, gone.tolist()) if not g])
                yield pd.DataFrame({"id": part["id"], "n_words": [len(x) for x in lists], "n_removed": [len(x) - len(k) for x, k in zip(lists, kept)],
                                    "sha": [_digest(k) for k in kept], **({"kept": [b" ".join(k).decode() for k in kept]} if texts else {})})

    names = ["id", "n_words", "n_removed", "sha", *(["kept"] if texts else [])]
    changed = rows.join(runs, "row").mapInPandas(locate, f"id {kind}, n_words long, n_removed long, sha string" + ", kept string" * texts)
    if texts:
        plain = rows.join(runs.select("row"), "row", "left_anti").mapInPandas(
            lambda parts: locate(p.assign(first=None, many=None) for p in parts), f"id {kind}, n_words long, n_removed long, sha string, kept string")
    else:
        plain = found.join(runs.select("row"), "row", "left_anti").withColumn("n_removed", F.lit(0).cast("long"))
    return changed.select(*names).unionByName(plain.select(*names)).withColumnsRenamed({"id": id_col, "sha": "kept_sha256", "kept": "kept_text"})


def occurrences(lists: list[list[bytes]], runs: list, window: int) -> list[np.ndarray]:
    """For each document of a shard which words lie in an occurrence of a confirmed passage of the shard.

    ``runs`` has for each document the first places and the lengths of runs of recurring windows, or None twice; windows in
    a row make one passage.
    """
    import ahocorasick

    number: dict[bytes, int] = {}
    ids = [tuple([number.setdefault(w, len(number)) for w in ws]) for ws in lists]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for doc, (first, many) in zip(ids, runs):
        if first is None:
            continue
        inside = np.zeros(len(doc) + 1, np.int64)  # starts of recurring windows
        np.add.at(inside, first, 1)
        np.subtract.at(inside, first + many, 1)
        is_start = np.cumsum(inside) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_start, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            automaton.add_word(doc[a:b - 1 + window], b - a - 1 + window)
    out = []
    if len(automaton):
        automaton.make_automaton()
    for doc in ids:
        cover = np.zeros(len(doc) + 1, np.int64)
        if len(automaton) and len(doc) >= window:
            for end, size in automaton.iter(doc):
                cover[end + 1 - size] += 1
                cover[end + 1] -= 1
        out.append(np.cumsum(cover)[:-1] > 0)
    return out
