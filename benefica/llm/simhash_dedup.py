"""Near duplicates by SimHash: fingerprints are cut into shards by vantage points and compared inside shards.

A vantage-point tree splits fingerprints at the median Hamming distance to a pivot.  A fingerprint lives in one leaf.  At
each split those that live inside also visit the outside where the triangle bound cannot rule it out, and those that are
visiting already go on to both sides, so every pair within the radius meets once, where one of the two lives.  The upper tree is built on the driver from a bounded sample (``sample_rows``) and only
decides where the shards are cut; every fingerprint is indexed.  Those that live in a shard and those that visit it are
cut into blocks of bounded size, and two blocks meet in a group of their own, where the tree goes on in numpy.

With a similarity the fingerprints and sketches only tell which documents of a block may have a similar one there; these
meet once more with their whole sets of shingles, which decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import connected_components, drop_stage, merge_labels, stage, words

SEED = 42
SHARD_ROWS = 16384
SAMPLE_ROWS = 32768
LEAF_ROWS = 256
BINS = 512
SIGMAS = 5  # standard errors that the sketches of a pair may fall short
ASKED = 4  # pairs of a fingerprint that are looked at first; eight times as many in each further step
SET_HASHES = 1 << 21  # shingle hashes of those that live in a group, or visit it, where whole sets are compared


def bit_majority(hashes: np.ndarray) -> int:
    """64-bit integer with the bits that are set in over half of the hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 65280):
        part = hashes[at:at + 65280]
        groups = -(-len(part) // 255)
        padded = np.zeros(groups * 255, "<u8")
        padded[:len(part)] = part
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits.reshape(groups, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of the word shingles in order, repeats included; of fewer words the whole sequence is one shingle."""
    found = [w.lower() for w in words(text)]  # bytes: lowers A-Z only
    if not found:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(found))
    lengths = np.array([len(w) + 1 for w in found])
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(found) - size + 1].tolist()
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles, repeats included; text without words has fingerprint zero."""
    return bit_majority(shingle_hashes(text, shingle))


def sketch(hashes: np.ndarray) -> tuple[int, bytes]:
    """(distinct shingles, for each of ``BINS`` ranges of hashes a byte of its smallest hash, 0 if it has none)."""
    distinct = np.unique(hashes)
    bins, first = np.unique(distinct >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(np.int64)] = 1 + distinct[first] % np.uint64(255)
    return len(distinct), out.tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, sets: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer; a null text has fingerprint zero.

    With ``sets`` each distinct shingle counts once in the fingerprint too, and there are also the number of distinct
    shingles, their sketch and a 128-bit hash of them all.
    """
    def many(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for hashes in (shingle_hashes(t, shingle) for t in texts):
                distinct = np.unique(hashes) if sets else None
                rows.append((bit_majority(distinct if sets else hashes), *((*sketch(distinct), xxhash.xxh3_128_digest(distinct.tobytes())) if sets else ())))
            out = pd.DataFrame({"fp": np.array([r[0] for r in rows], np.uint64).view(np.int64)})
            if sets:
                out["n"] = np.array([r[1] for r in rows], np.int64)
                for k, c in enumerate(("sketch", "whole"), 2):
                    out[c] = pd.Series([r[k] for r in rows], dtype=object)
            yield out

    of = F.pandas_udf(many, "fp long" + (", n long, sketch binary, whole binary" if sets else ""))
    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col).cast("string")).alias("f")).select("id", "f.*")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, whole, hashes) of all rows: the distinct shingle hashes in order, 8 bytes each, and the 128-bit hash of them all.

    Declared as not deterministic, so that a filter on ``whole``, which any join on it brings, is not pushed below: it would
    hash every text a second time, in a second Python worker of the same task.
    """
    @F.pandas_udf("whole binary, hashes binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts]
        return pd.DataFrame({"whole": pd.Series([xxhash.xxh3_128_digest(x) for x in sets], dtype=object), "hashes": pd.Series(sets, dtype=object)})

    once = of.asNondeterministic()
    return docs.select(F.col(id_col).cast("long").alias("id"), once(F.col(text_col).cast("string")).alias("s")).select("id", "s.*")


def _distances(fps: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ pivot).astype(np.int16)


def _pivot(fps: np.ndarray) -> np.uint64:
    """Of a few fingerprints, the one whose distances to the others spread most."""
    tries = fps[:: max(1, len(fps) // 8)][:8]
    seen = fps[:: max(1, len(fps) // 512)]
    return tries[int(np.argmax([_distances(seen, p).std() for p in tries]))]


def build_tree(sample: np.ndarray, depth: int, least: int = 16) -> list:
    """Nodes (pivot, median, inside, outside); a negative child -1-k is shard k."""
    nodes, shards = [], 0

    def grow(fps: np.ndarray, level: int) -> int:
        nonlocal shards
        if level < depth and len(fps) >= 2 * least:
            pivot = _pivot(fps)
            d = _distances(fps, pivot)
            middle = int(np.median(d))
            inside = d <= middle
            if 0 < inside.sum() < len(fps):
                at = len(nodes)
                nodes.append(None)
                nodes[at] = (pivot, middle, grow(fps[inside], level + 1), grow(fps[~inside], level + 1))
                return at
        shards += 1
        return -shards

    root = grow(sample, 0)
    return [root, nodes]


def visits(tree: list, fps: np.ndarray, radius: int, live: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions of the fingerprints that visit it, whether each one lives there); without ``live`` all only visit."""
    root, nodes = tree
    todo = [(root, np.arange(len(fps)), np.full(len(fps), live))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -1 - at, rows, home
            continue
        pivot, middle, inside, outside = nodes[at]
        d = _distances(fps[rows], pivot)
        mine = d <= middle
        # The inside asks the outside; what lives outside is asked and need not ask back.
        into = np.where(home, mine, d <= middle + radius)
        todo.append((inside, rows[into], home[into]))
        out = d > middle - radius
        todo.append((outside, rows[out], (home & ~mine)[out]))


def cells(home: np.ndarray, ask: np.ndarray, salt: np.ndarray, homes: int, asks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, positions, home, ask) of a shard cut into ``homes`` blocks of residents and ``asks`` blocks of visitors.

    Each visitor meets each resident in one cell; who is both in one cell is there once.
    """
    lives, visits_in = salt % np.uint64(homes), salt % np.uint64(asks)
    for i in range(homes):
        for j in range(asks):
            here, there = home & (lives == i), ask & (visits_in == j)
            at = np.flatnonzero(here | there)
            if len(at):
                yield i * asks + j, at, here[at], there[at]


def links_within(fps: np.ndarray, home: np.ndarray, radius: int, asking: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs (query, fingerprint that lives here) at most ``radius`` bits apart, found by a local tree; by query inside a batch."""
    todo = [(np.arange(len(fps)) if asking is None else np.flatnonzero(asking), np.flatnonzero(home))]
    while todo:
        ask, live = todo.pop()
        if not len(ask) or not len(live):
            continue
        if len(live) > LEAF_ROWS:
            pivot = _pivot(fps[live])
            d = _distances(fps[live], pivot)
            middle = int(np.median(d))
            inside = d <= middle
            if 0 < inside.sum() < len(live):
                q = _distances(fps[ask], pivot)
                near, far = q <= middle + radius, q > middle - radius
                if not (near.all() and far.all()):
                    todo += [(ask[near], live[inside]), (ask[far], live[~inside])]
                    continue
        step = max(1, 4_000_000 // len(live))
        for at in range(0, len(ask), step):
            part = ask[at:at + step]
            a, b = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[live][None, :]) <= radius)
            differ = part[a] != live[b]
            if differ.any():
                yield part[a[differ]], live[b[differ]]


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs of sketches of ``n_a`` and ``n_b`` shingles leave it possible that the sets are that similar.

    The used bins are a sample without replacement of the shingles of both: where no two shingles share a bin, all of them.
    A set that reaches the similarity falls ``SIGMAS`` standard errors (and two bins, for short texts) short almost never.
    """
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    whole = np.maximum((n_a + n_b) / (1 + similarity), used)
    slack = SIGMAS * np.sqrt(similarity * (1 - similarity) / used * (1 - used / whole)) + 2 / used
    return ((a == b) & (a > 0)).sum(axis=1) / used >= similarity - slack


def possible(rows: pd.DataFrame, radius: int, similarity: float) -> pd.DataFrame:
    """The rows of a group that have a pair which their sketches leave possible: at most all of them, however many pairs there are.

    Pairs of two rows that are known to have one say nothing new and are not looked at, so a large group is soon through.
    """
    rows = rows.sort_values("first", kind="stable")
    fps, first, n = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["first"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    sketches, known = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, BINS), np.zeros(len(fps), bool)
    for a, b in links_within(fps, rows["home"].to_numpy(bool), radius, rows["ask"].to_numpy(bool)):
        apart = (first[a] != first[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-6) & ~(known[a] & known[b])
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        count = np.bincount(a, minlength=len(fps))
        rank = np.arange(len(a)) - (np.cumsum(count) - count)[a]
        low, high = 0, ASKED
        while low <= rank.max():
            now = np.flatnonzero((rank >= low) & (rank < high) & ~(known[a] & known[b]))
            for at in range(0, len(now), 8192):
                s, t = a[now[at:at + 8192]], b[now[at:at + 8192]]
                new = ~(known[s] & known[t])
                s, t = s[new], t[new]
                near = likely(sketches[s], sketches[t], n[s], n[t], similarity)
                known[s[near]] = known[t[near]] = True
            low, high = high, 8 * high
    return rows.loc[known, ["ring", "shard", "cell", "fp", "first", "home", "ask", "n", "whole"]]


def alike(rows: pd.DataFrame, radius: int, similarity: float) -> pd.DataFrame:
    """Links (a, b) of ``first`` that span the pairs of a group whose sets of shingles have at least that Jaccard similarity.

    At most one link per row.  A document is compared with those that it is not linked to yet, all of them at once: its
    shingles are marked, and the marks that each of the others hits are counted.
    """
    rows = rows.sort_values("first", kind="stable")
    fps, first = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["first"].to_numpy(np.int64)
    n = np.array([len(h) // 8 for h in rows["hashes"]], np.int64)
    starts = np.cumsum(n) - n
    codes = np.unique(np.frombuffer(b"".join(rows["hashes"]), np.uint64), return_inverse=True)[1]
    marks, labels = np.zeros(len(codes) + 1, bool), np.arange(len(fps))
    for a, b in links_within(fps, rows["home"].to_numpy(bool), radius, rows["ask"].to_numpy(bool)):
        fit = (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-6) & (n[b] > 0)
        a, b = a[fit], b[fit]
        edges = np.flatnonzero(np.diff(a, prepend=-1, append=-1)) if len(a) else np.zeros(0, np.int64)
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            one, others = a[x], b[x:y]
            others = others[labels[others] != labels[one]]
            if not len(others):
                continue
            own = codes[starts[one]:starts[one] + n[one]]
            marks[own] = True
            at = np.cumsum(n[others]) - n[others]
            hit = marks[codes[np.repeat(starts[others] - at, n[others]) + np.arange(n[others].sum())]]
            marks[own] = False
            common = np.add.reduceat(hit, at, dtype=np.int64)
            near = others[common / (n[one] + n[others] - common) >= similarity]
            labels = merge_labels(labels, np.full(len(near), one), near)
    linked = labels != np.arange(len(fps))
    return pd.DataFrame({"a": first[linked], "b": first[labels[linked]]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
                    similarity: float | None = None, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Documents link when their fingerprints differ in at most ``radius`` bits and, with ``similarity``, when their shingle
    sets also have at least that Jaccard similarity.  The numbers of distinct shingles of two such documents differ by a bounded factor,
    so the trees are first cut into rings of like size, and a document visits its own ring and the one below.

    Equal fingerprints (and sets) are merged first, so a group of copies is one entry however large it is.  Without
    ``similarity`` shards return spanning links, at most one per visiting fingerprint, never pairs.  With it they first name
    the documents that may have a similar one there; only these meet again, in blocks of bounded size, with their sets, and
    each block returns spanning links, never pairs.  Ids name documents: rows that repeat an id share
    its component.  A row with a null id keeps its fingerprint, links nothing and has a null component_id.  An empty
    table gives no rows; other columns are not read.
    """
    key = ["fp", "n", "whole"] if similarity else ["fp"]
    prints = stage(fingerprints(docs, id_col, text_col, shingle, bool(similarity)).withColumn(
        "ring", F.floor(F.log(F.greatest("n", F.lit(1))) / -math.log(similarity) + 1e-9).cast("int") if similarity else F.lit(0)), "prints")
    distinct = stage(prints.where("id IS NOT NULL").groupBy("ring", *key).agg(
        F.min("id").cast("long").alias("first"), *([F.first("sketch").alias("sketch")] if similarity else [])), "distinct")
    sizes = distinct.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    depth = int(np.ceil(np.log2(max(1.0, (sizes[0] or 0) / shard_rows))))
    part = min(1.0, max(sample_rows, 64 << depth) / max(1, sizes[1] or 0))
    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1_000_000).cast("long")) < math.ceil(part * 1_000_000)).select("fp") if depth else None
    tree = build_tree(sample.toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64), depth)
    columns = {"n": "long", "whole": "binary", "sketch": "binary"} if similarity else {}

    def places(rows: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(ring, shard, positions, whether each one lives there)"""
        ring, fps = rows["ring"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64)
        for below in range(2 if similarity else 1):
            for shard, at, home in visits(tree, fps, radius, below == 0):
                for r in np.unique(ring[at]).tolist():
                    of = ring[at] == r
                    yield r - below, shard, at[of], home[of]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame([(r, shard, int(home.sum()), len(at)) for r, shard, at, home in places(rows)], columns=["ring", "shard", "homes", "asks"])

    many = distinct.select("ring", "fp").mapInPandas(count, "ring int, shard int, homes long, asks long").groupBy("ring", "shard").agg(
        F.sum("homes").alias("homes"), F.sum("asks").alias("asks")).where(F.greatest("homes", "asks") > shard_rows).collect()
    cut = {(r["ring"], r["shard"]): (max(1, -(-r["homes"] // shard_rows)), max(1, -(-r["asks"] // shard_rows))) for r in many}

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            fps, first, ask = rows["fp"].to_numpy(np.int64), rows["first"].to_numpy(np.int64), rows["ask"].to_numpy(bool)
            salt = (fps ^ first).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            for r, shard, at, home in places(rows):
                for cell, some, here, there in cells(home, ask[at], salt[at], *cut.get((r, shard), (1, 1))):
                    to = at[some]
                    yield pd.DataFrame({
                        "ring": np.full(len(to), r, np.int32), "shard": np.full(len(to), shard, np.int32), "cell": np.full(len(to), cell, np.int32), "fp": fps[to],
                        "first": first[to], "home": here, "ask": there, **{c: rows[c].to_numpy()[to] for c in columns}})

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first", kind="stable")
        fps, first = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["first"].to_numpy(np.int64)
        labels = np.arange(len(fps))
        for a, b in links_within(fps, rows["home"].to_numpy(bool), radius, rows["ask"].to_numpy(bool)):
            for at in range(0, len(a), 8192):
                labels = merge_labels(labels, a[at:at + 8192], b[at:at + 8192])
        linked = labels != np.arange(len(fps))
        return pd.DataFrame({"a": first[linked], "b": first[labels[linked]]})

    form = "ring int, shard int, cell int, fp long, first long, home boolean, ask boolean" + "".join(f", {c} {t}" for c, t in columns.items())
    asking = distinct.withColumn("ask", F.lit(True))
    place = ["ring", "shard", "cell"]
    if similarity:
        kept = form.removesuffix(", sketch binary")
        near = stage(asking.mapInPandas(deal, form).groupBy(*place).applyInPandas(
            lambda rows: possible(rows, radius, similarity), kept), "possible")
        large = near.groupBy(*place).agg(*[F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("home", "ask")]).where(
            F.greatest("home", "ask") > SET_HASHES).collect()
        blocks = {tuple(r[c] for c in place): tuple(max(1, -(-r[c] // SET_HASHES)) for c in ("home", "ask")) for r in large}

        def cut_by_size(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in parts:
                salt = (rows["fp"].to_numpy(np.int64) ^ rows["first"].to_numpy(np.int64)).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)
                for group, at in rows.groupby(place, sort=False).indices.items():
                    mine = rows.iloc[at]
                    for block, some, here, there in cells(mine["home"].to_numpy(bool), mine["ask"].to_numpy(bool), salt[at], *blocks.get(tuple(map(int, group)), (1, 1))):
                        yield mine.iloc[some].assign(home=here, ask=there, block=np.int32(block))

        named = stage(near.select(F.col("first").alias(id_col)).distinct(), "named")
        texts = docs.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull()).join(named, id_col, "left_semi")
        # Grouped by the keys of the join, so the sets are dealt once for both.
        sets = shingle_sets(texts, id_col, text_col, shingle).groupBy(F.col("id").alias("first"), "whole").agg(F.any_value("hashes").alias("hashes"))
        links = stage(near.mapInPandas(cut_by_size, f"{kept}, block int").join(sets, ["first", "whole"]).groupBy(*place, "block").applyInPandas(
            lambda rows: alike(rows, radius, similarity), "a long, b long"), "alike")
        for table in (near, named):
            drop_stage(table)
    else:
        links = asking.mapInPandas(deal, form).groupBy(*place).applyInPandas(match, "a long, b long")
    parts = connected_components(links).select(F.col("node").alias("first"), F.col("component_id").alias("part"))
    classes = stage(distinct.join(parts, "first", "left").select(*key, F.coalesce("part", "first").alias("component_id")), "classes")
    drop_stage(distinct)
    return prints.join(classes, key, "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
