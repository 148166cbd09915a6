"""Near-equal vectors by cosine: tiles ordered by principal axes, cut short by suffix norms.

Unit vectors are rotated to the principal axes of all vectors, which keeps cosines and moves most of the length into
the leading coordinates.  A tile adds up the leading coordinates first; what the others can still add is at most the
product of the two suffix norms, so rows and columns that cannot reach the threshold are dropped before the next
stretch.  Surviving pairs are decided by the cosine of the given vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import connected_components, merge_labels, stage

BLOCK_ROWS = 16384
TILE = 1024
LEAD = 4  # leading coordinates in the boxes of blocks
SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64).reshape(len(col), -1)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the axes by falling weight; d x d sums are all that reaches the driver."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for rows in parts:
            for d, some in rows.groupby("dim"):
                unit = _unit(_matrix(some["vector"]))
                total[d] = total.get(d, 0) + unit.T @ unit
        for d, m in total.items():
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"dim": np.full(len(i), d, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": m[i, j]})

    found = vectors.select("dim", "vector").mapInPandas(sums, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    axes = {}
    for d, some in found.toPandas().groupby("dim"):
        m = np.zeros((d, d))
        m[some["i"], some["j"]] = m[some["j"], some["i"]] = some["v"]
        axes[int(d)] = np.linalg.eigh(m)[1][:, ::-1]
    return axes


def tile_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of rotated unit vectors whose product may reach the threshold."""
    d = a.shape[1]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total, at = np.zeros((len(a), len(b))), 0
    for to in dict.fromkeys([min(8, d), min(24, d), d]):
        total += a[rows, at:to] @ b[cols, at:to].T
        rest = np.sqrt((a[rows, to:] ** 2).sum(axis=1))[:, None] * np.sqrt((b[cols, to:] ** 2).sum(axis=1))[None, :]
        hope = total + rest >= threshold - SLACK
        keep_r, keep_c = hope.any(axis=1), hope.any(axis=0)
        if not keep_r.any():
            return rows[:0], cols[:0]
        rows, cols, total, hope = rows[keep_r], cols[keep_c], total[np.ix_(keep_r, keep_c)], hope[np.ix_(keep_r, keep_c)]
        at = to
    i, j = np.nonzero(hope)
    return rows[i], cols[j]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept; vectors link when labels and lengths are equal and cosine >= threshold.

    Equal vectors of a label are merged and compared once.  A label's vectors are cut into blocks along its first axis;
    two blocks meet only if the boxes of their leading coordinates are near enough.  Blocks return link counts and
    spanning links, never pairs.  Vectors that are null, empty, zero, or hold null or non-finite components, rows with
    a null label and rows with a null id link with nothing (n_links 0, component_id the own id).  Ids name vectors:
    rows that repeat an id share its component.  An empty table gives no rows; other columns are not read.
    """
    value = F.col(vector_col).cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(value, lambda x: x != 0)
    sound = value.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(value) > 0) & ~bad
    rows = stage(vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), value.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound")), "vectors")
    usable = rows.where("sound").withColumn("dim", F.size("vector"))
    classes = stage(usable.groupBy("label", "dim", "vector").agg(
        F.min("id").cast("long").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    axes = principal_axes(classes)

    def lead(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in parts:
            out = np.zeros((len(some), LEAD))
            for d, at in some.groupby("dim").indices.items():
                c = _unit(_matrix(some["vector"].iloc[at])) @ axes[int(d)][:, :LEAD]
                out[at, : c.shape[1]] = c
            some["lead"] = list(out)
            yield some

    placed = stage(classes.mapInPandas(lead, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in classes.schema)}, lead array<double>"), "lead")
    cuts = stage(placed.groupBy("label", "dim").agg(
        F.count(F.lit(1)).alias("rows"),
        F.percentile_approx(F.col("lead")[1], [i / 256 for i in range(1, 256)], 2000).alias("cuts")), "cuts")
    u = F.pmod(F.xxhash64("first"), F.lit(1024).cast("long")) / 1024
    slot = (F.size(F.filter("cuts", lambda c: c < F.col("lead")[1])) + u) / 256
    blocks = stage(placed.join(cuts, ["label", "dim"]).select(
        "label", "dim", "first", "n", "vector", "lead",
        F.floor(slot * F.ceil(F.col("rows") / block_rows)).cast("int").alias("block")), "blocks")

    box = [F.struct(F.min(F.col("lead")[k]).alias("lo"), F.max(F.col("lead")[k]).alias("hi")).alias(f"x{k}") for k in range(LEAD)]
    boxes = stage(blocks.groupBy("label", "dim", "block").agg(*box), "boxes")
    other = boxes.select("label", "dim", F.col("block").alias("block_b"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(LEAD)])
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"x{k}.lo") - F.col(f"y{k}.hi"), F.col(f"y{k}.lo") - F.col(f"x{k}.hi")), 2) for k in range(LEAD))
    meet = stage(
        boxes.join(other, ["label", "dim"]).where((F.col("block") <= F.col("block_b")) & (gap <= 2 - 2 * threshold + SLACK))
        .select("label", "dim", F.col("block").alias("block_a"), "block_b").withColumn("pair", F.monotonically_increasing_id()), "meet")
    side = lambda s: meet.select("label", "dim", F.col(f"block_{s}").alias("block"), "pair",
                                 F.lit(s).alias("side"), (F.col("block_a") == F.col("block_b")).alias("own"))
    visits = side("a").unionByName(side("b").where("NOT own"))

    def compare(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("first", kind="stable")
        own, first, n = bool(some["own"].iloc[0]), some["first"].to_numpy(np.int64), some["n"].to_numpy(np.int64)
        given = _matrix(some["vector"])
        scaled = given / np.abs(given).max(axis=1, keepdims=True)
        length = np.sqrt((scaled * scaled).sum(axis=1))
        turned = _unit(given) @ axes[given.shape[1]]
        mine = np.flatnonzero(some["side"].to_numpy() == "a")
        theirs = mine if own else np.flatnonzero(some["side"].to_numpy() == "b")
        links, labels = np.zeros(len(some), np.int64), np.arange(len(some))
        for i in range(0, len(mine), TILE):
            for j in range(i if own else 0, len(theirs), TILE):
                ra, rb = mine[i:i + TILE], theirs[j:j + TILE]
                p, q = tile_pairs(turned[ra], turned[rb], threshold)
                a, b = ra[p], rb[q]
                if own and i == j:
                    a, b = a[a < b], b[a < b]
                for at in range(0, len(a), 65536):
                    s, t = a[at:at + 65536], b[at:at + 65536]
                    hit = np.einsum("ij,ij->i", scaled[s], scaled[t]) / (length[s] * length[t]) >= threshold
                    s, t = s[hit], t[hit]
                    np.add.at(links, s, n[t])
                    np.add.at(links, t, n[s])
                    labels = merge_labels(labels, s, t)
        seen = links > 0
        return pd.DataFrame({"a": first[seen], "b": first[labels[seen]], "links": links[seen]})

    found = stage(
        blocks.drop("lead").join(visits, ["label", "dim", "block"])
        .groupBy("pair").applyInPandas(compare, "a long, b long, links long"), "found")
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "first")
    parts = connected_components(found.select("a", "b")).select(F.col("node").alias("first"), F.col("component_id").alias("part"))
    known = stage(classes.join(counts, "first", "left").join(parts, "first", "left").select(
        "label", "vector", "n", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("part", "first").alias("part")), "known")
    linked = usable.join(known, ["label", "vector"]).select("id", (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("part").alias("component_id"))
    lone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return linked.unionByName(lone).select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).alias("kept"))
