"""Building blocks that keep one hot key from becoming one slow task.

Ordered work (positions, running sums, exact quantiles) is done inside range
partitions and stitched together with one small carry row per partition, so a
key that holds a third of all rows is spread over a third of the partitions.
Lists are always bounded: a long group becomes numbered chunks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is made for local masters only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="benefica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_staged: list[str] = []


def staging_path(spark: SparkSession, label: str = "stage") -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete what this process staged; call it when no result that reads it is needed any more."""
    sc = spark.sparkContext
    n = len(_staged)
    while _staged:
        path = sc._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is dealt by key on both sides, never sent whole to every executor.

    Spark judges a table by the compressed size of its files, which says little about its rows in memory.
    """
    return df.hint("merge")


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to an aggregate of their own keys, one row per key, so that a hot key can be split.

    Spark splits a skewed key only if both sides of a join are plain shuffles; an
    aggregate is not, so it is written first.  Rows with a NULL key have no group
    and take no part in the join.  ``how`` is inner, left or left_semi.
    """
    filled = F.lit(True)
    for k in keys:
        filled = filled & F.col(k).isNotNull()
    out = rows.where(filled).join(dealt(stage(groups.where(filled), "groups")), list(keys), how)
    return out.unionByName(rows.where(~filled), allowMissingColumns=True) if how == "left" else out


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    position: str | None = "position",
    kept: Sequence[str] | None = None,
) -> DataFrame:
    """Add the 1-based position, running sums and earlier maxima per key, in ``order``.

    ``sums`` maps a new column to the column it adds up, the row included;
    ``maxes`` maps a new column to the column whose largest value among the
    earlier rows it holds.  ``order`` must be a total order.  The rows are
    range-partitioned on (keys, order) and every partition adds what the
    partitions before it hold for the one key that reaches across the edge, so
    neither a hot key nor a table without keys becomes one task.  ``kept`` names
    the columns that go on (all by default); the others only order the rows and
    are not written.
    """
    kept = list(df.columns if kept is None else kept)
    sums, maxes, keys = dict(sums or {}), dict(maxes or {}), list(keys)
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    slotted = stage(
        df.repartitionByRange(*by).sortWithinPartitions(*by).select(*kept, F.monotonically_increasing_id().alias("_slot")),
        "ordered",
    ).withColumn("_part", F.shiftrightunsigned("_slot", 33))

    carried = {"_rows": F.count(F.lit(1))}
    carried |= {f"_{n}": F.sum(o) for n, o in sums.items()} | {f"_{n}": F.max(o) for n, o in maxes.items()}
    totals = slotted.groupBy("_part", *keys).agg(*[c.alias(n) for n, c in carried.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one key per partition began in an earlier partition, so the carry
    # table never has more rows than there are partitions.
    carry = totals.select(
        F.col("_part").alias("_c_part"),
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        *[(F.max(n) if n[1:] in maxes else F.sum(n)).over(before).alias(f"_c{n}") for n in carried],
    ).where("_c_rows IS NOT NULL")
    same = F.col("_part") == F.col("_c_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    w = Window.partitionBy("_part", *keys).orderBy("_slot")
    out = slotted.withColumns(_over(w, F.row_number().over(w).cast("long"), sums, maxes, position))
    out = out.join(F.broadcast(carry), same, "left")
    stitched = {position: F.col(position) + F.coalesce("_c_rows", F.lit(0))} if position else {}
    for new in sums:
        here, carry_in = F.col(new), F.col(f"_c_{new}")
        stitched[new] = F.when(here.isNull(), carry_in).when(carry_in.isNull(), here).otherwise(here + carry_in)
    for new in maxes:
        stitched[new] = F.greatest(new, f"_c_{new}")
    return out.withColumns(stitched).select(*kept, *stitched)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Add ``name``, the ``value`` of the row before per key in ``order``, NULL for a key's first row.

    Ordered range partitions as in :func:`running`: each takes from the ones before it the last row of the one key that
    crosses its edge, so a hot key is spread over many partitions.  ``order`` must be a total order.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    slotted = stage(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_slot", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftrightunsigned("_slot", 33))
    held = F.struct(F.col(value).alias("v"))
    lasts = slotted.groupBy("_part", *keys).agg(F.max_by(held, "_slot").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part")
    carry = lasts.select(
        F.col("_part").alias("_c_part"), *[F.col(k).alias(f"_c_{k}") for k in keys], F.lag("_last").over(before).alias("_c_last"),
    ).where("_c_last IS NOT NULL")  # one key per partition at most began in an earlier one
    same = F.col("_part") == F.col("_c_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    here = F.lag(held).over(Window.partitionBy("_part", *keys).orderBy("_slot"))
    out = slotted.withColumn("_here", here).join(F.broadcast(carry), same, "left")
    return out.select(*df.columns, F.coalesce("_here", "_c_last")["v"].alias(name))


def _over(w, place: Column, sums, maxes, position) -> dict[str, Column]:
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = {position: place} if position else {}
    out |= {new: F.sum(old).over(upto) for new, old in sums.items()}
    return out | {new: F.max(old).over(before) for new, old in maxes.items()}


def chunked_lists(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order: Sequence[Column] | None = None,
    size: int = 1000,
    name: str = "members",
) -> DataFrame:
    """Whole groups as numbered lists of at most ``size`` values: (keys, chunk, n, list)."""
    order = list(order or [F.col(value)])
    placed = running(df, keys, order, position="_position")
    pairs = F.collect_list(F.struct("_position", value))
    if "map<" in df.schema[value].dataType.simpleString():  # maps have no order of their own
        pairs = F.array_sort(pairs, lambda a, b: (a["_position"] - b["_position"]).cast("int"))
    else:
        pairs = F.array_sort(pairs)
    return (
        placed.withColumn("chunk", F.floor((F.col("_position") - 1) / size).cast("long"))
        .groupBy(*keys, "chunk")
        .agg(pairs.alias("_pairs"))
        .select(*keys, "chunk", F.size("_pairs").cast("long").alias("n"), F.col(f"_pairs.{value}").alias(name))
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key, without gathering the values.

    Equal values are merged map-side first; the distinct values are then ordered
    with :func:`running` and the two neighbours of every wanted rank picked out.
    """
    keys = list(keys)
    counts = stage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    placed = running(counts, keys, [F.col(value)], sums={"_upto": "_n"}, position=None)
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
        placed = placed.join(totals, keys)
    else:
        placed = placed.withColumn("_total", F.lit(counts.agg(F.sum("_n")).first()[0] or 0).cast("long"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col(value)))

    parts = []
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("_total") - 1)
        parts += [at(F.floor(rank)).alias(f"_lo_{name}"), at(F.ceil(rank)).alias(f"_hi_{name}"),
                  F.max(rank - F.floor(rank)).alias(f"_fr_{name}")]
    picked = placed.groupBy(*keys).agg(*parts)
    return picked.select(
        *keys,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n) for n in probs],
    )
