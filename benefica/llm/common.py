"""Helpers shared by the text operators: staged tables, words, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benefica.scale import staging_path


def stage(df: DataFrame, label: str = "llm", **options) -> DataFrame:
    """Write the rows once to the shared folder and read them back; lost executors cost only their own tasks."""
    path = staging_path(df.sparkSession, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs that run inside read Parquet and hand Python at most ``n`` rows at a time, where rows are large."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(n))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def words(text: str | None) -> list[bytes]:
    """The runs of characters other than space and U+0009 to U+000D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fold the links a[i] - b[i] into ``labels``, where every entry names the smallest member seen of its set."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id): the smallest id that each node of ``edges`` reaches; nodes are not null.

    Alternating star contraction: every round hangs neighbours below the smallest one.  The smallest neighbours are
    staged before they are joined back, so both sides of the join are plain shuffles and a hub node can be split.
    Nothing but two sums per round reaches the driver.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stage(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    before = None
    while True:
        sums = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.hash("hi", "lo"))).first())
        if sums == before or not sums[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component_id")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component_id")).distinct())
        before = sums
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = stage(both.groupBy("hi").agg(F.min("lo").alias("_m")).select("hi", F.least("hi", "_m").alias("_m")), "least")
        large = stage(both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("_m").alias("lo")).distinct(), "large")
        least = stage(large.groupBy("hi").agg(F.min("lo").alias("_m")), "least")
        small = large.join(least, "hi").select(F.explode(F.array(
            F.struct("hi", F.col("_m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("_m").alias("lo")))).alias("e"))
        now = stage(small.select("e.*").where("hi <> lo").distinct(), "links")
