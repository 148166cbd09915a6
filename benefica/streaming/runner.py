"""Running streams to the end of what has arrived, with Spark's state store and repeatable logs of changed rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def keep_state(spark: SparkSession) -> None:
    """State per key lives on disk, and its checkpoints hold what a batch changed; settings of the session stay as they are."""
    for name, value in STATE_STORE.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def read_files(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A directory as a stream; the checkpoint of the query remembers which files were read."""
    reader = spark.readStream.format(form).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand every micro-batch of what is available to ``handle`` and stop."""
    keep_state(stream.sparkSession)
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def run_append(stream: DataFrame, checkpoint: str, path: str, form: str = "parquet") -> None:
    """Append what is available to a file sink (exactly once per checkpoint) and stop."""
    keep_state(stream.sparkSession)
    stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()


def run_log(stream: DataFrame, checkpoint: str, path: str, mode: str = "update", prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write the rows that each micro-batch changed to a folder of its own, ``path``/batch=N.

    A batch that runs again after a failure replaces its folder, so no row is there twice; what is written grows
    with the batch and not with all that was ever seen.
    """
    stream.sparkSession.createDataFrame([], (prepare(stream) if prepare else stream).schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    run_batches(stream, checkpoint, lambda batch, n: (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{path}/batch={n}"), mode)


def logged(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log with the number of the batch that wrote them."""
    return spark.read.parquet(path)


def newest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last row that a log has for each key."""
    rows = logged(spark, path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
