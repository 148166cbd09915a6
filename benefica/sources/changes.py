"""Change events: condition, transform, publish; and submissions read by cursor."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transform_records(df: DataFrame, condition: str | None, fields: Mapping[str, str],
                      extra: Mapping[str, str] | None = None, payload: str | None = None,
                      payload_schema: str | None = None) -> DataFrame:
    """Filter and reshape records with Spark SQL expressions given as text.

    The parsed payload is available to the expressions as ``data``.
    """
    if payload:
        df = df.withColumn("data", F.from_json(payload, payload_schema))
    if condition:
        df = df.where(F.expr(condition))
    return df.select(*[F.expr(e).alias(n) for n, e in fields.items()],
                     *[F.lit(v).alias(n) for n, v in (extra or {}).items()])


def published(df: DataFrame, condition: str | Column | None, key: str, topic: str) -> DataFrame:
    """(topic, key, value) rows with the record as JSON, for a message sink or a file."""
    if condition is not None:
        df = df.where(F.expr(condition) if isinstance(condition, str) else condition)
    return df.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*df.columns)).alias("value"))


def since(df: DataFrame, column: str, cursor: Column) -> DataFrame:
    """Rows at or after the cursor; a row without a time is newer than nothing and is left out."""
    return df.where(F.col(column) >= cursor)
