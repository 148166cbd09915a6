"""Materialised views: catalog tables that are created once and refreshed by the partitions that changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benefica.scale import stage


def create_view(rows: DataFrame, name: str, by: str, path: str) -> DataFrame:
    """Create the catalog table ``name`` from the rows, with one partition per value of ``by``."""
    others = [c for c in rows.columns if c != by]
    rows.select(*others, by).write.partitionBy(by).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def refresh_view(rows: DataFrame, name: str, by: str, changed: Sequence) -> DataFrame:
    """Write the partitions named in ``changed`` anew from ``rows``, the view's query; the others are not touched.

    A partition without rows now is dropped.  ``changed`` is a list of partition values, so it is as small as the view's partition list.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != by]
    # The query may read the view itself, so its rows are fixed before a file is replaced.
    fresh = stage(rows.where(F.col(by).isin(list(changed))).select(*others, by), "refresh")
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        fresh.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)
    filled = {r[0] for r in fresh.select(by).distinct().collect()}
    for value in set(changed) - filled:
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({by} = '{text}')")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def drop_view(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
