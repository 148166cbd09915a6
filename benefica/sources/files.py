"""Scans and sinks: databases, delimited files, submissions, saved tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benefica.functions import scoring
from benefica.scale import running


def scan_database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int,
                  properties: Mapping[str, str] | None = None) -> DataFrame:
    """Partitioned read of a database table; filters and column choices on the result are sent to the database."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions,
                           properties=dict(properties or {}))


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Delimited file with a header and a given schema; fields that do not fit become NULL."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=False)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def save_alerts(scored: DataFrame, path: str) -> None:
    """Append one pending alert per scored beneficiary."""
    alert_rows(scored).write.mode("append").parquet(path)


def alert_rows(scored: DataFrame, *also: str) -> DataFrame:
    return scored.select(
        "beneficiary_id", F.col("final_score").alias("risk_score"), "risk_level",
        scoring.service_action(F.col("risk_level")).alias("action"),
        F.array_join("rule_flags", ", ").alias("rule_flags"), F.coalesce("explanation", F.lit("")).alias("explanation"),
        F.lit("pending").alias("status"), *also)


def batch_file_rows(payments: DataFrame, payer_type: str, payer: str, mode: str, currency: str) -> DataFrame:
    """Rows of the payment files, numbered from 0 inside each batch."""
    placed = running(payments, ["batch"], [F.col("entitlement_id")], position="_place")
    note = F.concat(F.lit("Program: "), F.split("batch", "/")[0], F.lit(". Cycle ID - "), F.col("cycle_id").cast("string"))
    return placed.select(
        "batch", (F.col("_place") - 1).alias("id"), F.col("entitlement_id").cast("string").alias("request_id"),
        F.lit(mode).alias("payment_mode"), F.lit(payer_type).alias("payer_identifier_type"),
        F.lit(payer).alias("payer_identifier"), F.lit("ACCOUNT").alias("payee_identifier_type"),
        F.col("account_number").alias("payee_identifier"), F.col("amount_issued").alias("amount"),
        F.lit(currency).alias("currency"), note.alias("note"))


def write_batch_files(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    """One folder per batch."""
    rows.write.partitionBy("batch").option("header", True).option("sep", delimiter).csv(path)


def scan_submissions(spark: SparkSession, path: str, schema: str, time_column: str, cursor: Column | None = None) -> DataFrame:
    """Form submissions from landed JSON files, from the cursor on; rows without a time come last."""
    df = spark.read.schema(schema).json(path)
    if cursor is not None:
        df = df.where(F.col(time_column) >= cursor)
    return df.orderBy(F.asc_nulls_last(time_column))


def refresh_table(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a materialised result and return it."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def import_nested(records: DataFrame, cursor: Column, id_field: str = "id") -> tuple[DataFrame, DataFrame]:
    """Parents to create or update after the cursor, and their child rows with the parent's action."""
    from benefica.operators.records import sync_split

    kept = sync_split(records, cursor).where("sync_action <> 'skip'")
    children = kept.select(id_field, "sync_action", F.inline("children"))
    return kept.drop("children"), children


def limited(df: DataFrame, limit: int | None, order: Sequence[str] = ()) -> DataFrame:
    """The optional row limit of a scan (the feature itself, not a guard)."""
    if limit is None:
        return df
    return (df.orderBy(*order) if order else df).limit(limit)
