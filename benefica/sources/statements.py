"""Bank statements as text: reading, and the rows inside them.

A statement is one text; its transactions are found with built-in string and
array functions, so every statement is parsed where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benefica.functions.text import matched_groups
from benefica.scale import join_groups, running, stage

# Value date, indicator, amount, customer reference, bank reference.
ENTRY = r"^:61:(\d{6})(?:\d{4})?(R?[DC])[A-Z]?(\d+,\d*)[A-Z][A-Z0-9]{3}((?:(?!//).)*)(?://(.*))?$"


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (statement_id, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1).alias("statement_id"),
        F.col("value").alias("text"))


def tag(text: Column, name: str, pattern: str = r"([^\n]*)") -> Column:
    return F.trim(F.regexp_extract(text, rf"(?m)^:{name}:{pattern}", 1))


def headers(statements: DataFrame) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\r"), F.lit(""))
    return statements.select(
        "statement_id", tag(text, "25").alias("account_number"), tag(text, "20").alias("reference_number"),
        tag(text, "28C?", r"(\d+)").alias("statement_number"),
        tag(text, "28C?", r"\d+/(\d+)").alias("sequence_number"))


def transactions(statements: DataFrame) -> DataFrame:
    """One row per entry with its 1-based place in the statement, which goes on over the pages of a statement.

    A page is a text of its own; its number is the sequence number of tag 28C, 1 where there is none.
    """
    text = F.replace(F.col("text"), F.lit("\r"), F.lit(""))
    blocks = F.split(text, r"\n(?=:61:)")
    pages = stage(statements.select("statement_id", F.coalesce(tag(text, "28C?", r"\d+/(\d+)").try_cast("int"), F.lit(1)).alias("page"),
                                    F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))).alias("blocks")).withColumn("n", F.size("blocks")), "pages")
    earlier = Window.partitionBy("statement_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.groupBy("statement_id", "page").agg(F.sum("n").alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).drop("n")
    # Pages find their start before they are taken apart, so lines are not joined.  Nothing comes before a page with
    # the smallest number of all, so only later pages are joined to their start.
    lowest = pages.agg(F.coalesce(F.min("page"), F.lit(1)).alias("m")).first().m
    later = F.col("page") > lowest
    begun = pages.where(~later).select("statement_id", "page", "blocks", F.lit(0).cast("long").alias("start"))
    placed = begun.unionByName(join_groups(pages.where(later).drop("n"), starts.where(later), ["statement_id", "page"]))
    entries = placed.where("statement_id IS NOT NULL").select("statement_id", "start", F.posexplode("blocks").alias("pos", "block")).withColumn(
        "place", F.col("pos") + F.col("start"))
    fields = matched_groups(F.substring_index("block", "\n", 1), ENTRY, 5)
    narrative = F.get(F.split("block", "\n:86:", 2), F.lit(1))
    part = lambda i: F.get("f", F.lit(i))
    return entries.select("statement_id", "place", fields.alias("f"), narrative.alias("n")).select(
        "statement_id", (F.col("place") + 1).cast("long").alias("entry_sequence"),
        F.to_date(F.concat(F.lit("20"), part(0)), "yyyyMMdd").alias("value_date"),
        part(1).alias("indicator"), F.replace(part(2), F.lit(","), F.lit(".")).try_cast("double").alias("amount"),
        F.trim(part(3)).alias("reconciliation_id"), F.coalesce(part(4), F.lit("")).alias("bank_reference"),
        F.trim(F.replace(F.regexp_replace("n", r"(?s)\n(?::\d{2}[A-Z]?:|-).*$", ""), F.lit("\n"), F.lit(" ")))
        .alias("narrative"))


def account_check(headers_: DataFrame, sponsor_accounts: DataFrame) -> DataFrame:
    """Statements of unknown sponsor accounts are in error."""
    known = sponsor_accounts.select("account_number", F.lit(True).alias("_known"))
    return headers_.join(known, "account_number", "left").withColumn(
        "status", F.when(F.col("_known").isNull(), "ERROR").otherwise("PROCESSED")).withColumn(
        "error", F.when(F.col("_known").isNull(), "INVALID_ACCOUNT_NUMBER")).drop("_known")


def compose(lines: DataFrame, order: list[str], page_size: int = 1000) -> DataFrame:
    """Statement texts from lines (the reverse of parsing, for exports and tests): (statement_id, page, text).

    A long statement becomes numbered pages of ``page_size`` lines, so no text and no list grows with it.
    """
    def entry(x: Column) -> Column:
        amount = F.replace(x.amount.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
        return F.concat(F.lit(":61:"), F.date_format(x.value_date, "yyMMddMMdd"), x.indicator, amount, F.lit("NTRF"),
                        x.reconciliation_id, F.lit("//"), x.reference, F.lit("\n:86:Transfer "), x.reference)

    # The texts are built after the shuffle, where the work is spread.
    parts = ["value_date", "indicator", "amount", "reconciliation_id", "reference"]
    placed = running(lines.select("statement_id", *order, *parts), ["statement_id"], [F.col(c) for c in order], position="_place", kept=["statement_id", *parts])
    page = (F.floor((F.col("_place") - 1) / page_size) + 1).cast("int").alias("page")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", *parts))), entry), "\n")
    return placed.groupBy("statement_id", page).agg(body.alias("body")).select("statement_id", "page", F.concat(
        F.lit(":20:REF"), F.col("statement_id"), F.lit("\n:25:ACC"), F.split("statement_id", "-")[0],
        F.lit("\n:28C:"), F.split("statement_id", "-")[1], F.lit("/"), F.col("page").cast("string"), F.lit("\n:60F:C000101USD0,00\n"),
        F.col("body"), F.lit("\n:62F:C000131USD0,00\n-")).alias("text"))
