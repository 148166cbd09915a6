"""Registry dashboard aggregates and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.functions.dates import full_years


def _people(registrant: DataFrame) -> DataFrame:
    return registrant.where("is_registrant AND active")


def gender_counts(registrant: DataFrame, codes: Mapping[str, str]) -> DataFrame:
    """Individuals per company and gender code; values without a code share the NULL code."""
    code = F.coalesce(*[F.when(F.col("gender") == v, c) for v, c in codes.items()], F.lit(None))
    return _people(registrant).where("NOT is_group").groupBy("company_id", code.alias("gender")).agg(
        F.count(F.lit(1)).alias("n"))


# Age classes with their inclusive limits.
AGE_CLASSES = {"below_18": (None, 17), "18_to_30": (18, 30), "31_to_40": (31, 40), "41_to_50": (41, 50),
               "above_50": (51, None)}


def age_distribution(registrant: DataFrame, as_of: Column) -> DataFrame:
    """One struct of class counts per company; unknown birth dates fall in no class."""
    age = full_years(F.col("birthdate"), as_of)

    def inside(lo, hi) -> Column:
        test = F.lit(True)
        if lo is not None:
            test = test & (age >= lo)
        if hi is not None:
            test = test & (age <= hi)
        return F.count_if(test & age.isNotNull())

    return _people(registrant).where("NOT is_group").groupBy("company_id").agg(
        F.struct(*[inside(*limits).alias(n) for n, limits in AGE_CLASSES.items()]).alias("age_distribution"))


def registrant_totals(registrant: DataFrame) -> DataFrame:
    return _people(registrant).groupBy("company_id").agg(
        F.count_if(~F.col("is_group")).alias("total_individuals"), F.count_if("is_group").alias("total_groups"))


def dashboard(registrant: DataFrame, companies: DataFrame, codes: Mapping[str, str], as_of: Column) -> DataFrame:
    """Totals, gender map and age classes per company; companies without registrants get zeros."""
    spec = gender_counts(registrant, codes).where("gender IS NOT NULL").groupBy("company_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("gender", "n")))).alias("gender_spec"))
    out = companies.join(registrant_totals(registrant), "company_id", "left")
    out = out.join(spec, "company_id", "left").join(age_distribution(registrant, as_of), "company_id", "left")
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in AGE_CLASSES])
    return out.select(
        "company_id", F.coalesce("total_individuals", F.lit(0)).alias("total_individuals"),
        F.coalesce("total_groups", F.lit(0)).alias("total_groups"),
        F.coalesce("gender_spec", F.create_map().cast("map<string,bigint>")).alias("gender_spec"),
        F.coalesce("age_distribution", zero).alias("age_distribution"))


def value_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of the given values, 0 for those that do not occur, with their place in the list."""
    listed = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, place int")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, column, "left").select("place", column, F.coalesce("n", F.lit(0)).alias("n"))


def cross_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` by ``column`` with one column per listed value, 0 where empty."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def histogram(df: DataFrame, column: str, by: Sequence[str], bins: int, lo: float, hi: float) -> DataFrame:
    """Rows per equal-width bin; the upper edge belongs to the last bin."""
    b = F.least(F.width_bucket(F.col(column), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins).cast("long"))
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def missing_profile(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "n_missing")
