"""Score, level and action expressions (columns in, columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where the divisor is 0 or missing."""
    return F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0))


def income_per_person(income: Column, size: Column) -> Column:
    return F.round(income / F.greatest(size, F.lit(1)), 2)


def dependency_ratio(size: Column, children: Column, elderly: Column) -> Column:
    adults = F.greatest(size - children - elderly, F.lit(1))
    return F.round((children + elderly) / adults, 3)


def network_risk(phones: Column, accounts: Column) -> Column:
    raw = F.least(phones, F.lit(5)) * 0.4 + F.least(accounts, F.lit(5)) * 0.6
    return F.round(F.least(raw, F.lit(1.0)), 4)


def heuristic_rule_score() -> Column:
    """Six thresholds; the weights are fixed values."""
    parts = [
        (F.col("shared_account_count") >= 2, 0.30),
        (F.col("shared_phone_count") >= 2, 0.25),
        (F.col("payment_gap_ratio") > 0.5, 0.20),
        (F.col("nb_programs").cast("long") > 3, 0.15),
        (F.col("has_disabled").cast("int") == 1, 0.05),
        (F.col("income_program_inconsistency").cast("int") == 1, 0.05),
    ]
    return clamp(sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.0)))


def heuristic_graph_score() -> Column:
    return clamp(F.tanh(F.col("shared_phone_count") / 3.0) * 0.5 + F.tanh(F.col("shared_account_count") / 3.0) * 0.5)


def service_blend(ml: Column, rule: Column, graph: Column) -> Column:
    return clamp(0.70 * ml + 0.20 * rule + 0.10 * graph)


def staged_blend(rule: Column, ml: Column, anomaly: Column, graph: Column) -> Column:
    return F.round(0.20 * rule + 0.50 * ml + 0.10 * anomaly + 0.20 * graph, 3)


def _steps(score: Column, steps, rest) -> Column:
    out = None
    for limit, label in steps:
        out = F.when(score >= limit, label) if out is None else out.when(score >= limit, label)
    return out.otherwise(rest)


def rule_level(score: Column) -> Column:
    return _steps(score, [(0.80, "CRITICAL"), (0.55, "HIGH"), (0.30, "MEDIUM")], "LOW")


def staged_level(score: Column) -> Column:
    return _steps(score, [(0.80, "CRITICAL"), (0.60, "HIGH"), (0.40, "MEDIUM")], "LOW")


def service_level(final: Column, prediction: Column, rule: Column, graph: Column) -> Column:
    critical = (final >= 0.90) & (prediction == 1) & (F.greatest(rule, graph) >= 0.35)
    return F.when(critical, "CRITICAL").when(final >= 0.75, "HIGH").when(final >= 0.45, "MEDIUM").otherwise("LOW")


def service_action(level: Column) -> Column:
    return (
        F.when(level == "CRITICAL", "Escalate for manual review")
        .when(level == "HIGH", "Review beneficiary case with priority")
        .when(level == "MEDIUM", "Review beneficiary case")
        .otherwise("No immediate action")
    )


def staged_action(level: Column) -> Column:
    return (
        F.when(level == "CRITICAL", "Block / suspend pending investigation")
        .when(level == "HIGH", "Escalate for manual review")
        .when(level == "MEDIUM", "Review beneficiary case")
        .otherwise("No immediate action")
    )


def explanation(model: str, ml: Column, rule: Column, graph: Column, final: Column) -> Column:
    text = f"Model {model} — ml_score=%.3f, rule_score=%.3f, graph_score=%.3f, final_score=%.3f."
    return F.format_string(text, ml, rule, graph, final)


def top_factors(features: list[str], n: int = 3) -> Column:
    """The n features with the largest absolute value, first-listed first on ties."""
    def entry(i: int, f: str) -> Column:
        v = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        return F.struct((-F.abs(v)).alias("size"), F.lit(i).alias("place"), F.lit(f).alias("feature"),
                        F.round(v, 3).alias("impact"), (v > 0).alias("up"))

    ranked = F.array_sort(F.array(*[entry(i, f) for i, f in enumerate(features)]))
    return F.transform(F.slice(ranked, 1, n), lambda x: F.struct(
        x.feature.alias("feature"), x.impact.alias("impact"), F.when(x.up, "+").otherwise("-").alias("direction")))
