"""Scoring rules given as text: each condition becomes one column, all rules one projection."""

from __future__ import annotations

import ast
import json
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from benefica.fixed import RULE_DEFAULTS
from benefica.functions import scoring


def default_rules() -> list[dict]:
    text = resources.files("benefica.resources").joinpath("fraud_rules.json").read_text(encoding="utf-8")
    return [r for r in json.loads(text)["rules"] if r.get("enabled", True)]


def scan_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rule file in shared storage; rules that are switched off are left out."""
    rules = (
        spark.read.json(path, multiLine=True).select(F.posexplode("rules").alias("_place", "r")).select("_place", "r.*")
    )
    if "enabled" in rules.columns:
        rules = rules.where(F.coalesce("enabled", F.lit(True)))
    return [row.asDict() for row in rules.orderBy("_place").drop("_place").collect()]


_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0))),
    ast.Mod: lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a - b * F.floor(a / F.nullif(b, F.lit(0)))),
    ast.Pow: F.pow,
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


def condition_column(text: str, columns: list[str]) -> Column:
    """The condition as a column; a name that is not in ``columns`` counts as 0."""

    def build(n) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            return F.col(n.id) if n.id in columns else F.lit(0)
        if isinstance(n, ast.BinOp):
            return _BINARY[type(n.op)](build(n.left), build(n.right))
        if isinstance(n, ast.UnaryOp):
            if isinstance(n.op, ast.Not):
                return ~truth(n.operand)
            return -build(n.operand) if isinstance(n.op, ast.USub) else build(n.operand)
        if isinstance(n, ast.BoolOp):
            out = truth(n.values[0])
            for v in n.values[1:]:
                out = out & truth(v) if isinstance(n.op, ast.And) else out | truth(v)
            return out
        if isinstance(n, ast.Compare):
            sides = [build(x) for x in (n.left, *n.comparators)]
            out = None
            for op, a, b in zip(n.ops, sides, sides[1:]):
                step = _COMPARE[type(op)](a, b)
                out = step if out is None else out & step
            return out
        raise ValueError(f"{type(n).__name__} is not allowed in a rule")

    def truth(n) -> Column:
        c = build(n)
        return c if isinstance(n, (ast.Compare, ast.BoolOp)) or (
            isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not)) else c.cast("double") != 0

    return truth(ast.parse(text, mode="eval").body)


def usable_rules(df: DataFrame, rules: list[dict]) -> tuple[list[tuple[dict, Column]], list[dict]]:
    """Rules whose condition resolves on ``df``, and those that fail with their message."""
    good, bad = [], []
    for r in rules:
        try:
            c = condition_column(r["condition"], df.columns)
            df.select(c)  # analysis only
            good.append((r, c))
        except (SyntaxError, ValueError, KeyError, AnalysisException) as e:
            bad.append({"rule_id": r["id"], "condition": r["condition"], "error": str(e).split("\n")[0]})
    return good, bad


def with_rule_context(df: DataFrame) -> DataFrame:
    """Defaults for missing values and back-filling between the two names of a feature."""
    have = set(df.columns)
    df = df.withColumns({
        k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in RULE_DEFAULTS.items()})

    def back_fill(a: str, b: str) -> Column:
        return F.when((F.col(b) == 0) & (F.col(a) != 0), F.col(a)).otherwise(F.col(b))

    for a, b in (("payment_gap_ratio", "gap_ratio"), ("network_risk_score", "network_risk")):
        df = df.withColumns({b: back_fill(a, b), a: back_fill(b, a)})
    return df


def score_rules(df: DataFrame, rules: list[dict] | None = None, id_column: str = "partner_id") -> DataFrame:
    """One row per beneficiary: capped weight sum, level, flags, explanations."""
    df = with_rule_context(df)
    checked, _ = usable_rules(df, rules if rules is not None else default_rules())
    total = sum((F.when(c, F.lit(float(r["weight"]))).otherwise(0.0) for r, c in checked), F.lit(0.0))
    score = F.round(F.least(total, F.lit(1.0)), 4)

    def listed(text) -> Column:
        if not checked:
            return F.array().cast("array<string>")
        return F.filter(F.array(*[F.when(c, F.lit(text(r))) for r, c in checked]), lambda x: x.isNotNull())

    return df.select(
        F.col(id_column).alias("beneficiary_id"),
        score.alias("rule_score"),
        listed(lambda r: r["flag"]).alias("flags"),
        listed(lambda r: f"[{r['id']}] {r['flag']} — {r['condition']} "
                         f"(poids={r['weight']}, sévérité={r['severity']})").alias("explanations"),
    ).select(
        "*", scoring.rule_level(F.col("rule_score")).alias("risk_level"),
        F.size("flags").cast("long").alias("n_rules_triggered"),
        (F.col("rule_score") < 0.80).alias("pass_to_ml"),
    )


def rule_summary(df: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per rule with the number of rows it matches; a broken rule carries its error."""
    context = with_rule_context(df)
    good, bad = usable_rules(context, rules)
    spark = df.sparkSession
    listing = spark.createDataFrame(
        [(r["id"], r["name"], r["flag"], r["severity"], float(r["weight"]), r["condition"]) for r in rules],
        "rule_id string, name string, flag string, severity string, weight double, condition string")
    if good:
        wide = context.agg(*[F.count_if(c).alias(r["id"]) for r, c in good])
        hits = wide.unpivot([], [r["id"] for r, _ in good], "rule_id", "n_matched")
    else:
        hits = spark.createDataFrame([], "rule_id string, n_matched long")
    errors = spark.createDataFrame([(b["rule_id"], b["error"]) for b in bad], "rule_id string, error string")
    return listing.join(hits, "rule_id", "left").join(errors, "rule_id", "left")
