"""Models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.fixed import ML_FEATURES, TRAINING_DEFAULTS
from benefica.functions import scoring
from benefica.operators import learning
from benefica.operators.features import beneficiary_features
from benefica.plans.fraud import BASE, STAR, as_of
from benefica.plans.registry import query
from benefica.scale import stage

# The label comes from delivered quantities, a column that feeds no feature: 25 or more deliveries of over 25 units.  Features only know how often
# and how much was paid, so they can guess it and not read it.
LARGE, MANY = 25, 25
LABEL = f"""{BASE}, heavy AS (SELECT o_custkey AS partner_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
        HAVING count(*) FILTER (l_quantity > {LARGE}) >= {MANY}),
    labelled AS (SELECT partner_id, CAST(partner_id IN (SELECT partner_id FROM heavy) AS INT) AS is_fraud FROM base)"""


def labels(t):
    """Beneficiaries with ``MANY`` or more large deliveries; only those are read on, and counted per order before they meet their owner."""
    large = t.lineitem.where(F.col("l_quantity") > LARGE).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("large"))
    return t.orders.select("o_orderkey", "o_custkey").join(large, "o_orderkey").groupBy(F.col("o_custkey").alias("partner_id")).agg(
        F.sum("large").alias("large")).where(F.col("large") >= MANY).select("partner_id", F.lit(1).alias("is_fraud"))


def people(t):
    """Features and label of all beneficiaries of the given tables, staged."""
    df = beneficiary_features(t, as_of()).join(labels(t), "partner_id", "left").na.fill(0, ["is_fraud"])
    return stage(learning.prepare_features(df).withColumn("idx", F.col("partner_id")), "people")


def trained(t, kind, **overrides):
    df = stage(learning.stratified_split(people(t), "is_fraud", "idx"), "training")
    train, test = df.where("NOT is_test"), df.where("is_test")
    columns = ML_FEATURES
    if kind == "logistic_regression":
        fitted = learning.fit_scaler(train, columns).collect()  # one row per feature
        train, test = learning.scale(train, fitted, columns), learning.scale(test, fitted, columns)
    return learning.train(train, kind, columns, **overrides), test


def held_out(t, kind, **overrides):
    model, test = trained(t, kind, **overrides)
    return learning.score_batch(model, test).select("idx", "is_fraud", "ml_prediction", "ml_score")


def quality_sql(least: float) -> str:
    """Rows and positives of the held-out fifth, and whether scores are in range and the area is at least ``least``."""
    return f"""WITH {LABEL} SELECT CAST(sum(t) AS BIGINT) AS n, CAST(sum(t) FILTER (is_fraud = 1) AS BIGINT) AS positives,
        true AS in_range, true AS area_{round(least * 100)} FROM (SELECT is_fraud, round(count(*) * 0.2) AS t FROM labelled GROUP BY 1)"""


def quality(scored, score: str, least: float):
    scored = stage(scored, "scored")
    area = learning.auc(scored, "is_fraud", score).select((F.col("auc") >= least).alias(f"area_{round(least * 100)}"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_fraud").cast("long")).alias("positives"),
                      F.bool_and(F.col(score).between(0, 1)).alias("in_range")).join(area)


ROWS = """rows AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS gap_ratio,
    o_custkey % 50 AS network_risk_score, o_custkey AS income, CAST(o_orderstatus = 'F' AS INT) AS synthetic_label
    FROM orders)"""


def alias_rows(t):
    return t.orders.selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS gap_ratio",
        "o_custkey % 50 AS network_risk_score", "o_custkey AS income", "CAST(o_orderstatus = 'F' AS INT) AS synthetic_label")


@query("k01_prepare_features", f"""WITH {ROWS} SELECT id, synthetic_label AS is_fraud, gap_ratio AS payment_gap_ratio,
    network_risk_score AS network_risk, income, CAST({TRAINING_DEFAULTS['nb_programs']} AS DOUBLE) AS nb_programs,
    CAST({TRAINING_DEFAULTS['pmt_score']} AS DOUBLE) AS pmt_score FROM rows""")
def _(t):
    return learning.prepare_features(alias_rows(t)).select(
        "id", "is_fraud", "payment_gap_ratio", "network_risk", "income", "nb_programs", "pmt_score")


@query("k02_impute_and_scale", f"""
    WITH {ROWS}, m AS (SELECT median(gap_ratio) AS g, median(network_risk_score) AS n FROM rows),
      f AS (SELECT id, coalesce(gap_ratio, g) AS g, coalesce(network_risk_score, n) AS n FROM rows, m)
    SELECT id, round((g - (SELECT avg(g) FROM f)) / (SELECT stddev_pop(g) FROM f), 6) AS gap_ratio,
        round((n - (SELECT avg(n) FROM f)) / (SELECT stddev_pop(n) FROM f), 6) AS network_risk_score FROM f""")
def _(t):
    df, cols = alias_rows(t), ["gap_ratio", "network_risk_score"]
    fitted = learning.fit_scaler(df, cols).collect()  # one row per feature
    return learning.scale(df, fitted, cols).select("id", *[F.round(c, 6).alias(c) for c in cols])


@query("k03_stratified_split", """
    SELECT o_orderstatus, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM orders GROUP BY 1""")
def _(t):
    return learning.stratified_split(t.orders, "o_orderstatus", "o_orderkey").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query("k04_logistic_regression", quality_sql(0.7))
def _(t):
    return quality(held_out(t, "logistic_regression"), "ml_score", 0.7)


@query("k05_random_forest", quality_sql(0.75))
def _(t):
    return quality(held_out(t, "random_forest"), "ml_score", 0.75)


@query("k06_gradient_boosting", quality_sql(0.75))
def _(t):
    return quality(held_out(t, "gradient_boosting"), "ml_score", 0.75)


@query("k07_isolation_forest", f"""WITH {LABEL} SELECT count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS positives, true AS in_range,
    true AS planted_stand_out FROM labelled""")
def _(t):
    """Scores of all beneficiaries; the two with the largest ids are there once more with every feature far beyond all others."""
    df = people(t).select("idx", "is_fraud", *ML_FEATURES)
    far = df.orderBy(F.desc("idx")).limit(2).select((-F.col("idx") - 1).alias("idx"), "is_fraud", *[(F.abs(c) * 30 + 1000).alias(c) for c in ML_FEATURES])
    both = stage(df.withColumn("idx", F.col("idx").cast("long")).union(far), "planted")
    forest = learning.fit_isolation_forest(both, "idx", ML_FEATURES)
    scored = stage(learning.score_isolation(both, forest, ML_FEATURES), "isolated")
    own, score = F.col("idx") >= 0, F.col("anomaly_score")
    return scored.agg(F.count_if(own).alias("n"), F.sum(F.when(own, F.col("is_fraud"))).cast("long").alias("positives"),
                      F.bool_and(score.between(0, 1)).alias("in_range"),
                      (F.min(F.when(~own, score)) >= F.percentile(F.when(own, score), 0.99)).alias("planted_stand_out"))


def hybrid(t):
    """Features, model score, anomaly score, heuristics, blends and levels of the held-out beneficiaries."""
    model, test = trained(t, "random_forest")
    forest = learning.fit_isolation_forest(test, "idx", ML_FEATURES)
    score = learning.score_isolation(test.select("idx", *ML_FEATURES), forest, ML_FEATURES).select("idx", "anomaly_score")
    df = learning.score_batch(model, test).join(score, "idx").withColumn("rule_s", scoring.heuristic_rule_score()).withColumn(
        "graph_s", scoring.heuristic_graph_score())
    c = F.col
    df = df.withColumn("final_score", scoring.service_blend(c("ml_score"), c("rule_s"), c("graph_s"))).withColumn(
        "staged_score", scoring.staged_blend(c("rule_s"), c("ml_score"), c("anomaly_score"), c("graph_s")))
    return df.withColumn("risk_level", scoring.service_level(c("final_score"), c("ml_prediction"), c("rule_s"), c("graph_s")))


@query("k08_hybrid_model_scores", quality_sql(0.7))
def _(t):
    return quality(hybrid(t).select("is_fraud", "final_score"), "final_score", 0.7)


@query("k13_model_scan", f"""WITH {LABEL} SELECT CAST(sum(t) AS BIGINT) AS total, true AS levels_add_up, true AS blend_in_range,
    true AS alerts_score_high FROM (SELECT is_fraud, round(count(*) * 0.2) AS t FROM labelled GROUP BY 1)""")
def _(t):
    df = hybrid(t)
    level, c = F.col("risk_level"), F.col
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        (F.count_if(level.isin("CRITICAL", "HIGH", "MEDIUM", "LOW")) == F.count(F.lit(1))).alias("levels_add_up"),
        F.bool_and(c("staged_score").between(0, 1) & c("final_score").between(0, 1)).alias("blend_in_range"),
        F.coalesce(F.bool_and(F.when(level.isin("CRITICAL", "HIGH"), c("final_score") >= 0.75)), F.lit(True)).alias("alerts_score_high"))


def matrix_sql(threshold: float) -> str:
    return f"""m AS (SELECT count(*) FILTER (score >= {threshold} AND label = 1) AS tp, count(*) FILTER (score >= {threshold}
        AND label = 0) AS fp, count(*) FILTER (score < {threshold} AND label = 1) AS fn, count(*) FILTER (
        score < {threshold} AND label = 0) AS tn FROM labelled_score),
      r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END
        AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM m)
    SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1
    FROM r"""


def rounded(m):
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("k09_metrics_at_50", f"WITH {matrix_sql(0.5)}")
def _(t):
    return rounded(learning.confusion(t.labelled_score, "label", "score", 0.5))


@query("k09_metrics_at_55", f"WITH {matrix_sql(0.55)}")
def _(t):
    return rounded(learning.confusion(t.labelled_score, "label", "score", 0.55))


@query("k09_area_under_curve", """
    WITH p AS (SELECT score FROM labelled_score WHERE label = 1), n AS (SELECT score FROM labelled_score WHERE label = 0)
    SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6)
        AS auc FROM p, n""")
def _(t):
    return learning.auc(t.labelled_score, "label", "score").select(F.round("auc", 6).alias("auc"))


@query("k09_model_comparison", """
    WITH s AS (SELECT label, score, score * score AS squared, 0.5 AS flat FROM labelled_score),
      l AS (SELECT label, 'score' AS model, score FROM s UNION ALL SELECT label, 'squared', squared FROM s
            UNION ALL SELECT label, 'flat', flat FROM s),
      a AS (SELECT p.model, sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)
            AS auc FROM l p JOIN l n ON p.model = n.model WHERE p.label = 1 AND n.label = 0 GROUP BY 1)
    SELECT model, count(*) FILTER (score >= 0.55 AND label = 1) AS tp, round(any_value(auc), 6) AS auc
    FROM l JOIN a USING (model) GROUP BY 1""")
def _(t):
    df = t.labelled_score.withColumns({"squared": F.col("score") * F.col("score"), "flat": F.lit(0.5)})
    return learning.evaluation_table(df, "label", {"score": "score", "squared": "squared", "flat": "flat"}, 0.55).select(
        "model", "tp", F.round("auc", 6).alias("auc"))


ROC_SQL = """WITH c AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM labelled_score
    GROUP BY 1)
  SELECT round(score, 6) AS score, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT
    AS fp FROM c"""


@query("k10_roc_points", ROC_SQL)
def _(t):
    return learning.roc_points(t.labelled_score, "label", "score").select(F.round("score", 6).alias("score"), "tp", "fp")


@query("k10_roc_by_ranges", ROC_SQL)
def _(t):
    return learning.roc_points(t.labelled_score, "label", "score").select(
        F.round("score", 6).alias("score"), "tp", "fp")


# The first feature of the forest is the one that goes with the label most.
STRONGEST = f"""WITH {STAR}, heavy AS (SELECT o_custkey AS partner_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
        HAVING count(*) FILTER (l_quantity > {LARGE}) >= {MANY}),
    lab AS (SELECT *, CAST(partner_id IN (SELECT partner_id FROM heavy) AS INT) AS y FROM feat),
    c AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, y)) AS r FROM lab" for f in
          ("payment_count", "nb_programs", "age", "income", "payment_gap_ratio", "shared_phone_count", "avg_enrollment_days"))})
    SELECT CAST(15 AS BIGINT) AS n, true AS falling, true AS own_names, (SELECT max_by(feature, r) FROM c WHERE isfinite(r)) AS strongest"""


@query("f05_top_importances", STRONGEST)
def _(t):
    model, _ = trained(t, "random_forest")
    top = learning.importances(model, t.spark, top=15)
    return ranked(top).withColumn("strongest", F.lit(top.first()["feature"]))


@query("k11_coefficients", f"SELECT CAST({len(ML_FEATURES)} AS BIGINT) AS n, true AS falling, true AS own_names")
def _(t):
    model, _ = trained(t, "logistic_regression")
    return ranked(learning.importances(model, t.spark))


def ranked(df):
    """Whether the few rows of a model are in falling order under the model's own names."""
    rows = df.collect()
    sizes = [abs(r["importance"]) for r in rows]
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(sizes == sorted(sizes, reverse=True)).alias("falling"),
                  F.bool_and(F.col("feature").isin(ML_FEATURES)).alias("own_names"))
