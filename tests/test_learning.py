"""Generated beneficiaries, models and their quality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from benefica.fixed import ML_FEATURES
from benefica.operators import learning
from benefica.operators.features import thresholds, with_threshold_flags
from benefica.scale import stage
from tests import population


@pytest.fixture(scope="module")
def people(spark):
    n = 4000
    df = population.population(spark.range(n).withColumnRenamed("id", "idx"), n)
    df = stage(population.with_noise(df, n))
    return stage(learning.stratified_split(with_threshold_flags(df, *thresholds(df)), "is_fraud", "idx"))


def test_population_does_not_depend_on_partitions(spark):
    ids = spark.range(500).withColumnRenamed("id", "idx")
    a = population.population(ids, 500).orderBy("idx").collect()
    assert a == population.population(ids.repartition(7), 500).orderBy("idx").collect()


def test_population_shape(people):
    counts = {r.scenario: r["count"] for r in people.groupBy("scenario").count().collect()}
    assert counts["legitimate"] == 3520 and len(counts) == 10 and abs(counts["multi_enrollment"] - 480 / 9) < 1
    sizes = {r.is_fraud: (r.n, r.t) for r in people.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert sizes == {0: (3520, 704), 1: (480, 96)}
    assert people.where("nb_children < 0 OR pmt_score < 0 OR household_size < 1 OR age IS NULL").count() == 0


def test_forest_and_evaluation(people):
    model = learning.train(people.where("NOT is_test"), "random_forest", numTrees=60)
    scored = stage(learning.score_batch(model, people.where("is_test")))
    area = learning.auc(scored, "is_fraud", "ml_score").first()[0]
    assert area > 0.9
    pdf = scored.select("is_fraud", "ml_score").toPandas()
    pos, neg = pdf[pdf.is_fraud == 1].ml_score.to_numpy(), pdf[pdf.is_fraud == 0].ml_score.to_numpy()
    brute = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(area - brute) < 1e-9
    assert abs(area - learning.auc(scored, "is_fraud", "ml_score").first()[0]) < 1e-12
    m = learning.confusion(scored, "is_fraud", "ml_score", 0.5).first()
    assert m.tp + m.fp + m.fn + m.tn == len(pdf) and m.accuracy > 0.9
    assert learning.confusion(scored, "is_fraud", "ml_score", 2.0).first().precision == 0
    top = learning.importances(model, people.sparkSession, top=15).collect()
    assert len(top) == 15 and top[0].importance >= top[-1].importance


def test_logistic_regression(people):
    train, test = people.where("NOT is_test"), people.where("is_test")
    fitted = learning.fit_scaler(train, ML_FEATURES).collect()
    model = learning.train(learning.scale(train, fitted, ML_FEATURES), "logistic_regression")
    scored = learning.score_batch(model, learning.scale(test, fitted, ML_FEATURES))
    assert learning.auc(scored, "is_fraud", "ml_score").first()[0] > 0.9


def test_boosting_is_wired(people):
    model = learning.train(people.where("NOT is_test"), "gradient_boosting", maxIter=5)
    assert learning.auc(learning.score_batch(model, people.where("is_test")), "is_fraud", "ml_score").first()[0] > 0.8


def test_isolation_forest_finds_far_points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(1500)] + [(2000 + i, 9.0, -9.0, 9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    forest = learning.fit_isolation_forest(df, "id", ["a", "b", "c"], trees=50)
    assert len({r["tree"] for r in forest}) == 50 and len(forest) <= 50 * 2 * 256
    scored = learning.score_isolation(df, forest, ["a", "b", "c"])
    r = scored.agg(F.min(F.when(F.col("id") >= 2000, F.col("anomaly_score"))).alias("far"),
                   F.avg(F.when(F.col("id") < 2000, F.col("anomaly_score"))).alias("near"),
                   F.avg(F.when(F.col("id") < 2000, (F.col("anomaly_score") >= 1).cast("int"))).alias("full")).first()
    # The score is full from an isolation value of 0.5 on: far points reach it, most others do not.
    assert r.far == 1.0 and r.near < 0.9 and r.full < 0.2


def test_no_column_of_the_label_feeds_a_feature():
    from benefica.plans import learning as plans
    from benefica.tables import DERIVED

    read = ("registrant", "program_membership", "entitlement", "payment", "phone_number", "bank_account", "group_membership")
    assert "l_quantity" in plans.LABEL and not any("l_quantity" in DERIVED[name] for name in read)
    heavy = plans.LABEL[plans.LABEL.index("heavy AS"):plans.LABEL.index("labelled AS")]
    assert not any(c in heavy for c in ("l_extendedprice", "l_returnflag", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"))


def test_labels_count_large_deliveries_before_they_meet_their_owner(spark):
    from types import SimpleNamespace

    from benefica.plans import learning as plans

    rows = [(o, q) for o, n in ((1, 20), (2, 5), (3, 24), (4, 30)) for q in [26.0] * n + [25.0, 1.0, None] * 9]
    t = SimpleNamespace(lineitem=spark.createDataFrame(rows, "l_orderkey long, l_quantity double"),
                        orders=spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9), (5, 6)], "o_orderkey long, o_custkey long"))
    found = plans.labels(t)
    assert {tuple(r) for r in found.collect()} == {(7, 1), (9, 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" in plan and "Aggregate" in plan[plan.index("Join "):]
