"""Model preparation, training, scoring and evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.fixed import ML_FEATURES, TRAINING_DEFAULTS
from benefica.scale import exact_quantiles, running, stage

# Other names of training columns.
ALIASES = {"payment_gap_ratio": "gap_ratio", "group_membership_count": "group_count", "network_risk": "network_risk_score",
           "amount_variance": "amount_variannce"}


def prepare_features(df: DataFrame, target: str = "is_fraud") -> DataFrame:
    """Target and all model features under their own names; absent ones get the training default."""
    if target not in df.columns:
        if "synthetic_label" not in df.columns:
            raise ValueError(f"no target column {target}")
        df = df.withColumn(target, F.col("synthetic_label"))
    new: dict[str, Column] = {}
    for f in ML_FEATURES:
        if f in df.columns:
            continue
        other = ALIASES.get(f)
        new[f] = F.col(other) if other in df.columns else F.lit(float(TRAINING_DEFAULTS[f]))
    return df.withColumns(new) if new else df


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median, mean, std): exact medians, then moments after imputing with them."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
    medians = exact_quantiles(long, "value", {"median": 0.5}, keys=["feature"])
    filled = long.join(F.broadcast(medians), "feature")  # one row per feature
    value = F.coalesce("value", "median")
    return filled.groupBy("feature", "median").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def scale(df: DataFrame, fitted: Sequence, columns: Sequence[str]) -> DataFrame:
    """Impute and standardise; ``fitted`` holds the collected scaler rows, one per feature."""
    by = {r["feature"]: r for r in fitted}
    return df.withColumns({
        c: (F.coalesce(F.col(c).cast("double"), F.lit(by[c]["median"])) - by[c]["mean"]) / (by[c]["std"] or 1.0)
        for c in columns})


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: exactly the rounded share of every class, drawn by hash of the key."""
    drawn = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    placed = running(drawn, [label], [F.col("_h"), F.col(key)], position="_place")
    sizes = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * share).alias("_size"))
    return placed.join(sizes, label).withColumn("is_test", F.col("_place") <= F.col("_size")).drop("_h", "_place", "_size")


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 x class size), from one aggregate row."""
    n, pos = df.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(n / (2.0 * max(pos or 0, 1))))
                         .otherwise(F.lit(n / (2.0 * max(n - (pos or 0), 1)))))


def classifier(kind: str, n: int, seed: int = 42, **overrides):
    """The three model kinds with their fixed hyper-parameters."""
    common = {"featuresCol": "features", "labelCol": "is_fraud"}
    if kind == "logistic_regression":
        return LogisticRegression(**common, weightCol="weight", **{
            "regParam": 1.0 / (0.1 * max(n, 1)), "maxIter": 800, "standardization": False, **overrides})
    if kind == "random_forest":
        return RandomForestClassifier(**common, weightCol="weight", seed=seed, **{
            "numTrees": 200, "maxDepth": 8, "minInstancesPerNode": 10, "featureSubsetStrategy": "sqrt",
            "maxMemoryInMB": 1024, **overrides})
    if kind == "gradient_boosting":
        return GBTClassifier(**common, seed=seed, **{
            "maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.9, **overrides})
    raise ValueError(kind)


def train(df: DataFrame, kind: str, columns: Sequence[str] = tuple(ML_FEATURES), **overrides) -> PipelineModel:
    """Assembler and classifier on prepared rows."""
    weighted = with_class_weights(df, "is_fraud")
    n = weighted.count() if kind == "logistic_regression" else 0
    stages = [VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep"),
              classifier(kind, n, **overrides)]
    return Pipeline(stages=stages).fit(weighted)


def score_batch(model: PipelineModel, df: DataFrame, columns: Sequence[str] = tuple(ML_FEATURES)) -> DataFrame:
    """Missing values as 0, then class and probability rounded to six places."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    out = model.transform(filled)
    return out.withColumns({
        "ml_prediction": F.col("prediction").cast("int"),
        "ml_score": F.round(vector_to_array("probability")[1], 6),
    }).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, spark, columns: Sequence[str] = tuple(ML_FEATURES), top: int | None = None) -> DataFrame:
    """(feature, importance): forest importances or linear coefficients, largest absolute value first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(columns, values.toArray())], "feature string, importance double")
    df = df.orderBy(F.desc(F.abs("importance")), "feature")
    return df.limit(top) if top else df


# --- evaluation -----------------------------------------------------------------------------------------------

def confusion(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Matrix and rates at a threshold; a rate with divisor 0 is 0."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    m = df.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
                            F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m = m.withColumns({"accuracy": rate(tp + tn, tp + fp + fn + tn), "precision": rate(tp, tp + fp),
                       "recall": rate(tp, tp + fn)})
    return m.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(
        F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp, tpr, fpr): one row per distinct score, from the highest down."""
    counts = stage(df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_pos"),
                                         F.count_if(F.col(label) != 1).alias("_neg")), "counts")
    pos, neg = counts.agg(F.sum("_pos"), F.sum("_neg")).first()
    placed = running(counts, [], [F.col(score).desc()], sums={"tp": "_pos", "fp": "_neg"}, position=None)
    return placed.select(score, "tp", "fp", (F.col("tp") / max(pos or 0, 1)).alias("tpr"),
                         (F.col("fp") / max(neg or 0, 1)).alias("fpr"), "_pos", "_neg")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve: share of (positive, negative) pairs in the right order, ties count half."""
    r = roc_points(df, label, score)
    right = F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / 2.0))
    return r.agg((right / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("auc"))


# --- isolation forest -----------------------------------------------------------------------------------------

TREE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, path double"


def _average_path(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree: (node, feature, cut, left, right, path); leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    free = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 and depth < limit else []
        if len(spread) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + _average_path(len(rows))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        left = part[:, f] <= cut
        nodes.append((node, f, cut, free, free + 1, 0.0))
        todo += [(free, rows[left], depth + 1), (free + 1, rows[~left], depth + 1)]
        free += 2
    return nodes


def fit_isolation_forest(df: DataFrame, key: str, columns: Sequence[str], trees: int = 200, sample: int = 256,
                         seed: int = 42) -> list:
    """Trees grown in parallel, each from ``sample`` rows; returns at most trees x 2 x sample node rows.

    For every tree a hash draws somewhat more rows than it needs from the whole
    table, of which the tree takes the ``sample`` with the smallest hash.
    """
    n = df.count()
    pool = df.select(F.col(key).alias("_k"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    share = min(1.0, 1.6 * sample / max(n, 1))
    # Each row names the trees that draw it before it is copied, so a large table is not multiplied by the trees.
    drawn = pool.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: F.pmod(
        F.xxhash64(F.col("_k"), k, F.lit(seed)), F.lit(1_000_000_007)) < share * 1_000_000_007)))
    names = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(["_o", "_k"]).head(sample)[names].to_numpy(dtype=float)
        limit = max(1, math.ceil(math.log2(max(sample, 2))))
        nodes = _grow(rows, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    ordered = drawn.withColumn("_o", F.xxhash64(F.col("_k"), F.col("tree"), F.lit(seed + 1)))
    # A fixed number of partitions: the rows are few but growing is work, so they are not merged into one task.
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    return ordered.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, TREE_SCHEMA).collect()


def score_isolation(df: DataFrame, forest: list, columns: Sequence[str], sample: int = 256) -> DataFrame:
    """Adds anomaly_score in 0..1, rounded to six places."""
    columns_of_node = ["tree", "node", "feature", "cut", "left", "right", "path"]
    table = pd.DataFrame([tuple(r) for r in forest], columns=columns_of_node).sort_values(["tree", "node"])
    packed = [tuple(g[k].to_numpy() for k in columns_of_node[2:]) for _, g in table.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(packed)
    names = list(columns)
    norm = _average_path(sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].fillna(0).to_numpy(dtype=float)
            total = np.zeros(len(x))
            for feature, cut, left, right, path in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[at]
                    open_ = np.flatnonzero(f >= 0)
                    if len(open_) == 0:
                        break
                    here = at[open_]
                    go_left = x[open_, f[open_]] <= cut[here]
                    at[open_] = np.where(go_left, left[here], right[here])
                total += path[at]
            depth = total / max(len(shared.value), 1)
            s = np.power(2.0, -depth / norm)
            yield pdf.assign(anomaly_score=np.round(np.clip((s - 0.1) / 0.4, 0.0, 1.0), 6))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", anomaly_score double"
    return df.mapInPandas(score, schema)


def evaluation_table(scored: DataFrame, label: str, scores: Mapping[str, str], threshold: float) -> DataFrame:
    """One row per score column: rates at the threshold and the area under the curve."""
    long = scored.unpivot([label], [F.col(c).cast("double").alias(n) for n, c in scores.items()], "model", "score")
    rates = confusion(long, label, "score", threshold, by=["model"])
    counts = long.groupBy("model", "score").agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    placed = running(counts, ["model"], [F.col("score").desc()], sums={"_tp": "_pos"}, position=None)
    areas = placed.groupBy("model").agg((F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2.0)) / F.nullif(
        F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("auc"))
    return rates.join(areas, "model")
