"""The graph of beneficiaries that share an attribute, without writing down its edges.

Two registrants are linked when they share a phone, address, agent or account;
parallel links keep the largest weight.  A group of k registrants holds
k(k-1)/2 edges, so the edge list is never built.  For a pair sharing the
attribute set S

    max weight over S = sum over non-empty T of S of (-1)^(|T|+1) * min weight over T

(the maximum-minimums identity), and "shares all of T" is an equality of one
combined key.  Every sum over neighbours therefore splits into sums over at
most 15 groups per registrant, and one round costs one pass over N x 15 rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benefica.scale import join_groups, stage


def memberships(nodes: DataFrame, weights: Mapping[str, float], id_column: str = "id") -> DataFrame:
    """(id, subset, key, min_weight, sign): every group that a node belongs to."""
    attributes = [a for a in weights if a in nodes.columns]
    entries = []
    for size in range(1, len(attributes) + 1):
        for chosen in combinations(attributes, size):
            filled = F.lit(True)
            for a in chosen:
                filled = filled & F.col(a).isNotNull()
            entries.append(F.when(filled, F.struct(
                F.lit("+".join(chosen)).alias("subset"),
                F.to_json(F.array(*[F.col(a).cast("string") for a in chosen])).alias("key"),
                F.lit(float(min(weights[a] for a in chosen))).alias("min_weight"),
                F.lit(1 if size % 2 else -1).alias("sign"))))
    return nodes.select(F.col(id_column).alias("id"), F.inline(F.filter(F.array(*entries), lambda x: x.isNotNull())))


def incidence(nodes: DataFrame, weights: Mapping[str, float], id_column: str = "id") -> DataFrame:
    """(id, subset, key, min_weight, sign, n): the groups with two or more members that a node belongs to."""
    exploded = memberships(nodes, weights, id_column)
    sizes = exploded.groupBy("subset", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_groups(exploded, sizes, ["subset", "key"])


def degrees(groups: DataFrame) -> DataFrame:
    """(id, degree, strength): number of distinct neighbours and sum of merged edge weights."""
    return groups.groupBy("id").agg(
        F.sum(F.expr("sign * (n - 1)")).alias("degree"),
        F.sum(F.expr("sign * min_weight * (n - 1)")).alias("strength"))


def merged_edge_weights(nodes: DataFrame, weights: Mapping[str, float], id_column: str = "id") -> DataFrame:
    """(weight, n_edges): edges per weight after parallel edges were merged by their maximum.

    Edges of weight >= w are the pairs sharing one of the attributes that weigh
    at least w; each level is counted by inclusion and exclusion over groups.
    Only the size of a group counts, so members are not joined to it.
    """
    levels = sorted(set(weights.values()), reverse=True)
    sizes = memberships(nodes, weights, id_column).groupBy("subset", "key", "min_weight", "sign").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.where("n > 1").groupBy("subset").agg(
        F.first("min_weight").alias("min_weight"), F.first("sign").alias("sign"), F.sum(F.expr("n * (n - 1) / 2")).alias("pairs"))
    at_least = pairs.agg(*[F.coalesce(F.sum(F.when(F.col("min_weight") >= w, F.col("sign") * F.col("pairs"))), F.lit(0.0))
                           .alias(str(i)) for i, w in enumerate(levels)])
    exact = [F.struct(F.lit(w).alias("weight"), (F.col(str(i)) - (F.col(str(i - 1)) if i else F.lit(0.0)))
                      .cast("long").alias("n_edges")) for i, w in enumerate(levels)]
    return at_least.select(F.inline(F.array(*exact))).where("n_edges > 0")


def pagerank(nodes: DataFrame, weights: Mapping[str, float], rounds: int = 100, damping: float = 0.85,
             tolerance: float = 1e-6, id_column: str = "id") -> DataFrame:
    """(id, rank, degree): weighted rank of every node by power iteration.

    Every round is written, which cuts the lineage, and the iteration stops when
    the summed change falls below N x tolerance, or after ``rounds``.  Nodes
    without a neighbour spread their rank evenly.
    """
    groups = stage(incidence(nodes, weights, id_column).select(
        "id", F.xxhash64("subset").alias("subset"), "key",
        (F.col("sign") * F.col("min_weight")).alias("coef"), "sign", "n"), "incidence")
    links = groups.groupBy("id").agg(F.sum(F.expr("sign * (n - 1)")).alias("degree"),
                                     F.sum(F.expr("coef * (n - 1)")).alias("strength"),
                                     F.sum("coef").alias("own"))
    base = stage(
        nodes.select(F.col(id_column).alias("id")).join(links, "id", "left").na.fill(
            0, ["degree"]).na.fill(0.0, ["strength", "own"]), "nodes")
    n, loose_nodes = base.agg(F.count(F.lit(1)), F.count_if(F.col("degree") == 0)).first()
    # Nodes without a neighbour all hold the same rank, so their part is one number.
    loose_rank = 1.0 / n if n else 0.0
    ranks = base.withColumn("rank", F.lit(loose_rank))
    for _ in range(rounds):
        share = F.when(F.col("degree") > 0, F.col("rank") / F.col("strength")).otherwise(0.0)
        shared = ranks.withColumn("share", share)
        # Rows carry their key, so a hot group is first summed inside every task.
        placed = groups.join(shared.select("id", "share"), "id")
        sums = placed.groupBy("subset", "key").agg(F.sum("share").alias("total"))
        received = join_groups(groups, sums, ["subset", "key"]).groupBy("id").agg(
            F.sum(F.col("coef") * F.col("total")).alias("received"))
        inflow = F.coalesce("received", F.lit(0.0)) - F.col("own") * F.col("share")
        everywhere = ((1 - damping) + damping * loose_nodes * loose_rank) / max(n, 1)
        step = shared.join(received, "id", "left").select(
            "id", "degree", "strength", "own", F.col("rank").alias("old"), (damping * inflow + everywhere).alias("rank"))
        loose_rank = everywhere
        step = stage(step, "ranks")
        if (step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < n * tolerance:
            break
        ranks = step.drop("old")
    return step.select("id", "rank", "degree")


def graph_risk(ranked: DataFrame, n_nodes: int) -> DataFrame:
    """Score, number of connections and hub flag; a graph of fewer than two nodes has no risk."""
    alone = n_nodes < 2
    score = F.lit(0.0) if alone else F.round(F.least(F.col("rank") * 200, F.lit(1.0)), 3)
    return ranked.select("id", score.alias("graph_score"), F.col("degree").cast("long").alias("connections"),
                         (F.lit(not alone) & (F.col("degree") > 5)).alias("is_hub"))


def first_neighbours(nodes: DataFrame, weights: Mapping[str, float], k: int = 5, id_column: str = "id") -> DataFrame:
    """(id, place, neighbour): the k smallest neighbour ids of every node.

    The k + 1 smallest members of each group are enough: among them are the k
    smallest others of everyone in it.  Spark limits the ranked groups before
    the shuffle, so a group never travels whole.
    """
    attributes = [a for a in weights if a in nodes.columns]
    member = nodes.select(F.col(id_column).alias("id"), F.inline(F.filter(F.array(*[
        F.when(F.col(a).isNotNull(), F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")))
        for a in attributes]), lambda x: x.isNotNull())))
    place = F.row_number().over(Window.partitionBy("attribute", "value").orderBy("id"))
    smallest = member.withColumn("_p", place).where(F.col("_p") <= k + 1).groupBy("attribute", "value").agg(
        F.array_sort(F.collect_list("id")).alias("_few"))
    met = join_groups(member, smallest, ["attribute", "value"]).select(
        "id", F.explode(F.slice(F.array_except("_few", F.array("id")), 1, k)).alias("neighbour"))
    # At most k candidates per attribute are left, so each node's list is short.
    lists = met.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("neighbour")), 1, k).alias("_n"))
    return lists.select("id", F.posexplode("_n").alias("place", "neighbour")).withColumn("place", F.col("place") + 1)
