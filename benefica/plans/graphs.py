"""The shared-attribute graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.fixed import EDGE_WEIGHTS
from benefica.operators import graph
from benefica.plans.aggregates import EDGES_SQL, graph_nodes
from benefica.plans.registry import query

BOTH = f"""{EDGES_SQL}, both_ways AS MATERIALIZED (SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM edge
    UNION ALL SELECT dst, src, CAST(weight AS DOUBLE) FROM edge),
    deg AS MATERIALIZED (SELECT src AS id, count(*) AS degree, sum(weight) AS strength FROM both_ways GROUP BY 1)"""


@query("j01_degrees_and_strength", f"""
    WITH {BOTH} SELECT id, degree, round(strength, 4) AS strength FROM deg""")
def _(t):
    return graph.degrees(graph.incidence(graph_nodes(t), EDGE_WEIGHTS)).select(
        "id", "degree", F.round("strength", 4).alias("strength")).where("degree > 0")


ROUNDS = 16  # of the check; the job goes on until it has converged


def rank_sql(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM node) AS rank FROM node)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM node) + 0.85 * coalesce(x.s, 0)
            + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT id FROM deg))
              / (SELECT count(*) FROM node) AS rank
            FROM node n LEFT JOIN (SELECT dst AS id, sum(p.rank * b.weight / d.strength) AS s FROM both_ways b
                JOIN r{i - 1} p ON p.id = b.src JOIN deg d ON d.id = b.src GROUP BY 1) x USING (id))""")
    # The first round whose summed change is below one millionth per node is the last.
    changes = " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.rank - b.rank)) AS c FROM r{i} a JOIN r{i - 1} b USING (id)"
                                 for i in range(1, rounds + 1))
    stop = f"stop AS MATERIALIZED (SELECT min(i) AS i FROM ({changes}) WHERE c < 1e-6 * (SELECT count(*) FROM node))"
    ends = " UNION ALL ".join(f"SELECT id, rank FROM r{i} WHERE (SELECT i FROM stop) = {i}" for i in range(1, rounds + 1))
    return ", ".join([*steps, stop, f"done AS MATERIALIZED ({ends})"])


@query("j02_weighted_pagerank", f"""
    WITH {BOTH}, {rank_sql(ROUNDS)} SELECT id, round(rank * 1e6, 3) AS rank_millionths FROM done""")
def _(t):
    return graph.pagerank(graph_nodes(t), EDGE_WEIGHTS).select(
        "id", F.round(F.col("rank") * 1e6, 3).alias("rank_millionths"))


@query("j03_graph_risk", f"""
    WITH {BOTH}, {rank_sql(ROUNDS)} SELECT id, round(least(rank * 200, 1.0), 3) AS graph_score, coalesce(degree, 0)
        AS connections, coalesce(degree, 0) > 5 AS is_hub FROM done LEFT JOIN deg USING (id)""")
def _(t):
    nodes = graph_nodes(t)
    return graph.graph_risk(graph.pagerank(nodes, EDGE_WEIGHTS), nodes.count())


@query("j02_converged_pagerank", f"""
    WITH {BOTH}, {rank_sql(ROUNDS)} SELECT id, round(rank * 1e6, 3) AS rank_millionths, coalesce(degree, 0) AS degree
    FROM done LEFT JOIN deg USING (id)""")
def _(t):
    return graph.pagerank(graph_nodes(t), EDGE_WEIGHTS).select(
        "id", F.round(F.col("rank") * 1e6, 3).alias("rank_millionths"), "degree")
