"""Skew-safe building blocks against brute force, with one key that holds a third or more of the rows."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from benefica.operators import graph, payments, validation
from benefica.operators.sharing import other_owners
from benefica.scale import chunked_lists, exact_quantiles, join_groups, running, stage


def skewed(n=3000, seed=1):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), i, rnd.randint(0, 9)) for i in range(n)]


def test_running_matches_a_loop(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = running(df, ["k"], [F.col("v").desc(), F.col("i")], sums={"s": "v"}, maxes={"m": "i"})
    got = {r["i"]: (r["position"], r["s"], r["m"]) for r in out.collect()}
    want, place, total, top = {}, {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        place[k], total[k] = place.get(k, 0) + 1, total.get(k, 0) + v
        want[i] = (place[k], total[k], top.get(k))
        top[k] = max(top.get(k, -1), i)
    assert got == want


def test_running_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None if i % 3 else "x", i) for i in range(200)], "k string, i long")
    whole = running(df, [], [F.col("i")]).collect()
    assert all(r["position"] == r["i"] + 1 for r in whole)
    a = sorted(map(tuple, running(df, ["k"], [F.col("i")]).collect()), key=repr)
    b = sorted(map(tuple, running(df, ["k"], [F.col("i")]).collect()), key=repr)
    assert a == b


def test_a_hot_key_is_spread_over_partitions(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("i")).repartition(8)
    by = [F.col("k"), F.col("i")]
    parts = df.repartitionByRange(8, *by).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 20000 / 4


def test_staged_tables_can_be_dropped(spark):
    from pathlib import Path

    from benefica import scale

    kept, scale._staged[:] = list(scale._staged), []
    df = scale.stage(spark.range(5))
    assert df.count() == 5
    path = Path(scale._staged[0])
    assert path.exists() and scale.drop_staged(spark) == 1 and not path.exists()
    scale._staged[:] = kept


def test_chunked_lists_hold_everything_in_order(spark):
    df = spark.createDataFrame(skewed(), "k string, i long, v long")
    out = chunked_lists(df, ["k"], "i", size=100).collect()
    assert max(len(r["members"]) for r in out) == 100
    for k in ("hot", "a"):
        pages = sorted((r["chunk"], r["members"]) for r in out if r["k"] == k)
        assert [x for _, m in pages for x in m] == sorted(i for kk, i, _ in skewed() if kk == k)


def test_exact_quantiles(spark):
    rnd = random.Random(3)
    values = [round(rnd.gauss(0, 10), 1) for _ in range(2001)] + [5.0] * 1500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    r = exact_quantiles(df, "v", {"a": 0.15, "b": 0.5, "c": 0.95}).first()
    assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(values, [0.15, 0.5, 0.95]))


@pytest.mark.parametrize("wide", [1, 9])
def test_other_owners_matches_sets(spark, wide):
    rnd = random.Random(7)
    pairs = [(o, "hot") for o in range(300)] + [(o, f"v{rnd.randint(0, 200)}") for o in range(300) for _ in range(wide - 1)]
    pairs += [(rnd.randint(250, 400), f"v{rnd.randint(0, 200)}") for _ in range(300)] + [(o, f"set{k}") for o in range(500, 600) for k in range(wide)]
    pairs += [(5, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(pairs + pairs[:20] + [(1, None)], "o long, v string")
    holders = {}
    for o, v in set(pairs):
        holders.setdefault(v, set()).add(o)
    want = {}
    for o in {p[0] for p in pairs}:
        met = set().union(*[holders[v] for oo, v in set(pairs) if oo == o]) - {o}
        if met:
            want[o] = len(met)
    got = {r["o"]: r["shared_count"] for r in other_owners(df, "o", "v", strict=False).collect()}
    assert got == want
    strict = {r["o"]: r["shared_count"] for r in other_owners(df, "o", "v").collect()}
    assert strict == {o: n - 1 for o, n in want.items()}


WEIGHTS = {"phone": 0.9, "address_hash": 0.7, "agent_id": 0.4, "bank_account": 1.0}


def people(n=60, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, rnd.choice([None, "p1", "p2", "p3"]) if i < 50 else f"own{i}", f"h{rnd.randint(0, 30)}",
                     "one" if i < 25 else (f"a{i % 9}" if i < 50 else None), f"b{rnd.randint(0, 40)}" if i < 50 else None))
    return rows


def edges_of(rows):
    edges = {}
    for a, b in combinations(rows, 2):
        shared = [w for x, y, w in zip(a[1:], b[1:], (0.9, 0.7, 0.4, 1.0)) if x is not None and x == y]
        if shared:
            edges[(a[0], b[0])] = max(shared)
    return edges


def test_graph_counts_match_the_edge_list(spark):
    rows = people()
    df = spark.createDataFrame(rows, "id long, phone string, address_hash string, agent_id string, bank_account string")
    edges = edges_of(rows)
    got = {r["weight"]: r["n_edges"] for r in graph.merged_edge_weights(df, WEIGHTS).collect()}
    want = {}
    for w in edges.values():
        want[w] = want.get(w, 0) + 1
    assert got == want
    near = {}
    for (a, b) in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    degree = {r["id"]: r["degree"] for r in graph.degrees(graph.incidence(df, WEIGHTS)).collect() if r["degree"]}
    assert degree == {k: len(v) for k, v in near.items()}
    first = {}
    for r in graph.first_neighbours(df, WEIGHTS).orderBy("id", "place").collect():
        first.setdefault(r["id"], []).append(r["neighbour"])
    assert first == {k: sorted(v)[:5] for k, v in near.items()}


def test_pagerank_matches_dense_iteration(spark):
    rows = people()
    df = spark.createDataFrame(rows, "id long, phone string, address_hash string, agent_id string, bank_account string")
    n = len(rows)
    w = np.zeros((n, n))
    for (a, b), x in edges_of(rows).items():
        w[a, b] = w[b, a] = x
    out = w.sum(axis=1)
    rank = np.full(n, 1.0 / n)
    for _ in range(200):
        rank = 0.85 * ((rank / np.where(out > 0, out, 1)) * (out > 0)) @ w + 0.15 / n + 0.85 * rank[out == 0].sum() / n
    got = {r["id"]: r["rank"] for r in graph.pagerank(df, WEIGHTS, tolerance=1e-9).collect()}
    assert max(abs(got[i] - rank[i]) for i in range(n)) < 1e-6
    assert abs(sum(got.values()) - 1) < 1e-9


def test_overlaps_match_all_pairs(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(300):
        start = rnd.randint(0, 3000)
        rows.append((i, rnd.choice(["hot", "hot", "x", "y"]) if i % 2 else f"k{i}", None if i % 17 == 0 else start,
                     None if i % 13 == 0 else start + rnd.randint(0, 20)))
    df = spark.createDataFrame(rows, "id long, k string, s int, e int").select(
        "id", "k", F.date_add(F.lit("2000-01-01").cast("date"), F.col("s")).alias("s"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("e")).alias("e"))
    lo = lambda r: -10**9 if r[2] is None else r[2]
    hi = lambda r: 10**9 if r[3] is None else r[3]
    want = {a[0] for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and lo(a) <= hi(b) and lo(b) <= hi(a)}
    got = {r["id"] for r in validation.overlapping_rows(df, ["k"], "id", "s", "e").collect()}
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_a_hot_key_is_split_in_a_join_to_its_own_group(spark, how):
    rows = spark.range(60000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 12")
    want = rows.alias("r").join(groups.where("k IS NOT NULL").alias("g"), "k", how)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = join_groups(stage(rows, "rows"), groups, ["k"], how)
        found = got.collect()
        assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edge_weights_are_counted_without_joining_members_to_groups(spark):
    df = spark.createDataFrame(people(), "id long, phone string, address_hash string, agent_id string, bank_account string")
    out = graph.merged_edge_weights(df, WEIGHTS)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() > 0


def test_groups_of_small_files_are_not_broadcast(spark):
    rows = spark.range(3000).selectExpr("id", "id % 700 AS k")
    got = join_groups(stage(rows, "rows"), rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])
    assert got.count() == 3000
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_columns_that_only_order_rows_do_not_go_on(spark):
    rows = skewed(400)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = running(df, ["k"], [F.col("v").desc(), F.col("i")], kept=["k", "i"])
    assert out.columns == ["k", "i", "position"]
    whole = running(df, ["k"], [F.col("v").desc(), F.col("i")]).select("k", "i", "position")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))


def test_pages_with_the_smallest_number_are_not_joined(spark):
    from benefica.sources import statements

    page = lambda s, n, refs: (s, f":20:X\n:28C:1/{n}\n" + "\n".join(f":61:2401010101D5,00NTRF{r}//B{r}\n:86:T {r}" for r in refs) + "\n:62F:C")
    texts = [page("a", 1, "pq"), page("a", 3, "s"), page("a", 2, "r"), page("b", 2, "tu"), page("c", 1, "v")]
    got = statements.transactions(spark.createDataFrame(texts, "statement_id string, text string"))
    assert sorted((r.statement_id, r.entry_sequence, r.reconciliation_id) for r in got.collect()) == [
        ("a", 1, "p"), ("a", 2, "q"), ("a", 3, "r"), ("a", 4, "s"), ("b", 1, "t"), ("b", 2, "u"), ("c", 1, "v")]
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()  # only later pages reach the join


def test_mapping_requests_are_judged_once_and_blank_ids_meet_nothing(spark):
    rows = [(f"r{i:03d}", op, who, "fa", None) for i, (op, who) in enumerate([("update", "a"), ("link", "n"), ("unlink", "b"), ("link", "n")] + [("link", ""), ("update", None)] * 40)]
    requests = spark.createDataFrame(rows, "reference_id string, op string, id_value string, fa_value string, name string")
    mapping = spark.createDataFrame([("a", "old", "A"), ("b", "fa", "B"), ("", "none", "C")], "id_value string, fa_value string, name string")
    judged = payments.judge_mapping_requests(requests, mapping)
    assert {r.reference_id: r.reason for r in judged.collect()} == {
        r[0]: None if i < 3 else "rjct.reference_id.duplicate" if i == 3 else "rjct.id.invalid" for i, r in enumerate(rows)}
    after = payments.apply_mapping_requests(mapping, judged)
    assert {tuple(r) for r in after.collect()} == {("a", "fa", "A"), ("", "none", "C"), ("n", "fa", None)}
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3  # the mapping meets the updates, and both parts of the result the unlinked ids
