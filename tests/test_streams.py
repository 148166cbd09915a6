"""Streams: any number of batches in any order of arrival gives the batch result, repeats change nothing."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from benefica import scale
from benefica.operators import learning, payments
from benefica.scale import staging_path
from benefica.streaming import jobs
from benefica.streaming.runner import logged, newest, read_files, run_log

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def folders(spark):
    return [staging_path(spark, x) for x in ("inbox", "checkpoint", "log")]


def feed(spark, rows, schema, batches, step):
    """Land the rows in so many parts and run ``step`` after each; the paths of the log."""
    inbox, checkpoint, log = folders(spark)
    size = -(-len(rows) // batches)
    for i in range(0, len(rows), size):
        df = spark.createDataFrame(rows[i:i + size], schema)
        df.coalesce(1).write.mode("append").parquet(inbox)
        step(read_files(spark, inbox, df.schema), checkpoint, log)
    return log


# --- stages ---------------------------------------------------------------------------------------------------

EVENTS = [
    ("a", at(0), 1, "start"), ("a", at(1), 2, "ok"), ("a", at(2), 3, "fail"),
    ("b", at(0), 4, "start"), ("b", at(5), 5, "fail"), ("b", at(9), 6, "fail"), ("b", at(20), 7, "fail"), ("b", at(30), 8, "ok"),
    ("c", at(0), 9, "start"), ("d", at(0), 10, "start"), ("d", at(1), 11, "fail"),
]
WANT = {"a": ("PROCESSED", 1), "b": ("ERROR", 3), "c": ("PROCESSING", 0), "d": ("PENDING", 1)}
SCHEMA = "key string, ts timestamp, event_id long, kind string"


def stages(spark, log):
    return {r.key: (r.status, r.attempts) for r in newest(spark, log, ["key"]).collect()}


@pytest.mark.parametrize(("batches", "order"), [(1, 1), (2, -1), (7, 1), (7, -1)])
def test_stage_machine_in_any_arrival_order(spark, batches, order):
    log = feed(spark, EVENTS[::order], SCHEMA, batches, lambda s, c, out: jobs.stage_machine(s, c, out))
    assert stages(spark, log) == WANT
    batch = {r.key: (r.status, r.attempts) for r in jobs.stage_status(jobs.stage_summary(spark.createDataFrame(EVENTS, SCHEMA))).collect()}
    assert batch == WANT


@pytest.mark.parametrize("batches", [1, 3])
def test_a_timer_resets_stale_keys(spark, batches):
    clock = [("e", at(100), 12, "start"), (None, at(130), 13, "x")]
    # The clock stands at minute 120: c began at 0 and is stale, e is not; a later success of c still counts.
    log = feed(spark, [*sorted(EVENTS, key=lambda r: r[1]), *clock], SCHEMA, batches, lambda s, c, out: jobs.stage_machine(s, c, out, lateness="10 minutes"))
    assert stages(spark, log) == {**WANT, "c": ("PENDING", 0), "e": ("PROCESSING", 0)}


def test_work_goes_on_after_a_reset(spark):
    rows = [("c", at(0), 1, "start"), (None, at(90), 2, "x"), ("c", at(95), 3, "ok"), (None, at(300), 4, "x")]
    log = feed(spark, rows, SCHEMA, 4, lambda s, c, out: jobs.stage_machine(s, c, out, lateness="10 minutes"))
    seen = [r.status for r in logged(spark, log).orderBy("batch").collect()]
    assert seen[0] == "PROCESSING" and "PENDING" in seen and stages(spark, log) == {"c": ("PROCESSED", 1)}


def test_a_batch_is_reduced_before_it_is_shuffled():
    import pandas as pd

    rows = pd.DataFrame({"key": ["h"] * 1000 + ["k"], "ts": [*range(1000), 5], "event_id": range(1001), "kind": ["fail"] * 1000 + ["ok"]})
    out = next(jobs._reduced(3)(iter([rows.sample(frac=1, random_state=1)])))
    assert out.to_dict("records")[0] == {"key": "h", "ts": 999, "last_event": 999, "last_kind": "fail", "done": pytest.approx(float("nan"), nan_ok=True), "fails": [0, 1, 2]}
    assert len(out) == 2


def test_a_batch_writes_what_it_changed(spark):
    def size(path):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))

    inbox, checkpoint, log = folders(spark)
    many = [(f"k{i}", at(i % 50), i, "start") for i in range(20000)]
    for rows in (many, [("k7", at(55), 30000, "ok")]):
        df = spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(inbox)
        jobs.stage_machine(read_files(spark, inbox, df.schema), checkpoint, log)
    counts = {r.batch: r["count"] for r in logged(spark, log).groupBy("batch").count().collect()}
    assert sorted(counts.values()) == [1, 20000] and size(f"{log}/batch={max(counts)}") < size(f"{log}/batch=0") / 20
    assert stages(spark, log)["k7"] == ("PROCESSED", 1) and len(stages(spark, log)) == 20000


def test_a_failed_batch_runs_again(spark, monkeypatch):
    inbox, checkpoint, log = folders(spark)
    df = spark.createDataFrame(EVENTS[:6], SCHEMA)
    df.coalesce(1).write.parquet(inbox)
    jobs.stage_machine(read_files(spark, inbox, df.schema), checkpoint, log)
    spark.createDataFrame(EVENTS[6:], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    real = jobs.run_log

    def breaks(stream, c, path, *a, **k):
        def fail(batch):
            raise RuntimeError("lost")
        return real(stream, c, path, "update", lambda d: d if d.isStreaming else fail(d))

    monkeypatch.setattr(jobs, "run_log", breaks)
    with pytest.raises(Exception, match="lost"):
        jobs.stage_machine(read_files(spark, inbox, df.schema), checkpoint, log)
    monkeypatch.undo()
    jobs.stage_machine(read_files(spark, inbox, df.schema), checkpoint, log)
    assert stages(spark, log) == WANT


def test_stale_processing_is_reset(spark):
    status = jobs.stage_status(jobs.stage_summary(spark.createDataFrame(EVENTS, SCHEMA)))
    got = lambda m: {r.key: r.status for r in jobs.reset_stale(status, F.lit(at(m))).collect()}["c"]
    assert got(60) == "PROCESSING" and got(61) == "PENDING"


# --- reconciliation -------------------------------------------------------------------------------------------

LINES = "statement_id string, statement_order long, entry_sequence long, indicator string, reconciliation_id string, amount double"


def reconciled(spark, rows, batches, known):
    log = feed(spark, rows, LINES, batches, lambda s, c, out: jobs.reconcile_stream(s, c, f"{out}/facts", f"{out}/lines"))
    dis = spark.createDataFrame([(k,) for k in known], "disbursement_id string")
    geo = spark.createDataFrame([], "geo_batch_id string")
    return (jobs.reconciliations(spark, f"{log}/facts", dis, geo), jobs.reconciled_lines(spark, f"{log}/lines", f"{log}/facts", dis, geo), dis, geo)


def test_reconciliation_over_three_statements(spark):
    rows = [("s1", 1, 1, "D", "D1", 5.0), ("s1", 1, 2, "RD", "D2", 5.0), ("s2", 2, 1, "D", "D1", 5.0), ("s2", 2, 2, "D", "D2", 1.0), ("s3", 3, 1, "RD", "D1", 5.0)]
    made, lines, _, _ = reconciled(spark, rows, 3, ["D1", "D2"])
    assert {r.reconciliation_id: (r.statement_id, r.reversal_statement_id) for r in made.collect()} == {"D1": ("s1", "s3"), "D2": ("s2", None)}
    bad = sorted((r.statement_id, r.outcome) for r in payments.error_records(lines).collect())
    assert bad == [("s1", "INVALID_REVERSAL"), ("s2", "DUPLICATE_DISBURSEMENT")]


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_statements_in_any_order_give_the_rows_of_the_batch(spark, batches):
    rng = random.Random(batches)
    rows = [(f"s{o}", o, e, rng.choice(["D", "D", "RD", "C"]), rng.choice(["D1", "D2", "D3", "X", None]), float(o)) for o in range(12) for e in range(4)]
    batch = payments.reconcile
    want = spark.createDataFrame(rows, LINES)
    rng.shuffle(rows)  # late statements, and lines of one statement far apart
    made, lines, dis, geo = reconciled(spark, rows, batches, ["D1", "D2"])
    judged = batch(want, dis, geo)
    assert sorted(map(repr, lines.collect())) == sorted(map(repr, judged.collect()))
    cols = made.columns
    assert sorted(map(repr, made.collect())) == sorted(map(repr, payments.recon_records(judged).select(cols).collect()))


# --- audit, counts, totals, alerts ----------------------------------------------------------------------------

IMAGES = "k string, ts timestamp, event_id long, v string, w int"


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_every_change_is_logged_whatever_the_batches(spark, batches):
    rows = [(k, at(m), 10 * m + len(k), v, 1) for k, m, v in [
        ("a", 0, "x"), ("b", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("a", 4, "z"), ("b", 5, None), ("a", 6, "x")]]
    log = feed(spark, rows, IMAGES, batches, lambda s, c, out: jobs.audit_stream(s, c, "k", ["v", "w"], out))
    got = sorted((tuple(r) for r in jobs.audit_log(spark, log).select("k", "change", "field", "old_value", "new_value").collect()), key=repr)
    assert got == sorted([("a", "create", "v", None, "x"), ("b", "create", "v", None, "x"), ("a", "create", "w", None, "1"), ("b", "create", "w", None, "1"),
                          ("a", "write", "v", "x", "y"), ("a", "write", "v", "y", "z"), ("b", "write", "v", "x", None), ("a", "write", "v", "z", "x")], key=repr)


def test_a_hot_record_is_many_tasks(spark):
    rows = [("hot" if i % 3 else f"k{i}", at(i), i, f"v{i % 5}", None) for i in range(6000)]
    log = feed(spark, rows, IMAGES, 2, lambda s, c, out: jobs.audit_stream(s, c, "k", ["v", "w"], out))
    last, want = {}, []
    for k, _, _, v, _ in rows:
        if last.get(k) != v:
            want.append((k, last.get(k), v))
        last[k] = v
    got = [(r.k, r.old_value, r.new_value) for r in jobs.audit_log(spark, log).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert spark.read.parquet(f"{log}/between").count() == len(set(last)) + (rows[3000][3] != rows[2999][3])  # one row a key and border at most
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition again
    try:
        scale.previous(spark.createDataFrame(rows, IMAGES).repartition(8), ["k"], [F.col("ts")], "v", "old")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = spark.read.parquet([p for p in scale._staged if "/ordered-" in p][-1]).where("k = 'hot'")
    held = ordered.groupBy(F.shiftrightunsigned("_slot", 33).alias("part")).count().collect()
    assert len(held) > 3 and max(r["count"] for r in held) < 2500


def test_members_go_up_and_down(spark):
    people = [(g, True, True, None) for g in (10, 20, 30)] + [(i, True, False, None) for i in (1, 2, 3)] + [(4, True, False, dt.date(2000, 1, 1))]
    registrant = spark.createDataFrame(people, "partner_id long, is_registrant boolean, is_group boolean, disabled date")
    rows = [(10, 1, 1), (10, 2, 1), (20, 3, 1), (10, 4, 1), (20, 3, -1), (99, 1, 1), (10, 1, -1), (30, 1, 1), (10, 1, 1)]
    for batches in (1, 4):
        log = feed(spark, rows, "group_id long, individual_id long, sign int", batches, lambda s, c, out: jobs.membership_stream(s, c, registrant, out))
        assert {r.group_id: r.members for r in newest(spark, log, ["group_id"]).collect()} == {10: 2, 20: 0, 30: 1, 99: 0}
    touched = {r.batch: r.n for r in logged(spark, log).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(touched.values()) < 4 * 4  # only groups that a batch names


def test_alerts_of_a_repeated_batch_are_there_once(spark):
    rows = spark.createDataFrame([(i, float(i % 7) / 7, i % 5, i % 2) for i in range(60)], "partner_id long, payment_gap_ratio double, shared_phone_count int, is_fraud int")
    model = staging_path(spark, "model")
    learning.train(learning.prepare_features(rows), "logistic_regression", maxIter=5).write().save(model)
    new = rows.drop("is_fraud")
    inbox, checkpoint, log = folders(spark)
    new.coalesce(1).write.parquet(inbox)
    jobs.scoring_stream(read_files(spark, inbox, new.schema), checkpoint, model, log)
    # The same batch again, as after a failure before its commit.
    from pyspark.ml import PipelineModel

    loaded = PipelineModel.load(model)
    jobs.scored_alerts(new, loaded, "partner_id", "model").write.mode("overwrite").parquet(f"{log}/batch=0")
    got = logged(spark, log).drop("batch").collect()
    assert len(got) == 60 and sorted(map(repr, got)) == sorted(map(repr, jobs.scored_alerts(new, loaded, "partner_id", "model").collect()))
    assert {r.status for r in got} == {"pending"} and all(r.explanation.startswith("Model model") for r in got)


def test_an_empty_stream_leaves_an_empty_log(spark):
    inbox, checkpoint, log = folders(spark)
    df = spark.createDataFrame([], SCHEMA)
    df.write.parquet(inbox)
    run_log(read_files(spark, inbox, df.schema), checkpoint, log, "append")
    assert logged(spark, log).count() == 0
