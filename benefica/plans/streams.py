"""Streams over the given tables, run to the end of what has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.functions import scoring
from benefica.operators import learning
from benefica.plans.fraud import LIGHT, SERVICE, light_features
from benefica.plans.joins import RECON, geo_batches, parsed
from benefica.plans.registry import query
from benefica.scale import stage, staging_path
from benefica.streaming import jobs
from benefica.streaming.runner import logged, newest, read_files, run_append

EVENTS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, CASE event_type WHEN 'error' THEN 'fail'
    WHEN 'purchase' THEN 'ok' ELSE 'start' END AS kind FROM events)"""


def landed(t, df, label: str, parts: int = 4):
    """The rows as files in a landing folder, and that folder as a stream."""
    path = staging_path(t.spark, label)
    df.repartition(parts).write.parquet(path)
    return read_files(t.spark, path, df.schema)


def folder(t, label: str) -> str:
    return staging_path(t.spark, label)


@query("l01_incremental_import", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    df = t.events.select("event_id", "user_id", "event_type", "ts")
    path, out, checkpoint = (folder(t, x) for x in ("inbox", "imported", "checkpoint"))
    early = F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    for part in (df.where(early), df.where(~early)):
        part.write.mode("append").parquet(path)
        # The same checkpoint: the second run sees only the files that came later.
        run_append(read_files(t.spark, path, df.schema), checkpoint, out)
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type")


@query("l02_publish_changes", """
    SELECT 'registry' AS topic, CAST(record_id AS VARCHAR) AS key, event_id FROM change_event WHERE op = 'signup'""")
def _(t):
    out = folder(t, "published")
    jobs.publish_stream(landed(t, t.change_event.select("event_id", "record_id", "op"), "changes"), folder(t, "checkpoint"),
                        "op = 'signup'", "record_id", "registry", out)
    return t.spark.read.parquet(out).select("topic", "key", F.get_json_object("value", "$.event_id").cast("long")
                                            .alias("event_id"))


def stage_events(t):
    return t.events.selectExpr(
        "CAST(user_id AS STRING) AS key", "CAST(ts AS TIMESTAMP) AS ts", "event_id",
        "CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'ok' ELSE 'start' END AS kind")


STATUS = f"""{EVENTS}, f AS (SELECT key, ts, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM ev
        WHERE kind = 'fail'), f3 AS (SELECT key, ts AS t3 FROM f WHERE n = 3),
    a AS (SELECT key, min(ts) FILTER (kind = 'ok') AS ok, count(*) FILTER (kind = 'fail') AS fails,
        max_by(kind, event_id) AS last_kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS z
        FROM ev) GROUP BY 1),
    s AS (SELECT a.*, t3, (SELECT count(*) FROM f WHERE f.key = a.key AND f.ts < a.ok) AS before_ok
        FROM a LEFT JOIN f3 USING (key))
    SELECT key, CASE WHEN t3 IS NOT NULL AND (ok IS NULL OR t3 < ok) THEN 'ERROR' WHEN ok IS NOT NULL THEN 'PROCESSED'
        WHEN last_kind = 'start' THEN 'PROCESSING' ELSE 'PENDING' END AS status,
        CAST(CASE WHEN t3 IS NOT NULL AND (ok IS NULL OR t3 < ok) THEN 3 WHEN ok IS NOT NULL THEN before_ok + 1
        ELSE fails END AS INT) AS attempts FROM s"""


@query("l03_stage_machine_batch", f"WITH {STATUS}")
def _(t):
    return jobs.stage_status(jobs.stage_summary(stage_events(t))).select("key", "status", "attempts")


def in_turn(t, parts, schema, step):
    """Land the parts one after the other; ``step`` runs the stream over what is there after each."""
    inbox, checkpoint, out = (folder(t, x) for x in ("inbox", "checkpoint", "log"))
    for part in parts:
        part.write.mode("append").parquet(inbox)
        step(read_files(t.spark, inbox, schema), checkpoint, out)
    return out


def halves(df, column="ts"):
    early = F.col(column) < F.expr("TIMESTAMP '2024-01-16 00:00:00'")
    return [df.where(early), df.where(~early)]


@query("l03_stage_machine_stream", f"WITH {STATUS}")
def _(t):
    df = stage_events(t)
    log = in_turn(t, halves(df), df.schema, lambda s, c, out: jobs.stage_machine(s, c, out, stale=None))
    return newest(t.spark, log, ["key"]).select("key", "status", "attempts")


@query("l05_stale_reset_stream", f"""
    WITH st AS (WITH {STATUS}), l AS (SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS since FROM events GROUP BY 1)
    SELECT key, CASE WHEN status = 'PROCESSING' AND since < TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 12 DAY THEN 'PENDING' ELSE status END AS status,
        attempts FROM st JOIN l USING (key)""")
def _(t):
    df = stage_events(t)
    tick = t.spark.sql("SELECT CAST(NULL AS STRING) AS key, TIMESTAMP '2024-02-10 00:00:00' AS ts, -1L AS event_id, 'tick' AS kind")
    log = in_turn(t, [*halves(df), tick], df.schema, lambda s, c, out: jobs.stage_machine(s, c, out, stale=12 * 24 * 60, lateness="0 seconds"))
    return newest(t.spark, log, ["key"]).select("key", "status", "attempts")


@query("l05_stale_reset", """
    WITH l AS (SELECT user_id, max(ts) AS since, max_by(event_type, ts) AS kind FROM events GROUP BY 1)
    SELECT user_id AS key, CASE WHEN kind = 'click' AND since >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 60 MINUTE
        THEN 'PROCESSING' WHEN kind = 'click' THEN 'PENDING' ELSE 'PROCESSED' END AS status FROM l""")
def _(t):
    last = t.events.groupBy(F.col("user_id").alias("key")).agg(
        F.max("ts").cast("timestamp").alias("since"), F.max_by("event_type", "ts").alias("kind"))
    status = last.withColumn("status", F.when(F.col("kind") == "click", "PROCESSING").otherwise("PROCESSED"))
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz").cast("timestamp")
    return jobs.reset_stale(status, as_of).select("key", "status")


@query("l04_recon_stream", f"""
    WITH {RECON}, back AS (SELECT reconciliation_id, statement_id AS rs, entry_sequence AS re, row_number() OVER (
        PARTITION BY reconciliation_id ORDER BY statement_order DESC, entry_sequence DESC) AS z FROM judged
        WHERE outcome = 'REVERSED')
    SELECT reconciliation_id, target, statement_id, entry_sequence, rs IS NOT NULL AS reversal_found,
        rs AS reversal_statement_id, re AS reversal_entry_sequence
    FROM judged LEFT JOIN (SELECT * FROM back WHERE z = 1) USING (reconciliation_id) WHERE outcome = 'RECONCILED'""")
def _(t):
    lines = parsed(t).select("statement_id", "statement_order", "entry_sequence", "indicator", "reconciliation_id", "amount")
    first_half = F.col("statement_order") < 199900 * 1000000
    # The later statements arrive first.
    facts = in_turn(t, [lines.where(~first_half), lines.where(first_half)], lines.schema,
                    lambda s, c, out: jobs.reconcile_stream(s, c, f"{out}/facts", f"{out}/lines"))
    return jobs.reconciliations(t.spark, f"{facts}/facts", t.disbursement, geo_batches(t)).drop("amount")


@query("l04_late_statements", f"""
    WITH {RECON} SELECT statement_id, entry_sequence, reconciliation_id, outcome FROM judged""")
def _(t):
    lines = parsed(t).select("statement_id", "statement_order", "entry_sequence", "indicator", "reconciliation_id", "amount")
    out = in_turn(t, [lines.where(F.col("statement_order") % 1000000 >= 5), lines.where(F.col("statement_order") % 1000000 < 5)], lines.schema,
                  lambda s, c, out: jobs.reconcile_stream(s, c, f"{out}/facts", f"{out}/lines"))
    return jobs.reconciled_lines(t.spark, f"{out}/lines", f"{out}/facts", t.disbursement, geo_batches(t)).select(
        "statement_id", "entry_sequence", "reconciliation_id", "outcome")


@query("l08_audit_stream", """
    SELECT user_id, CASE WHEN old IS NULL THEN 'create' ELSE 'write' END AS change, 'event_type' AS field, old AS old_value,
        event_type AS new_value FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old
        FROM events) WHERE old IS DISTINCT FROM event_type""")
def _(t):
    df = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    log = in_turn(t, halves(df), df.schema, lambda s, c, out: jobs.audit_stream(s, c, "user_id", ["event_type"], out))
    return jobs.audit_log(t.spark, log)


@query("l10_group_recompute", """
    WITH touched AS (SELECT DISTINCT group_id FROM group_membership WHERE start_date >= DATE '1999-01-01'),
      c AS (SELECT m.group_id, count(*) AS n FROM group_membership m JOIN registrant g ON g.partner_id = m.group_id
        JOIN registrant p ON p.partner_id = m.individual_id WHERE g.is_registrant AND g.is_group AND g.disabled IS NULL
        AND p.disabled IS NULL AND m.ended_date IS NULL GROUP BY 1)
    SELECT group_id, coalesce(n, 0) AS members FROM touched LEFT JOIN c USING (group_id)""")
def _(t):
    changed = t.group_membership.where("start_date >= DATE '1999-01-01'").select("group_id")
    return members_by_changes(t).join(changed.distinct(), "group_id", "left_semi")


def members_by_changes(t):
    """Counts after three arrivals: what began before 1999, what began later, and what ended."""
    m = t.group_membership
    begun = m.select("group_id", "individual_id", F.lit(1).alias("sign"), "start_date")
    ended = m.where("ended_date IS NOT NULL").select("group_id", "individual_id", F.lit(-1).alias("sign"), "start_date")
    new = F.col("start_date") >= F.lit("1999-01-01").cast("date")
    log = in_turn(t, [begun.where(~new), begun.where(new), ended], begun.schema, lambda s, c, out: jobs.membership_stream(s, c, t.registrant, out))
    return newest(t.spark, log, ["group_id"])


@query("l10_membership_changes", """
    WITH c AS (SELECT m.group_id, count(*) AS n FROM group_membership m JOIN registrant g ON g.partner_id = m.group_id
        JOIN registrant p ON p.partner_id = m.individual_id WHERE g.is_registrant AND g.is_group AND g.disabled IS NULL
        AND p.disabled IS NULL AND m.ended_date IS NULL GROUP BY 1)
    SELECT group_id, coalesce(n, 0) AS members FROM (SELECT DISTINCT group_id FROM group_membership) LEFT JOIN c USING (group_id)""")
def _(t):
    return members_by_changes(t)


def totals_by_changes(t, arrivals):
    """Count and total per event type after signed change rows (event_type, value, sign)."""
    rows = [a.select("event_type", F.col("value").cast("decimal(18,6)").alias("value"), F.lit(sign).alias("sign")) for a, sign in arrivals]
    aggregates = [F.sum("sign").cast("long").alias("n"), F.sum(F.col("sign") * F.col("value")).alias("total")]
    log = in_turn(t, rows, rows[0].schema, lambda s, c, out: jobs.running_totals(s, c, ["event_type"], aggregates, out))
    return newest(t.spark, log, ["event_type"]).select("event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("l11_dashboard_stream", """
    SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def _(t):
    return totals_by_changes(t, [(part, 1) for part in halves(t.events.withColumn("ts", F.col("ts").cast("timestamp")))])


@query("l11_dashboard_corrections", """
    SELECT event_type, count(*) FILTER (value < 40) AS n, coalesce(round(sum(value) FILTER (value < 40), 2), 0) AS total FROM events GROUP BY 1""")
def _(t):
    return totals_by_changes(t, [(t.events, 1), (t.events.where("NOT value < 40"), -1)])


@query("l13_scoring_stream", f"""
    WITH {LIGHT}, s AS (SELECT partner_id, least(1.0, 0.3 * CAST(shared_account_count >= 2 AS INT)
        + 0.25 * CAST(shared_phone_count >= 2 AS INT) + 0.2 * CAST(payment_gap_ratio > 0.5 AS INT)
        + 0.15 * CAST(nb_programs > 3 AS INT) + 0.05 * CAST(has_disabled = 1 AS INT)
        + 0.05 * CAST(income_program_inconsistency = 1 AS INT)) AS r FROM feat)
    SELECT partner_id, round(r, 6) AS rule_score FROM s WHERE r >= 0.3""")
def _(t):
    return streamed_alerts(t).select(F.col("beneficiary_id").alias("partner_id"), F.round("rule_score", 6).alias("rule_score")).where("rule_score >= 0.3")


def streamed_alerts(t):
    """Alerts of all light feature rows that arrive, by a model that was trained before and saved."""
    rows = light_features(t)
    known = stage(learning.prepare_features(rows.withColumn("is_fraud", (F.col("cycle_count") > 10).cast("int"))), "known")
    model = folder(t, "model")
    learning.train(known, "logistic_regression", maxIter=20).write().overwrite().save(model)
    early = F.col("partner_id") % 2 == 0
    log = in_turn(t, [rows.where(early), rows.where(~early)], rows.schema, lambda s, c, out: jobs.scoring_stream(s, c, model, out))
    return logged(t.spark, log).drop("batch")


@query("l13_streamed_alerts", f"""
    WITH {LIGHT}, {SERVICE} SELECT partner_id AS beneficiary_id, round(rule_s, 6) AS rule_score, round(graph_s, 6) AS graph_score,
        true AS blended, true AS levelled, true AS scored, 'pending' AS status FROM svc""")
def _(t):
    ml, rule, graph, risk = (F.col(c) for c in ("ml_score", "rule_score", "graph_score", "risk_score"))
    level = scoring.service_level(risk, F.col("ml_prediction"), rule, graph)
    return streamed_alerts(t).select(
        "beneficiary_id", F.round(rule, 6).alias("rule_score"), F.round(graph, 6).alias("graph_score"),
        (F.abs(risk - scoring.service_blend(ml, rule, graph)) < 1e-9).alias("blended"), (F.col("risk_level") == level).alias("levelled"),
        ml.between(0, 1).alias("scored"), "status")


def counted(t, window, keys):
    """Window counts of all events, an event that comes after its window was closed, and one that closes the last window."""
    df = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("user_id").cast("long").alias("user_id"))
    edges = df.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    late = edges.select(F.col("lo").alias("ts"), F.lit("late").alias("event_type"), F.lit(-1).cast("long").alias("user_id"))
    close = edges.select((F.col("hi") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("close").alias("event_type"),
                         F.lit(-1).cast("long").alias("user_id"))
    inbox, checkpoint, out = (folder(t, x) for x in ("timed", "checkpoint", "windows"))
    for part in (df, late.union(close)):
        part.write.mode("append").parquet(inbox)
        jobs.windowed_counts(read_files(t.spark, inbox, df.schema), checkpoint, window, keys, out)
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return t.spark.read.parquet(out).select(form("start"), form("end"), *keys, "n")


STAMP = "%Y-%m-%d %H:%M:%S"


@query("l12_tumbling_counts", f"""
    SELECT strftime(date_trunc('day', ts), '{STAMP}') AS start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '{STAMP}') AS "end",
        event_type, count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    return counted(t, F.window("ts", "1 day"), ["event_type"])


@query("l12_sliding_counts", f"""
    WITH e AS (SELECT event_type, date_trunc('day', ts) - to_days(CAST(unnest([0, 1]) AS INT)) AS s FROM events)
    SELECT strftime(s, '{STAMP}') AS start, strftime(s + INTERVAL 2 DAY, '{STAMP}') AS "end", event_type, count(*) AS n
    FROM e GROUP BY ALL""")
def _(t):
    return counted(t, F.window("ts", "2 days", "1 day"), ["event_type"])


@query("l12_session_counts", f"""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT strftime(min(ts), '{STAMP}') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '{STAMP}') AS "end", user_id, count(*) AS n
    FROM s GROUP BY user_id, k""")
def _(t):
    return counted(t, F.session_window("ts", "6 hours"), ["user_id"])
