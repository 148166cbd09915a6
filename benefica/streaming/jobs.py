"""Stream forms of the incremental jobs.

What is known of a key lives in Spark's state store.  Rows are reduced where they are read, before they are
shuffled to their key, so a key that fills a batch reaches its state as a few rows.  Results are logs of changed
rows, one folder per batch (see ``runner.run_log``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from benefica.fixed import MAX_ATTEMPTS, SCORING_DEFAULTS, STALE_MINUTES
from benefica.functions import scoring
from benefica.operators import learning, payments
from benefica.scale import previous, running
from benefica.sources import files
from benefica.sources.changes import published
from benefica.streaming.runner import logged, newest, read_files, run_append, run_batches, run_log

# --- stages ---------------------------------------------------------------------------------------------------


def stage_summary(events: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """What matters of every key's events: first success, first failures up to the limit, last event.

    ``events`` holds key, ts, event_id and kind (start, ok, fail).
    """
    main = events.groupBy("key").agg(
        F.min(F.when(F.col("kind") == "ok", F.col("ts"))).alias("done"), F.max("ts").alias("last"),
        F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"))
    placed = running(events.where("kind = 'fail'").select("key", "ts", "event_id"), ["key"], [F.col("ts"), F.col("event_id")], position="_p")
    fails = placed.where(F.col("_p") <= attempts).groupBy("key").agg(F.array_sort(F.collect_list("ts")).alias("fails"))
    return main.join(fails, "key", "left").select(
        "key", "done", F.coalesce("fails", F.array().cast("array<timestamp>")).alias("fails"), "last", "last_kind")


def stage_status(state: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, status, attempts, since): a success ends the work, so does the last allowed failure."""
    limit = F.get("fails", F.lit(attempts - 1))
    failed = limit.isNotNull() & (F.col("done").isNull() | (limit < F.col("done")))
    done = F.col("done").isNotNull() & ~failed
    tried = F.when(failed, F.lit(attempts)).when(done, F.size(F.filter("fails", lambda x: x < F.col("done"))) + 1).otherwise(
        F.size("fails"))
    status = F.when(failed, "ERROR").when(done, "PROCESSED").when(F.col("last_kind") == "start", "PROCESSING").otherwise(
        "PENDING")
    since = F.when(failed, limit).when(done, F.col("done")).otherwise(F.col("last"))
    return state.select("key", status.alias("status"), tried.cast("int").alias("attempts"), since.alias("since"))


def reset_stale(status: DataFrame, as_of: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """PROCESSING that is older than the limit goes back to PENDING."""
    old = (F.col("status") == "PROCESSING") & (F.col("since") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return status.withColumn("status", F.when(old, "PENDING").otherwise(F.col("status")))


STAGE_STATE = "done long, fails array<long>, last long, last_event long, last_kind string"


def _reduced(attempts: int):
    """What matters of each key's events, per Arrow batch."""
    def reduce(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            rows = rows.sort_values(["key", "ts", "event_id"], kind="stable")
            by = rows.groupby("key", sort=False)
            out = by.agg(ts=("ts", "last"), last_event=("event_id", "last"), last_kind=("kind", "last"))
            out["done"] = rows[rows["kind"] == "ok"].groupby("key")["ts"].first()
            fails = rows[rows["kind"] == "fail"]
            fails = fails[fails.groupby("key").cumcount() < attempts].groupby("key")["ts"].agg(list)
            out["fails"] = fails.reindex(out.index)
            out["fails"] = [x if isinstance(x, list) else [] for x in out["fails"]]
            yield out.reset_index()[["key", "ts", "last_event", "last_kind", "done", "fails"]]
    return reduce


def _status(done, fails, last, kind, attempts: int) -> tuple[str, int, int]:
    """(status, attempts, since) of a key: a success ends the work, so does the last allowed failure."""
    limit = fails[attempts - 1] if len(fails) >= attempts else None
    if limit is not None and (done is None or limit < done):
        return "ERROR", attempts, limit
    if done is not None:
        return "PROCESSED", sum(x < done for x in fails) + 1, done
    return ("PROCESSING" if kind == "start" else "PENDING"), len(fails), last


def _stage_state(attempts: int, stale: int | None):
    def change(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, fails, last, event, kind = state.get if state.exists else (None, [], None, None, None)
        fails = list(fails)
        if state.hasTimedOut:
            state.update((done, fails, last, event, "stale"))
            yield pd.DataFrame({"key": [key[0]], "status": ["PENDING"], "attempts": [len(fails)], "since": [last]})
            return
        for rows in parts:
            rows = rows.sort_values(["last", "last_event"])
            oks = [int(x) for x in rows["done"] if pd.notna(x)]
            done = min([*oks, *([] if done is None else [done])], default=None)
            fails = sorted([*fails, *(int(x) for some in rows["fails"] for x in some)])[:attempts]
            top = rows.iloc[-1]
            if last is None or (int(top["last"]), int(top["last_event"])) > (last, event):
                last, event, kind = int(top["last"]), int(top["last_event"]), top["last_kind"]
        status, tried, since = _status(done, fails, last, kind, attempts)
        if status == "PROCESSING" and stale is not None:
            until = last // 1000 + stale * 60_000  # milliseconds, as timers count
            if until < state.getCurrentWatermarkMs():
                status, kind = "PENDING", "stale"
            else:
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        state.update((done, fails, last, event, kind))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "attempts": [tried], "since": [since]})
    return change


def stage_machine(stream: DataFrame, checkpoint: str, path: str, attempts: int = MAX_ATTEMPTS, stale: int | None = STALE_MINUTES,
                  lateness: str = "1 hour") -> None:
    """Status of every key after its events (key, ts, event_id, kind), as a log of changes in ``path``.

    A key's state is its first success, its first failures and its last event, whatever the order of arrival.  A timer sends
    a key that is PROCESSING for more than ``stale`` minutes back to PENDING (None: never); time is the newest event
    less ``lateness``, and events of a key that arrive later than that are dropped.  Events without a key only move the clock.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = stream.select("key", micros.alias("ts"), "event_id", "kind")
    tick = F.coalesce("key", F.lit(""))
    rows = rows.withColumns({"key": tick, "kind": F.when(tick == "", "tick").otherwise(F.col("kind"))})
    reduced = rows.mapInPandas(_reduced(attempts), "key string, ts long, last_event long, last_kind string, done long, fails array<long>")
    timed = reduced.withColumn("last", F.col("ts")).withColumn("ts", F.timestamp_micros("ts")).withWatermark("ts", lateness)
    status = timed.groupBy("key").applyInPandasWithState(
        _stage_state(attempts, stale), "key string, status string, attempts int, since long", STAGE_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    run_log(status.where("key <> ''").withColumn("since", F.timestamp_micros("since")), checkpoint, path)


# --- reconciliation -------------------------------------------------------------------------------------------

def reconcile_stream(stream: DataFrame, checkpoint: str, facts_path: str, lines_path: str) -> None:
    """Statement lines in any order of arrival: the lines themselves, and per id its first debit and its last reversal.

    Both facts are aggregates that Spark keeps in its state store, so a batch reads and writes the ids that it touches.  A
    late statement moves them, and with them the judgement of lines that came before it.
    """
    lines = stream.where(F.col("indicator").isin("D", "RD")).where("reconciliation_id IS NOT NULL")
    run_append(stream, f"{checkpoint}/lines", lines_path)
    place = [F.col(c) for c in ("statement_order", "entry_sequence")]
    line = F.struct(*place, "statement_id", "amount")
    facts = lines.groupBy("reconciliation_id").agg(
        F.min(F.when(F.col("indicator") == "D", line)).alias("first_debit"), F.max(F.when(F.col("indicator") == "RD", line)).alias("last_reversal"))
    run_log(facts, f"{checkpoint}/facts", facts_path)


def reconciliations(spark, facts_path: str, disbursement: DataFrame, geo_batches: DataFrame) -> DataFrame:
    """One row per reconciled id after all that has arrived, with its last reversal if that did not come before the debit's statement."""
    facts = newest(spark, facts_path, ["reconciliation_id"]).where("first_debit IS NOT NULL")
    out = facts.join(payments.targets(disbursement, geo_batches), "reconciliation_id")
    back = F.coalesce(F.col("last_reversal.statement_order") >= F.col("first_debit.statement_order"), F.lit(False))
    return out.select(
        "reconciliation_id", "target", "first_debit.statement_id", "first_debit.entry_sequence", "first_debit.amount",
        back.alias("reversal_found"), F.when(back, F.col("last_reversal.statement_id")).alias("reversal_statement_id"),
        F.when(back, F.col("last_reversal.entry_sequence")).alias("reversal_entry_sequence"))


def reconciled_lines(spark, lines_path: str, facts_path: str, disbursement: DataFrame, geo_batches: DataFrame) -> DataFrame:
    """Every line that has arrived with its outcome by the facts known now; earlier judgements are revised that way."""
    first = newest(spark, facts_path, ["reconciliation_id"]).select(
        "reconciliation_id", F.struct("first_debit.statement_order", "first_debit.entry_sequence").alias("_first"))
    return payments.judge(spark.read.parquet(lines_path), payments.targets(disbursement, geo_batches), first)


# --- audit, indicators, totals, publishing, scoring -----------------------------------------------------------

def _compare(key: str, kind: str, fields: Sequence[str]):
    """The log rows between the image that a key's state holds and the first images of its batches."""
    def change(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values("batch")  # one row per batch of the key
        last, out = (list(state.get[0]) if state.exists else None), []
        for first, end in zip(rows["first"], rows["end"]):
            old = last if last is not None else [None] * len(fields)
            out += [(group[0], "create" if last is None else "write", f, a, b) for f, a, b in zip(fields, old, first) if a != b]
            last = list(end)
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "change", "field", "old_value", "new_value"])
    return change


def audit_stream(stream: DataFrame, checkpoint: str, key: str, fields: Sequence[str], path: str) -> None:
    """Field-level log of every change: each image of a record against the one before it.

    Inside a batch images are compared in ordered range partitions, in the order of ``ts`` and ``event_id``, so a record that
    fills a batch is not one task.  Only the first and the last image of each record go on, as a second stream, to
    its state, which holds the last image.  Wherever the borders of batches fall the log is the same (see :func:`audit_log`).
    """
    texts = F.array(*[F.col(f).cast("string") for f in fields])

    def handle(batch: DataFrame, n: int) -> None:
        rows = previous(batch.select(key, "ts", "event_id", texts.alias("_v")), [key], [F.col("ts"), F.col("event_id")], "_v", "_old")
        entries = F.filter(F.transform(F.arrays_zip(F.array(*[F.lit(f) for f in fields]).alias("field"), F.col("_old").alias("old_value"),
                                                    F.col("_v").alias("new_value")), lambda e: e), lambda e: ~e.old_value.eqNullSafe(e.new_value))
        rows.where("_old IS NOT NULL").select(key, F.lit("write").alias("change"), F.inline(entries)).write.mode("overwrite").parquet(f"{path}/inside/batch={n}")
        place = F.struct("ts", "event_id")
        edges = batch.groupBy(key).agg(F.min_by(texts, place).alias("first"), F.max_by(texts, place).alias("end"))
        edges.select(key, "first", "end", F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{path}/edges/{n}")

    stream.sparkSession.createDataFrame([], f"{key} {stream.schema[key].dataType.simpleString()}, change string, field string, old_value string, new_value string").write.mode(
        "ignore").parquet(f"{path}/inside/batch=-1")
    run_batches(stream, f"{checkpoint}/images", handle)
    spark, kind = stream.sparkSession, stream.schema[key].dataType.simpleString()
    schema = stream.select(key, texts.alias("first"), texts.alias("end"), F.lit(0).cast("long").alias("batch")).schema
    edges = read_files(spark, f"{path}/edges/*", schema)
    log = edges.groupBy(key).applyInPandasWithState(
        _compare(key, kind, fields), f"{key} {kind}, change string, field string, old_value string, new_value string",
        "last array<string>", "update", GroupStateTimeout.NoTimeout)
    run_log(log, f"{checkpoint}/edges", f"{path}/between")


def audit_log(spark, path: str) -> DataFrame:
    """What :func:`audit_stream` has logged: changes inside batches and between them."""
    return spark.read.parquet(f"{path}/inside").drop("batch").unionByName(logged(spark, f"{path}/between").drop("batch"))


def windowed_counts(stream: DataFrame, checkpoint: str, window: Column, keys: Sequence[str], path: str,
                    delay: str = "1 hour") -> None:
    """Counts per event-time window and key, appended once the watermark has passed a window; rows that come later are dropped."""
    counts = stream.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    run_append(counts.select("w.start", "w.end", *keys, "n"), checkpoint, path)


def membership_stream(stream: DataFrame, checkpoint: str, registrant: DataFrame, path: str) -> None:
    """Member counts of groups, kept up to date by membership changes (group_id, individual_id, sign).

    A membership that begins counts +1, one that ends -1, of live members in live groups only; the counts are Spark's state,
    so a batch reads and writes the groups that it touches.
    """
    live = registrant.where("is_registrant AND disabled IS NULL")
    groups = live.where("is_group").select(F.col("partner_id").alias("group_id"), F.lit(True).alias("_group"))
    people = registrant.where("disabled IS NULL").select(F.col("partner_id").alias("individual_id"), F.lit(True).alias("_person"))
    counted = F.when(F.col("_group") & F.col("_person"), F.col("sign")).otherwise(0)
    counts = stream.join(people, "individual_id", "left").join(groups, "group_id", "left").groupBy("group_id").agg(F.sum(counted).cast("long").alias("members"))
    run_log(counts, checkpoint, path)


def running_totals(stream: DataFrame, checkpoint: str, keys: Sequence[str], aggregates: Sequence[Column], path: str) -> None:
    """A grouped aggregate kept in Spark's state; every trigger logs the groups that changed."""
    run_log(stream.groupBy(*keys).agg(*aggregates), checkpoint, path)


def publish_stream(stream: DataFrame, checkpoint: str, condition: str | None, key: str, topic: str, path: str) -> None:
    run_append(published(stream, condition, key, topic), checkpoint, path)


def scored_alerts(rows: DataFrame, model: PipelineModel, id_col: str, model_name: str) -> DataFrame:
    """Alert rows of beneficiaries by the full scoring path: default fill, model, rule and graph scores, blend and level.

    Columns that the rows do not have, and missing values, count as the scoring defaults.
    """
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(d))) if c in rows.columns else F.lit(float(d)) for c, d in SCORING_DEFAULTS.items()}
    out = learning.score_batch(model, rows.select(F.col(id_col).alias("beneficiary_id"), *[v.alias(c) for c, v in fill.items()]))
    out = out.withColumn("rule_score", scoring.heuristic_rule_score()).withColumn("graph_score", scoring.heuristic_graph_score())
    ml, rule, graph = F.col("ml_score"), F.col("rule_score"), F.col("graph_score")
    out = out.withColumn("final_score", scoring.service_blend(ml, rule, graph))
    out = out.withColumn("risk_level", scoring.service_level(F.col("final_score"), F.col("ml_prediction"), rule, graph)).withColumn(
        "explanation", scoring.explanation(model_name, ml, rule, graph, F.col("final_score"))).withColumn("rule_flags", F.array().cast("array<string>"))
    return files.alert_rows(out, "ml_score", "ml_prediction", "rule_score", "graph_score")


def scoring_stream(stream: DataFrame, checkpoint: str, model_path: str, path: str, id_col: str = "partner_id", model_name: str = "model") -> None:
    """Score new beneficiary rows with the saved model; each batch owns one folder of alerts, so one that runs twice alerts once."""
    model = PipelineModel.load(model_path)
    run_log(scored_alerts(stream, model, id_col, model_name), checkpoint, path, "append")
