"""Account resolution, allocation, payloads, envelope status and statement reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.functions.text import account_parts, blank_to_null
from benefica.scale import chunked_lists, join_groups, stage

# --- id to account mapping ------------------------------------------------------------------------------------


def resolve(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Look up the account of every requested id; scope "details" returns it, any other only the status.

    The status and reason texts are fixed values.
    """
    found = mapping.select("id_value", "fa_value", F.lit(True).alias("_found"))
    no_id = blank_to_null(F.col("id_value")).isNull()
    out = requests.join(found, "id_value", "left")
    ok = F.coalesce("_found", F.lit(False))
    return out.select(
        "reference_id", "id_value",
        F.when(no_id, "rjct").otherwise("succ").alias("status"),
        F.when(no_id, "rjct.reference_id.invalid").when(ok, "succ.id.active")
        .otherwise("succ.fa.not_linked_to_id").alias("reason"),
        F.when(ok & (F.col("scope") == "details"), F.col("fa_value")).alias("fa_value"))


def judge_mapping_requests(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Status of link, update and unlink requests against the stored mapping.

    Inside one run the first link of a new id (by reference) wins and the later
    ones meet an id that exists.  Requests without an id meet nothing, so however
    many there are they are not gathered under one key.  The codes are fixed values.
    """
    no_id = blank_to_null(F.col("id_value")).isNull()
    stored = mapping.select("id_value", F.col("fa_value").alias("_fa"), F.lit(True).alias("_stored"))
    first = requests.where("op = 'link' AND id_value <> '' AND fa_value <> ''").groupBy("id_value").agg(
        F.min("reference_id").alias("_first"))
    r = requests.where(~no_id).join(stored, "id_value", "left").join(first, "id_value", "left")
    no_fa = blank_to_null(F.col("fa_value")).isNull()
    known = F.coalesce("_stored", F.lit(False))
    is_ = lambda op: F.col("op") == op
    reason = (
        F.when(~is_("unlink") & no_fa, "rjct.fa.invalid")
        .when(is_("link") & (known | (F.col("reference_id") != F.col("_first"))), "rjct.reference_id.duplicate")
        .when(is_("update") & ~known, "rjct.reference_id.duplicate")
        .when(is_("unlink") & (~known | (~no_fa & (F.col("fa_value") != F.col("_fa")))), "rjct.id.invalid")
    )
    met = r.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "succ").otherwise("rjct")).select(*requests.columns, "status", "reason")
    return met.unionByName(requests.where(no_id).withColumns({"status": F.lit("rjct"), "reason": F.lit("rjct.id.invalid")}))


def apply_mapping_requests(mapping: DataFrame, judged: DataFrame) -> DataFrame:
    """Mapping after the accepted requests: links added, given fields overwritten, unlinked ids gone.

    Several accepted updates of one id: the last reference wins.  The accepted
    requests are written once, so they are judged once and not for each kind.
    """
    ok = stage(judged.where("status = 'succ'").select("reference_id", "op", "id_value", "fa_value", "name"), "accepted")
    unlinked = ok.where("op = 'unlink'").select("id_value").distinct()
    updates = ok.where("op = 'update'").groupBy("id_value").agg(
        F.max_by("fa_value", "reference_id").alias("_fa"),
        F.max_by("name", F.when(blank_to_null(F.col("name")).isNotNull(), F.col("reference_id"))).alias("_name"))
    linked = ok.where("op = 'link'").select("id_value", "fa_value", "name")
    kept = mapping.select("id_value", "fa_value", "name").join(updates, "id_value", "left").select(
        "id_value", F.coalesce(blank_to_null(F.col("_fa")), "fa_value").alias("fa_value"),
        F.coalesce(blank_to_null(F.col("_name")), "name").alias("name"))
    return kept.unionByName(linked).join(unlinked, "id_value", "left_anti")


def unresolved(disbursement: DataFrame, resolution: DataFrame) -> DataFrame:
    return disbursement.join(resolution.select("disbursement_id"), "disbursement_id", "left_anti")


def resolve_accounts(disbursement: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every disbursement with the account found for its beneficiary."""
    return disbursement.join(mapping.select("beneficiary_id", "fa_value", F.col("name").alias("resolved_name")), "beneficiary_id", "left")


def mark_repeated(disbursement: DataFrame) -> DataFrame:
    """Whether a beneficiary has several disbursements in the batch."""
    repeated = disbursement.groupBy("batch_id", "beneficiary_id").agg((F.count(F.lit(1)) > 1).alias("is_repeated"))
    return disbursement.join(repeated, ["batch_id", "beneficiary_id"])


def batch_resolution_status(resolved: DataFrame) -> DataFrame:
    """A batch with one missing account is in error."""
    return resolved.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("fa_value").isNull()).alias("n_missing"),
        F.when(F.bool_or(F.col("fa_value").isNull()), "ERROR").otherwise("PROCESSED").alias("status"))


# --- zones, warehouses, agencies ------------------------------------------------------------------------------

def resolve_zones(disbursement: DataFrame, geo: DataFrame) -> DataFrame:
    return disbursement.join(geo, "beneficiary_id")


def zone_totals(located: DataFrame, keys: Sequence[str] = ("zone_large", "zone_small")) -> DataFrame:
    return located.groupBy(*keys).agg(
        F.sum("quantity").alias("total_quantity"), F.count(F.lit(1)).alias("n_beneficiaries"))


def allocate(zones: DataFrame, allocation: DataFrame, zone: str, partner: str) -> DataFrame:
    """Zone rows with the warehouse or agency of their zone; ERROR where the zone has none."""
    return zones.join(allocation, zone, "left").withColumn(
        f"{partner}_status", F.when(F.col(partner).isNull(), "ERROR").otherwise("PROCESSED"))


def notices(rows: DataFrame, key: str, entry: Column, order: Sequence[Column], size: int = 500) -> DataFrame:
    """Numbered notices per receiver, each with at most ``size`` entries."""
    return chunked_lists(rows.withColumn("entry", entry), [key], "entry", order, size, "entries")


# --- payloads -------------------------------------------------------------------------------------------------

def digital_payloads(resolved: DataFrame, programs: DataFrame) -> DataFrame:
    """Payment payload per disbursement: account parts, sponsor account, payee name with fallbacks."""
    parts = account_parts(F.col("fa_value"))
    name = F.coalesce(blank_to_null(F.col("beneficiary_name")), blank_to_null(F.col("resolved_name")), F.lit("N/A"))
    return resolved.join(programs, "envelope_id", "left").select(
        "disbursement_id", "envelope_id", "quantity", name.alias("payee_name"), "sponsor_account",
        *[c.alias(n) for n, c in parts.items()])


def split_by_quantity(payloads: DataFrame) -> DataFrame:
    """Payloads marked as to send, or with nothing to pay and straight to reconciliation."""
    return payloads.withColumn("to_recon", F.col("quantity") <= 0)


def funds_gate(envelope: DataFrame, received: DataFrame, as_of: Column) -> DataFrame:
    """Complete, live envelopes that are due and whose funds are still to be checked."""
    return envelope.join(received, "envelope_id").where(
        (F.col("received_n") == F.col("declared_n"))
        & (F.abs(F.col("received_total") - F.col("declared_total")) < 0.005)
        & (F.col("cancellation_status") == "NOT_CANCELLED")
        & (F.col("schedule_date").isNull() | (F.col("schedule_date") == as_of))
        & F.col("funds_status").isin("PENDING_CHECK", "FUNDS_NOT_AVAILABLE"))


def received_counters(disbursement: DataFrame) -> DataFrame:
    """Per envelope: received after create, and what is left after cancellations."""
    live = F.col("cancellation_status") != "CANCELLED"
    return disbursement.groupBy("envelope_id").agg(
        F.count(F.lit(1)).alias("received_n"), F.round(F.sum("quantity"), 2).alias("received_total"),
        F.count_if(live).alias("live_n"),
        F.round(F.coalesce(F.sum(F.when(live, F.col("quantity"))), F.lit(0.0)), 2).alias("live_total"))


def envelope_limit_errors(requests: DataFrame, envelope: DataFrame, received: DataFrame) -> DataFrame:
    """First failing check of every request (a set of rows sharing request_id).  The codes are fixed values."""
    asked = requests.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("quantity").alias("_q"), F.min("envelope_id").alias("envelope_id"),
        (F.min("envelope_id") != F.max("envelope_id")).alias("_several"))
    e = envelope.select("envelope_id", "declared_n", "declared_total", F.col("cancellation_status").alias("_state"))
    r = asked.join(e, "envelope_id", "left").join(
        received.select("envelope_id", "received_n", "received_total"), "envelope_id", "left")
    zero = F.lit(0)
    error = (
        F.when(F.col("_several"), "MULTIPLE_ENVELOPES_FOUND")
        .when(F.col("declared_n").isNull(), "DISBURSEMENT_ENVELOPE_NOT_FOUND")
        .when(F.col("_state") == "CANCELLED", "DISBURSEMENT_ENVELOPE_ALREADY_CANCELED")
        .when(F.coalesce("received_n", zero) + F.col("_n") > F.col("declared_n"),
              "NO_OF_DISBURSEMENTS_EXCEEDS_DECLARED")
        .when(F.coalesce("received_total", zero) + F.col("_q") > F.col("declared_total") + 0.005,
              "TOTAL_DISBURSEMENT_QUANTITY_EXCEEDS_DECLARED")
    )
    return r.select("request_id", error.alias("error"))


# --- reconciliation -------------------------------------------------------------------------------------------

def reconcile(lines: DataFrame, disbursement: DataFrame, geo_batches: DataFrame,
              stored: DataFrame | None = None) -> DataFrame:
    """Outcome of every debit and reversal line.

    Statements count in ``statement_order``, and inside one all debits come
    before its reversals.  The first debit of an id makes its reconciliation,
    later ones are duplicates; a reversal needs a reconciliation that exists by
    then.  One aggregate per id and one join: no ordering of an id's lines.
    The outcome codes are fixed values.
    """
    place = F.struct("statement_order", "entry_sequence")
    debits = lines.where("indicator = 'D'").groupBy("reconciliation_id").agg(F.min(place).alias("_first"))
    if stored is not None:  # a reconciliation that is there already was made before every line
        kinds = [lines.schema[c].dataType for c in ("statement_order", "entry_sequence")]
        before = F.struct(*[F.lit(-(1 << 31)).cast(k).alias(c) for c, k in zip(("statement_order", "entry_sequence"), kinds)])
        debits = debits.unionByName(stored.select("reconciliation_id", before.alias("_first")))
    return judge(lines, targets(disbursement, geo_batches), debits)


def targets(disbursement: DataFrame, geo_batches: DataFrame) -> DataFrame:
    """(reconciliation_id, target) of everything a line may refer to."""
    return disbursement.select(F.col("disbursement_id").alias("reconciliation_id"), F.lit("disbursement").alias("target")).unionByName(
        geo_batches.select(F.col("geo_batch_id").alias("reconciliation_id"), F.lit("geo_batch").alias("target")))


def judge(lines: DataFrame, known: DataFrame, first: DataFrame) -> DataFrame:
    """Outcome of debit and reversal lines, given what ids refer to and the place of each id's first debit (``_first``)."""
    lines = lines.where(F.col("indicator").isin("D", "RD"))
    place = F.struct("statement_order", "entry_sequence")
    # All that is known of an id is one row, so its lines are joined once.
    facts = known.unionByName(first, allowMissingColumns=True).groupBy("reconciliation_id").agg(F.min("target").alias("target"), F.min("_first").alias("_first"))
    out = join_groups(lines, facts, ["reconciliation_id"], "left")
    debit = F.col("indicator") == "D"
    earlier = F.coalesce(F.col("_first.statement_order") <= F.col("statement_order"), F.lit(False))
    outcome = (
        F.when(F.col("target").isNull(), "INVALID_RECONCILIATION_ID")
        .when(debit & (place != F.col("_first")), "DUPLICATE_DISBURSEMENT")
        .when(debit, "RECONCILED")
        .when(earlier, "REVERSED")
        .otherwise("INVALID_REVERSAL")
    )
    return out.withColumn("outcome", outcome).select(*lines.columns, "target", "outcome")


def recon_records(judged: DataFrame) -> DataFrame:
    """One row per reconciled id with the last reversal, if there is one."""
    place = F.struct("statement_order", "entry_sequence")
    made = judged.where("outcome = 'RECONCILED'")
    back = judged.where("outcome = 'REVERSED'").groupBy("reconciliation_id").agg(
        F.max_by(F.struct("statement_id", "entry_sequence"), place).alias("_r"))
    return made.join(back, "reconciliation_id", "left").select(
        "reconciliation_id", "target", "statement_id", "entry_sequence", "amount",
        F.col("_r").isNotNull().alias("reversal_found"), F.col("_r.statement_id").alias("reversal_statement_id"),
        F.col("_r.entry_sequence").alias("reversal_entry_sequence"))


def error_records(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("outcome").isin("RECONCILED", "REVERSED")).select(
        "statement_id", "entry_sequence", "reconciliation_id", "outcome", "amount")
