"""Funds, scores, entitlements, approval, priority lists and payment batches of programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.scale import running

# --- funds ----------------------------------------------------------------------------------------------------


def fund_balances(funds: DataFrame, entitlement: DataFrame, keys: Sequence[str] = ("program_id",)) -> DataFrame:
    """Posted funds less approved entitlements per program (and company)."""
    posted = funds.where("state = 'posted'").groupBy(*keys).agg(F.sum("amount").alias("posted"))
    used = entitlement.where("state = 'approved'").groupBy(*keys).agg(F.sum("initial_amount").alias("approved"))
    zero = F.lit(0.0)
    return posted.join(used, list(keys), "full").select(
        *keys, F.coalesce("posted", zero).alias("posted"), F.coalesce("approved", zero).alias("approved"),
        (F.coalesce("posted", zero) - F.coalesce("approved", zero)).alias("balance"))


def fund_report(funds: DataFrame, payouts: DataFrame) -> DataFrame:
    """Posted funds and outbound payouts (negative) as one ledger."""
    inflow = funds.where("state = 'posted'").select("name", "program_id", "date_posted", "amount")
    outflow = payouts.select(F.col("code").alias("name"), "partner_id", "program_id", "cycle_id", "date_posted",
                             (-F.col("amount")).alias("amount"))
    return inflow.unionByName(outflow, allowMissingColumns=True)


def numbered_ledger(ledger: DataFrame) -> DataFrame:
    """Ledger rows numbered by posting date; name, partner and amount break ties."""
    order = [F.col(c).asc_nulls_first() for c in ("date_posted", "name", "partner_id", "cycle_id", "amount")]
    return running(ledger, [], order, position="id")


# --- scores and amounts ---------------------------------------------------------------------------------------

def pmt_scores(registrants: DataFrame, weights: Sequence[dict]) -> DataFrame:
    """Weighted sums of attributes.

    ``weights`` lists {"target": individual | group, "kind": ..., "field": ..., "weight": ...}; groups use the
    set of their kind, and a registrant without a set scores 0.
    """
    total = F.lit(0.0)
    for w in weights:
        applies = F.col("is_group") == F.lit(w["target"] == "group")
        if w["target"] == "group":
            applies = applies & (F.col("kind") == w["kind"])
        value = F.coalesce(F.col(w["field"]).cast("double"), F.lit(0.0)) * float(w["weight"])
        total = total + F.when(applies, value).otherwise(0.0)
    return registrants.withColumn("pmt_score", total)


def entitlement_amount(is_group: Column, members: Column, base: float, per_member: float, max_members: int) -> Column:
    counted = F.least(members, F.lit(max_members)) if max_members else members
    return F.lit(base) + F.when(is_group, F.coalesce(counted, F.lit(0)) * per_member).otherwise(0.0)


def transfer_fee(amount: Column, percent: float, fixed: float) -> Column:
    if percent > 0:
        return amount * (percent / 100.0)
    return F.lit(float(fixed))


def itemised_amount(items: Sequence[dict], cap: float = 0.0, inflation: float | None = None) -> Column:
    """Sum of items in order, held at ``cap`` after every item, then inflated.

    Item: {"condition": Column | None, "amount": number | None, "amount_field": name | None,
    "multiplier_field": name | None, "max_multiplier": number}.  NULL when no item applies.
    """
    parts = []
    for it in items:
        times = F.coalesce(F.col(it["multiplier_field"]), F.lit(0)) if it.get("multiplier_field") else F.lit(1)
        if it.get("max_multiplier"):
            times = F.least(times, F.lit(it["max_multiplier"]))
        unit = F.coalesce(F.col(it["amount_field"]), F.lit(0)) if it.get("amount_field") else F.lit(it["amount"])
        amount = unit.cast("double") * times.cast("double")
        parts.append(F.when(it["condition"], amount) if it.get("condition") is not None else amount)
    amounts = F.filter(F.array(*parts), lambda x: x.isNotNull())

    def add(acc: Column, x: Column) -> Column:
        return F.least(acc + x, F.lit(float(cap))) if cap > 0 else acc + x

    total = F.aggregate(amounts, F.lit(0.0), add)
    if inflation:
        total = total * inflation
    return F.when(F.size(amounts) > 0, total)


def prepare_entitlements(beneficiaries: DataFrame, existing: DataFrame, amount: Column) -> DataFrame:
    """Positive draft entitlements for (cycle, partner) pairs that have none."""
    fresh = beneficiaries.join(existing.select("cycle_id", "partner_id"), ["cycle_id", "partner_id"], "left_anti")
    return fresh.withColumn("initial_amount", amount).where("initial_amount > 0").withColumn("state", F.lit("draft"))


def approve(entitlement: DataFrame, balances: DataFrame, key: str = "program_id", order: str = "entitlement_id") -> DataFrame:
    """Approve in order while the balance lasts; the first that does not fit stops its program.

    Amounts are not negative, so the running sum grows and "sum so far fits" is
    the same as stopping at the first misfit.  Rows in another state are state
    errors and take nothing from the balance.
    """
    open_ = F.col("state").isin("draft", "pending_validation")
    asked = entitlement.withColumn("_ask", F.when(open_, F.col("initial_amount")).otherwise(0.0))
    summed = running(asked, [key], [F.col(order)], sums={"_sum": "_ask"}, position=None)
    fits = F.col("_sum") <= F.coalesce("balance", F.lit(0.0)) + 1e-6
    return summed.join(balances.select(key, "balance"), key, "left").withColumn(
        "decision", F.when(~open_, "state_error").when(fits, "approved").otherwise("insufficient_funds")
    ).select(*entitlement.columns, "decision")


# --- order ----------------------------------------------------------------------------------------------------

def sort_columns(criteria: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort keys from (field, direction) pairs; missing values count as the largest."""
    return [F.col(f).desc_nulls_first() if d == "desc" else F.col(f).asc_nulls_last() for f, d in criteria]


def priority_list(candidates: DataFrame, keys: Sequence[str], criteria: Sequence[tuple[str, str]], limit: Column,
                  id_column: str = "partner_id") -> DataFrame:
    """Candidates ranked by the criteria, cut at each list's remaining places."""
    ranked = running(candidates, list(keys), [*sort_columns(criteria), F.col(id_column)], position="rank")
    return ranked.where(F.col("rank") <= limit)


def first_tag(tags: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first tag whose condition holds, NULL when none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in tags])


def payment_batches(entitlement: DataFrame, failed_only: DataFrame | None, tags: Sequence[tuple[str, Column, int]],
                    accounts: DataFrame) -> DataFrame:
    """Payments for approved entitlements, routed to a tag and numbered into batches of the tag's size.

    ``failed_only`` names entitlements with a payment that did not fail; these are not paid again.
    """
    due = entitlement.where("state = 'approved'")
    if failed_only is not None:
        due = due.join(failed_only, "entitlement_id", "left_anti")
    routed = due.withColumn("tag", first_tag([(n, c) for n, c, _ in tags])).where("tag IS NOT NULL")
    placed = running(routed, ["tag"], [F.col("entitlement_id")], position="_place")
    size = None
    for name, _, s in tags:
        size = F.when(F.col("tag") == name, s) if size is None else size.when(F.col("tag") == name, s)
    first = accounts.groupBy("partner_id").agg(F.min_by("acc_number", "account_id").alias("account_number"))
    place = F.col("_place") - 1
    return placed.withColumn("batch", F.concat_ws("/", "tag", F.floor(place / size).cast("string"))).withColumn(
        "row_in_batch", place % size).join(first, "partner_id", "left").select(
        "entitlement_id", "cycle_id", "partner_id", "tag", "batch", "row_in_batch",
        F.col("initial_amount").alias("amount_issued"), F.col("transfer_fee").alias("payment_fee"), "account_number")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key: one partial aggregate, no sort."""
    newest = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")
