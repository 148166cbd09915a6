"""Who may join a program, and what happens to those who may not."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.operators.domain import Relation, domain_filter

Manager = Callable[[DataFrame], DataFrame]


def default_manager(target: str, domain: Sequence = (), relations: dict[str, Relation] | None = None) -> Manager:
    """Enabled registrants of the program's target type that satisfy its domain."""

    def apply(registrants: DataFrame) -> DataFrame:
        kept = registrants.where(
            F.col("disabled").isNull() & F.coalesce("is_registrant", F.lit(False))
            & (F.col("is_group") == F.lit(target == "group")))
        return domain_filter(kept, list(domain), relations) if domain else kept

    return apply


def id_document_manager(reg_id: DataFrame, as_of: Column, id_types: Sequence[str] = ()) -> Manager:
    """At least one document without an expiry date or with a later one."""
    valid = reg_id.where(F.col("expiry_date").isNull() | (F.col("expiry_date") > as_of))
    if id_types:
        valid = valid.where(F.col("id_type").isin(list(id_types)))
    return lambda registrants: registrants.join(valid.select("partner_id"), "partner_id", "left_semi")


def phone_manager(phone_number: DataFrame) -> Manager:
    """At least one number that is not disabled."""
    usable = phone_number.where(F.col("disabled").isNull()).select("partner_id")
    return lambda registrants: registrants.join(usable, "partner_id", "left_semi")


def reimbursement_manager() -> Manager:
    """Service providers: neither group nor registrant."""
    return lambda registrants: registrants.where(
        (F.col("supplier_rank") > 0) & ~F.col("is_group") & ~F.coalesce("is_registrant", F.lit(False)))


# Managers a program may name in its settings; each entry builds one from the tables and its options.
MANAGERS: dict[str, Callable[..., Manager]] = {
    "default": lambda tables, as_of, **o: default_manager(o.get("target", "individual"), o.get("domain", ())),
    "id_document": lambda tables, as_of, **o: id_document_manager(tables.reg_id, as_of, o.get("id_types", ())),
    "phone": lambda tables, as_of, **o: phone_manager(tables.phone_number),
    "reimbursement": lambda tables, as_of, **o: reimbursement_manager(),
}


def chosen_managers(settings: Sequence[dict], tables, as_of: Column) -> list[Manager]:
    """Managers by name: {"kind": ..., options}; own managers can be added to MANAGERS."""
    return [MANAGERS[s["kind"]](tables, as_of, **{k: v for k, v in s.items() if k != "kind"}) for s in settings]


def chain(registrants: DataFrame, managers: Sequence[Manager]) -> DataFrame:
    """Every manager narrows what the one before it left."""
    for m in managers:
        registrants = m(registrants)
    return registrants


def enrol(membership: DataFrame, registrants: DataFrame, managers: Sequence[Manager]) -> DataFrame:
    """Memberships with their new state: enrolled when all managers accept, else not eligible."""
    ok = chain(registrants, managers).select("partner_id", F.lit(True).alias("_ok"))
    return membership.join(ok, "partner_id", "left").withColumn(
        "new_state", F.when(F.coalesce("_ok", F.lit(False)), "enrolled").otherwise("not_eligible")).drop("_ok")


def cancel_entitlements(entitlement: DataFrame, refused: DataFrame) -> DataFrame:
    """Entitlements of refused members become cancelled; all others keep their state."""
    gone = refused.select("partner_id", "program_id").distinct().withColumn("_gone", F.lit(True))
    return entitlement.join(gone, ["partner_id", "program_id"], "left").withColumn(
        "state", F.when(F.coalesce("_gone", F.lit(False)), "cancelled").otherwise(F.col("state"))).drop("_gone")


def not_yet_members(eligible: DataFrame, membership: DataFrame) -> DataFrame:
    return eligible.join(membership.select("partner_id"), "partner_id", "left_anti")


def import_counts(selected: DataFrame, membership: DataFrame) -> DataFrame:
    """How many were selected, already there, and added."""
    there = membership.select("partner_id").distinct().withColumn("_there", F.lit(True))
    return selected.select("partner_id").distinct().join(there, "partner_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_there").alias("ignored"),
        F.count_if(F.col("_there").isNull()).alias("added"))


def auto_enrol(registrants: DataFrame, programs: Sequence[tuple[int, str, Sequence]],
               relations: dict[str, Relation] | None = None) -> DataFrame:
    """(partner_id, program_id) for each program whose domain a registrant satisfies: one filter per program."""
    out = None
    for program_id, target, domain in programs:
        kept = default_manager(target, domain, relations)(registrants).select(
            "partner_id", F.lit(program_id).alias("program_id"), F.lit("draft").alias("state"))
        out = kept if out is None else out.unionByName(kept)
    return out
