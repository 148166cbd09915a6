"""Managers of programs: a settings table says which kind each program uses, and one plan serves all programs.

``settings`` holds program_id, role (eligibility, deduplication, entitlement, payment, cycle), name and options, a map of
texts.  Every manager is a column over the facts of a membership and the options of its setting, so a program's choice is
data: programs with different managers are rows of one job, not jobs of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.operators.dedup import valid_documents
from benefica.scale import join_groups

ROLES = ("eligibility", "deduplication", "entitlement", "payment", "cycle")
Manager = Callable[[Column], Column]


def number(options: Column, name: str, default: float) -> Column:
    return F.coalesce(F.try_element_at(options, F.lit(name)).try_cast("double"), F.lit(default))


def word(options: Column, name: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(options, F.lit(name)), F.lit(default))


def _default_target(o: Column) -> Column:
    kind = F.when(F.col("is_group"), "group").otherwise("individual")
    return F.col("is_registrant") & F.col("disabled").isNull() & (kind == word(o, "target", "individual")) & (
        F.coalesce(F.col("income"), F.lit(0.0)) >= number(o, "least_income", -1e300))


def _group_amount(o: Column) -> Column:
    counted = F.least(F.coalesce("members", F.lit(0)).cast("double"), number(o, "max_members", 1e300))
    return number(o, "base", 0.0) + F.when(F.col("is_group"), counted * number(o, "per_member", 0.0)).otherwise(0.0)


def _cycle_end(days: Callable[[Column], Column]) -> Manager:
    return lambda o: F.date_add(F.col("cycle_start"), (days(o) - 1).cast("int"))


# Managers by role and name; own managers can be added.
MANAGERS: dict[str, dict[str, Manager]] = {
    "eligibility": {
        "default": _default_target,
        "id_document": lambda o: F.coalesce(F.array_contains("documents", word(o, "id_type", "National ID")), F.lit(False)),
        "phone": lambda o: F.coalesce("has_phone", F.lit(False)),
    },
    "deduplication": {
        "id": lambda o: F.coalesce(F.array_contains("shared_documents", word(o, "id_type", "National ID")), F.lit(False)),
        "phone": lambda o: F.coalesce("shares_phone", F.lit(False)),
    },
    "entitlement": {
        "default": _group_amount,
        "share_of_income": lambda o: F.greatest(F.coalesce("income", F.lit(0.0)) * number(o, "share", 0.0), number(o, "least", 0.0)),
    },
    "payment": {
        "account": lambda o: F.when(F.col("has_account"), F.concat(F.lit("account/"), word(o, "currency", "EUR"))),
        "cash": lambda o: F.concat(F.lit("cash/"), F.coalesce(F.col("zone_id").cast("string"), F.lit("none"))),
    },
    "cycle": {
        "days": _cycle_end(lambda o: number(o, "days", 30.0)),
        "months": lambda o: F.date_add(F.add_months("cycle_start", number(o, "months", 1.0).cast("int")), -1),
    },
}


def settings_by_program(settings: DataFrame, managers: Mapping[str, Mapping[str, Manager]] | None = None) -> DataFrame:
    """One row per program: for each role the array of its managers (name, options), in order of name.

    A setting that names no known manager is an error, which one small count finds before the job runs.
    """
    managers = managers or MANAGERS
    known = F.lit(False)
    for role, kinds in managers.items():
        known = known | ((F.col("role") == role) & F.col("name").isin(list(kinds)))
    bad = settings.where(~F.coalesce(known, F.lit(False))).select("role", "name").limit(1).collect()
    if bad:
        raise ValueError(f"no {bad[0].role} manager {bad[0].name}")
    setting = F.struct("name", F.array_sort(F.map_entries("options")).alias("options"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("role") == r, setting))).alias(r) for r in managers]
    return settings.groupBy("program_id").agg(*lists)


def _choice(role: str, setting: Column, managers: Mapping[str, Mapping[str, Manager]]) -> Column:
    """The column of the manager that a setting names."""
    options = F.map_from_entries(setting["options"])
    out = None
    for name, manager in managers[role].items():
        hit = setting["name"] == name
        out = F.when(hit, manager(options)) if out is None else out.when(hit, manager(options))
    return out


def facts(t, as_of: Column) -> DataFrame:
    """What managers ask about a registrant, one row each."""
    documents = valid_documents(t.reg_id, as_of, ["National ID", "Household ID"])
    valid = documents.groupBy("partner_id").agg(F.collect_set("id_type").alias("documents"))
    several = t.reg_id.groupBy("id_type", "value").agg(F.count_distinct("partner_id").alias("_n")).where("_n > 1").select("id_type", "value")
    shared = join_groups(t.reg_id, several, ["id_type", "value"], "left_semi").groupBy("partner_id").agg(F.collect_set("id_type").alias("shared_documents"))
    phones = t.phone_number.where("phone_sanitized IS NOT NULL AND disabled IS NULL")
    more = phones.groupBy("phone_sanitized").agg(F.count_distinct("partner_id").alias("_n")).where("_n > 1").select("phone_sanitized")
    has_phone = phones.groupBy("partner_id").agg(F.lit(True).alias("has_phone"))
    shares = join_groups(phones, more, ["phone_sanitized"], "left_semi").groupBy("partner_id").agg(F.lit(True).alias("shares_phone"))
    members = t.group_membership.where("ended_date IS NULL").groupBy(F.col("group_id").alias("partner_id")).agg(F.count(F.lit(1)).alias("members"))
    accounts = t.bank_account.where("active").groupBy("partner_id").agg(F.lit(True).alias("has_account"))
    out = t.registrant.select("partner_id", "is_group", "is_registrant", "disabled", "income", "zone_id")
    for side in (valid, shared, has_phone, shares, members, accounts):
        out = out.join(side, "partner_id", "left")
    return out


def run_programs(membership: DataFrame, registrants: DataFrame, settings: DataFrame, cycle_start: Column,
                 managers: Mapping[str, Mapping[str, Manager]] | None = None) -> DataFrame:
    """Every membership under its program's managers: state, amount, payment batch and cycle end.

    All eligibility managers must accept a member (else not_eligible), any deduplication manager may mark it (duplicated);
    only enrolled members get an amount and a batch.  A program without an eligibility manager accepts all, one without
    another manager leaves its column NULL; of several entitlement, payment or cycle managers the first by name counts.
    """
    managers = managers or MANAGERS
    rows = membership.join(registrants, "partner_id").join(settings_by_program(settings, managers), "program_id", "left")
    rows = rows.withColumn("cycle_start", cycle_start)
    pick = lambda role: lambda s: F.coalesce(_choice(role, s, managers), F.lit(False))
    eligible = F.coalesce(F.forall("eligibility", pick("eligibility")), F.lit(True))
    twice = F.coalesce(F.exists("deduplication", pick("deduplication")), F.lit(False))
    state = F.when(~eligible, "not_eligible").when(twice, "duplicated").otherwise("enrolled")
    rows = rows.withColumn("new_state", state)
    first = lambda role: _choice(role, F.get(role, F.lit(0)), managers)
    enrolled = F.col("new_state") == "enrolled"
    return rows.select("membership_id", "partner_id", "program_id", "new_state", F.when(enrolled, first("entitlement")).alias("amount"),
                       F.when(enrolled, first("payment")).alias("batch"), first("cycle").alias("cycle_end"))
