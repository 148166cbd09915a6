"""Beneficiary features: one row per registrant, 25 model columns and a few totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.fixed import FEATURE_DEFAULTS, SYSTEM_NAMES
from benefica.functions import dates, scoring, text
from benefica.operators.sharing import other_owners
from benefica.scale import exact_quantiles, stage


def base_filter(df: DataFrame) -> DataFrame:
    """Active registrants that are neither companies nor system accounts."""
    return df.where(
        F.coalesce("active", F.lit(True))
        & ~F.coalesce("is_company", F.lit(False))
        & F.coalesce("is_registrant", F.lit(False))
        & ~F.col("name").isin(SYSTEM_NAMES)
    )


def base_beneficiaries(registrant: DataFrame, as_of: Column) -> DataFrame:
    zero = F.lit(0)
    return base_filter(registrant).select(
        "partner_id",
        dates.age_or_default(F.col("birthdate"), as_of).alias("age"),
        text.lower_or_unknown(F.col("gender")).alias("gender"),
        F.coalesce("income", F.lit(0.0)).alias("income"),
        F.lit(1).alias("household_size"), zero.alias("nb_children"), zero.alias("nb_elderly"),
        zero.alias("has_disabled"), zero.alias("single_head"), zero.alias("elderly_head"),
        dates.days_since(F.col("create_date"), as_of).alias("registration_age_days"),
    )


def program_features(membership: DataFrame, as_of: Column) -> DataFrame:
    return membership.groupBy("partner_id").agg(
        F.countDistinct("program_id").alias("nb_programs"),
        F.countDistinct(F.when(F.col("state") == "enrolled", F.col("program_id"))).alias("nb_active_programs"),
        F.round(F.avg(F.datediff(as_of, "enrollment_date"))).cast("int").alias("avg_enrollment_days"),
    )


def payment_features(payment: DataFrame, entitlement: DataFrame) -> DataFrame:
    """Payments met with their entitlement, then one row per beneficiary."""
    issued, paid = F.sum("amount_issued"), F.sum("amount_paid")
    return (
        payment.join(entitlement.select("entitlement_id", "partner_id", "cycle_id", "initial_amount"),
                     "entitlement_id")
        .groupBy("partner_id")
        .agg(
            F.count(F.lit(1)).alias("payment_count"),
            F.coalesce(issued, F.lit(0.0)).alias("total_issued"),
            F.coalesce(paid, F.lit(0.0)).alias("total_paid"),
            F.when(issued > 0, (issued - paid) / issued).otherwise(0.0).alias("payment_gap_ratio"),
            F.when(issued > 0, paid / issued).otherwise(0.0).alias("payment_success_rate"),
            F.coalesce(F.var_pop("amount_paid"), F.lit(0.0)).alias("amount_variance"),
            F.countDistinct("cycle_id").alias("cycle_count"),
            F.avg("initial_amount").alias("avg_entitlement_amount"),
        )
    )


def group_counts(group_membership: DataFrame) -> DataFrame:
    return group_membership.groupBy(F.col("individual_id").alias("partner_id")).agg(
        F.count(F.lit(1)).alias("group_membership_count"))


def shared_phones(phone_number: DataFrame, strict: bool = True) -> DataFrame:
    pairs = phone_number.select("partner_id", F.coalesce("phone_sanitized", "phone_no").alias("number"))
    return other_owners(pairs, "partner_id", "number", strict).withColumnRenamed("shared_count", "shared_phone_count")


def shared_accounts(bank_account: DataFrame, strict: bool = True) -> DataFrame:
    number = F.coalesce(text.blank_to_null(F.col("sanitized_acc_number")), "acc_number")
    pairs = bank_account.where("active").select("partner_id", number.alias("number"))
    return other_owners(pairs, "partner_id", "number", strict).withColumnRenamed(
        "shared_count", "shared_account_count")


def feature_star(t, as_of: Column) -> DataFrame:
    """Base rows with six pre-aggregated sides, all keyed and shuffled on partner_id once."""
    out = base_beneficiaries(t.registrant, as_of)
    for side in (
        program_features(t.program_membership, as_of),
        payment_features(t.payment, t.entitlement),
        shared_phones(t.phone_number),
        shared_accounts(t.bank_account),
        group_counts(t.group_membership),
    ):
        out = out.join(side, "partner_id", "left")
    out = out.withColumns({"pmt_score": F.lit(0.5), "pmt_score_min": F.lit(0.5)})
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in FEATURE_DEFAULTS.items()})


def with_derived(star: DataFrame) -> DataFrame:
    c = F.col
    return star.withColumns({
        "income_per_person": scoring.income_per_person(c("income"), c("household_size")),
        "dependency_ratio": scoring.dependency_ratio(c("household_size"), c("nb_children"), c("nb_elderly")),
        "network_risk": scoring.network_risk(c("shared_phone_count"), c("shared_account_count")),
    })


def thresholds(features: DataFrame) -> tuple[float, float]:
    """Exact 95 % quantile of issued totals and 15 % quantile of income per person."""
    long = features.unpivot([], ["total_issued", "income_per_person"], "_feature", "_value")
    rows = exact_quantiles(long, "_value", {"q95": 0.95, "q15": 0.15}, keys=["_feature"]).collect()  # two rows
    cut = {r["_feature"]: r for r in rows}
    return cut["total_issued"]["q95"], cut["income_per_person"]["q15"]


def with_threshold_flags(features: DataFrame, q95: float, q15: float) -> DataFrame:
    return features.withColumns({
        "high_amount_flag": (F.col("total_issued") > F.lit(q95)).cast("int"),
        "income_program_inconsistency": (
            (F.col("income_per_person") < F.lit(q15)) & (F.col("nb_programs") >= 3)).cast("int"),
    })


def beneficiary_features(t, as_of: Column) -> DataFrame:
    derived = stage(with_derived(feature_star(t, as_of)), "features")
    return with_threshold_flags(derived, *thresholds(derived))
