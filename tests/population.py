"""Synthetic beneficiaries: an honest profile, nine fraud scenarios, noise and borderline cases.

Every draw is a hash of (row number, draw number, seed), so a row is the same
in any partitioning and after any retry.  Distributions follow fixed values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.functions import scoring

# Scenario names, in order.
SCENARIOS = [
    "multi_enrollment", "shared_phone", "ghost_household", "payment_manipulation", "identity_fraud",
    "income_underreporting", "coordinated_fraud", "systematic_ghost", "network_exploitation",
]
# Noise per column (standard deviation).
NOISE = {
    "income": 0.15, "pmt_score": 0.08, "payment_gap_ratio": 0.10, "network_risk": 0.10, "income_per_person": 0.12,
    "shared_phone_count": 0.5, "shared_account_count": 0.4, "nb_programs": 0.3,
}
N_CYCLES = 3


class Draws:
    """Numbered random columns over a row number."""

    def __init__(self, idx: Column, seed: int):
        self.idx, self.seed, self.n = idx, seed, 0

    def uniform(self, lo: float = 0.0, hi: float = 1.0) -> Column:
        self.n += 1
        bits = F.shiftrightunsigned(F.xxhash64(self.idx, F.lit(self.n), F.lit(self.seed)), 11)
        return lo + (bits.cast("double") + 0.5) / float(2**53) * (hi - lo)

    def normal(self, mean, sd: float) -> Column:
        u, v = self.uniform(), self.uniform()
        return mean + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)

    def integer(self, lo: int, hi) -> Column:
        return F.floor(lo + self.uniform() * (hi - lo + 1)).cast("int")

    def choice(self, weights: dict) -> Column:
        u, upto, out = self.uniform(), 0.0, None
        for value, p in list(weights.items())[:-1]:
            upto += p
            out = F.when(u < upto, value) if out is None else out.when(u < upto, value)
        return out.otherwise(list(weights)[-1])


def population(ids: DataFrame, n_total: int, fraud_rate: float = 0.12, seed: int = 42) -> DataFrame:
    """One row per id; ``ids`` holds idx = 0 .. n_total - 1.  The last rows are the fraud cases."""
    n_legit = n_total - int(n_total * fraud_rate)
    c = F.col
    d = Draws(c("idx"), seed)
    clamp = scoring.clamp
    scenario = F.when(c("idx") < n_legit, "legitimate").otherwise(F.element_at(
        F.array(*[F.lit(s) for s in SCENARIOS]), (F.pmod(c("idx") - n_legit, F.lit(len(SCENARIOS))) + 1).cast("int")))
    df = ids.select("idx").withColumn("scenario", scenario)

    def by_scenario(default: Column, **cases: Column) -> Column:
        out = None
        for name, value in cases.items():
            out = F.when(c("scenario") == name, value) if out is None else out.when(c("scenario") == name, value)
        return out.otherwise(default)

    def pmt(mean: float, sd: float, extra: float, lo: float, hi: float) -> Column:
        return clamp(d.normal(F.lit(mean), sd) + d.normal(F.lit(0.0), extra), lo, hi)

    def money(mean: float, sd: float, extra: float, lo: float, hi: float) -> Column:
        return clamp(d.normal(F.lit(mean), sd) + d.normal(F.lit(0.0), extra), lo, hi)

    df = df.withColumns({
        "is_fraud": (c("scenario") != "legitimate").cast("int"),
        "age": d.integer(21, 74), "gender": d.choice({"male": 0.5, "female": 0.5}),
        "household_size": by_scenario(
            clamp(d.normal(F.lit(4.0), 2.0).cast("int"), 1, 14).cast("int"),
            ghost_household=d.integer(7, 12), systematic_ghost=d.integer(8, 13)),
        "nb_programs": by_scenario(
            d.choice({1: 0.35, 2: 0.40, 3: 0.20, 4: 0.05}), multi_enrollment=d.integer(4, 5),
            identity_fraud=d.integer(3, 5), income_underreporting=d.integer(2, 4), coordinated_fraud=d.integer(4, 5),
            network_exploitation=d.integer(3, 5)),
        "base_programs": d.choice({1: 0.35, 2: 0.40, 3: 0.20, 4: 0.05}),
        "has_disabled": (d.uniform() < 0.07).cast("int"),
        "single_head": by_scenario((d.uniform() < 0.14).cast("int"), ghost_household=F.lit(1)),
        "nb_elderly": clamp(d.normal(F.lit(0.4), 0.7).cast("int"), 0, 4).cast("int"),
        "income": F.round(by_scenario(
            money(900, 500, 150, 60, 8000), ghost_household=money(500, 250, 100, 80, 2500),
            income_underreporting=money(280, 180, 80, 50, 900), systematic_ghost=money(380, 200, 100, 60, 1800)), 2),
        "pmt_score": F.round(by_scenario(
            pmt(0.60, 0.18, 0.06, 0.08, 1.0), multi_enrollment=pmt(0.45, 0.18, 0.07, 0.08, 0.85),
            ghost_household=pmt(0.40, 0.18, 0.07, 0.08, 0.80), payment_manipulation=pmt(0.38, 0.18, 0.07, 0.08, 0.80),
            identity_fraud=pmt(0.42, 0.18, 0.07, 0.08, 0.85), income_underreporting=pmt(0.55, 0.15, 0.06, 0.20, 0.90),
            coordinated_fraud=pmt(0.38, 0.18, 0.07, 0.05, 0.72), systematic_ghost=pmt(0.35, 0.18, 0.07, 0.05, 0.72),
            network_exploitation=pmt(0.40, 0.20, 0.08, 0.05, 0.80)), 4),
        "shared_phone_count": by_scenario(
            d.choice({0: 0.72, 1: 0.18, 2: 0.07, 3: 0.03}), shared_phone=d.integer(3, 6), identity_fraud=d.integer(2, 4),
            coordinated_fraud=d.integer(3, 6), network_exploitation=d.integer(4, 8)),
        "shared_account_count": by_scenario(
            d.choice({0: 0.78, 1: 0.17, 2: 0.05}), shared_phone=d.integer(1, 3), identity_fraud=d.integer(2, 4),
            coordinated_fraud=d.integer(2, 5), network_exploitation=d.integer(3, 6)),
        "success": by_scenario(
            d.uniform(0.60, 1.0), payment_manipulation=d.uniform(0.30, 0.65),
            income_underreporting=d.uniform(0.80, 1.0), systematic_ghost=d.uniform(0.35, 0.65)),
        "amount_per_payment": F.round(d.uniform(150, 500), 2),
        "avg_enrollment_days": d.integer(365, 1825), "group_membership_count": d.integer(0, 1),
        "z": F.abs(d.normal(F.lit(0.0), 1.0)),
    })
    size = c("household_size")
    phone, account = c("shared_phone_count"), c("shared_account_count")
    df = df.withColumns({
        "nb_children": by_scenario(
            F.greatest(F.lit(0), F.least(d.normal(size * 0.38, 1.5).cast("int"), size - 1)),
            ghost_household=d.integer(4, size - 1), systematic_ghost=d.integer(5, size - 1)),
        "pmt_score_min": F.round(F.greatest(F.lit(0.05), c("pmt_score") - F.abs(d.normal(F.lit(0.0), 0.08))), 4),
        "payment_count": c("base_programs") * N_CYCLES,
        "nb_active_programs": c("base_programs"),
        "network_risk": F.round(by_scenario(
            F.least(phone / 5, F.lit(1.0)) * 0.4 + F.least(account / 5, F.lit(1.0)) * 0.6 + 0.05 * c("z"),
            shared_phone=clamp(phone * 0.09 + account * 0.12 + 0.12 * c("z")),
            identity_fraud=clamp(account * 0.13 + phone * 0.09 + 0.13 * c("z")),
            coordinated_fraud=clamp(phone * 0.12 + account * 0.15 + 0.14 * c("z")),
            network_exploitation=clamp(phone * 0.15 + account * 0.18 + 0.16 * c("z"))), 3),
    })
    paid = F.floor(c("payment_count") * c("success"))
    df = df.withColumn("payment_gap_ratio", F.round(1 - paid / c("payment_count"), 3))
    p = 1 - c("payment_gap_ratio")
    amount = c("amount_per_payment")
    return df.withColumns({
        "payment_success_rate": F.round(p, 3), "amount_variance": F.round(p * (1 - p) * amount * amount, 2),
        "cycle_count": F.least(c("payment_count"), F.lit(N_CYCLES)),
        "total_issued": F.round(c("payment_count") * amount, 2), "total_paid": F.round(paid * amount, 2),
        "income_per_person": F.round(c("income") / size, 2),
        "dependency_ratio": scoring.dependency_ratio(size, c("nb_children"), c("nb_elderly")),
    }).drop("success", "z", "base_programs")


def with_noise(df: DataFrame, n_total: int, fraud_rate: float = 0.12, seed: int = 43) -> DataFrame:
    """Gaussian noise clipped at 0; the first 8 % of fraud rows copy four features of a random honest row."""
    d = Draws(F.col("idx"), seed)
    df = df.withColumns({k: F.greatest(F.col(k) + d.normal(F.lit(0.0), s), F.lit(0.0)) for k, s in NOISE.items()
                         if k in df.columns})
    n_fraud = int(n_total * fraud_rate)
    n_legit, n_border = n_total - n_fraud, int(n_fraud * 0.08)
    copied = ["pmt_score", "shared_phone_count", "nb_programs", "network_risk"]
    border = (F.col("idx") >= n_legit) & (F.col("idx") < n_legit + n_border)
    donors = df.where(F.col("idx") < n_legit).select(F.col("idx").alias("donor"), *[
        F.col(k).alias(f"_{k}") for k in copied])
    picked = df.where(border).withColumn("donor", F.floor(d.uniform() * n_legit)).join(donors, "donor")
    replaced = picked.withColumns({k: F.col(f"_{k}") for k in copied}).select(*df.columns)
    out = df.where(~border).unionByName(replaced)
    return out.withColumn("income_per_person", F.round(F.col("income") / F.greatest(F.col("household_size"), F.lit(1)), 2))


def normalised_tables(people: DataFrame, n_programs: int = 5, n_cycles: int = N_CYCLES) -> dict[str, DataFrame]:
    """The wide rows as registry tables: partner, phone, account, membership, cycle, entitlement, payment."""
    programs = people.select("idx", F.explode(F.sequence(F.lit(0), F.least(
        F.greatest(F.round("nb_programs").cast("int"), F.lit(1)), F.lit(n_programs)) - 1)).alias("program_id"),
        "amount_per_payment", "payment_success_rate")
    cycles = programs.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n_cycles - 1)))).withColumn(
        "entitlement_id", (F.col("idx") * n_programs + F.col("program_id")) * n_cycles + F.col("n"))
    paid = Draws(F.col("entitlement_id"), 7).uniform() < F.col("payment_success_rate")
    return {
        "partner": people.select(F.col("idx").alias("partner_id"), "income", "gender", "age"),
        "phone_number": people.select(F.col("idx").alias("partner_id"), F.concat(
            F.lit("P"), F.when(F.col("shared_phone_count") >= 1, F.floor(F.col("idx") / (F.col("shared_phone_count") + 1)))
            .otherwise(F.col("idx")).cast("string")).alias("phone_no")),
        "bank_account": people.select(F.col("idx").alias("partner_id"), F.concat(F.lit("A"), F.when(
            F.col("shared_account_count") >= 1, F.floor(F.col("idx") / (F.col("shared_account_count") + 1)))
            .otherwise(F.col("idx")).cast("string")).alias("acc_number")),
        "program_membership": programs.select(F.col("idx").alias("partner_id"), "program_id", F.lit("enrolled").alias("state")),
        "cycle": cycles.select((F.col("program_id") * n_cycles + F.col("n")).alias("cycle_id"), "program_id").distinct(),
        "cycle_membership": cycles.select((F.col("program_id") * n_cycles + F.col("n")).alias("cycle_id"),
                                          F.col("idx").alias("partner_id")),
        "entitlement": cycles.select("entitlement_id", F.col("idx").alias("partner_id"), (
            F.col("program_id") * n_cycles + F.col("n")).alias("cycle_id"), F.col("amount_per_payment").alias("initial_amount")),
        "payment": cycles.select("entitlement_id", F.col("amount_per_payment").alias("amount_issued"), F.when(
            paid, F.col("amount_per_payment")).otherwise(0.0).alias("amount_paid")),
        "group_membership": people.where("group_membership_count > 0").select(
            F.floor(F.col("idx") / 5).alias("group_id"), F.col("idx").alias("individual_id")),
    }
