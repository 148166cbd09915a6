"""Features, rules, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.fixed import (
    FEATURE_DEFAULTS, ML_FEATURES, REQUIRED_UPLOAD_COLUMNS, RULE_DEFAULTS, SCORING_DEFAULTS, SYSTEM_NAMES,
    TRAINING_DEFAULTS,
)
from benefica.functions import scoring
from benefica.operators import features, rules, validation
from benefica.plans.registry import query

def as_of():
    return F.lit("2002-01-01").cast("date")

BASE = f"""base AS (
    SELECT partner_id, coalesce(CAST(date_part('year', age(DATE '2002-01-01', birthdate)) AS INT), 35) AS age,
           lower(coalesce(gender, 'unknown')) AS gender, coalesce(income, 0) AS income,
           1 AS household_size, 0 AS nb_children, 0 AS nb_elderly, 0 AS has_disabled, 0 AS single_head,
           0 AS elderly_head,
           coalesce(CAST(date_diff('day', create_date, DATE '2002-01-01') AS INT), 365) AS registration_age_days
    FROM registrant
    WHERE coalesce(active, true) AND NOT coalesce(is_company, false) AND coalesce(is_registrant, false)
      AND name NOT IN ({", ".join(repr(n) for n in SYSTEM_NAMES)}))"""
PROG = """prog AS (
    SELECT partner_id, count(DISTINCT program_id) AS nb_programs,
           count(DISTINCT CASE WHEN state = 'enrolled' THEN program_id END) AS nb_active_programs,
           CAST(round(avg(date_diff('day', enrollment_date, DATE '2002-01-01'))) AS INT) AS avg_enrollment_days
    FROM program_membership GROUP BY partner_id)"""
PAY = """pay AS (
    SELECT e.partner_id, count(*) AS payment_count, sum(amount_issued) AS total_issued, sum(amount_paid) AS total_paid,
           CASE WHEN sum(amount_issued) > 0 THEN (sum(amount_issued) - sum(amount_paid)) / sum(amount_issued)
                ELSE 0 END AS payment_gap_ratio,
           CASE WHEN sum(amount_issued) > 0 THEN sum(amount_paid) / sum(amount_issued) ELSE 0 END
               AS payment_success_rate,
           var_pop(amount_paid) AS amount_variance, count(DISTINCT e.cycle_id) AS cycle_count,
           avg(e.initial_amount) AS avg_entitlement_amount
    FROM payment p JOIN entitlement e ON p.entitlement_id = e.entitlement_id GROUP BY e.partner_id)"""
PHONES = """phones AS (
    SELECT a.partner_id, count(DISTINCT b.partner_id) - 1 AS shared_phone_count
    FROM phone_number a JOIN phone_number b
      ON coalesce(a.phone_sanitized, a.phone_no) = coalesce(b.phone_sanitized, b.phone_no)
     AND a.partner_id <> b.partner_id
    GROUP BY a.partner_id)"""
ACCOUNTS = """accounts AS (
    SELECT a.partner_id, count(DISTINCT b.partner_id) - 1 AS shared_account_count
    FROM bank_account a JOIN bank_account b
      ON coalesce(nullif(a.sanitized_acc_number, ''), a.acc_number)
       = coalesce(nullif(b.sanitized_acc_number, ''), b.acc_number)
     AND a.partner_id <> b.partner_id AND a.active AND b.active
    GROUP BY a.partner_id)"""
GROUPS = """grp AS (
    SELECT individual_id AS partner_id, count(*) AS group_membership_count FROM group_membership
    GROUP BY individual_id)"""
STAR = f"""{BASE}, {PROG}, {PAY}, {PHONES}, {ACCOUNTS}, {GROUPS}, star AS (
    SELECT b.*, coalesce(nb_programs, 0) AS nb_programs, coalesce(nb_active_programs, 0) AS nb_active_programs,
           coalesce(avg_enrollment_days, 0) AS avg_enrollment_days, 0.5 AS pmt_score, 0.5 AS pmt_score_min,
           coalesce(payment_count, 0) AS payment_count, coalesce(total_issued, 0) AS total_issued,
           coalesce(total_paid, 0) AS total_paid, coalesce(payment_gap_ratio, 0) AS payment_gap_ratio,
           coalesce(payment_success_rate, 0) AS payment_success_rate, coalesce(amount_variance, 0) AS amount_variance,
           coalesce(cycle_count, 0) AS cycle_count, coalesce(avg_entitlement_amount, 0) AS avg_entitlement_amount,
           coalesce(shared_phone_count, 0) AS shared_phone_count,
           coalesce(shared_account_count, 0) AS shared_account_count,
           coalesce(group_membership_count, 0) AS group_membership_count,
           round(b.income / greatest(household_size, 1), 2) AS income_per_person,
           round((nb_children + nb_elderly) / greatest(household_size - nb_children - nb_elderly, 1), 3)
               AS dependency_ratio,
           round(least(least(coalesce(shared_phone_count, 0), 5) * 0.4
                 + least(coalesce(shared_account_count, 0), 5) * 0.6, 1.0), 4) AS network_risk
    FROM base b LEFT JOIN prog USING (partner_id) LEFT JOIN pay USING (partner_id)
         LEFT JOIN phones USING (partner_id) LEFT JOIN accounts USING (partner_id) LEFT JOIN grp USING (partner_id)),
  cuts AS (SELECT quantile_cont(total_issued, 0.95) AS q95, quantile_cont(income_per_person, 0.15) AS q15 FROM star),
  feat AS (SELECT star.*, CAST(total_issued > q95 AS INT) AS high_amount_flag,
                  CAST(income_per_person < q15 AND nb_programs >= 3 AS INT) AS income_program_inconsistency
           FROM star, cuts)"""
RULES = """ruled AS (
    SELECT *, network_risk AS network_risk_score,
        shared_account_count >= 2 AS r1, shared_phone_count >= 3 AS r2, nb_programs >= 4 AS r3, pmt_score <= 0.2 AS r4,
        payment_gap_ratio >= 0.5 AS r5, household_size >= 8 AND income_per_person < 70 AS r6,
        shared_phone_count >= 2 AND shared_account_count >= 2 AS r7, network_risk >= 0.6 AS r8,
        income_per_person < 50 AND nb_programs >= 3 AS r9,
        payment_gap_ratio >= 0.3 AND (shared_phone_count >= 2 OR shared_account_count >= 2) AS r10
    FROM feat)"""
RULE_SCORE = """round(least(0.35 * CAST(r1 AS INT) + 0.3 * CAST(r2 AS INT) + 0.3 * CAST(r3 AS INT)
    + 0.2 * CAST(r4 AS INT) + 0.3 * CAST(r5 AS INT) + 0.25 * CAST(r6 AS INT) + 0.4 * CAST(r7 AS INT)
    + 0.3 * CAST(r8 AS INT) + 0.2 * CAST(r9 AS INT) + 0.35 * CAST(r10 AS INT), 1.0), 4)"""
SERVICE = """svc AS (
    SELECT *, least(1.0, 0.3 * CAST(shared_account_count >= 2 AS INT) + 0.25 * CAST(shared_phone_count >= 2 AS INT)
           + 0.2 * CAST(payment_gap_ratio > 0.5 AS INT) + 0.15 * CAST(nb_programs > 3 AS INT)
           + 0.05 * CAST(has_disabled = 1 AS INT) + 0.05 * CAST(income_program_inconsistency = 1 AS INT)) AS rule_s,
           0.5 * tanh(shared_phone_count / 3.0) + 0.5 * tanh(shared_account_count / 3.0) AS graph_s
    FROM feat)"""


def level_sql(score: str, a: float, b: float, c: float) -> str:
    return (f"CASE WHEN {score} >= {a} THEN 'CRITICAL' WHEN {score} >= {b} THEN 'HIGH' "
            f"WHEN {score} >= {c} THEN 'MEDIUM' ELSE 'LOW' END")


def features_of(t):
    return features.beneficiary_features(t, as_of())


LIGHT = f"""{PROG}, {PAY}, feat AS (
    SELECT *, cycle_count % 4 AS shared_phone_count, nb_programs % 4 AS shared_account_count,
           0.4 * (payment_count % 3) AS network_risk, CAST(payment_count % 11 = 0 AS INT) AS has_disabled,
           CAST(nb_active_programs > 2 AS INT) AS income_program_inconsistency, avg_enrollment_days % 90 AS age,
           avg_enrollment_days * 1.5 AS income, cycle_count % 12 AS household_size, 0.5 AS pmt_score,
           CAST(payment_count % 120 AS DOUBLE) AS income_per_person
    FROM prog JOIN pay USING (partner_id))"""


def light_features(t):
    """Cheaper rows with the feature names, for checking expressions."""
    both = features.program_features(t.program_membership, as_of()).join(
        features.payment_features(t.payment, t.entitlement), "partner_id")
    return both.selectExpr(
        "*", "cycle_count % 4 AS shared_phone_count", "nb_programs % 4 AS shared_account_count",
        "0.4D * (payment_count % 3) AS network_risk", "CAST(payment_count % 11 = 0 AS INT) AS has_disabled",
        "CAST(nb_active_programs > 2 AS INT) AS income_program_inconsistency", "avg_enrollment_days % 90 AS age",
        "avg_enrollment_days * 1.5D AS income", "cycle_count % 12 AS household_size", "0.5D AS pmt_score",
        "CAST(payment_count % 120 AS DOUBLE) AS income_per_person")


@query("flagship_risk_levels", f"""
    WITH {STAR}, {RULES}, s AS (SELECT *, {RULE_SCORE} AS score FROM ruled)
    SELECT {level_sql('score', .8, .55, .3)} AS risk_level, count(*) AS n, round(avg(score), 4) AS mean_score,
           count(*) FILTER (score < 0.8) AS n_pass_to_ml FROM s GROUP BY 1""")
def _(t):
    scored = rules.score_rules(features_of(t))
    return scored.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rule_score"), 4).alias("mean_score"),
        F.count_if("pass_to_ml").alias("n_pass_to_ml"))


@query("b02_base_filter", f"WITH {BASE} SELECT partner_id, age, gender, income, registration_age_days FROM base")
def _(t):
    return features.base_beneficiaries(t.registrant, as_of()).select(
        "partner_id", "age", "gender", "income", "registration_age_days")


@query("b03_default_maps", """
    SELECT r.partner_id, coalesce(m.n, 0) AS feature_programs, coalesce(m.n, 1) AS scoring_programs,
           coalesce(m.n, 1) AS training_programs, coalesce(m.n, 0) AS rule_programs,
           0.5 AS feature_pmt, 0.5 AS scoring_pmt, 0.5 AS training_pmt, 1.0 AS rule_pmt,
           999999.0 AS rule_income_per_person
    FROM registrant r LEFT JOIN (SELECT partner_id, count(DISTINCT program_id) AS n FROM program_membership
         WHERE state = 'enrolled' GROUP BY 1) m USING (partner_id)""")
def _(t):
    counts = t.program_membership.where("state = 'enrolled'").groupBy("partner_id").agg(
        F.countDistinct("program_id").alias("nb_programs"))
    df = t.registrant.select("partner_id").join(counts, "partner_id", "left").withColumn(
        "pmt_score", F.lit(None).cast("double"))
    maps = {"feature": FEATURE_DEFAULTS, "scoring": SCORING_DEFAULTS, "training": TRAINING_DEFAULTS,
            "rule": RULE_DEFAULTS}
    out = {}
    for name, m in maps.items():
        out[f"{name}_programs"] = F.coalesce("nb_programs", F.lit(m["nb_programs"]))
        out[f"{name}_pmt"] = F.coalesce("pmt_score", F.lit(float(m["pmt_score"])))
    out["rule_income_per_person"] = F.lit(float(RULE_DEFAULTS["income_per_person"]))
    return df.select("partner_id", *[c.alias(n) for n, c in out.items()])


@query("b05_rule_predicate", f"""
    WITH {LIGHT} SELECT partner_id,
        (CASE WHEN nb_active_programs = 0 THEN 0 ELSE nb_programs / nb_active_programs END > 1.5) AS ratio_rule,
        (20 <= age AND age < 40) AS chained_rule, NOT (income < 1000 OR payment_count > 30) AS not_rule,
        (CASE WHEN nb_active_programs = 0 THEN 0 ELSE payment_count % nb_active_programs END = 1) AS mod_rule,
        (power(nb_programs, 2) - 1 >= 3) AS power_rule, false AS unknown_rule FROM feat""")
def _(t):
    df = light_features(t)
    conditions = {
        "ratio_rule": "nb_programs / nb_active_programs > 1.5",
        "chained_rule": "20 <= age < 40",
        "not_rule": "not (income < 1000 or payment_count > 30)",
        "mod_rule": "payment_count % nb_active_programs == 1",
        "power_rule": "nb_programs ** 2 - 1 >= 3",
        "unknown_rule": "no_such_feature > 0",
    }
    return df.select("partner_id", *[rules.condition_column(c, df.columns).alias(n) for n, c in conditions.items()])


FLAG_SQL = ", ".join(f"CASE WHEN r{i + 1} THEN '{r['flag']}' END" for i, r in enumerate(rules.default_rules()))


@query("b06_rule_scores", f"""
    WITH {STAR}, {RULES}, s AS (SELECT *, {RULE_SCORE} AS rule_score,
        list_filter([{FLAG_SQL}], lambda x: x IS NOT NULL) AS flags FROM ruled)
    SELECT partner_id AS beneficiary_id, rule_score, {level_sql('rule_score', .8, .55, .3)} AS risk_level,
           array_to_string(flags, '|') AS flags, len(flags) AS n_rules_triggered, rule_score < 0.8 AS pass_to_ml
    FROM s""")
def _(t):
    return rules.score_rules(features_of(t)).select(
        "beneficiary_id", "rule_score", "risk_level", F.array_join("flags", "|").alias("flags"),
        "n_rules_triggered", "pass_to_ml")


@query("b07_alias_back_fill", f"""
    WITH {LIGHT} SELECT partner_id, round(CASE WHEN payment_gap_ratio = 0 AND nb_programs = 3 THEN 0.25
                                  ELSE payment_gap_ratio END, 6) AS payment_gap_ratio,
        round(CASE WHEN nb_programs = 3 THEN 0.25 ELSE payment_gap_ratio END, 6) AS gap_ratio,
        network_risk, network_risk AS network_risk_score
    FROM feat""")
def _(t):
    df = light_features(t).withColumn("gap_ratio", F.expr("CASE WHEN nb_programs = 3 THEN 0.25D ELSE NULL END"))
    out = rules.with_rule_context(df)
    return out.select("partner_id", F.round("payment_gap_ratio", 6).alias("payment_gap_ratio"),
                      F.round("gap_ratio", 6).alias("gap_ratio"), "network_risk", "network_risk_score")


@query("b08_rule_summary", f"""
    WITH {LIGHT}, {RULES} """ + " UNION ALL ".join(
        f"SELECT '{r['id']}' AS rule_id, '{r['flag']}' AS flag, {r['weight']} AS weight, "
        f"count(*) FILTER (r{i + 1}) AS n_matched, CAST(NULL AS VARCHAR) AS error FROM ruled"
        for i, r in enumerate(rules.default_rules()))
    + " UNION ALL SELECT 'X1', 'BROKEN', 0.1, NULL, 'Call is not allowed in a rule'")
def _(t):
    broken = {"id": "X1", "name": "broken", "flag": "BROKEN", "severity": "LOW", "weight": 0.1,
              "condition": "abs(income) > 1"}
    return rules.rule_summary(light_features(t), [*rules.default_rules(), broken]).select(
        "rule_id", "flag", "weight", "n_matched", "error")


@query("b17_upload_check", f"""
    SELECT 'registrant' AS upload, 'missing columns: nb_programs, payment_gap_ratio, pmt_score' AS error
    UNION ALL SELECT 'scored', CASE WHEN (SELECT count(*) FROM registrant) > 5000
        THEN 'too many rows: more than 5000' END
    UNION ALL SELECT 'empty', CASE WHEN (SELECT count(*) FROM registrant WHERE income > 1e12) = 0
        THEN 'the file is empty' END""")
def _(t):
    from benefica.scale import stage

    reg = t.registrant
    full = reg.withColumns({c: F.lit(0.0) for c in REQUIRED_UPLOAD_COLUMNS if c != "income"})
    checks = [("registrant", reg), ("scored", full), ("empty", full.where("income > 1e12"))]
    out = None
    for name, df in checks:
        row = validation.upload_error(df).select(F.lit(name).alias("upload"), "error")
        out = row if out is None else out.unionByName(row)
    return out


@query("c01_payment_join_entitlement", """
    SELECT e.cycle_id, count(*) AS n, round(sum(p.amount_issued), 2) AS issued
    FROM payment p JOIN entitlement e ON p.entitlement_id = e.entitlement_id GROUP BY 1""")
def _(t):
    return (t.payment.join(t.entitlement.select("entitlement_id", "cycle_id"), "entitlement_id")
            .groupBy("cycle_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_issued"), 2).alias("issued")))


ROUNDED = ["total_issued", "total_paid", "payment_gap_ratio", "payment_success_rate", "amount_variance",
           "avg_entitlement_amount"]


@query("c02_feature_star", f"""WITH {STAR} SELECT partner_id, age, gender, income, nb_programs, nb_active_programs,
    avg_enrollment_days, payment_count, cycle_count, shared_phone_count, shared_account_count, group_membership_count,
    pmt_score, {", ".join(f"round({c}, 4) AS {c}" for c in ROUNDED)} FROM star""")
def _(t):
    return features.feature_star(t, as_of()).select(
        "partner_id", "age", "gender", "income", "nb_programs", "nb_active_programs", "avg_enrollment_days",
        "payment_count", "cycle_count", "shared_phone_count", "shared_account_count", "group_membership_count",
        "pmt_score", *[F.round(c, 4).alias(c) for c in ROUNDED])


@query("c03_shared_phone", f"WITH {PHONES} SELECT * FROM phones")
def _(t):
    return features.shared_phones(t.phone_number)


@query("c04_shared_account", f"WITH {ACCOUNTS} SELECT * FROM accounts")
def _(t):
    return features.shared_accounts(t.bank_account)


@query("i03_other_owners", f"""WITH {PHONES} SELECT partner_id, shared_phone_count + 1 AS shared_phone_count
    FROM phones""")
def _(t):
    return features.shared_phones(t.phone_number, strict=False)


@query("d01_program_features", f"WITH {PROG} SELECT * FROM prog")
def _(t):
    return features.program_features(t.program_membership, as_of())


@query("d02_payment_features", f"""WITH {PAY} SELECT partner_id, payment_count, cycle_count,
    {", ".join(f"round({c}, 4) AS {c}" for c in ROUNDED)} FROM pay""")
def _(t):
    return features.payment_features(t.payment, t.entitlement).select(
        "partner_id", "payment_count", "cycle_count", *[F.round(c, 4).alias(c) for c in ROUNDED])


@query("d03_group_counts", f"WITH {GROUPS} SELECT * FROM grp")
def _(t):
    return features.group_counts(t.group_membership)


@query("d17_global_thresholds", f"""WITH {STAR} SELECT partner_id, high_amount_flag, income_program_inconsistency
    FROM feat""")
def _(t):
    return features_of(t).select("partner_id", "high_amount_flag", "income_program_inconsistency")


@query("h20_clip_round_divide", """
    SELECT partner_id, greatest(0, least(1, income / 5000)) AS clipped,
           CASE WHEN zone_id = 0 THEN 0 ELSE income / zone_id END AS ratio FROM registrant""")
def _(t):
    return t.registrant.select(
        "partner_id", scoring.clamp(F.col("income") / 5000).alias("clipped"),
        scoring.safe_ratio(F.col("income"), F.col("zone_id")).alias("ratio"))


@query("h21_derived_features", f"""WITH {STAR} SELECT partner_id, income_per_person, dependency_ratio, network_risk
    FROM star""")
def _(t):
    return features.with_derived(features.feature_star(t, as_of())).select(
        "partner_id", "income_per_person", "dependency_ratio", "network_risk")


@query("h22_graph_heuristic", f"WITH {LIGHT}, {SERVICE} SELECT partner_id, round(graph_s, 6) AS graph_score FROM svc")
def _(t):
    return light_features(t).select("partner_id", F.round(scoring.heuristic_graph_score(), 6).alias("graph_score"))


@query("h23_rule_heuristic", f"WITH {LIGHT}, {SERVICE} SELECT partner_id, round(rule_s, 6) AS rule_score FROM svc")
def _(t):
    return light_features(t).select("partner_id", F.round(scoring.heuristic_rule_score(), 6).alias("rule_score"))


def scored(t, full=False):
    """Scores with the payment gap standing in for the model, so that the blend can be checked in SQL."""
    df = (features_of(t) if full else light_features(t)).withColumn("ml_score", F.col("payment_gap_ratio")).withColumn(
        "prediction", (F.col("ml_score") >= 0.5).cast("int"))
    df = df.withColumn("rule_s", scoring.heuristic_rule_score()).withColumn(
        "graph_s", scoring.heuristic_graph_score())
    return df.withColumn("final", scoring.service_blend(F.col("ml_score"), F.col("rule_s"), F.col("graph_s")))


SCORED = f"""{LIGHT}, {SERVICE}, scored AS (
    SELECT *, payment_gap_ratio AS ml_score, CAST(payment_gap_ratio >= 0.5 AS INT) AS prediction,
           greatest(0.0, least(1.0, 0.7 * payment_gap_ratio + 0.2 * rule_s + 0.1 * graph_s)) AS final FROM svc)"""
FULL_SCORED = SCORED.replace(LIGHT, STAR)
SERVICE_LEVEL = """CASE WHEN final >= 0.9 AND prediction = 1 AND greatest(rule_s, graph_s) >= 0.35 THEN 'CRITICAL'
    WHEN final >= 0.75 THEN 'HIGH' WHEN final >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END"""


@query("h24_risk_levels", f"""
    WITH {SCORED}, l AS (SELECT partner_id, {SERVICE_LEVEL} AS service_level,
        {level_sql('rule_s', .8, .55, .3)} AS rule_level, {level_sql('round(final, 3)', .8, .6, .4)} AS staged_level
        FROM scored)
    SELECT *, CASE service_level WHEN 'CRITICAL' THEN 'Escalate for manual review'
                 WHEN 'HIGH' THEN 'Review beneficiary case with priority' WHEN 'MEDIUM' THEN 'Review beneficiary case'
                 ELSE 'No immediate action' END AS service_action,
           CASE staged_level WHEN 'CRITICAL' THEN 'Block / suspend pending investigation'
                 WHEN 'HIGH' THEN 'Escalate for manual review' WHEN 'MEDIUM' THEN 'Review beneficiary case'
                 ELSE 'No immediate action' END AS staged_action FROM l""")
def _(t):
    df = scored(t).select(
        "partner_id",
        scoring.service_level(F.col("final"), F.col("prediction"), F.col("rule_s"), F.col("graph_s"))
        .alias("service_level"),
        scoring.rule_level(F.col("rule_s")).alias("rule_level"),
        scoring.staged_level(F.round("final", 3)).alias("staged_level"))
    return df.withColumn("service_action", scoring.service_action(F.col("service_level"))).withColumn(
        "staged_action", scoring.staged_action(F.col("staged_level")))


@query("h25_score_blends", f"""
    WITH {SCORED} SELECT partner_id, round(final, 6) AS service_score,
        round(0.2 * rule_s + 0.5 * ml_score + 0.1 * payment_success_rate + 0.2 * graph_s, 3) AS staged_score
    FROM scored""")
def _(t):
    c = F.col
    return scored(t).select(
        "partner_id", F.round("final", 6).alias("service_score"),
        scoring.staged_blend(c("rule_s"), c("ml_score"), c("payment_success_rate"), c("graph_s"))
        .alias("staged_score"))


@query("h03_explanation_text", f"""
    WITH {SCORED} SELECT partner_id, printf('Model gap — ml_score=%.3f, rule_score=%.3f, graph_score=%.3f, '
        || 'final_score=%.3f.', ml_score, rule_s, graph_s, final) AS explanation FROM scored""")
def _(t):
    c = F.col
    return scored(t).select("partner_id", scoring.explanation(
        "gap", c("ml_score"), c("rule_s"), c("graph_s"), c("final")).alias("explanation"))


@query("f04_top_factors", f"""
    WITH {STAR}, long AS (
        {" UNION ALL ".join(f"SELECT partner_id, {i} AS place, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM feat"
                            for i, f in enumerate(ML_FEATURES))}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY abs(v) DESC, place) AS rank FROM long)
    SELECT partner_id, rank, feature, round(v, 3) AS impact, CASE WHEN v > 0 THEN '+' ELSE '-' END AS direction
    FROM ranked WHERE rank <= 3""")
def _(t):
    return features_of(t).select("partner_id", F.posexplode(scoring.top_factors(ML_FEATURES))).select(
        "partner_id", (F.col("pos") + 1).cast("long").alias("rank"), "col.feature", "col.impact", "col.direction")


@query("k13_hybrid_scan", f"""
    WITH {FULL_SCORED}, l AS (SELECT *, {SERVICE_LEVEL} AS level FROM scored)
    SELECT count(*) AS total, count(*) FILTER (level = 'CRITICAL') AS n_critical,
           count(*) FILTER (level = 'HIGH') AS n_high, count(*) FILTER (level IN ('CRITICAL', 'HIGH')) AS n_alerts,
           round(avg(final), 6) AS mean_score FROM l""")
def _(t):
    df = scored(t, full=True).withColumn("level", scoring.service_level(
        F.col("final"), F.col("prediction"), F.col("rule_s"), F.col("graph_s")))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "CRITICAL").alias("n_critical"),
        F.count_if(F.col("level") == "HIGH").alias("n_high"),
        F.count_if(F.col("level").isin("CRITICAL", "HIGH")).alias("n_alerts"),
        F.round(F.avg("final"), 6).alias("mean_score"))
