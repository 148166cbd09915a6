"""Row, payload and state checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.operators import records, validation
from benefica.plans.projections import REQUESTS, requests
from benefica.plans.registry import query

def as_of():
    return F.lit("2002-01-01").cast("date")


@query("b18_payload_errors", """
    WITH e AS (SELECT disbursement_id, list_filter([
        CASE WHEN quantity < 0 THEN 'INVALID_DISBURSEMENT_QUANTITY' END,
        CASE WHEN beneficiary_name = '' THEN 'INVALID_BENEFICIARY_ID' END,
        CASE WHEN narrative IS NULL OR narrative = '' THEN 'INVALID_NARRATIVE' END], lambda x: x IS NOT NULL) AS codes
        FROM disbursement)
    SELECT disbursement_id, array_to_string(codes, ',') AS codes FROM e WHERE len(codes) > 0""")
def _(t):
    df = t.disbursement.withColumn("beneficiary_id", F.coalesce("beneficiary_name", F.lit("known")))
    return df.withColumn("codes", validation.all_errors(validation.payload_checks())).where(
        F.size("codes") > 0).select("disbursement_id", F.array_join("codes", ",").alias("codes"))


ENVELOPE = """SELECT cycle_id AS envelope_id, CASE WHEN cycle_id % 9 = 0 THEN '' ELSE 'P' || CAST(min(program_id)
        AS STRING) END AS program_id, CASE WHEN cycle_id % 7 = 0 THEN 'Hourly' ELSE 'Monthly' END AS frequency,
    CASE WHEN cycle_id % 11 = 0 THEN NULL ELSE 'CYC' END AS cycle_code, count(*) - 60 AS n_beneficiaries,
    count(*) AS n_disbursements, sum(initial_amount) - 1e7 AS total_quantity, 'B1' AS benefit_code,
    CASE WHEN cycle_id % 5 = 0 THEN '' ELSE 'farmers' END AS target_registry,
    CASE WHEN cycle_id % 4 = 0 THEN NULL ELSE 'mn' END AS program_mnemonic
    FROM {e} GROUP BY cycle_id"""


@query("b19_envelope_errors", f"""
    WITH v AS ({ENVELOPE.format(e='entitlement')})
    SELECT envelope_id, CASE WHEN program_id = '' THEN 'INVALID_PROGRAM_ID'
        WHEN frequency = 'Hourly' THEN 'INVALID_DISBURSEMENT_FREQUENCY'
        WHEN cycle_code IS NULL THEN 'INVALID_CYCLE_CODE_MNEMONIC'
        WHEN n_beneficiaries < 1 THEN 'INVALID_NO_OF_BENEFICIARIES'
        WHEN n_disbursements < 1 THEN 'INVALID_NO_OF_DISBURSEMENTS'
        WHEN total_quantity < 0 THEN 'INVALID_DISBURSEMENT_QUANTITY'
        WHEN target_registry = '' THEN 'INVALID_TARGET_REGISTRY' END AS error,
      CASE WHEN program_id = '' THEN 'INVALID_PROGRAM_ID' WHEN program_mnemonic IS NULL
           THEN 'INVALID_PROGRAM_MNEMONIC' WHEN n_beneficiaries < 1 THEN 'INVALID_NO_OF_BENEFICIARIES'
           END AS amend_error FROM v""")
def _(t):
    return t.spark.sql(ENVELOPE, e=t.entitlement).select(
        "envelope_id", validation.first_error(validation.envelope_checks()).alias("error"),
        validation.first_error(validation.amend_checks()).alias("amend_error"))


@query("b20_exception_rules", """
    WITH f AS (
        SELECT partner_id, 'no gender' AS rule FROM registrant WHERE gender IS NULL
        UNION ALL SELECT partner_id, 'negative income' FROM registrant WHERE income < 0
        UNION ALL SELECT partner_id, 'group of company' FROM registrant WHERE is_group AND coalesce(is_company, false)),
      s AS (SELECT partner_id, 'no gender' AS rule FROM registrant WHERE zone_id % 2 = 0)
    SELECT partner_id, rule, 'add' AS change FROM f WHERE (partner_id, rule) NOT IN (SELECT partner_id, rule FROM s)
    UNION ALL
    SELECT partner_id, rule, 'remove' FROM s WHERE (partner_id, rule) NOT IN (SELECT partner_id, rule FROM f)""")
def _(t):
    rules = {
        "no gender": F.col("gender").isNull(),
        "negative income": F.col("income") < 0,
        "group of company": lambda df: df["is_group"] & F.coalesce(df["is_company"], F.lit(False)),
    }
    found = validation.detect_exceptions(t.registrant, "partner_id", rules)
    stored = t.registrant.where("zone_id % 2 = 0").select("partner_id", F.lit("no gender").alias("rule"))
    return validation.exception_changes(found, stored, "partner_id")


@query("b21_id_patterns", """
    SELECT partner_id, id_type, regexp_matches(value, CASE id_type WHEN 'National ID' THEN '^(?:N1[0-9]-[0-9]+)'
        ELSE '^(?:H[BM][0-9]{3,4})' END) AS is_valid FROM reg_id""")
def _(t):
    # Fixed small table of patterns: one row per id type.
    patterns = t.spark.createDataFrame(
        [("National ID", "N1[0-9]-[0-9]+"), ("Household ID", "H[BM][0-9]{3,4}")], "id_type string, pattern string")
    return t.reg_id.join(F.broadcast(patterns), "id_type").select(
        "partner_id", "id_type", validation.pattern_matches(F.col("value"), F.col("pattern")).alias("is_valid"))


@query("b22_row_constraints", """
    SELECT 'membership ends before it starts' AS violation, count(*) AS n FROM group_membership
     WHERE ended_date < start_date
    UNION ALL SELECT 'valid_until before valid_from', count(*) FROM entitlement WHERE valid_until < valid_from
    UNION ALL SELECT 'member of itself', count(*) FROM group_membership WHERE group_id = individual_id
    UNION ALL SELECT 'relation between wrong types', count(*) FROM group_membership m JOIN registrant r
        ON m.group_id = r.partner_id WHERE NOT r.is_group
    UNION ALL SELECT 'born later', count(*) FROM registrant WHERE birthdate > DATE '1999-06-01'""")
def _(t):
    m = t.group_membership
    cases = {
        "membership ends before it starts": m.where("ended_date < start_date"),
        "valid_until before valid_from": t.entitlement.where("valid_until < valid_from"),
        "member of itself": m.where("group_id = individual_id"),
        "relation between wrong types": m.join(
            t.registrant.where("NOT is_group").select(F.col("partner_id").alias("group_id")), "group_id", "left_semi"),
        "born later": t.registrant.where("birthdate > DATE '1999-06-01'"),
    }
    out = None
    for name, df in cases.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("violation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("b23_uniqueness", """
    SELECT 'head' AS what, CAST(group_id AS VARCHAR) AS k, count(*) AS n FROM group_membership WHERE kind = 'head'
      AND ended_date IS NULL GROUP BY group_id HAVING count(*) > 1
    UNION ALL SELECT 'member', group_id || '/' || individual_id, count(*) FROM group_membership
      GROUP BY group_id, individual_id HAVING count(*) > 1
    UNION ALL SELECT 'id type', partner_id || '/' || id_type, count(*) FROM reg_id GROUP BY partner_id, id_type
      HAVING count(*) > 1
    UNION ALL SELECT 'program', partner_id || '/' || program_id, count(*) FROM program_membership
      GROUP BY partner_id, program_id HAVING count(*) > 1
    UNION ALL SELECT 'entitlement code', program_id || '/' || code, count(*) FROM entitlement
      GROUP BY program_id, code HAVING count(*) > 1""")
def _(t):
    def case(what, df, *keys):
        return validation.duplicates_of(df, keys).select(
            F.lit(what).alias("what"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("k"), "n")

    m = t.group_membership
    return (
        case("head", m.where("kind = 'head' AND ended_date IS NULL"), "group_id")
        .unionByName(case("member", m, "group_id", "individual_id"))
        .unionByName(case("id type", t.reg_id, "partner_id", "id_type"))
        .unionByName(case("program", t.program_membership, "partner_id", "program_id"))
        .unionByName(case("entitlement code", t.entitlement, "program_id", "code")))


@query("b24_active_request_conflicts", f"""
    WITH q AS ({REQUESTS.format(r='registrant')}), z AS (SELECT *, partner_id % 50 AS who FROM q)
    SELECT who AS partner_id, count(*) AS n FROM z WHERE state IN ('draft', 'submitted') GROUP BY 1
    HAVING count(*) > 1""")
def _(t):
    return records.active_request_conflicts(requests(t).withColumn("partner_id", F.expr("partner_id % 50")))


@query("b31_state_guards", """
    WITH s AS (SELECT membership_id, state AS old_state,
        CASE WHEN program_id = 1 THEN 'enrolled' WHEN program_id = 2 THEN 'paused' ELSE 'exited' END AS new_state
        FROM program_membership)
    SELECT * FROM s WHERE (old_state, new_state) NOT IN (('draft', 'enrolled'), ('enrolled', 'paused'),
        ('enrolled', 'exited'), ('paused', 'enrolled'), ('not_eligible', 'enrolled'))""")
def _(t):
    moves = t.program_membership.select(
        "membership_id", F.col("state").alias("old_state"),
        F.when(F.col("program_id") == 1, "enrolled").when(F.col("program_id") == 2, "paused").otherwise("exited")
        .alias("new_state"))
    allowed = [("draft", "enrolled"), ("enrolled", "paused"), ("enrolled", "exited"), ("paused", "enrolled"),
               ("not_eligible", "enrolled")]
    return validation.illegal_transitions(moves, allowed)


@query("c20_interval_overlap", """
    WITH r AS (SELECT o_orderkey AS id, o_custkey AS source, o_orderpriority AS relation, CAST(o_orderdate AS DATE) AS s,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) END AS e
        FROM orders)
    SELECT DISTINCT a.id, a.source FROM r a JOIN r b ON a.source = b.source AND a.relation = b.relation
       AND a.id <> b.id AND (b.e IS NULL OR b.e >= a.s) AND (a.e IS NULL OR b.s <= a.e)""")
def _(t):
    df = t.orders.selectExpr(
        "o_orderkey AS id", "o_custkey AS source", "o_orderpriority AS relation", "CAST(o_orderdate AS DATE) AS s",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) END AS e")
    return validation.overlapping_rows(df, ["source", "relation"], "id", "s", "e").select("id", "source")


@query("h32_name_uniqueness", """
    SELECT lower(name) AS name, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name
        END AS name FROM part) GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    names = t.part.select(F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END").alias("name"))
    return validation.duplicates_of(names, [F.lower("name").alias("name")])


@query("h34_usable_entitlements", """
    SELECT entitlement_id, state = 'approved' AND valid_until >= DATE '2000-01-01' AS usable FROM entitlement""")
def _(t):
    return t.entitlement.select("entitlement_id", (
        (F.col("state") == "approved") & (F.col("valid_until") >= F.lit("2000-01-01").cast("date"))).alias("usable"))
