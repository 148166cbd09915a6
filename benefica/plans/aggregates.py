"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.fixed import EDGE_WEIGHTS
from benefica.operators import dashboards, households, programs
from benefica.operators.graph import merged_edge_weights
from benefica.plans.joins import MEMBERS
from benefica.plans.registry import query
from benefica.scale import chunked_lists, join_groups

def as_of():
    return F.lit("2002-01-01").cast("date")
CODES = {"Male": "M", "Female": "F"}
PEOPLE = "registrant WHERE is_registrant AND active"
AGE = "date_part('year', age(DATE '2002-01-01', birthdate))"


@query("d04_duplicate_ids", """
    WITH g AS (SELECT id_type, value, count(*) AS n FROM reg_id GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT id_type, value, 0 AS chunk, n, string_agg(CAST(partner_id AS VARCHAR), ',' ORDER BY partner_id) AS members
    FROM g JOIN reg_id USING (id_type, value) GROUP BY ALL""")
def _(t):
    twice = t.reg_id.groupBy("id_type", "value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = join_groups(t.reg_id, twice, ["id_type", "value"], "left_semi")
    return chunked_lists(rows, ["id_type", "value"], "partner_id").withColumn(
        "members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("d05_duplicate_keys", """
    SELECT partner_id, id_type, value FROM (SELECT *, row_number() OVER (PARTITION BY id_type, value ORDER BY
        partner_id) AS k FROM reg_id) WHERE k > 1""")
def _(t):
    # The kept row is the smallest id of its key: an aggregate instead of an ordered window.
    first = t.reg_id.groupBy("id_type", "value").agg(F.min("partner_id").alias("_keep"))
    return join_groups(t.reg_id, first, ["id_type", "value"]).where("partner_id <> _keep").select(
        "partner_id", "id_type", "value")


@query("d06_ids_by_kind", """
    WITH r AS (SELECT kind, partner_id, row_number() OVER (PARTITION BY kind ORDER BY partner_id) - 1 AS k
        FROM registrant)
    SELECT kind, k // 100 AS chunk, count(*) AS n, string_agg(CAST(partner_id AS VARCHAR), ',' ORDER BY partner_id)
        AS members FROM r GROUP BY 1, 2""")
def _(t):
    return chunked_lists(t.registrant, ["kind"], "partner_id", size=100).withColumn(
        "members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("d07_gender_counts", f"""
    SELECT company_id, CASE gender WHEN 'Male' THEN 'M' WHEN 'Female' THEN 'F' END AS gender, count(*) AS n
    FROM {PEOPLE} AND NOT is_group GROUP BY 1, 2""")
def _(t):
    return dashboards.gender_counts(t.registrant, CODES)


@query("d08_age_distribution", f"""
    SELECT company_id, count(*) FILTER ({AGE} < 18) AS below_18, count(*) FILTER ({AGE} BETWEEN 18 AND 30)
        AS from_18, count(*) FILTER ({AGE} BETWEEN 31 AND 40) AS from_31, count(*) FILTER ({AGE} BETWEEN 41 AND 50)
        AS from_41, count(*) FILTER ({AGE} > 50) AS above_50 FROM {PEOPLE} AND NOT is_group GROUP BY 1""")
def _(t):
    a = "age_distribution"
    return dashboards.age_distribution(t.registrant, as_of()).select(
        "company_id", f"{a}.below_18", F.col(f"{a}.18_to_30").alias("from_18"), F.col(f"{a}.31_to_40").alias("from_31"),
        F.col(f"{a}.41_to_50").alias("from_41"), f"{a}.above_50")


@query("d09_registrant_totals", f"""
    SELECT company_id, count(*) FILTER (NOT is_group) AS total_individuals, count(*) FILTER (is_group) AS total_groups
    FROM {PEOPLE} GROUP BY 1""")
def _(t):
    return dashboards.registrant_totals(t.registrant)


@query("d10_dashboard_rows", f"""
    WITH c AS (SELECT DISTINCT n_nationkey % 6 AS company_id FROM nation),
      tot AS (SELECT company_id, count(*) FILTER (NOT is_group) AS i, count(*) FILTER (is_group) AS g FROM {PEOPLE}
        GROUP BY 1),
      gen AS (SELECT company_id, CASE gender WHEN 'Male' THEN 'M' ELSE 'F' END AS gender, count(*) AS n FROM {PEOPLE}
        AND NOT is_group AND gender IN ('Male', 'Female') GROUP BY 1, 2),
      spec AS (SELECT company_id, string_agg(gender || '=' || n, ',' ORDER BY gender) AS s FROM gen GROUP BY 1),
      ages AS (SELECT company_id, count(*) FILTER ({AGE} > 50) AS above FROM {PEOPLE} AND NOT is_group GROUP BY 1)
    SELECT c.company_id, coalesce(i, 0) AS total_individuals, coalesce(g, 0) AS total_groups, coalesce(s, '') AS genders,
        coalesce(above, 0) AS above_50
    FROM c LEFT JOIN tot USING (company_id) LEFT JOIN spec USING (company_id) LEFT JOIN ages USING (company_id)""")
def _(t):
    companies = t.nation.select((F.col("n_nationkey") % 6).alias("company_id")).distinct()
    d = dashboards.dashboard(t.registrant, companies, CODES, as_of())
    genders = F.array_join(F.transform(F.array_sort(F.map_entries("gender_spec")), lambda e: F.concat(
        e.key, F.lit("="), e.value.cast("string"))), ",")
    return d.select("company_id", "total_individuals", "total_groups", genders.alias("genders"),
                    F.col("age_distribution.above_50").alias("above_50"))


FUNDS = """SELECT 'F' || CAST(l_partkey AS STRING) || '/' || CAST(l_orderkey AS STRING) AS name,
    CAST(l_linenumber AS INT) % 6 AS program_id, l_extendedprice * 40 AS amount, CAST(l_shipdate AS DATE) AS date_posted,
    CASE WHEN l_linestatus = 'F' THEN 'posted' ELSE 'draft' END AS state FROM {lineitem}"""
FUNDS_CTE = f"funds AS ({FUNDS.format(lineitem='lineitem')})"


def funds(t):
    return t.spark.sql(FUNDS, lineitem=t.lineitem)


BALANCE = f"""{FUNDS_CTE}, bal AS (
    SELECT coalesce(f.program_id, e.program_id) AS program_id, coalesce(posted, 0) AS posted,
           coalesce(approved, 0) AS approved, coalesce(posted, 0) - coalesce(approved, 0) AS balance
    FROM (SELECT program_id, sum(amount) AS posted FROM funds WHERE state = 'posted' GROUP BY 1) f
    FULL JOIN (SELECT program_id, sum(initial_amount) AS approved FROM entitlement WHERE state = 'approved' GROUP BY 1) e
      ON f.program_id = e.program_id)"""


@query("d11_fund_balances", f"""WITH {BALANCE} SELECT program_id, round(posted, 2) AS posted,
    round(approved, 2) AS approved, round(balance, 2) AS balance FROM bal""")
def _(t):
    b = programs.fund_balances(funds(t), t.entitlement)
    return b.select("program_id", *[F.round(c, 2).alias(c) for c in ("posted", "approved", "balance")])


@query("d12_household_indicator", f"""
    WITH c AS (SELECT m.group_id, count(*) AS n {MEMBERS} AND m.kind IN ('head', 'child') AND p.income > 500 GROUP BY 1)
    SELECT partner_id AS group_id, coalesce(n, 0) AS earners, coalesce(n, 0) > 0 AS has_earner
    FROM registrant LEFT JOIN c ON c.group_id = partner_id WHERE is_group""")
def _(t):
    groups = t.registrant.where("is_group").select(F.col("partner_id").alias("group_id"))
    n = households.indicator(groups, t.registrant, t.group_membership, "earners", ["head", "child"],
                             [("income", ">", 500)])
    return n.withColumn("has_earner", F.col("earners") > 0)


@query("d16_program_counters", """
    WITH m AS (SELECT program_id, count(*) AS members, count(*) FILTER (state = 'enrolled') AS enrolled,
            count(*) FILTER (state = 'duplicated') AS duplicated FROM program_membership GROUP BY 1),
         e AS (SELECT program_id, count(*) AS entitlements, count(DISTINCT cycle_id) AS cycles,
            round(sum(initial_amount), 2) AS total_amount, bool_and(state = 'approved') AS all_approved
            FROM entitlement GROUP BY 1),
         p AS (SELECT program_id, count(*) AS payments, round(sum(amount_paid), 2) AS paid FROM payment JOIN entitlement
            USING (entitlement_id) GROUP BY 1)
    SELECT * FROM m JOIN e USING (program_id) JOIN p USING (program_id)""")
def _(t):
    c = F.count(F.lit(1))
    m = t.program_membership.groupBy("program_id").agg(
        c.alias("members"), F.count_if(F.col("state") == "enrolled").alias("enrolled"),
        F.count_if(F.col("state") == "duplicated").alias("duplicated"))
    e = t.entitlement.groupBy("program_id").agg(
        c.alias("entitlements"), F.countDistinct("cycle_id").alias("cycles"),
        F.round(F.sum("initial_amount"), 2).alias("total_amount"),
        F.bool_and(F.col("state") == "approved").alias("all_approved"))
    p = t.payment.join(t.entitlement.select("entitlement_id", "program_id"), "entitlement_id").groupBy(
        "program_id").agg(c.alias("payments"), F.round(F.sum("amount_paid"), 2).alias("paid"))
    return m.join(e, "program_id").join(p, "program_id")


STATES = ["draft", "enrolled", "paused", "exited", "not_eligible", "duplicated"]


@query("d18_value_counts", "WITH v(place, state) AS (VALUES " + ", ".join(
    f"({i}, '{s}')" for i, s in enumerate(STATES)) + """)
    SELECT place, v.state, count(m.membership_id) AS n FROM v LEFT JOIN program_membership m ON m.state = v.state
    GROUP BY 1, 2""")
def _(t):
    return dashboards.value_counts(t.program_membership, "state", STATES)


@query("d18_cross_counts", """
    SELECT program_id, count(*) FILTER (state = 'approved') AS approved, count(*) FILTER (state = 'draft') AS draft,
        count(*) FILTER (state = 'pending_validation') AS pending_validation FROM entitlement GROUP BY 1""")
def _(t):
    return dashboards.cross_counts(t.entitlement, "program_id", "state", ["approved", "draft", "pending_validation"])


@query("d18_scenario_means", """
    SELECT scenario, count(*) AS n, round(avg(score), 6) AS mean_score FROM labelled_score GROUP BY 1""")
def _(t):
    return t.labelled_score.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"),
                                                    F.round(F.avg("score"), 6).alias("mean_score"))


@query("d19_score_histogram", """
    SELECT label, least(CAST(floor(score * 50) AS BIGINT) + 1, 50) AS bin, count(*) AS n FROM labelled_score
    GROUP BY 1, 2""")
def _(t):
    return dashboards.histogram(t.labelled_score, "score", ["label"], 50, 0.0, 1.0)


@query("d20_missing_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM registrant"
    for c in ("active", "is_company", "gender", "birthdate", "disabled", "name")))
def _(t):
    return dashboards.missing_profile(t.registrant.select("active", "is_company", "gender", "birthdate", "disabled",
                                                          "name"))


@query("d21_payment_status", """
    SELECT entitlement_id, bool_or(status = 'paid') AS is_paid, strftime(min(paid_on) FILTER (status = 'paid'),
        '%Y-%m-%d') AS paid_on FROM payment GROUP BY 1""")
def _(t):
    paid = F.col("status") == "paid"
    return t.payment.groupBy("entitlement_id").agg(
        F.bool_or(paid).alias("is_paid"), F.min(F.when(paid, F.col("paid_on"))).cast("string").alias("paid_on"))


@query("d22_pmt_scores", """
    SELECT partner_id, round(CASE WHEN NOT is_group THEN 0.01 * income + 2.0 * supplier_rank
        WHEN kind = 'BUILDING' THEN 0.5 * zone_id + 0.02 * income WHEN kind = 'HOUSEHOLD' THEN 1.5 * zone_id
        ELSE 0 END, 6) AS pmt_score FROM registrant""")
def _(t):
    weights = [
        {"target": "individual", "field": "income", "weight": 0.01},
        {"target": "individual", "field": "supplier_rank", "weight": 2.0},
        {"target": "group", "kind": "BUILDING", "field": "zone_id", "weight": 0.5},
        {"target": "group", "kind": "BUILDING", "field": "income", "weight": 0.02},
        {"target": "group", "kind": "HOUSEHOLD", "field": "zone_id", "weight": 1.5},
    ]
    return programs.pmt_scores(t.registrant, weights).select(
        "partner_id", F.round("pmt_score", 6).alias("pmt_score"))


@query("d23_itemised_entitlements", """
    WITH a AS (SELECT partner_id, CASE WHEN income < 5000 THEN 100.0 * least(zone_id, 10) END AS x,
        CAST(supplier_rank * 250 AS DOUBLE) AS y, CASE WHEN is_group THEN 700.0 END AS z FROM registrant),
      b AS (SELECT partner_id, least(coalesce(x, 0), 1200) AS s1, * FROM a),
      c AS (SELECT *, least(s1 + y, 1200) AS s2 FROM b)
    SELECT partner_id, round(CASE WHEN z IS NULL THEN s2 ELSE least(s2 + z, 1200) END * 1.1, 6) AS initial_amount FROM c
    WHERE CASE WHEN z IS NULL THEN s2 ELSE least(s2 + z, 1200) END > 0""")
def _(t):
    items = [
        {"condition": F.col("income") < 5000, "amount": 100, "multiplier_field": "zone_id", "max_multiplier": 10},
        {"amount": 250, "multiplier_field": "supplier_rank"},
        {"condition": F.col("is_group"), "amount": 700},
    ]
    amount = programs.itemised_amount(items, cap=1200, inflation=1.1)
    people = t.registrant.withColumn("cycle_id", F.lit(1))
    none = t.entitlement.where("cycle_id = 1").select("cycle_id", "partner_id")
    return programs.prepare_entitlements(people, none, amount).select(
        "partner_id", F.round("initial_amount", 6).alias("initial_amount"))


EDGES_SQL = """node AS (SELECT partner_id AS id, kind || CAST(zone_id AS VARCHAR) AS address_hash,
        zone_id * 1000 + CAST(floor(income / 100) AS BIGINT) AS phone, zone_id AS agent_id,
        CAST(floor(income / 2) AS BIGINT) AS bank_account FROM registrant),
    edge AS (SELECT a.id AS src, b.id AS dst, greatest(
            CASE WHEN a.bank_account = b.bank_account THEN 1.0 ELSE 0 END,
            CASE WHEN a.phone = b.phone THEN 0.9 ELSE 0 END,
            CASE WHEN a.address_hash = b.address_hash THEN 0.7 ELSE 0 END,
            CASE WHEN a.agent_id = b.agent_id THEN 0.4 ELSE 0 END) AS weight
        FROM node a JOIN node b ON a.id < b.id AND (a.bank_account = b.bank_account OR a.phone = b.phone
            OR a.address_hash = b.address_hash OR a.agent_id = b.agent_id))"""


def graph_nodes(t):
    return t.registrant.selectExpr(
        "partner_id AS id", "kind || CAST(zone_id AS STRING) AS address_hash",
        "zone_id * 1000 + CAST(floor(income / 100) AS BIGINT) AS phone", "zone_id AS agent_id",
        "CAST(floor(income / 2) AS BIGINT) AS bank_account")


@query("d24_merged_edge_weights", f"""WITH {EDGES_SQL} SELECT CAST(weight AS DOUBLE) AS weight, count(*) AS n_edges FROM edge
    GROUP BY 1""")
def _(t):
    return merged_edge_weights(graph_nodes(t), EDGE_WEIGHTS)


@query("d25_partition_by_key", """
    WITH r AS (SELECT state, membership_id, row_number() OVER (PARTITION BY state ORDER BY membership_id) - 1 AS k
        FROM program_membership)
    SELECT state, k // 1000 AS chunk, count(*) AS n, md5(string_agg(CAST(membership_id AS VARCHAR), ',' ORDER BY k))
        AS members FROM r GROUP BY 1, 2""")
def _(t):
    return chunked_lists(t.program_membership, ["state"], "membership_id").withColumn(
        "members", F.md5(F.array_join(F.col("members").cast("array<string>"), ",")))


@query("d26_ticket_counts", """
    SELECT n_name AS category, count(c.conv_id) AS tickets FROM nation LEFT JOIN conversations c
      ON c.conv_id % 40 = n_nationkey AND c.role = 'user' GROUP BY 1""")
def _(t):
    counts = t.conversations.where("role = 'user'").groupBy((F.col("conv_id") % 40).alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("tickets"))
    return t.nation.join(counts, "n_nationkey", "left").select(
        F.col("n_name").alias("category"), F.coalesce("tickets", F.lit(0)).alias("tickets"))
