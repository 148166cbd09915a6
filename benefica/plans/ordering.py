"""Windows, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.operators import programs, records
from benefica.operators.graph import first_neighbours
from benefica.fixed import EDGE_WEIGHTS
from benefica.plans.aggregates import BALANCE, EDGES_SQL, FUNDS_CTE, funds, graph_nodes
from benefica.plans.fraud import STAR, features_of
from benefica.plans.projections import CLEAN_CTE, clean_survey, survey
from benefica.plans.registry import query
from benefica.scale import join_groups, running


@query("e01_shared_value_count", f"""
    WITH {CLEAN_CTE}, n AS (SELECT *, CASE WHEN phone_number IS NULL THEN 1
        ELSE count(*) OVER (PARTITION BY phone_number) END AS shared FROM clean)
    SELECT id, shared, CAST(shared >= 3 AS INT) AS flag FROM n""")
def _(t):
    df = clean_survey(survey(t)).select("id", "phone_number")
    counts = df.groupBy("phone_number").agg(F.count("phone_number").alias("_n"))
    shared = F.coalesce("_n", F.lit(1))
    return join_groups(df, counts, ["phone_number"], "left").select(
        "id", shared.alias("shared"), (shared >= 3).cast("int").alias("flag"))


LEDGER = f"""{FUNDS_CTE}, ledger AS (
    SELECT name, NULL AS partner_id, program_id, NULL AS cycle_id, date_posted, amount FROM funds
     WHERE state = 'posted'
    UNION ALL SELECT code || '/' || CAST(entitlement_id AS VARCHAR), partner_id, program_id, cycle_id, valid_from,
        -initial_amount FROM entitlement WHERE state = 'approved')"""


def ledger(t):
    payouts = t.entitlement.where("state = 'approved'").select(
        F.concat_ws("/", "code", F.col("entitlement_id").cast("string")).alias("code"), "partner_id", "program_id",
        "cycle_id", F.col("valid_from").alias("date_posted"), F.col("initial_amount").alias("amount"))
    return programs.fund_report(funds(t), payouts)


@query("e02_numbered_ledger", f"""
    WITH {LEDGER} SELECT row_number() OVER (ORDER BY date_posted, name, partner_id NULLS FIRST, cycle_id NULLS FIRST,
        amount) AS id, name, round(amount, 2) AS amount FROM ledger""")
def _(t):
    return programs.numbered_ledger(ledger(t)).select("id", "name", F.round("amount", 2).alias("amount"))


@query("e02_ledger_by_ranges", f"""
    WITH {LEDGER} SELECT row_number() OVER (ORDER BY date_posted, name, partner_id NULLS FIRST, cycle_id NULLS FIRST,
        amount) AS id, name, round(amount, 2) AS amount FROM ledger""")
def _(t):
    return programs.numbered_ledger(ledger(t)).select("id", "name", F.round("amount", 2).alias("amount"))


@query("g02_fund_report", f"""WITH {LEDGER} SELECT program_id, partner_id IS NULL AS is_fund, count(*) AS n,
    round(sum(amount), 2) AS amount FROM ledger GROUP BY 1, 2""")
def _(t):
    return ledger(t).groupBy("program_id", F.col("partner_id").isNull().alias("is_fund")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


PRIORITY = """WITH c AS (SELECT m.program_id, r.partner_id, r.gender, r.income,
        100 * m.program_id + (SELECT count(*) FROM program_membership x WHERE x.program_id = m.program_id
            AND x.state = 'enrolled') // 2 AS places
    FROM program_membership m JOIN registrant r USING (partner_id) WHERE m.state <> 'enrolled'),
  k AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY gender ASC NULLS LAST, income DESC NULLS FIRST,
        partner_id) AS rank FROM c)
  SELECT program_id, partner_id, rank FROM k WHERE rank <= places"""


def priority(t, **how):
    members = t.program_membership
    taken = members.where("state = 'enrolled'").groupBy("program_id").agg(
        F.count(F.lit(1)).alias("taken"))
    waiting = members.where("state <> 'enrolled'").join(
        t.registrant.select("partner_id", "gender", "income"), "partner_id").join(taken, "program_id", "left")
    places = 100 * F.col("program_id") + F.floor(F.coalesce("taken", F.lit(0)) / 2)
    return programs.priority_list(waiting, ["program_id"], [("gender", "asc"), ("income", "desc")], places, **how).select(
        "program_id", "partner_id", "rank")


@query("e03_priority_rank", PRIORITY)
def _(t):
    return priority(t)


@query("e03_priority_by_ranges", PRIORITY)
def _(t):
    return priority(t)


@query("e04_latest_per_key", """
    SELECT conv_id, turn, role, md5(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1""")
def _(t):
    return programs.latest_per_key(t.conversations, ["conv_id"], ["turn"]).select(
        "conv_id", "turn", "role", F.md5("text").alias("text"))


@query("e04_last_cycle", """
    SELECT program_id, max(cycle_id) AS cycle_id, strftime(max_by(end_date, cycle_id), '%Y-%m-%d') AS end_date
    FROM cycle GROUP BY 1""")
def _(t):
    return programs.latest_per_key(t.cycle, ["program_id"], ["cycle_id"]).select(
        "program_id", "cycle_id", F.col("end_date").cast("string").alias("end_date"))


APPROVE = f"""WITH {BALANCE}, s AS (SELECT *, sum(CASE WHEN state IN ('draft', 'pending_validation')
        THEN initial_amount ELSE 0 END) OVER (PARTITION BY program_id ORDER BY entitlement_id) AS upto FROM entitlement)
    SELECT entitlement_id, CASE WHEN state NOT IN ('draft', 'pending_validation') THEN 'state_error'
        WHEN upto <= coalesce(balance, 0) / 20 + 1e-6 THEN 'approved' ELSE 'insufficient_funds' END AS decision
    FROM s LEFT JOIN bal USING (program_id)"""


def approvals(t, **how):
    balances = programs.fund_balances(funds(t), t.entitlement).withColumn("balance", F.col("balance") / 20)
    return programs.approve(t.entitlement, balances, **how).select("entitlement_id", "decision")


@query("e05_greedy_approval", APPROVE)
def _(t):
    return approvals(t)


@query("e05_approval_by_ranges", APPROVE)
def _(t):
    return approvals(t)


BATCHES = """WITH good AS (SELECT DISTINCT entitlement_id FROM payment WHERE status <> 'failed'),
    due AS (SELECT *, CASE WHEN initial_amount > 400000 THEN 'large' WHEN program_id IN (1, 2) THEN 'urgent'
        WHEN transfer_fee = 0 THEN 'rest' END AS tag FROM entitlement WHERE state = 'approved'
        AND entitlement_id NOT IN (SELECT entitlement_id FROM good)),
    acc AS (SELECT partner_id, min_by(acc_number, account_id) AS account_number FROM bank_account GROUP BY 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY entitlement_id) - 1 AS i,
        CASE tag WHEN 'large' THEN 7 WHEN 'urgent' THEN 20 ELSE 50 END AS size FROM due WHERE tag IS NOT NULL)
    SELECT entitlement_id, tag, tag || '/' || CAST(i // size AS VARCHAR) AS batch, i % size AS row_in_batch,
        account_number FROM k LEFT JOIN acc USING (partner_id)"""


def batches(t, **how):
    tags = [("large", F.col("initial_amount") > 400000, 7), ("urgent", F.col("program_id").isin(1, 2), 20),
            ("rest", F.col("transfer_fee") == 0, 50)]
    good = t.payment.where("status <> 'failed'").select("entitlement_id")
    return programs.payment_batches(t.entitlement, good, tags, t.bank_account, **how)


@query("e06_payment_batches", BATCHES)
def _(t):
    return batches(t).select("entitlement_id", "tag", "batch", "row_in_batch", "account_number")


@query("e07_first_child", """
    SELECT partner_id, min_by(acc_number, account_id) AS account, min_by(value, id_type) AS document
    FROM bank_account JOIN reg_id USING (partner_id) GROUP BY 1""")
def _(t):
    account = t.bank_account.groupBy("partner_id").agg(F.min_by("acc_number", "account_id").alias("account"))
    document = t.reg_id.groupBy("partner_id").agg(F.min_by("value", "id_type").alias("document"))
    return account.join(document, "partner_id")


@query("e08_tag_routing", """
    SELECT entitlement_id, CASE WHEN initial_amount > 400000 THEN 'large' WHEN program_id IN (1, 2) THEN 'urgent'
        WHEN state = 'draft' THEN 'later' END AS tag FROM entitlement""")
def _(t):
    return t.entitlement.select("entitlement_id", programs.first_tag([
        ("large", F.col("initial_amount") > 400000), ("urgent", F.col("program_id").isin(1, 2)),
        ("later", F.col("state") == "draft")]).alias("tag"))


@query("e09_next_cycle", """
    WITH l AS (SELECT program_id, count(*) AS n, max_by(end_date, cycle_id) AS last_end FROM cycle GROUP BY 1),
      s AS (SELECT program_id, n + 1 AS sequence, CASE WHEN day(last_end + 1) <= 10
        THEN CAST(date_trunc('month', last_end + 1) AS DATE) + 9
        ELSE CAST(date_trunc('month', last_end + 1) + INTERVAL 1 MONTH AS DATE) + 9 END AS start_date FROM l)
    SELECT program_id, sequence, strftime(start_date, '%Y-%m-%d') AS start_date,
        strftime(CAST(start_date + INTERVAL 1 MONTH AS DATE) - 1, '%Y-%m-%d') AS end_date FROM s""")
def _(t):
    from benefica.functions.dates import cycle_range

    last = t.cycle.groupBy("program_id").agg(F.count(F.lit(1)).alias("n"),
                                             F.max_by("end_date", "cycle_id").alias("last_end"))
    start, end = cycle_range(F.date_add("last_end", 1), {"type": "monthly", "interval": 1, "day": 10})
    return last.select("program_id", (F.col("n") + 1).alias("sequence"), start.cast("string").alias("start_date"),
                       end.cast("string").alias("end_date"))


@query("f01_top_alerts", f"""
    WITH {STAR} SELECT partner_id, round(network_risk, 4) AS risk_score FROM feat WHERE network_risk >= 0.4
    ORDER BY network_risk DESC, partner_id LIMIT 100""")
def _(t):
    return features_of(t).where("network_risk >= 0.4").orderBy(F.desc("network_risk"), "partner_id").limit(100).select(
        "partner_id", F.round("network_risk", 4).alias("risk_score"))


@query("f02_multi_key_sort", """
    SELECT partner_id, row_number() OVER (ORDER BY gender DESC NULLS FIRST, birthdate ASC NULLS LAST, partner_id) AS place
    FROM registrant""")
def _(t):
    order = [*programs.sort_columns([("gender", "desc"), ("birthdate", "asc")]), F.col("partner_id")]
    return running(t.registrant, [], order, position="place").select("partner_id", "place")


@query("f03_missing_last", """
    SELECT partner_id, row_number() OVER (ORDER BY disabled ASC NULLS LAST, partner_id) AS place FROM registrant""")
def _(t):
    return running(t.registrant, [], [F.asc_nulls_last("disabled"), F.col("partner_id")], position="place").select(
        "partner_id", "place")


@query("f06_page", "SELECT entitlement_id FROM entitlement ORDER BY initial_amount, entitlement_id LIMIT 100 OFFSET 300")
def _(t):
    return t.entitlement.orderBy("initial_amount", "entitlement_id").offset(300).limit(100).select("entitlement_id")


@query("f07_first_neighbours", f"""
    WITH {EDGES_SQL}, both_ways AS (SELECT src AS id, dst AS neighbour FROM edge UNION ALL SELECT dst, src FROM edge),
      k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY neighbour) AS place FROM both_ways)
    SELECT id, place, neighbour FROM k WHERE place <= 5""")
def _(t):
    return first_neighbours(graph_nodes(t), EDGE_WEIGHTS)


@query("g01_concatenate", """
    SELECT c_custkey AS id, c_name AS name, 0 AS source FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier""")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("source"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("source"))
    return a.unionByName(b)


@query("g03_difference", """
    SELECT partner_id FROM registrant WHERE NOT is_group EXCEPT SELECT partner_id FROM program_membership
     WHERE program_id = 1""")
def _(t):
    return t.registrant.where("NOT is_group").select("partner_id").join(
        t.program_membership.where("program_id = 1").select("partner_id"), "partner_id", "left_anti")


@query("g04_intersection", """
    SELECT entitlement_id FROM entitlement WHERE state = 'approved' INTERSECT SELECT entitlement_id FROM payment
     WHERE status = 'failed'""")
def _(t):
    return t.entitlement.where("state = 'approved'").select("entitlement_id").join(
        t.payment.where("status = 'failed'").select("entitlement_id"), "entitlement_id", "left_semi")


@query("g05_union_distinct", """
    SELECT partner_id FROM program_membership WHERE state = 'exited' UNION SELECT partner_id FROM entitlement
     WHERE state = 'draft'""")
def _(t):
    return t.program_membership.where("state = 'exited'").select("partner_id").union(
        t.entitlement.where("state = 'draft'").select("partner_id")).distinct()


@query("g06_key_sets", """
    SELECT partner_id, CASE WHEN gender IS NULL THEN '' ELSE 'gender' END AS removed,
        CASE WHEN zone_id > 12 THEN 'zone' ELSE '' END AS added,
        CASE WHEN company_id > 1 THEN 'company' ELSE '' END AS changed,
        CASE WHEN company_id > 1 THEN 'kind' ELSE 'company,kind' END AS unchanged FROM registrant""")
def _(t):
    past = F.expr("map_filter(map('gender', gender, 'kind', kind, 'company', CAST(company_id AS STRING)), "
                  "(k, v) -> v IS NOT NULL)")
    now = F.expr("map_filter(map('zone', IF(zone_id > 12, 'z', NULL), 'kind', kind, 'company', "
                 "CAST(company_id % 2 AS STRING)), (k, v) -> v IS NOT NULL)")
    sets = records.key_sets(F.col("past"), F.col("now"))
    return t.registrant.select("partner_id", past.alias("past"), now.alias("now")).select(
        "partner_id", *[F.array_join(c, ",").alias(n) for n, c in sets.items()])


@query("g07_distinct_first_seen", """
    SELECT record_id, count(DISTINCT op) AS n_ops FROM change_event GROUP BY 1""")
def _(t):
    seen = t.change_event.select("record_id", "op").dropDuplicates()
    return seen.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_ops"))


def first_seen(df, keys, value, order):
    """Each value of a key once, numbered in the order in which it was first seen; one aggregate, then ordered ranges."""
    seen = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    return running(seen, list(keys), [F.col("_at")], position="place").select(*keys, "place", value)


@query("g07_first_seen_order", """
    WITH s AS (SELECT record_id, op, min(ts) AS seen, min_by(event_id, (ts, event_id)) AS e FROM change_event GROUP BY 1, 2)
    SELECT record_id, op, row_number() OVER (PARTITION BY record_id ORDER BY seen, e) AS place FROM s""")
def _(t):
    return first_seen(t.change_event, ["record_id"], "op", ["ts", "event_id"])

