"""Joins: lookups, differences, resolution, allocation, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.operators import eligibility, households, payments, programs, records
from benefica.plans.projections import AFTER, after_image
from benefica.plans.registry import query
from benefica.scale import running
from benefica.sources import statements

def as_of():
    return F.lit("2002-01-01").cast("date")
ORDER = [f"o{i}" for i in range(1, 9)]


@query("c05_id_lookup", """
    SELECT r.partner_id, r.name, d.id_type, d.value, k.label FROM registrant r JOIN reg_id d USING (partner_id)
    LEFT JOIN (SELECT DISTINCT c_mktsegment AS kind, lower(c_mktsegment) AS label FROM customer
               WHERE c_mktsegment <> 'MACHINERY') k USING (kind) WHERE r.is_group""")
def _(t):
    kinds = t.customer.where("c_mktsegment <> 'MACHINERY'").selectExpr(
        "c_mktsegment AS kind", "lower(c_mktsegment) AS label").distinct()
    return t.registrant.where("is_group").join(t.reg_id, "partner_id").join(kinds, "kind", "left").select(
        "partner_id", "name", "id_type", "value", "label")


@query("c06_member_lookup", """
    SELECT m.group_id, m.individual_id, d.id_type, d.value FROM group_membership m
    JOIN registrant r ON r.partner_id = m.individual_id JOIN reg_id d ON d.partner_id = m.individual_id
    WHERE m.group_id IN (SELECT partner_id FROM registrant WHERE is_group AND income > 5000)""")
def _(t):
    groups = t.registrant.where("is_group AND income > 5000").select(F.col("partner_id").alias("group_id"))
    people = t.registrant.select(F.col("partner_id").alias("individual_id"))
    ids = t.reg_id.withColumnRenamed("partner_id", "individual_id")
    return t.group_membership.join(groups, "group_id", "left_semi").join(people, "individual_id", "left_semi").join(
        ids, "individual_id").select("group_id", "individual_id", "id_type", "value")


MEMBERS = """FROM group_membership m JOIN registrant g ON g.partner_id = m.group_id
    JOIN registrant p ON p.partner_id = m.individual_id
    WHERE g.is_registrant AND g.is_group AND g.disabled IS NULL AND p.disabled IS NULL AND m.ended_date IS NULL"""


@query("c07_group_members", f"SELECT m.group_id, count(*) AS members {MEMBERS} AND p.income < 6000 GROUP BY 1")
def _(t):
    return households.member_counts(t.registrant, t.group_membership, member_domain=[("income", "<", 6000)])


@query("c08_without_entitlement", """
    SELECT DISTINCT m.partner_id FROM program_membership m WHERE m.program_id = 2 AND NOT EXISTS (
        SELECT 1 FROM entitlement e WHERE e.partner_id = m.partner_id AND e.program_id = 2
          AND e.state = 'approved')""")
def _(t):
    has = t.entitlement.where("program_id = 2 AND state = 'approved'").select("partner_id")
    return t.program_membership.where("program_id = 2").join(has, "partner_id", "left_anti").select(
        "partner_id").distinct()


@query("c09_import_counts", """
    WITH sel AS (SELECT partner_id FROM registrant WHERE income > 1000),
         mem AS (SELECT DISTINCT partner_id FROM program_membership WHERE program_id = 4)
    SELECT count(*) AS total, count(*) FILTER (partner_id IN (SELECT partner_id FROM mem)) AS ignored,
           count(*) FILTER (partner_id NOT IN (SELECT partner_id FROM mem)) AS added FROM sel""")
def _(t):
    return eligibility.import_counts(t.registrant.where("income > 1000"), t.program_membership.where("program_id = 4"))


@query("c10_unresolved_disbursements", """
    SELECT disbursement_id, beneficiary_id FROM disbursement d WHERE NOT EXISTS (
        SELECT 1 FROM id_fa_mapping m WHERE m.beneficiary_id = d.beneficiary_id)""")
def _(t):
    resolved = t.disbursement.join(t.id_fa_mapping.select("beneficiary_id"), "beneficiary_id", "left_semi")
    return payments.unresolved(t.disbursement, resolved).select("disbursement_id", "beneficiary_id")


@query("c11_orphan_rows", """
    SELECT 'mapping' AS target, CAST(beneficiary_id AS VARCHAR) AS key, count(*) AS n FROM disbursement
     WHERE beneficiary_id NOT IN (SELECT beneficiary_id FROM id_fa_mapping) GROUP BY ALL
    UNION ALL SELECT 'entitlement', CAST(entitlement_id AS VARCHAR), count(*) FROM payment
     WHERE entitlement_id NOT IN (SELECT entitlement_id FROM entitlement WHERE state = 'approved') GROUP BY ALL""")
def _(t):
    def orphans(name, df, key, targets):
        return df.join(targets.select(key), key, "left_anti").groupBy(
            F.lit(name).alias("target"), F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))

    return orphans("mapping", t.disbursement, "beneficiary_id", t.id_fa_mapping).unionByName(
        orphans("entitlement", t.payment, "entitlement_id", t.entitlement.where("state = 'approved'")))


@query("c12_resolve_ids", """
    WITH q AS (SELECT 'R' || CAST(partner_id AS VARCHAR) AS reference_id,
        CASE WHEN partner_id % 50 = 0 THEN '' ELSE 'ID' || CAST(partner_id AS VARCHAR) END AS id_value,
        CASE WHEN partner_id % 2 = 0 THEN 'details' ELSE 'yes_no' END AS scope FROM registrant)
    SELECT reference_id, q.id_value, CASE WHEN q.id_value = '' THEN 'rjct' ELSE 'succ' END AS status,
        CASE WHEN q.id_value = '' THEN 'rjct.reference_id.invalid' WHEN m.id_value IS NOT NULL THEN 'succ.id.active'
             ELSE 'succ.fa.not_linked_to_id' END AS reason,
        CASE WHEN scope = 'details' THEN m.fa_value END AS fa_value
    FROM q LEFT JOIN id_fa_mapping m ON m.id_value = q.id_value""")
def _(t):
    q = t.registrant.selectExpr(
        "'R' || partner_id AS reference_id",
        "CASE WHEN partner_id % 50 = 0 THEN '' ELSE 'ID' || partner_id END AS id_value",
        "CASE WHEN partner_id % 2 = 0 THEN 'details' ELSE 'yes_no' END AS scope")
    return payments.resolve(q, t.id_fa_mapping)


RESOLVED = """resolved AS (SELECT d.*, m.fa_value, m.name AS resolved_name,
    count(*) OVER (PARTITION BY batch_id, d.beneficiary_id) > 1 AS is_repeated
    FROM disbursement d LEFT JOIN id_fa_mapping m ON m.beneficiary_id = d.beneficiary_id)"""


@query("c13_resolve_accounts", f"WITH {RESOLVED} SELECT disbursement_id, fa_value, is_repeated FROM resolved")
def _(t):
    return payments.mark_repeated(payments.resolve_accounts(t.disbursement, t.id_fa_mapping)).select(
        "disbursement_id", "fa_value", "is_repeated")


@query("c13_batch_status", f"""
    WITH {RESOLVED} SELECT batch_id, count(*) AS n, count(*) FILTER (fa_value IS NULL) AS n_missing,
        CASE WHEN bool_or(fa_value IS NULL) THEN 'ERROR' ELSE 'PROCESSED' END AS status FROM resolved GROUP BY 1""")
def _(t):
    return payments.batch_resolution_status(payments.resolve_accounts(t.disbursement, t.id_fa_mapping))


@query("c14_geo_resolution", """
    SELECT d.disbursement_id, g.zone_large, g.zone_small FROM disbursement d JOIN geo_resolution g
    ON g.beneficiary_id = d.beneficiary_id""")
def _(t):
    return payments.resolve_zones(t.disbursement, t.geo_resolution).select(
        "disbursement_id", "zone_large", "zone_small")


ZONES = """zones AS (SELECT zone_large, zone_small, round(sum(quantity), 2) AS total_quantity,
    count(*) AS n_beneficiaries FROM disbursement d JOIN geo_resolution g ON g.beneficiary_id = d.beneficiary_id
    GROUP BY 1, 2)"""
ALLOC = """alloc AS (SELECT s_nationkey AS zone_small, min(s_suppkey) AS agency FROM supplier WHERE s_acctbal > 3000
    GROUP BY 1)"""


def agencies(t):
    return t.supplier.where("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("zone_small")).agg(
        F.min("s_suppkey").alias("agency"))


@query("c15_zone_allocation", f"""
    WITH {ZONES}, {ALLOC}, w AS (SELECT s_nationkey % 5 AS zone_large, max(s_suppkey) AS warehouse FROM supplier
        GROUP BY 1)
    SELECT zone_large, zone_small, total_quantity, n_beneficiaries, warehouse, 'PROCESSED' AS warehouse_status, agency,
        CASE WHEN agency IS NULL THEN 'ERROR' ELSE 'PROCESSED' END AS agency_status
    FROM zones JOIN w USING (zone_large) LEFT JOIN alloc USING (zone_small)""")
def _(t):
    zones = payments.zone_totals(payments.resolve_zones(t.disbursement, t.geo_resolution)).withColumn(
        "total_quantity", F.round("total_quantity", 2))
    warehouses = t.supplier.groupBy((F.col("s_nationkey") % 5).alias("zone_large")).agg(
        F.max("s_suppkey").alias("warehouse"))
    placed = payments.allocate(zones, warehouses, "zone_large", "warehouse")
    return payments.allocate(placed, agencies(t), "zone_small", "agency")


def payload_rows(t):
    sponsors = t.envelope.select("envelope_id", F.concat(F.lit("SP-"), "program_mnemonic").alias("sponsor_account"))
    return payments.digital_payloads(payments.resolve_accounts(t.disbursement, t.id_fa_mapping), sponsors)


@query("c16_digital_payloads", f"""
    WITH {RESOLVED} SELECT disbursement_id, quantity,
        coalesce(nullif(beneficiary_name, ''), nullif(resolved_name, ''), 'N/A') AS payee_name,
        'SP-' || e.program_mnemonic AS sponsor_account,
        coalesce(regexp_extract(fa_value, '^account_number:([^.]*)[.]', 1), '') AS account_number,
        coalesce(regexp_extract(fa_value, 'bank_code:([^.]*)[.]', 1), '') AS bank_code,
        coalesce(regexp_extract(fa_value, 'wallet_provider_code:([^.]*)[.]', 1), '') AS wallet_provider_code,
        coalesce(regexp_extract(fa_value, 'fa_type:(.*)$', 1), '') AS fa_type, quantity <= 0 AS to_recon
    FROM resolved LEFT JOIN envelope e ON e.envelope_id = resolved.envelope_id""")
def _(t):
    return payments.split_by_quantity(payload_rows(t)).select(
        "disbursement_id", "quantity", "payee_name", "sponsor_account", "account_number", "bank_code", "wallet_provider_code", "fa_type", "to_recon")


@query("c17_physical_payloads", f"""
    WITH {ZONES}, {ALLOC} SELECT zone_large, zone_small, total_quantity, s_name AS agency_name,
        round(s_acctbal, 2) AS agency_float FROM zones LEFT JOIN alloc USING (zone_small)
    LEFT JOIN supplier ON s_suppkey = agency""")
def _(t):
    zones = payments.zone_totals(payments.resolve_zones(t.disbursement, t.geo_resolution))
    attributes = t.supplier.select(F.col("s_suppkey").alias("agency"), F.col("s_name").alias("agency_name"),
                                   F.round("s_acctbal", 2).alias("agency_float"))
    return payments.allocate(zones, agencies(t), "zone_small", "agency").join(attributes, "agency", "left").select(
        "zone_large", "zone_small", F.round("total_quantity", 2).alias("total_quantity"), "agency_name", "agency_float")


RECEIVED = """rec AS (SELECT envelope_id, count(*) AS received_n, round(sum(quantity), 2) AS received_total,
    count(*) FILTER (cancellation_status <> 'CANCELLED') AS live_n,
    round(coalesce(sum(quantity) FILTER (cancellation_status <> 'CANCELLED'), 0), 2) AS live_total
    FROM disbursement GROUP BY 1)"""


@query("c18_funds_gate", f"""
    WITH {RECEIVED} SELECT e.envelope_id, funds_status FROM envelope e JOIN rec USING (envelope_id)
    WHERE received_n = declared_n AND abs(received_total - declared_total) < 0.005
      AND cancellation_status = 'NOT_CANCELLED' AND (schedule_date IS NULL OR schedule_date = DATE '2002-01-01')
      AND funds_status IN ('PENDING_CHECK', 'FUNDS_NOT_AVAILABLE')""")
def _(t):
    return payments.funds_gate(t.envelope, payments.received_counters(t.disbursement), as_of()).select(
        "envelope_id", "funds_status")


@query("d13_envelope_counters", f"WITH {RECEIVED} SELECT * FROM rec")
def _(t):
    return payments.received_counters(t.disbursement)


@query("d14_envelope_limits", f"""
    WITH q AS (SELECT o_custkey % 500 AS request_id, CASE WHEN o_custkey % 20 = 0 THEN 'V' || CAST(o_orderkey % 3 AS
        VARCHAR) WHEN o_custkey % 9 = 0 THEN 'V0000' ELSE 'V' || CAST(19921 + 10 * (o_custkey % 7) AS VARCHAR) END
        AS envelope_id, o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 0.00001 ELSE 0.01 END AS quantity FROM orders),
      a AS (SELECT request_id, count(*) AS n, sum(quantity) AS q, min(envelope_id) AS envelope_id,
            count(DISTINCT envelope_id) > 1 AS several FROM q GROUP BY 1),
      {RECEIVED}
    SELECT request_id, CASE WHEN several THEN 'MULTIPLE_ENVELOPES_FOUND'
        WHEN declared_n IS NULL THEN 'DISBURSEMENT_ENVELOPE_NOT_FOUND'
        WHEN cancellation_status = 'CANCELLED' THEN 'DISBURSEMENT_ENVELOPE_ALREADY_CANCELED'
        WHEN received_n - 100 + n > declared_n THEN 'NO_OF_DISBURSEMENTS_EXCEEDS_DECLARED'
        WHEN received_total - 100 + q > declared_total + 0.005 THEN 'TOTAL_DISBURSEMENT_QUANTITY_EXCEEDS_DECLARED'
        END AS error
    FROM a LEFT JOIN envelope USING (envelope_id) LEFT JOIN rec USING (envelope_id)""")
def _(t):
    q = t.orders.selectExpr(
        "o_custkey % 500 AS request_id",
        "CASE WHEN o_custkey % 20 = 0 THEN 'V' || o_orderkey % 3 WHEN o_custkey % 9 = 0 THEN 'V0000' "
        "ELSE 'V' || (19921 + 10 * (o_custkey % 7)) END AS envelope_id",
        "o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 0.00001D ELSE 0.01D END AS quantity")
    received = payments.received_counters(t.disbursement).withColumns({
        "received_n": F.col("received_n") - 100, "received_total": F.col("received_total") - 100})
    return payments.envelope_limit_errors(q, t.envelope, received)


@query("d15_zone_totals", f"WITH {ZONES} SELECT * FROM zones")
def _(t):
    return payments.zone_totals(payments.resolve_zones(t.disbursement, t.geo_resolution)).withColumn(
        "total_quantity", F.round("total_quantity", 2))


@query("c19_auto_enrol", """
    SELECT partner_id, 1 AS program_id, 'draft' AS state FROM registrant WHERE disabled IS NULL AND is_registrant
      AND NOT is_group AND income < 1500
    UNION ALL SELECT partner_id, 2, 'draft' FROM registrant WHERE disabled IS NULL AND is_registrant AND is_group
      AND kind IN ('BUILDING', 'HOUSEHOLD')""")
def _(t):
    return eligibility.auto_enrol(t.registrant, [
        (1, "individual", [("income", "<", 1500)]), (2, "group", [("kind", "in", ["BUILDING", "HOUSEHOLD"])])])


LINES = f"""lines AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY {", ".join(ORDER)})
    AS entry_sequence FROM statement_line)"""
GEO = "geo AS (SELECT DISTINCT 'G' || CAST(p_partkey % 40 AS VARCHAR) AS geo_batch_id FROM part WHERE p_size < 20)"
RECON = f"""{LINES}, {GEO}, target AS (
    SELECT l.*, CASE WHEN d.disbursement_id IS NOT NULL THEN 'disbursement' WHEN g.geo_batch_id IS NOT NULL
        THEN 'geo_batch' END AS target,
        row_number() OVER (PARTITION BY reconciliation_id, indicator ORDER BY statement_order, entry_sequence) AS k
    FROM lines l LEFT JOIN disbursement d ON d.disbursement_id = l.reconciliation_id
         LEFT JOIN geo g ON g.geo_batch_id = l.reconciliation_id WHERE indicator IN ('D', 'RD')),
  firsts AS (SELECT reconciliation_id, statement_order AS first_order FROM target WHERE indicator = 'D' AND k = 1),
  judged AS (SELECT t.*, CASE WHEN target IS NULL THEN 'INVALID_RECONCILIATION_ID'
        WHEN indicator = 'D' AND k > 1 THEN 'DUPLICATE_DISBURSEMENT' WHEN indicator = 'D' THEN 'RECONCILED'
        WHEN first_order <= statement_order THEN 'REVERSED' ELSE 'INVALID_REVERSAL' END AS outcome
    FROM target t LEFT JOIN firsts USING (reconciliation_id))"""


def geo_batches(t):
    return t.part.where("p_size < 20").selectExpr("'G' || p_partkey % 40 AS geo_batch_id").distinct()


def parsed(t):
    texts = statements.compose(t.statement_line, ORDER)
    order = F.split("statement_id", "-")
    return statements.transactions(texts).withColumn(
        "statement_order", order[1].cast("long") * 1000000 + F.substring(order[0], 2, 20).cast("long"))


def numbered_lines(t):
    judged_by = ["statement_id", "statement_order", "reconciliation_id", "indicator", "amount"]
    return running(t.statement_line.select(*judged_by, *ORDER), ["statement_id"], [F.col(c) for c in ORDER], position="entry_sequence", kept=judged_by)


def judged(t):
    return payments.reconcile(numbered_lines(t), t.disbursement, geo_batches(t))


@query("a08_statement_transactions", f"""
    WITH {LINES} SELECT statement_id, entry_sequence, indicator, round(amount, 2) AS amount, reconciliation_id,
        reference AS bank_reference, 'Transfer ' || reference AS narrative, '20' || strftime(value_date, '%y-%m-%d')
        AS value_date FROM lines""")
def _(t):
    return parsed(t).select("statement_id", "entry_sequence", "indicator", F.round("amount", 2).alias("amount"),
                            "reconciliation_id", "bank_reference", "narrative",
                            F.col("value_date").cast("string").alias("value_date"))


@query("a08_statement_headers", """
    SELECT DISTINCT statement_id, 'REF' || statement_id AS reference_number, split_part(statement_id, '-', 2)
        AS statement_number, '1' AS sequence_number, 'ACC' || split_part(statement_id, '-', 1) AS account_number,
        CASE WHEN s_suppkey IS NULL THEN 'ERROR' ELSE 'PROCESSED' END AS status,
        CASE WHEN s_suppkey IS NULL THEN 'INVALID_ACCOUNT_NUMBER' END AS error
    FROM statement_line LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0)
      ON 'S' || CAST(s_suppkey AS VARCHAR) = split_part(statement_id, '-', 1)""")
def _(t):
    sponsors = t.supplier.where("s_acctbal > 0").selectExpr("'ACCS' || s_suppkey AS account_number")
    pages = statements.compose(t.statement_line, ORDER)
    return statements.account_check(statements.headers(pages.where("page = 1")), sponsors)


@query("c21_reconcile_lines", f"""
    WITH {RECON} SELECT statement_id, entry_sequence, reconciliation_id, target, outcome FROM judged""")
def _(t):
    return judged(t).select("statement_id", "entry_sequence", "reconciliation_id", "target", "outcome")


@query("l04_recon_batch", f"""
    WITH {RECON}, back AS (SELECT reconciliation_id, statement_id AS rs, entry_sequence AS re, row_number() OVER (
        PARTITION BY reconciliation_id ORDER BY statement_order DESC, entry_sequence DESC) AS z FROM judged
        WHERE outcome = 'REVERSED')
    SELECT reconciliation_id, target, statement_id, entry_sequence, round(amount, 2) AS amount,
        rs IS NOT NULL AS reversal_found, rs AS reversal_statement_id, re AS reversal_entry_sequence
    FROM judged LEFT JOIN (SELECT * FROM back WHERE z = 1) USING (reconciliation_id) WHERE outcome = 'RECONCILED'""")
def _(t):
    return payments.recon_records(judged(t)).withColumn("amount", F.round("amount", 2))


@query("c22_disbursement_status", f"""
    WITH {RECON} SELECT d.disbursement_id, count(j.outcome) FILTER (outcome IN ('RECONCILED', 'REVERSED')) AS n_recon,
        count(j.outcome) FILTER (outcome NOT IN ('RECONCILED', 'REVERSED')) AS n_errors,
        coalesce(bool_or(outcome = 'REVERSED'), false) AS reversed
    FROM disbursement d LEFT JOIN judged j ON j.reconciliation_id = d.disbursement_id GROUP BY 1""")
def _(t):
    good = F.col("outcome").isin("RECONCILED", "REVERSED")
    counts = judged(t).groupBy(F.col("reconciliation_id").alias("disbursement_id")).agg(
        F.count_if(good).alias("n_recon"), F.count_if(~good).alias("n_errors"),
        F.bool_or(F.col("outcome") == "REVERSED").alias("reversed"))
    return t.disbursement.select("disbursement_id").join(counts, "disbursement_id", "left").na.fill(
        0, ["n_recon", "n_errors"]).na.fill(False, ["reversed"])


@query("c23_envelope_status", f"""
    WITH {RECON}, {RECEIVED}, r AS (SELECT d.envelope_id, count(*) FILTER (outcome = 'RECONCILED') AS n_reconciled,
        count(*) FILTER (outcome = 'REVERSED') AS n_reversed FROM judged j JOIN disbursement d
        ON d.disbursement_id = j.reconciliation_id GROUP BY 1),
      z AS (SELECT envelope_id, count(DISTINCT zone_small) AS n_geo_batches FROM disbursement d JOIN geo_resolution g
        ON g.beneficiary_id = d.beneficiary_id GROUP BY 1)
    SELECT e.envelope_id, e.declared_n, received_n, e.funds_status, coalesce(n_reconciled, 0) AS n_reconciled,
        coalesce(n_reversed, 0) AS n_reversed, coalesce(n_geo_batches, 0) AS n_geo_batches
    FROM envelope e LEFT JOIN rec USING (envelope_id) LEFT JOIN r USING (envelope_id) LEFT JOIN z USING (envelope_id)""")
def _(t):
    recon = judged(t).join(t.disbursement.select(F.col("disbursement_id").alias("reconciliation_id"), "envelope_id"),
                           "reconciliation_id").groupBy("envelope_id").agg(
        F.count_if(F.col("outcome") == "RECONCILED").alias("n_reconciled"),
        F.count_if(F.col("outcome") == "REVERSED").alias("n_reversed"))
    zones = payments.resolve_zones(t.disbursement, t.geo_resolution).groupBy("envelope_id").agg(
        F.countDistinct("zone_small").alias("n_geo_batches"))
    out = t.envelope.join(payments.received_counters(t.disbursement), "envelope_id", "left")
    return out.join(recon, "envelope_id", "left").join(zones, "envelope_id", "left").na.fill(0).select(
        "envelope_id", "declared_n", "received_n", "funds_status", "n_reconciled", "n_reversed", "n_geo_batches")


@query("c24_external_binding", """
    WITH b AS (SELECT value AS external_id, min(partner_id) AS internal_id, count(DISTINCT partner_id) AS n
        FROM reg_id GROUP BY 1)
    SELECT external_id, CASE WHEN n = 1 THEN internal_id END AS internal_id,
        CASE WHEN n > 1 THEN 'several matches' END AS error FROM b""")
def _(t):
    b = t.reg_id.groupBy(F.col("value").alias("external_id")).agg(
        F.min("partner_id").alias("_first"), F.countDistinct("partner_id").alias("_n"))
    return b.select("external_id", F.when(F.col("_n") == 1, F.col("_first")).alias("internal_id"),
                    F.when(F.col("_n") > 1, "several matches").alias("error"))


@query("c25_household_head", """
    SELECT r.partner_id, CASE WHEN r.is_group THEN h.head_id ELSE r.partner_id END AS payee_id FROM registrant r
    LEFT JOIN (SELECT group_id, min(individual_id) AS head_id FROM group_membership WHERE kind = 'head' GROUP BY 1) h
      ON h.group_id = r.partner_id""")
def _(t):
    return households.payee_of(t.registrant, t.group_membership).select("partner_id", "payee_id")


FIELD_LOG = " UNION ALL ".join(
    f"SELECT r.partner_id, '{f}' AS field, CAST(r.{f} AS VARCHAR) AS old_value, CAST(a.{f} AS VARCHAR) AS new_value "
    f"FROM registrant r JOIN a USING (partner_id) WHERE a.{f} IS DISTINCT FROM r.{f}"
    for f in ("gender", "kind", "company_id"))


@query("c26_audit_lines", f"""
    WITH a AS ({AFTER.format(r='registrant')}), lines AS ({FIELD_LOG})
    SELECT l.*, r.write_date > DATE '2000-01-01' AS recent FROM lines l JOIN registrant r USING (partner_id)""")
def _(t):
    lines = records.field_log(t.registrant, after_image(t), "partner_id", ["gender", "kind", "company_id", "name"],
                              excluded=["name"]).drop("change")
    heads = t.registrant.select("partner_id", (F.col("write_date") > F.lit("2000-01-01").cast("date")).alias("recent"))
    return lines.join(heads, "partner_id")


@query("c27_agency_notices", f"""
    WITH {ALLOC}, rows AS (SELECT agency, disbursement_id, quantity, row_number() OVER (PARTITION BY agency
        ORDER BY disbursement_id) - 1 AS k FROM disbursement d JOIN geo_resolution g
        ON g.beneficiary_id = d.beneficiary_id JOIN alloc USING (zone_small))
    SELECT agency, k // 500 AS chunk, count(*) AS n, md5(string_agg(disbursement_id, ',' ORDER BY k)) AS ids,
        round(sum(quantity), 2) AS quantity FROM rows GROUP BY 1, 2""")
def _(t):
    rows = payments.resolve_zones(t.disbursement, t.geo_resolution).join(agencies(t), "zone_small")
    pages = payments.notices(rows, "agency", F.struct("disbursement_id", "quantity"), [F.col("disbursement_id")])
    return pages.select(
        "agency", "chunk", "n", F.md5(F.array_join("entries.disbursement_id", ",")).alias("ids"),
        F.round(F.aggregate("entries.quantity", F.lit(0.0), lambda a, x: a + x), 2).alias("quantity"))


@query("c28_assessment_after", """
    WITH e AS (SELECT partner_id, max(valid_from) AS last_entitlement FROM entitlement WHERE state = 'approved'
        GROUP BY 1), a AS (SELECT partner_id, max(enrollment_date) AS assessed FROM program_membership GROUP BY 1)
    SELECT a.partner_id, coalesce(assessed > last_entitlement, true) AS show_create FROM a LEFT JOIN e USING
        (partner_id)""")
def _(t):
    last = t.entitlement.where("state = 'approved'").groupBy("partner_id").agg(
        F.max("valid_from").alias("last_entitlement"))
    assessed = t.program_membership.groupBy("partner_id").agg(F.max("enrollment_date").alias("assessed"))
    return assessed.join(last, "partner_id", "left").select(
        "partner_id", F.coalesce(F.col("assessed") > F.col("last_entitlement"), F.lit(True)).alias("show_create"))


@query("c29_reimbursement_claims", """
    WITH q AS (SELECT entitlement_id, CASE WHEN entitlement_id % 8 = 0 THEN 'wrong' ELSE code END AS received,
        CASE WHEN entitlement_id % 3 = 0 THEN 0.0 ELSE initial_amount / 2 END AS amount FROM entitlement
        WHERE state = 'approved')
    SELECT q.entitlement_id, CASE WHEN received <> e.code THEN 2 ELSE 0 END AS error,
        CASE WHEN amount <> 0 THEN amount ELSE e.initial_amount END AS amount FROM q JOIN entitlement e USING
        (entitlement_id)""")
def _(t):
    claims = t.entitlement.where("state = 'approved'").selectExpr(
        "entitlement_id", "CASE WHEN entitlement_id % 8 = 0 THEN 'wrong' ELSE code END AS received",
        "CASE WHEN entitlement_id % 3 = 0 THEN 0.0D ELSE initial_amount / 2 END AS amount")
    return claims.join(t.entitlement.select("entitlement_id", "code", "initial_amount"), "entitlement_id").select(
        "entitlement_id", F.when(F.col("received") != F.col("code"), 2).otherwise(0).alias("error"),
        F.coalesce(F.nullif("amount", F.lit(0.0)), "initial_amount").alias("amount"))
