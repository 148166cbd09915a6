"""Places where users supply text, callables or tables of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.operators import managers, eligibility, payments, records, rules, validation
from benefica.operators.domain import domain_filter, parse_domain
from benefica.plans.fraud import LIGHT, light_features
from benefica.plans.joins import ALLOC, LINES, ORDER, ZONES, agencies
from benefica.plans.registry import query
from benefica.sources import changes, export, statements

def as_of():
    return F.lit("2002-01-01").cast("date")


@query("m01_condition_text", f"""
    WITH {LIGHT} SELECT partner_id, round(least(CASE WHEN nb_programs > 2 AND NOT payment_gap_ratio < 0.3 THEN 0.7 ELSE 0 END
        + CASE WHEN payment_count - cycle_count >= 4 OR age = 12 THEN 0.6 ELSE 0 END, 1.0), 4) AS rule_score FROM feat""")
def _(t):
    own = [
        {"id": "U1", "name": "a", "flag": "A", "severity": "LOW", "weight": 0.7,
         "condition": "nb_programs > 2 and not payment_gap_ratio < 0.3"},
        {"id": "U2", "name": "b", "flag": "B", "severity": "LOW", "weight": 0.6,
         "condition": "payment_count - cycle_count >= 4 or age == 12"},
    ]
    return rules.score_rules(light_features(t), own).select(F.col("beneficiary_id").alias("partner_id"), "rule_score")


@query("m02_domain_text", """
    SELECT partner_id FROM registrant WHERE (kind = 'BUILDING' OR income < 0) AND zone_id >= 3""")
def _(t):
    domain = parse_domain("['&', '|', ('kind', '=', 'BUILDING'), ('income', '<', 0), ('zone_id', '>=', 3)]")
    return domain_filter(t.registrant, domain).select("partner_id")


@query("m03_expression_text", """
    SELECT partner_id, upper(kind) || '-' || CAST(zone_id AS VARCHAR) AS label, 'registry' AS origin FROM registrant
    WHERE income > 3000 AND NOT is_group""")
def _(t):
    return changes.transform_records(
        t.registrant, "income > 3000 AND NOT is_group",
        {"partner_id": "partner_id", "label": "concat_ws('-', upper(kind), zone_id)"}, {"origin": "registry"})


@query("m04_rule_callables", """
    SELECT partner_id, 'young group' AS rule FROM registrant WHERE is_group AND birthdate > DATE '1985-01-01'
    UNION ALL SELECT partner_id, 'zone of company' FROM registrant WHERE zone_id % 4 <> company_id""")
def _(t):
    return validation.detect_exceptions(t.registrant, "partner_id", {
        "young group": lambda df: df["is_group"] & (df["birthdate"] > F.lit("1985-01-01").cast("date")),
        "zone of company": lambda df: df["zone_id"] % 4 != df["company_id"]})


@query("m05_chosen_managers", """
    SELECT partner_id FROM registrant r WHERE disabled IS NULL AND is_registrant AND is_group AND income > 1000
      AND EXISTS (SELECT 1 FROM reg_id d WHERE d.partner_id = r.partner_id AND id_type = 'National ID'
                  AND (expiry_date IS NULL OR expiry_date > DATE '2002-01-01'))""")
def _(t):
    settings = [{"kind": "default", "target": "group", "domain": [("income", ">", 1000)]},
                {"kind": "id_document", "id_types": ["National ID"]}]
    return eligibility.chain(t.registrant, eligibility.chosen_managers(settings, t, as_of())).select("partner_id")


# Programs 1 and 2 use other managers of every role; program 3 has two for eligibility and two against duplicates.
SETTINGS = [
    (1, "eligibility", "default", {"target": "individual", "least_income": "1000"}), (1, "deduplication", "id", {"id_type": "Household ID"}),
    (1, "entitlement", "default", {"base": "100", "per_member": "20"}), (1, "payment", "account", {"currency": "USD"}), (1, "cycle", "days", {"days": "14"}),
    (2, "eligibility", "id_document", {"id_type": "National ID"}), (2, "deduplication", "phone", {}),
    (2, "entitlement", "share_of_income", {"share": "0.1", "least": "50"}), (2, "payment", "cash", {}), (2, "cycle", "months", {"months": "1"}),
    (3, "eligibility", "default", {"target": "group"}), (3, "eligibility", "phone", {}), (3, "deduplication", "id", {}), (3, "deduplication", "phone", {}),
    (3, "entitlement", "default", {"base": "10", "per_member": "5", "max_members": "3"}),
]


@query("m05_programs_by_settings", """
    WITH docs AS (SELECT DISTINCT partner_id, id_type FROM reg_id WHERE value IS NOT NULL AND (expiry_date IS NULL OR expiry_date > DATE '2002-01-01')),
      dup AS (SELECT DISTINCT partner_id, id_type FROM reg_id WHERE (id_type, value) IN (SELECT (id_type, value) FROM reg_id GROUP BY id_type, value HAVING count(DISTINCT partner_id) > 1)),
      ph AS (SELECT DISTINCT partner_id, phone_sanitized AS p FROM phone_number WHERE phone_sanitized IS NOT NULL AND disabled IS NULL),
      dph AS (SELECT DISTINCT partner_id FROM ph WHERE p IN (SELECT p FROM ph GROUP BY p HAVING count(*) > 1)),
      mem AS (SELECT group_id AS partner_id, count(*) AS n FROM group_membership WHERE ended_date IS NULL GROUP BY 1),
      acc AS (SELECT DISTINCT partner_id FROM bank_account WHERE active),
      f AS (SELECT m.membership_id, m.partner_id, m.program_id, r.is_group, coalesce(r.income, 0) AS income, zone_id, coalesce(mem.n, 0) AS n,
          coalesce(r.is_registrant, false) AND r.disabled IS NULL AS live,
          EXISTS (SELECT 1 FROM docs d WHERE d.partner_id = m.partner_id AND id_type = 'National ID') AS has_doc,
          EXISTS (SELECT 1 FROM ph WHERE ph.partner_id = m.partner_id) AS has_phone,
          EXISTS (SELECT 1 FROM dup d WHERE d.partner_id = m.partner_id AND id_type = 'Household ID') AS dup_house,
          EXISTS (SELECT 1 FROM dup d WHERE d.partner_id = m.partner_id AND id_type = 'National ID') AS dup_id,
          EXISTS (SELECT 1 FROM dph d WHERE d.partner_id = m.partner_id) AS dup_phone, acc.partner_id IS NOT NULL AS has_account
        FROM program_membership m JOIN registrant r USING (partner_id) LEFT JOIN mem ON mem.partner_id = m.partner_id LEFT JOIN acc ON acc.partner_id = m.partner_id),
      s AS (SELECT *, CASE program_id WHEN 1 THEN CASE WHEN NOT (live AND NOT is_group AND income >= 1000) THEN 'not_eligible' WHEN dup_house THEN 'duplicated' ELSE 'enrolled' END
          WHEN 2 THEN CASE WHEN NOT has_doc THEN 'not_eligible' WHEN dup_phone THEN 'duplicated' ELSE 'enrolled' END
          WHEN 3 THEN CASE WHEN NOT (live AND is_group AND has_phone) THEN 'not_eligible' WHEN dup_id OR dup_phone THEN 'duplicated' ELSE 'enrolled' END
          ELSE 'enrolled' END AS new_state FROM f)
    SELECT membership_id, partner_id, program_id, new_state, CASE WHEN new_state = 'enrolled' THEN CASE program_id WHEN 1 THEN 100.0 + CASE WHEN is_group THEN n * 20.0 ELSE 0 END
          WHEN 2 THEN greatest(round(income * 0.1, 6), 50.0) WHEN 3 THEN 10.0 + CASE WHEN is_group THEN least(n, 3) * 5.0 ELSE 0 END END END AS amount,
        CASE WHEN new_state = 'enrolled' THEN CASE program_id WHEN 1 THEN CASE WHEN has_account THEN 'account/USD' END WHEN 2 THEN 'cash/' || CAST(zone_id AS VARCHAR) END END AS batch,
        CASE program_id WHEN 1 THEN '2002-01-14' WHEN 2 THEN '2002-01-31' END AS cycle_end FROM s""")
def _(t):
    settings = t.spark.createDataFrame(SETTINGS, "program_id int, role string, name string, options map<string,string>")
    out = managers.run_programs(t.program_membership.select("membership_id", "partner_id", "program_id"), managers.facts(t, as_of()), settings, as_of())
    return out.withColumns({"amount": F.round("amount", 6), "cycle_end": F.col("cycle_end").cast("string")})


@query("m06_mapping_callables", """
    SELECT partner_id AS external_id, upper(left(name, 3)) AS prefix, CASE WHEN income < 0 THEN 'debt' ELSE 'ok' END AS flag
    FROM registrant""")
def _(t):
    return records.map_records(t.registrant, [("partner_id", "external_id")], [
        lambda df: {"prefix": F.upper(F.substring("name", 1, 3))},
        lambda df: {"flag": F.when(df["income"] < 0, "debt").otherwise("ok")}])


@query("m07_resolver_callables", """
    SELECT partner_id, 'zone ' || CAST(zone_id AS VARCHAR) AS place FROM registrant""")
def _(t):
    text = export.jsonify(t.registrant, ["partner_id:id", (
        "zone_id:place", lambda df: F.concat(F.lit("zone "), df["zone_id"].cast("string")))])
    return t.registrant.select(F.from_json(text, "id LONG, place STRING").alias("r")).select(
        F.col("r.id").alias("partner_id"), "r.place")


@query("m08_lookup_tables", f"""
    WITH {ZONES}, {ALLOC} SELECT zone_small, agency, CASE WHEN agency IS NULL THEN 'ERROR' ELSE 'PROCESSED' END
        AS agency_status FROM zones LEFT JOIN alloc USING (zone_small)""")
def _(t):
    zones = payments.zone_totals(payments.resolve_zones(t.disbursement, t.geo_resolution))
    return payments.allocate(zones, agencies(t), "zone_small", "agency").select("zone_small", "agency", "agency_status")


@query("m09_text_to_rows", f"""
    WITH {LINES} SELECT indicator, count(*) AS n, max(entry_sequence) AS longest FROM lines GROUP BY 1""")
def _(t):
    rows = statements.transactions(statements.compose(t.statement_line, ORDER))
    return rows.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"), F.max("entry_sequence").alias("longest"))
