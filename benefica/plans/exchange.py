"""Sources, sinks, imports and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from benefica.functions import scoring
from benefica.operators import records, rules
from benefica.plans.fraud import LIGHT, level_sql, light_features
from benefica.plans.ordering import BATCHES, batches
from benefica.plans.projections import AFTER, after_image
from benefica.plans.registry import query
from benefica.scale import chunked_lists, stage, staging_path
from benefica.sources import changes, export, files, views


@query("a01_table_scan", """
    SELECT entitlement_id, initial_amount FROM entitlement WHERE state = 'approved' AND initial_amount > 100000
    ORDER BY entitlement_id LIMIT 500""")
def _(t):
    df = t.entitlement.where("state = 'approved' AND initial_amount > 100000").select("entitlement_id", "initial_amount")
    return files.limited(df, 500, ["entitlement_id"])


@query("a02_csv_round_trip", """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 9 = 0 THEN NULL
        ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _(t):
    path = staging_path(t.spark, "orders-csv")
    df = t.orders.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                             "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus")
    files.write_csv(df, path)
    return files.scan_csv(t.spark, path, df.schema)


@query("a03_scored_csv", f"""
    WITH {LIGHT} SELECT partner_id, round(payment_gap_ratio, 6) AS final_score FROM feat""")
def _(t):
    path = staging_path(t.spark, "scored-csv")
    files.write_csv(light_features(t).select("partner_id", F.round("payment_gap_ratio", 6).alias("final_score")), path)
    return files.scan_csv(t.spark, path, "partner_id LONG, final_score DOUBLE")


@query("a04_rules_from_file", f"""
    WITH {LIGHT} SELECT 'R002' AS rule_id, count(*) FILTER (shared_phone_count >= 3) AS n_matched FROM feat
    UNION ALL SELECT 'R005', count(*) FILTER (payment_gap_ratio >= 0.5) FROM feat""")
def _(t):
    path = staging_path(t.spark, "rules")
    listed = [{**r, "enabled": r["id"] in ("R002", "R005")} for r in rules.default_rules()]
    t.spark.createDataFrame([(listed,)], "rules array<struct<id:string,name:string,condition:string,weight:double,"
                            "severity:string,flag:string,enabled:boolean>>").write.json(path)
    return rules.rule_summary(light_features(t), rules.scan_rules(t.spark, path)).select("rule_id", "n_matched")


@query("a05_submissions_since", """
    SELECT event_id, record_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at
    FROM change_event WHERE event_id % 10 <> 0 AND ts >= TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    path = staging_path(t.spark, "submissions")
    t.change_event.selectExpr(
        "event_id", "record_id", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS at"
    ).write.json(path)
    return files.scan_submissions(t.spark, path, "event_id LONG, record_id LONG, at STRING", "at",
                                  F.lit("2024-01-20 00:00:00"))


NESTED_SQL = """k AS (SELECT partner_id AS id, CASE WHEN create_date > DATE '2000-01-01' THEN 'create'
    WHEN write_date > DATE '2000-01-01' THEN 'update' ELSE 'skip' END AS sync_action FROM registrant)"""


def nested(t):
    kids = chunked_lists(t.group_membership.select(F.col("group_id").alias("id"), F.struct("individual_id", "kind").alias(
        "child")), ["id"], "child", name="children")
    return t.registrant.select(F.col("partner_id").alias("id"), "create_date", "write_date").join(kids, "id", "left")


@query("a06_nested_import", f"""
    WITH {NESTED_SQL} SELECT k.id, sync_action, individual_id, kind FROM k JOIN group_membership m ON m.group_id = k.id
    WHERE sync_action <> 'skip'""")
def _(t):
    return files.import_nested(nested(t), F.lit("2000-01-01").cast("date"))[1]


@query("a06_sync_actions", f"WITH {NESTED_SQL} SELECT id, sync_action FROM k")
def _(t):
    df = t.registrant.select(F.col("partner_id").alias("id"), "create_date", "write_date")
    return records.sync_split(df, F.lit("2000-01-01").cast("date")).select("id", "sync_action")


@query("a07_registry_pull", """
    SELECT partner_id, name, income FROM registrant WHERE is_group AND write_date >= DATE '2001-01-01'""")
def _(t):
    df = t.registrant.where(F.col("is_group"))
    return changes.since(df, "write_date", F.lit("2001-01-01").cast("date")).select("partner_id", "name", "income")


@query("a09_alert_sink", f"""
    WITH {LIGHT} SELECT partner_id AS beneficiary_id, round(payment_gap_ratio, 4) AS risk_score,
        {level_sql('payment_gap_ratio', .5, .4, .3)} AS risk_level, 'pending' AS status,
        CASE WHEN nb_programs > 3 THEN 'MANY, GAP' ELSE 'GAP' END AS rule_flags FROM feat""")
def _(t):
    path = staging_path(t.spark, "alerts")
    level = scoring._steps(F.col("payment_gap_ratio"), [(.5, "CRITICAL"), (.4, "HIGH"), (.3, "MEDIUM")], "LOW")
    df = light_features(t).select(
        F.col("partner_id").alias("beneficiary_id"), F.round("payment_gap_ratio", 4).alias("final_score"),
        level.alias("risk_level"), F.lit(None).cast("string").alias("explanation"),
        F.when(F.col("nb_programs") > 3, F.array(F.lit("MANY"), F.lit("GAP"))).otherwise(F.array(F.lit("GAP")))
        .alias("rule_flags"))
    files.save_alerts(df, path)
    return t.spark.read.parquet(path).select("beneficiary_id", "risk_score", "risk_level", "status", "rule_flags")


@query("a10_payment_batch_files", f"""
    WITH b AS ({BATCHES}) SELECT batch, row_in_batch AS id, CAST(entitlement_id AS VARCHAR) AS request_id,
        account_number AS payee_identifier, 'LKR' AS currency FROM b""")
def _(t):
    path = staging_path(t.spark, "batches")
    rows = files.batch_file_rows(batches(t), "MSISDN", "0771234567", "CLOSEDLOOP", "LKR")
    files.write_batch_files(rows, path)
    back = t.spark.read.schema("id LONG, request_id STRING, payment_mode STRING, payer_identifier_type STRING, "
                               "payer_identifier STRING, payee_identifier_type STRING, payee_identifier STRING, "
                               "amount DOUBLE, currency STRING, note STRING, batch STRING").csv(path, header=True)
    return back.select("batch", "id", "request_id", "payee_identifier", "currency")


@query("a11_change_event_sink", """
    SELECT 'registry' AS topic, CAST(record_id AS VARCHAR) AS key, event_id, op FROM change_event
    WHERE op IN ('purchase', 'signup') AND value > 20""")
def _(t):
    rows = changes.published(t.change_event.select("event_id", "record_id", "op", "value"),
                             "op IN ('purchase', 'signup') AND value > 20", "record_id", "registry")
    parsed = F.from_json("value", "event_id LONG, op STRING")
    return rows.select("topic", "key", parsed.alias("v")).select("topic", "key", "v.event_id", "v.op")


@query("a12_full_records", """
    WITH ids AS (SELECT partner_id, string_agg(id_type || '=' || value, ';' ORDER BY id_type) AS ids FROM reg_id GROUP BY 1),
      m AS (SELECT group_id AS partner_id, (row_number() OVER (PARTITION BY group_id ORDER BY individual_id, m.kind) - 1)
            // 50 AS page, individual_id, coalesce(ids, '') AS member_ids FROM group_membership m
            JOIN registrant r ON r.partner_id = m.individual_id LEFT JOIN ids ON ids.partner_id = m.individual_id),
      p AS (SELECT partner_id, page, string_agg(individual_id || ':' || member_ids, ',' ORDER BY individual_id,
            member_ids) AS members FROM m GROUP BY 1, 2)
    SELECT r.partner_id, r.name, coalesce(ids, '') AS ids, coalesce(page, 0) AS page, coalesce(members, '') AS members
    FROM registrant r LEFT JOIN ids USING (partner_id) LEFT JOIN p USING (partner_id)""")
def _(t):
    df = export.full_records(t.registrant, t.reg_id, t.group_membership, ["name", "gender"], page_size=50)
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(
        e.key, F.lit("="), e.value)), ";")
    members = F.array_join(F.transform("members", lambda m: F.concat(
        m.individual_id.cast("string"), F.lit(":"), flat(m.individual.reg_ids))), ",")
    return df.select("partner_id", "name", flat(F.col("reg_ids")).alias("ids"), "page",
                     F.coalesce(members, F.lit("")).alias("members"))


@query("a13_parser_json", """
    SELECT partner_id, name, strftime(birthdate, '%Y-%m-%d') AS born, company_id || '/' || zone_id AS places,
        upper(kind) AS kind FROM registrant""")
def _(t):
    parser = ["partner_id:id", "name", "birthdate:born", "company_id:places=list", "zone_id:places=list", "missing_field",
              ("kind:kind", lambda df: F.upper("kind"))]
    text = export.jsonify(t.registrant, parser)
    back = F.from_json("j", "id LONG, name STRING, born STRING, places ARRAY<LONG>, kind STRING")
    return t.registrant.select(text.alias("j")).select(back.alias("r")).select(
        F.col("r.id").alias("partner_id"), "r.name", "r.born", F.array_join(F.col("r.places").cast("array<string>"), "/")
        .alias("places"), "r.kind")


@query("a14_materialised_totals", """
    SELECT company_id, count(*) FILTER (NOT is_group) AS total_individuals, count(*) FILTER (is_group) AS total_groups
    FROM registrant WHERE is_registrant AND active GROUP BY 1""")
def _(t):
    from benefica.operators.dashboards import registrant_totals

    path = staging_path(t.spark, "totals")
    registrant_totals(t.registrant).write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query("a14_refreshed_totals", """
    SELECT zone_id, count(*) FILTER (NOT is_group) AS total_individuals, count(*) FILTER (is_group) AS total_groups
    FROM registrant WHERE is_registrant AND active AND NOT (zone_id = 3) AND NOT (zone_id = 5 AND income > 5000) GROUP BY 1""")
def _(t):
    """Created, refreshed for two zones that changed, read and dropped; one zone has no one left."""
    def totals(people):
        return people.where("is_registrant AND active").groupBy("zone_id").agg(
            F.count_if(~F.col("is_group")).alias("total_individuals"), F.count_if("is_group").alias("total_groups"))

    name = f"totals_{uuid.uuid4().hex}"
    views.create_view(totals(t.registrant), name, "zone_id", staging_path(t.spark, "view"))
    after = t.registrant.where("NOT (zone_id = 3) AND NOT (zone_id = 5 AND income > 5000)")
    rows = stage(views.refresh_view(totals(after), name, "zone_id", [3, 5]), "read")
    views.drop_view(t.spark, name)
    return rows


@query("a17_case_update", """
    WITH u AS (SELECT entitlement_id, CASE WHEN program_id = 1 THEN 'closed' END AS state, CASE WHEN program_id = 2 THEN
        'X' END AS code FROM entitlement WHERE initial_amount < 50000)
    SELECT e.entitlement_id, coalesce(u.state, e.state) AS state, coalesce(u.code, e.code) AS code,
        CASE WHEN u.entitlement_id IS NOT NULL THEN '2002-01-01' END AS updated_at
    FROM entitlement e LEFT JOIN u USING (entitlement_id)""")
def _(t):
    updates = t.entitlement.where("initial_amount < 50000").selectExpr(
        "entitlement_id", "CASE WHEN program_id = 1 THEN 'closed' END AS state", "CASE WHEN program_id = 2 THEN 'X' END AS code")
    return records.merge_updates(t.entitlement, updates, "entitlement_id", ["state", "code"], F.lit("2002-01-01")).select(
        "entitlement_id", "state", "code", "updated_at")


LOGS = """WITH a AS ({after}) SELECT r.partner_id, 'write' AS change, f.field,
    CASE f.field WHEN 'gender' THEN r.gender WHEN 'kind' THEN r.kind ELSE CAST(r.company_id AS VARCHAR) END AS old_value,
    CASE f.field WHEN 'gender' THEN a.gender WHEN 'kind' THEN a.kind ELSE CAST(a.company_id AS VARCHAR) END AS new_value
    FROM registrant r JOIN a USING (partner_id), (VALUES ('gender'), ('kind'), ('company_id')) f(field)
    WHERE old_value IS DISTINCT FROM new_value"""


@query("l08_field_audit", LOGS.format(after=AFTER.format(r="registrant")))
def _(t):
    return records.field_log(t.registrant, after_image(t), "partner_id", ["gender", "kind", "company_id", "name"], ["name"])


@query("l06_expire_entitlements", """
    SELECT entitlement_id, CASE WHEN state = 'approved' AND valid_until < DATE '1999-01-01' THEN 'expired' ELSE state END
        AS state FROM entitlement""")
def _(t):
    past = (F.col("state") == "approved") & (F.col("valid_until") < F.lit("1999-01-01").cast("date"))
    return t.entitlement.select("entitlement_id", F.when(past, "expired").otherwise(F.col("state")).alias("state"))


@query("l07_log_retention", """
    SELECT event_id FROM change_event WHERE ts > TIMESTAMP '2024-01-22 00:00:00'""")
def _(t):
    return t.change_event.where("ts > TIMESTAMP_NTZ '2024-01-22 00:00:00'").select("event_id")


@query("l07_oldest_chunk", """
    SELECT event_id FROM change_event WHERE ts <= TIMESTAMP '2024-01-22 00:00:00' ORDER BY ts, event_id LIMIT 1000""")
def _(t):
    return t.change_event.where("ts <= TIMESTAMP_NTZ '2024-01-22 00:00:00'").orderBy("ts", "event_id").limit(1000).select(
        "event_id")


@query("l09_change_history", """
    SELECT record_id, event_id, op FROM change_event WHERE record_id IN (SELECT partner_id FROM registrant
        WHERE kind = 'BUILDING') ORDER BY ts DESC""")
def _(t):
    kept = t.registrant.where("kind = 'BUILDING'").select(F.col("partner_id").alias("record_id"))
    return t.change_event.join(kept, "record_id", "left_semi").orderBy(F.desc("ts")).select("record_id", "event_id", "op")
