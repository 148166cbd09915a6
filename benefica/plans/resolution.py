"""Duplicates, entity resolution and keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.operators import dedup, near_texts, payments
from benefica.plans.registry import query
from benefica.scale import dealt, join_groups, stage
from benefica.plans.scalars import grams_sql

def as_of():
    return F.lit("2002-01-01").cast("date")
VALID = "d.value IS NOT NULL AND (d.expiry_date IS NULL OR d.expiry_date > DATE '2002-01-01')"


@query("i01_duplicates_by_document", f"""
    WITH d AS (SELECT d.partner_id, d.id_type, d.value FROM reg_id d WHERE {VALID} AND d.partner_id IN (
            SELECT partner_id FROM program_membership WHERE program_id = 2)),
      dup AS (SELECT partner_id FROM d WHERE (id_type, value) IN (SELECT id_type, value FROM d GROUP BY 1, 2
            HAVING count(*) > 1))
    SELECT membership_id, state, CASE state WHEN 'enrolled' THEN 'duplicated' ELSE state END AS new_state
    FROM program_membership WHERE program_id = 2 AND partner_id IN (SELECT partner_id FROM dup)""")
def _(t):
    members = t.program_membership.where("program_id = 2")
    return dedup.duplicates_by_document(members, t.reg_id, as_of(), ["National ID", "Household ID"]).select(
        "membership_id", "state", "new_state")


@query("i02_duplicates_by_phone", """
    WITH d AS (SELECT partner_id, phone_sanitized AS p FROM phone_number WHERE disabled IS NULL AND phone_sanitized
        IS NOT NULL AND partner_id IN (SELECT partner_id FROM program_membership WHERE program_id = 3))
    SELECT membership_id, state, CASE state WHEN 'enrolled' THEN 'duplicated' ELSE state END AS new_state
    FROM program_membership WHERE program_id = 3 AND partner_id IN (SELECT partner_id FROM d WHERE p IN (
        SELECT p FROM d GROUP BY 1 HAVING count(*) > 1))""")
def _(t):
    return dedup.duplicates_by_phone(t.program_membership.where("program_id = 3"), t.phone_number).select(
        "membership_id", "state", "new_state")


HOUSEHOLDS = """ben AS (SELECT m.* FROM program_membership m JOIN registrant USING (partner_id) WHERE is_group
        AND program_id IN (1, 2)),
    grp AS (SELECT DISTINCT partner_id AS group_id FROM ben),
    inside AS (SELECT individual_id, group_id FROM group_membership WHERE group_id IN (SELECT group_id FROM grp)),
    by_member AS (SELECT * FROM inside WHERE individual_id IN (SELECT individual_id FROM inside GROUP BY 1
        HAVING count(*) > 1)),
    owners AS (SELECT individual_id AS partner_id FROM inside UNION SELECT group_id FROM grp),
    docs AS (SELECT id_type, value, partner_id FROM reg_id d WHERE partner_id IN (SELECT partner_id FROM owners)
        AND (expiry_date IS NULL OR expiry_date > DATE '2002-01-01')),
    twice AS (SELECT partner_id FROM docs WHERE (id_type, value) IN (SELECT id_type, value FROM docs GROUP BY 1, 2
        HAVING count(*) > 1)),
    by_doc AS (SELECT * FROM inside WHERE individual_id IN (SELECT partner_id FROM twice)),
    pairs AS (SELECT DISTINCT individual_id, group_id FROM (SELECT * FROM by_member UNION ALL SELECT * FROM by_doc))"""


def household_pairs(t):
    groups = t.registrant.where("is_group").select("partner_id")
    ben = t.program_membership.where("program_id IN (1, 2)").join(groups, "partner_id", "left_semi")
    grp = ben.select(F.col("partner_id").alias("group_id")).distinct()
    docs = dedup.valid_documents(t.reg_id, as_of(), ["National ID", "Household ID"])
    pairs = dedup.households_by_member(grp, t.group_membership).unionByName(
        dedup.households_by_attribute(grp, t.group_membership, docs, ["id_type", "value"])).distinct()
    return ben, pairs


@query("i04_duplicate_households", f"WITH {HOUSEHOLDS} SELECT individual_id, group_id FROM pairs")
def _(t):
    return household_pairs(t)[1]


@query("i05_survivor_rule", f"""
    WITH {HOUSEHOLDS}, r AS (SELECT individual_id, membership_id, state, count(*) FILTER (state = 'enrolled') OVER (
            PARTITION BY individual_id) AS n FROM pairs JOIN ben ON ben.partner_id = pairs.group_id),
      k AS (SELECT membership_id, state, bool_or(NOT (n = 1 AND state = 'enrolled')
            AND state NOT IN ('exited', 'not_eligible', 'duplicated')) AS marked FROM r GROUP BY 1, 2)
    SELECT membership_id, state, CASE WHEN marked THEN 'duplicated' ELSE state END AS new_state FROM k""")
def _(t):
    ben, pairs = household_pairs(t)
    return dedup.survivors(ben, pairs)


@query("i06_fuzzy_duplicates", f"""
    WITH tup AS (SELECT p_name, p_type, p_brand, min(p_partkey) AS rep, count(*) AS n FROM part GROUP BY 1, 2, 3),
      g AS (SELECT *, {grams_sql('p_name')} AS grams FROM tup),
      s AS (SELECT a.rep AS rep_a, b.rep AS rep_b, a.n + b.n AS records,
          0.6 * len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams,
          b.grams))) + CASE WHEN a.p_type = b.p_type THEN 0.2 ELSE 0 END + CASE WHEN a.p_brand = b.p_brand THEN 0.2
          ELSE 0 END AS score FROM g a JOIN g b ON a.rep < b.rep AND (a.p_type = b.p_type OR a.p_brand = b.p_brand))
    SELECT rep_a, rep_b, records, round(score, 6) AS score FROM s WHERE score >= 0.75 - 1e-12""")
def _(t):
    return dedup.fuzzy_duplicates(t.part, "p_partkey", "p_name", 0.6, {"p_type": 0.2, "p_brand": 0.2}, 0.75).withColumn(
        "score", F.round("score", 6))


@query("i06_near_documents", """
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
      s AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM w WHERE len(w) > 0),
      c AS (SELECT min(doc_id) AS id, s FROM s GROUP BY s),
      g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM c),
      met AS (SELECT x.id AS a, y.id AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
    SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM met WHERE k / (na + nb - k) >= 0.8 - 1e-12""")
def _(t):
    near, _ = near_texts.similar_long_texts(t.documents, "doc_id", "text")
    return near.withColumn("similarity", F.round("similarity", 6))


@query("i07_registry_flags", """
    WITH p AS (SELECT d.* FROM reg_id d JOIN registrant r USING (partner_id) WHERE NOT is_group
            AND id_type = 'National ID'),
      g AS (SELECT d.* FROM reg_id d JOIN registrant r USING (partner_id) WHERE is_group AND id_type = 'Household ID'),
      dp AS (SELECT partner_id FROM p WHERE value IN (SELECT value FROM p GROUP BY 1 HAVING count(*) > 1)),
      dg AS (SELECT partner_id FROM g WHERE value IN (SELECT value FROM g GROUP BY 1 HAVING count(*) > 1)
             UNION SELECT group_id FROM group_membership WHERE individual_id IN (SELECT partner_id FROM dp))
    SELECT partner_id, is_group, partner_id IN (SELECT partner_id FROM dp UNION SELECT partner_id FROM dg)
        AS is_duplicated FROM registrant""")
def _(t):
    return dedup.registry_flags(t.registrant, t.reg_id, t.group_membership, ["National ID"], ["Household ID"])


INCOMING = """SELECT c_custkey AS record_id, 'National ID' AS t1,
    CASE WHEN c_custkey % 3 = 0 THEN 'new-' || CAST(c_custkey AS STRING) ELSE 'N' || CAST(c_nationkey AS STRING) || '-' ||
        CAST(CAST(floor(c_acctbal / 10) + c_custkey % 2 AS BIGINT) AS STRING) END AS v1,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Household ID' END AS t2,
    'H' || substr(c_mktsegment, 1, 1) || CAST(CAST(floor(c_acctbal / 5) AS BIGINT) AS STRING) AS v2 FROM {c}"""
MATCHED = f"""inc AS ({INCOMING.format(c='customer')}), ids AS (SELECT record_id, 0 AS place, t1 AS id_type, v1 AS value
    FROM inc UNION ALL SELECT record_id, 1, t2, v2 FROM inc WHERE t2 <> ''),
    known AS (SELECT id_type, value, min(partner_id) AS partner_id FROM reg_id GROUP BY 1, 2),
    hit AS (SELECT record_id, min_by(partner_id, place) AS partner_id FROM ids JOIN known USING (id_type, value)
        GROUP BY 1), matched AS (SELECT inc.record_id, hit.partner_id FROM inc LEFT JOIN hit USING (record_id))"""


def incoming(t):
    return t.spark.sql(INCOMING, c=t.customer).selectExpr(
        "record_id", "array(named_struct('id_type', t1, 'value', v1), named_struct('id_type', t2, 'value', v2)) AS ids")


@query("i08_upsert_by_identifier", f"""WITH {MATCHED} SELECT record_id, partner_id, partner_id IS NULL AS is_created,
    partner_id IS NOT NULL AS is_updated FROM matched""")
def _(t):
    return dedup.upsert(incoming(t), t.reg_id)["records"]


@query("i08_missing_identifiers", f"""WITH {MATCHED} SELECT record_id, partner_id, id_type, value FROM ids JOIN matched
    USING (record_id) WHERE NOT EXISTS (SELECT 1 FROM reg_id r WHERE r.partner_id = matched.partner_id
        AND r.id_type = ids.id_type)""")
def _(t):
    return dedup.upsert(incoming(t), t.reg_id)["ids"].select("record_id", "partner_id", "id_type", "value")


@query("i09_new_duplicate_records", """
    WITH f AS (SELECT 'id' AS manager, id_type AS reason, value AS set_id, partner_id AS member FROM reg_id
        WHERE (id_type, value) IN (SELECT id_type, value FROM reg_id GROUP BY 1, 2 HAVING count(*) > 1)),
      k AS (SELECT DISTINCT manager, reason, set_id FROM f WHERE member % 5 < 2)
    SELECT f.* FROM f WHERE (manager, reason, set_id) NOT IN (SELECT manager, reason, set_id FROM k)""")
def _(t):
    keys = ["id_type", "value"]
    twice = t.reg_id.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    found = join_groups(t.reg_id, twice, keys, "left_semi").select(
        F.lit("id").alias("manager"), F.col("id_type").alias("reason"), F.col("value").alias("set_id"),
        F.col("partner_id").alias("member"))
    stored = found.selectExpr("manager", "reason", "member",
                              "CASE WHEN member % 5 < 2 THEN 'duplicate' ELSE 'not_duplicate' END AS state")
    return dedup.new_duplicate_records(found, stored)


MAP_REQUESTS = """SELECT 'R' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS reference_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'update' ELSE 'unlink' END AS op,
    CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'ID' || CAST(o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 900 ELSE 0 END
        AS STRING) END AS id_value,
    CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 3 = 2 THEN NULL ELSE 'fa-' || CAST(o_orderkey AS STRING) END AS fa_value,
    CASE WHEN o_orderkey % 5 = 0 THEN 'New ' || o_orderpriority END AS name
    FROM {o}"""
JUDGED = f"""q AS ({MAP_REQUESTS.format(o='orders')}),
    first AS (SELECT id_value, min(reference_id) AS first FROM q WHERE op = 'link' AND id_value <> '' AND fa_value <> ''
        GROUP BY 1),
    j AS (SELECT q.*, CASE WHEN q.id_value = '' THEN 'rjct.id.invalid'
        WHEN op <> 'unlink' AND q.fa_value IS NULL THEN 'rjct.fa.invalid'
        WHEN op = 'link' AND (m.id_value IS NOT NULL OR reference_id <> first.first) THEN 'rjct.reference_id.duplicate'
        WHEN op = 'update' AND m.id_value IS NULL THEN 'rjct.reference_id.duplicate'
        WHEN op = 'unlink' AND m.id_value IS NULL THEN 'rjct.id.invalid' END AS reason
      FROM q LEFT JOIN id_fa_mapping m ON m.id_value = q.id_value LEFT JOIN first ON first.id_value = q.id_value)"""


def judged(t):
    return payments.judge_mapping_requests(t.spark.sql(MAP_REQUESTS, o=t.orders), t.id_fa_mapping)


@query("i10_mapping_requests", f"""WITH {JUDGED} SELECT reference_id, op, reason, CASE WHEN reason IS NULL THEN 'succ'
    ELSE 'rjct' END AS status FROM j""")
def _(t):
    return judged(t).select("reference_id", "op", "reason", "status")


@query("i10_mapping_after", f"""
    WITH {JUDGED}, ok AS (SELECT * FROM j WHERE reason IS NULL),
      up AS (SELECT id_value, max_by(fa_value, reference_id) AS fa, max_by(name, reference_id) FILTER (name <> '') AS name
        FROM ok WHERE op = 'update' GROUP BY 1),
      al AS (SELECT m.id_value, coalesce(up.fa, m.fa_value) AS fa_value, coalesce(up.name, m.name) AS name
        FROM id_fa_mapping m LEFT JOIN up USING (id_value)
        UNION ALL SELECT id_value, fa_value, name FROM ok WHERE op = 'link')
    SELECT * FROM al WHERE id_value NOT IN (SELECT id_value FROM ok WHERE op = 'unlink')""")
def _(t):
    return payments.apply_mapping_requests(t.id_fa_mapping, judged(t))


def pulled(t):
    """The incoming records with fields: every second one has no income."""
    return incoming(t).join(dealt(t.registrant.select(
        F.col("partner_id").alias("record_id"), F.concat(F.lit("In "), "name").alias("name"),
        F.when(F.col("partner_id") % 2 == 0, F.col("income") + 1).alias("income"))), "record_id")


MERGED = f"""WITH RECURSIVE {MATCHED},
    link AS (SELECT DISTINCT a.record_id AS a, b.record_id AS b FROM ids a JOIN ids b USING (id_type, value)),
    reach(node, seen) AS (SELECT record_id, record_id FROM matched WHERE partner_id IS NULL
        UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen),
    lead AS (SELECT node, min(seen) AS leader, min_by(partner_id, record_id) FILTER (partner_id IS NOT NULL) AS known
        FROM reach JOIN matched ON record_id = seen GROUP BY 1),
    new AS (SELECT leader, row_number() OVER (ORDER BY leader) + (SELECT max(partner_id) FROM registrant) AS id
        FROM (SELECT DISTINCT leader FROM lead WHERE known IS NULL)),
    owner AS (SELECT record_id, coalesce(partner_id, known, new.id) AS partner_id, partner_id IS NULL AND known IS NULL AS created
        FROM matched LEFT JOIN lead ON node = record_id LEFT JOIN new USING (leader)),
    pull AS (SELECT o.*, 'In ' || r.name AS name, CASE WHEN record_id % 2 = 0 THEN r.income + 1 END AS income
        FROM owner o JOIN registrant r ON r.partner_id = o.record_id)"""


def merged(t):
    return dedup.merge_registry(pulled(t), t.registrant, t.reg_id, t.program_membership, ["name", "income"], 2, "pull")


@query("i08_merged_registrants", f"""{MERGED},
    g AS (SELECT partner_id, max_by(name, record_id) AS name, max_by(income, record_id) FILTER (income IS NOT NULL) AS income, bool_or(created) AS created
        FROM pull GROUP BY 1)
    SELECT partner_id, coalesce(g.name, r.name) AS name, coalesce(g.income, r.income) AS income, CASE WHEN g.partner_id IS NULL THEN r.is_registrant
        ELSE true END AS is_registrant, g.created AS is_created FROM registrant r FULL JOIN g USING (partner_id)""")
def _(t):
    out = merged(t)
    return out["registrants"].join(dealt(out["imported"]), "partner_id", "left").select("partner_id", "name", "income", "is_registrant", "is_created")


@query("i08_added_ids", f"""{MERGED}
    SELECT partner_id, id_type, min_by(value, record_id * 2 + place) AS value FROM ids JOIN owner USING (record_id)
    WHERE NOT EXISTS (SELECT 1 FROM reg_id d WHERE d.partner_id = owner.partner_id AND d.id_type = ids.id_type) GROUP BY 1, 2""")
def _(t):
    return merged(t)["ids"]


@query("i08_new_memberships", f"""{MERGED},
    p AS (SELECT DISTINCT partner_id FROM owner EXCEPT SELECT partner_id FROM program_membership WHERE program_id = 2)
    SELECT partner_id, row_number() OVER (ORDER BY partner_id) + (SELECT max(membership_id) FROM program_membership) AS membership_id FROM p""")
def _(t):
    return merged(t)["memberships"].select("partner_id", "membership_id")


@query("i08_second_pull", f"""{MERGED},
    g AS (SELECT partner_id, max_by(name, record_id) AS name, max_by(income, record_id) FILTER (income IS NOT NULL) AS income FROM pull GROUP BY 1)
    SELECT partner_id, coalesce(g.name, r.name) AS name, coalesce(g.income, r.income) AS income, CASE WHEN g.partner_id IS NULL THEN r.is_registrant
        ELSE true END AS is_registrant, CASE WHEN g.partner_id IS NOT NULL THEN false END AS is_created FROM registrant r FULL JOIN g USING (partner_id)""")
def _(t):
    """The registry after the same pull was merged twice: no one is new the second time."""
    once = merged(t)
    people = stage(once["registrants"].drop("data_source"), "people")
    ids = stage(t.reg_id.select("partner_id", "id_type", "value").unionByName(once["ids"]), "ids")
    members = stage(t.program_membership.select("membership_id", "partner_id", "program_id", "state").unionByName(once["memberships"]), "members")
    again = dedup.merge_registry(pulled(t), people, ids, members, ["name", "income"], 2, "pull", links=once["links"])
    return again["registrants"].join(dealt(again["imported"]), "partner_id", "left").select("partner_id", "name", "income", "is_registrant", "is_created")
