"""Projections, filters, eligibility, record mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.fixed import FAKE_MISSING, INCOME_CLASSES, VEHICLE_CLASSES, YES_WORDS
from benefica.functions import text
from benefica.operators import eligibility, records
from benefica.operators.domain import Relation, domain_filter
from benefica.plans.registry import query
from benefica.scale import chunked_lists, join_groups

def as_of():
    return F.lit("2002-01-01").cast("date")

SURVEY_EXPRS = [
    "c_custkey AS id",
    "CASE c_custkey % 8 WHEN 0 THEN '0_5000' WHEN 1 THEN '5001_10000' WHEN 2 THEN '10001_15000' "
    "WHEN 3 THEN '50001_100000' WHEN 4 THEN 'refused' WHEN 5 THEN NULL ELSE CAST(c_custkey AS STRING) END AS income",
    "CASE c_nationkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'two_wheeler' "
    "WHEN 3 THEN 'four_wheeler' ELSE '3' END AS vehicles_owned",
    "CASE c_nationkey % 4 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'DISABLED' WHEN 2 THEN 'no' END AS disability_status",
    "CASE c_nationkey % 3 WHEN 0 THEN 'owned' WHEN 1 THEN 'rent' ELSE 'TRUE' END AS own_home",
    "CASE WHEN c_custkey % 9 = 0 THEN 'nan' WHEN c_custkey % 9 = 1 THEN '' WHEN c_custkey % 9 = 2 THEN 'None' "
    "ELSE 'P' || CAST(c_nationkey * 40 + c_custkey % 40 AS STRING) END AS phone_number",
    "c_nationkey % 11 AS household_size", "c_custkey % 6 AS nb_children",
    "CASE c_custkey % 5 WHEN 0 THEN 'Migrant' WHEN 1 THEN ' immigrant' WHEN 2 THEN 'citizen' WHEN 3 THEN '1' END AS immigration_status",
    "CASE WHEN c_custkey % 7 = 0 THEN 'None' WHEN c_custkey % 7 = 1 THEN ' ' WHEN c_custkey % 7 = 2 THEN NULL "
    "ELSE ' A' || CAST(c_nationkey AS STRING) || ' ' END AS account_number",
]
SURVEY_CTE = f"survey AS (SELECT {', '.join(SURVEY_EXPRS)} FROM customer)"


def survey(t):
    return t.customer.selectExpr(*SURVEY_EXPRS)


def clean_survey(df):
    """Class labels to numbers, yes-words to flags, pretended gaps to NULL."""
    def mapped(name, table):
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in (kv[0], str(kv[1]))])
        return F.coalesce(F.try_element_at(pairs, F.col(name)), F.col(name)).try_cast("double")

    def yes(name, kind):
        return F.coalesce(F.lower(F.trim(name)).isin(YES_WORDS[kind]), F.lit(False)).cast("int")

    return df.withColumns({
        "income": mapped("income", INCOME_CLASSES), "vehicles_owned": mapped("vehicles_owned", VEHICLE_CLASSES),
        "disability_flag": yes("disability_status", "disability"), "own_home_flag": yes("own_home", "own_home"),
        "immigration_flag": yes("immigration_status", "immigration"),
        **{c: F.when(~F.trim(c).isin(FAKE_MISSING), F.trim(c)) for c in ("phone_number", "account_number")},
    })


CLEAN_CTE = f"""{SURVEY_CTE}, clean AS (SELECT id, household_size, nb_children,
    CASE income {" ".join(f"WHEN '{k}' THEN {v}.0" for k, v in INCOME_CLASSES.items())}
         ELSE TRY_CAST(income AS DOUBLE) END AS income,
    CASE vehicles_owned {" ".join(f"WHEN '{k}' THEN {v}.0" for k, v in VEHICLE_CLASSES.items())}
         ELSE TRY_CAST(vehicles_owned AS DOUBLE) END AS vehicles_owned,
    CAST(coalesce(lower(trim(disability_status)) IN ('yes', 'true', '1', 'disabled', 'has_disability'), false) AS INT)
        AS disability_flag,
    CAST(lower(trim(own_home)) IN ('yes', 'true', '1', 'owned', 'own_home') AS INT) AS own_home_flag,
    CAST(coalesce(lower(trim(immigration_status)) IN ('yes', 'true', '1', 'immigrant', 'migrant'), false) AS INT) AS immigration_flag,
    CASE WHEN trim(account_number) NOT IN ('nan', 'None', '') THEN trim(account_number) END AS account_number,
    CASE WHEN phone_number NOT IN ('nan', 'None', '') THEN phone_number END AS phone_number FROM survey)"""


@query("b01_align_sources", """
    SELECT c_custkey AS id, c_name AS full_name, c_acctbal AS income, c_mktsegment AS employment, NULL AS region,
           'customers' AS source FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey, 'suppliers' FROM supplier""")
def _(t):
    a = t.customer.withColumnsRenamed({"c_custkey": "id", "c_name": "full_name", "c_acctbal": "income",
                                       "c_mktsegment": "employment"}).drop("c_nationkey")
    b = t.supplier.withColumnsRenamed({"s_suppkey": "id", "s_name": "full_name", "s_acctbal": "income",
                                       "s_nationkey": "region"})
    return a.withColumn("source", F.lit("customers")).unionByName(
        b.withColumn("source", F.lit("suppliers")), allowMissingColumns=True)


@query("b04_domain_filter", """
    SELECT partner_id, kind, income FROM registrant r
    WHERE income >= 100 AND kind <> 'MACHINERY'
      AND (name LIKE '%99%' OR NOT (zone_id IN (1, 2, 3) OR lower(kind) LIKE '%hold%')
           OR EXISTS (SELECT 1 FROM reg_id d WHERE d.partner_id = r.partner_id AND d.status = 'invalid'))""")
def _(t):
    domain = ["&", "&", ("income", ">=", 100), ("kind", "!=", "MACHINERY"), ("kind", "=?", False),
              "|", "|", ("name", "like", "99"), "!", "|", ("zone_id", "in", [1, 2, 3]), ("kind", "ilike", "HOLD"),
              ("reg_ids.status", "=", "invalid")]
    return domain_filter(t.registrant, domain, {"reg_ids": Relation(t.reg_id, "partner_id", "partner_id")}).select(
        "partner_id", "kind", "income")


@query("b04_domain_paths", """
    SELECT partner_id, kind FROM registrant r
    WHERE (gender IS NULL OR gender NOT IN ('Female'))
      AND EXISTS (SELECT 1 FROM reg_id d WHERE d.partner_id = r.partner_id AND d.id_type = 'Household ID')
      AND EXISTS (SELECT 1 FROM phone_number p WHERE p.partner_id = r.partner_id AND p.phone_no LIKE '%5%')""")
def _(t):
    relations = {"reg_ids": Relation(t.reg_id, "partner_id", "partner_id"),
                 "phones": Relation(t.phone_number, "partner_id", "partner_id")}
    domain = [("gender", "not in", ["Female"]), ("reg_ids.id_type", "=", "Household ID"),
              ("phones.phone_no", "like", "5")]
    return domain_filter(t.registrant, domain, relations).select("partner_id", "kind")


@query("b09_states_paged", """
    SELECT entitlement_id, state, initial_amount FROM entitlement WHERE state IN ('draft', 'pending_validation')
    ORDER BY initial_amount DESC, entitlement_id LIMIT 50 OFFSET 20""")
def _(t):
    kept = t.entitlement.where(F.col("state").isin("draft", "pending_validation"))
    return kept.orderBy(F.desc("initial_amount"), "entitlement_id").offset(20).limit(50).select(
        "entitlement_id", "state", "initial_amount")


@query("b09_state_counts", "SELECT program_id, state, count(*) AS n FROM program_membership GROUP BY ALL")
def _(t):
    return t.program_membership.groupBy("program_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("b10_eligible_default", """
    SELECT DISTINCT r.partner_id, r.income FROM registrant r JOIN program_membership m USING (partner_id)
    WHERE m.program_id = 3 AND r.disabled IS NULL AND r.is_registrant AND NOT r.is_group AND r.income < 4000""")
def _(t):
    members = t.program_membership.where("program_id = 3").select("partner_id")
    manager = eligibility.default_manager("individual", [("income", "<", 4000)])
    return manager(t.registrant).join(members, "partner_id", "left_semi").select("partner_id", "income")


@query("b11_eligible_by_document", """
    SELECT r.partner_id, r.kind FROM registrant r WHERE EXISTS (SELECT 1 FROM reg_id d
        WHERE d.partner_id = r.partner_id AND d.id_type = 'National ID'
          AND (d.expiry_date IS NULL OR d.expiry_date > DATE '2002-01-01'))""")
def _(t):
    manager = eligibility.id_document_manager(t.reg_id, as_of(), ["National ID"])
    return manager(t.registrant).select("partner_id", "kind")


@query("b12_eligible_by_phone", """
    SELECT r.partner_id, r.kind FROM registrant r WHERE EXISTS (SELECT 1 FROM phone_number p
        WHERE p.partner_id = r.partner_id AND p.disabled IS NULL)""")
def _(t):
    return eligibility.phone_manager(t.phone_number)(t.registrant).select("partner_id", "kind")


@query("b13_eligible_reimbursement", """
    SELECT partner_id, supplier_rank FROM (SELECT *, partner_id % 3 = 0 AS reg FROM registrant)
    WHERE supplier_rank > 0 AND NOT is_group AND NOT reg""")
def _(t):
    df = t.registrant.withColumn("is_registrant", F.expr("partner_id % 3 = 0"))
    return eligibility.reimbursement_manager()(df).select("partner_id", "supplier_rank")


CHAIN_SQL = """ok AS (
    SELECT partner_id FROM registrant r WHERE disabled IS NULL AND is_registrant AND NOT is_group
      AND EXISTS (SELECT 1 FROM reg_id d WHERE d.partner_id = r.partner_id
                  AND (d.expiry_date IS NULL OR d.expiry_date > DATE '2002-01-01'))
      AND EXISTS (SELECT 1 FROM phone_number p WHERE p.partner_id = r.partner_id AND p.disabled IS NULL)),
  enrolled AS (SELECT m.*, CASE WHEN m.partner_id IN (SELECT partner_id FROM ok) THEN 'enrolled'
                                ELSE 'not_eligible' END AS new_state FROM program_membership m)"""


def enrolled(t):
    managers = [eligibility.default_manager("individual"), eligibility.id_document_manager(t.reg_id, as_of()),
                eligibility.phone_manager(t.phone_number)]
    return eligibility.enrol(t.program_membership, t.registrant, managers)


@query("b14_manager_chain", f"WITH {CHAIN_SQL} SELECT membership_id, state, new_state FROM enrolled")
def _(t):
    return enrolled(t).select("membership_id", "state", "new_state")


@query("b14_cancelled_entitlements", f"""
    WITH {CHAIN_SQL} SELECT e.entitlement_id, CASE WHEN EXISTS (SELECT 1 FROM enrolled m WHERE m.partner_id =
        e.partner_id AND m.program_id = e.program_id AND new_state = 'not_eligible') THEN 'cancelled'
        ELSE e.state END AS state FROM entitlement e""")
def _(t):
    refused = enrolled(t).where("new_state = 'not_eligible'")
    return eligibility.cancel_entitlements(t.entitlement, refused).select("entitlement_id", "state")


@query("b15_category_maps", f"""WITH {CLEAN_CTE}
    SELECT id, income, vehicles_owned, disability_flag, immigration_flag, own_home_flag, phone_number, account_number FROM clean""")
def _(t):
    return clean_survey(survey(t)).select("id", "income", "vehicles_owned", "disability_flag", "immigration_flag", "own_home_flag",
                                          "phone_number", "account_number")


@query("b16_suspicion_target", f"""WITH {CLEAN_CTE},
    shared AS (SELECT phone_number, count(*) AS n FROM clean WHERE phone_number IS NOT NULL GROUP BY 1),
    f AS (SELECT c.*, coalesce(n, 1) AS shared_phone_count,
        CASE WHEN greatest(household_size - nb_children, 0) = 0 THEN 0
             ELSE nb_children / greatest(household_size - nb_children, 0) END AS dependency,
        CASE WHEN household_size = 0 OR income IS NULL THEN 0 ELSE income / household_size END AS per_person
        FROM clean c LEFT JOIN shared USING (phone_number))
    SELECT id, CAST(shared_phone_count >= 3 OR dependency >= 3 OR per_person < 100
                    OR coalesce(income < 500 AND vehicles_owned >= 3, false) AS INT) AS is_suspicious FROM f""")
def _(t):
    df = clean_survey(survey(t))
    counts = df.where("phone_number IS NOT NULL").groupBy("phone_number").agg(
        F.count(F.lit(1)).alias("shared_phone_count"))
    adults = F.greatest(F.col("household_size") - F.col("nb_children"), F.lit(0))
    dependency = F.coalesce(F.col("nb_children") / F.nullif(adults, F.lit(0)), F.lit(0.0))
    per_person = F.coalesce(F.col("income") / F.nullif("household_size", F.lit(0)), F.lit(0.0))
    suspicious = (
        (F.coalesce("shared_phone_count", F.lit(1)) >= 3) | (dependency >= 3) | (per_person < 100)
        | F.coalesce((F.col("income") < 500) & (F.col("vehicles_owned") >= 3), F.lit(False)))
    return join_groups(df, counts, ["phone_number"], "left").select("id", suspicious.cast("int").alias("is_suspicious"))


@query("b25_search_by_name", """
    SELECT partner_id, name FROM registrant WHERE NOT is_group AND is_registrant AND name LIKE '%77%'""")
def _(t):
    return domain_filter(t.registrant, [("is_group", "=", False), ("is_registrant", "=", True),
                                        ("name", "like", "77")]).select("partner_id", "name")


@query("b26_registry_page", """
    SELECT partner_id, name, count(*) OVER () AS page_count,
           (SELECT count(*) FROM registrant WHERE NOT is_group AND create_date > DATE '1999-01-01'
             AND kind = 'BUILDING') AS total
    FROM (SELECT * FROM registrant WHERE NOT is_group AND create_date > DATE '1999-01-01' AND kind = 'BUILDING'
          ORDER BY income DESC, partner_id LIMIT 25 OFFSET 10)""")
def _(t):
    kept = domain_filter(t.registrant, [("is_group", "=", False), ("create_date", ">", F.lit("1999-01-01").cast(
        "date")), ("kind", "=", "BUILDING")])
    page = kept.orderBy(F.desc("income"), "partner_id").offset(10).limit(25)
    total, on_page = kept.count(), page.count()
    return page.select("partner_id", "name", F.lit(on_page).cast("long").alias("page_count"),
                       F.lit(total).cast("long").alias("total"))


@query("b27_id_values", """
    SELECT DISTINCT value FROM reg_id d WHERE id_type = 'National ID' AND status = 'valid'
      AND (expiry_date IS NULL OR expiry_date > DATE '2002-01-01')
      AND NOT EXISTS (SELECT 1 FROM reg_id x WHERE x.partner_id = d.partner_id AND x.id_type = 'Household ID')""")
def _(t):
    ids = t.reg_id
    valid = ids.where((F.col("id_type") == "National ID") & (F.col("status") == "valid")
                      & (F.col("expiry_date").isNull() | (F.col("expiry_date") > as_of())))
    excluded = ids.where("id_type = 'Household ID'").select("partner_id")
    return valid.join(excluded, "partner_id", "left_anti").select("value").distinct()


@query("b28_record_mapping", """
    SELECT 'ext-' || CAST(partner_id AS VARCHAR) AS external_id, CASE WHEN income <> 0 THEN income END AS income,
           CAST(NULL AS VARCHAR) AS created_on, CASE WHEN supplier_rank <> 0 THEN CAST(supplier_rank AS VARCHAR) END
           AS rank_text, CASE WHEN partner_id % 2 = 0 THEN upper(name) END AS label FROM registrant""")
def _(t):
    df = t.registrant.withColumn("changed", F.expr(
        "CASE WHEN partner_id % 2 = 0 THEN array('name', 'income') ELSE array('gender') END"))
    return records.map_records(
        df, direct=[(records.falsy_to_null("income"), "income"),
                    (F.col("create_date").cast("string"), "created_on"),
                    (records.converted("supplier_rank", "string"), "rank_text")],
        functions=[lambda d: {"external_id": F.concat(F.lit("ext-"), F.col("partner_id").cast("string"))},
                   lambda d: {"label": F.upper("name")}],
        only_create=["created_on"], changed_by={"label": ["name"]}, changed_fields="changed")


@query("b28_mapped_children", """
    SELECT 'grp-' || CAST(group_id AS VARCHAR) AS external_id, CASE WHEN group_id % 2 = 0 THEN '1998' END AS created_on, 'ind-' || CAST(individual_id AS VARCHAR) AS member,
        CASE WHEN individual_id % 2 = 0 THEN upper(kind) END AS role, CASE WHEN group_id % 2 = 0 THEN CAST(start_date AS VARCHAR) END AS joined_on,
        CAST(2 * (individual_id % 3) AS BIGINT) AS weight FROM group_membership WHERE ended_date IS NULL""")
def _(t):
    """Groups with pages of their members: parents and children are mapped in one pass, each level under its own conditions."""
    child = F.struct("individual_id", "kind", "start_date", "ended_date", F.array(F.when(F.col("individual_id") % 2 == 0, "kind").otherwise("ended")).alias("changed"),
                     F.array(F.col("individual_id") % 3, F.col("individual_id") % 3).alias("points"))
    pages = chunked_lists(t.group_membership.select("group_id", "individual_id", child.alias("child")), ["group_id"], "child",
                          [F.col("individual_id"), F.col("child.kind"), F.col("child.start_date")], size=100)
    new = F.col("group_id") % 2 == 0
    children = records.map_children(
        "members", direct=[(lambda c: F.concat(F.lit("ind-"), c["individual_id"].cast("string")), "member"), (lambda c: F.upper(c["kind"]), "role"),
                           (lambda c: c["start_date"].cast("string"), "joined_on")],
        only_create=["joined_on"], changed_by={"role": ["kind"]}, for_create=new, changed_fields="changed", keep=lambda c: c["ended_date"].isNull(),
        nested={"weight": lambda c: F.aggregate(c["points"], F.lit(0).cast("long"), lambda a, x: a + x)})
    return records.map_records(pages, direct=[(F.concat(F.lit("grp-"), F.col("group_id").cast("string")), "external_id"),
                                              (F.when(new, F.lit("1998")), "created_on"), (children, "members")]).select("external_id", "created_on", F.inline("members"))


REQUESTS = """SELECT partner_id, CASE WHEN partner_id % 10 < 6 THEN 'modify' ELSE 'delete' END AS change,
    ' ' || lower(name) || ' ' AS new_name, CASE WHEN partner_id % 4 = 0 THEN '' ELSE 'Other' END AS gender,
    CASE WHEN partner_id % 3 = 0 THEN NULL ELSE 'X-' || kind END AS kind,
    CASE partner_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'submitted' ELSE 'approved' END AS state
    FROM {r} WHERE income > 2000"""


def requests(t):
    return t.spark.sql(REQUESTS, r=t.registrant)


@query("b29_apply_change_requests", f"""
    WITH q AS ({REQUESTS.format(r='registrant')})
    SELECT r.partner_id, CASE WHEN q.change = 'modify' THEN upper(trim(q.new_name)) ELSE r.name END AS name,
           CASE WHEN q.change = 'modify' THEN coalesce(nullif(q.gender, ''), r.gender) ELSE r.gender END AS gender,
           CASE WHEN q.change = 'modify' THEN coalesce(q.kind, r.kind) ELSE r.kind END AS kind,
           CASE WHEN q.change = 'delete' THEN false ELSE r.active END AS active
    FROM registrant r LEFT JOIN q USING (partner_id)""")
def _(t):
    return records.apply_requests(t.registrant, requests(t), ["gender", "kind"]).select(
        "partner_id", "name", "gender", "kind", "active")


AFTER = """SELECT partner_id, CASE WHEN partner_id % 2 = 0 THEN 'Unknown' ELSE gender END AS gender,
    CASE WHEN zone_id > 20 THEN NULL ELSE kind END AS kind, company_id % 2 AS company_id, name, income
    FROM {r}"""


def after_image(t):
    return t.spark.sql(AFTER, r=t.registrant)


@query("b30_write_difference", f"""
    WITH a AS ({AFTER.format(r='registrant')}), d AS (
        SELECT partner_id, (CASE WHEN a.company_id IS DISTINCT FROM r.company_id THEN ';company_id='
                  || CAST(a.company_id AS VARCHAR) ELSE '' END) ||
               (CASE WHEN a.gender IS DISTINCT FROM r.gender THEN ';gender=' || coalesce(a.gender, '') ELSE '' END) ||
               (CASE WHEN a.kind IS DISTINCT FROM r.kind THEN ';kind=' || coalesce(a.kind, '') ELSE '' END) AS diff
        FROM registrant r JOIN a USING (partner_id))
    SELECT substr(diff, 2) AS diff, count(*) AS n_records FROM d WHERE diff <> '' GROUP BY 1""")
def _(t):
    diffs = records.differences(t.registrant, after_image(t), "partner_id", ["gender", "kind", "company_id"])
    return records.difference_groups(diffs)


@query("b32_assign_to_batch", """
    SELECT count(*) AS selected, count(*) FILTER (state = 'draft') AS ignored, count(*) FILTER (state <> 'draft')
           AS added FROM entitlement WHERE program_id = 2""")
def _(t):
    return batch_choice(t).agg(F.count(F.lit(1)).alias("selected"), F.count_if(~F.col("is_added")).alias("ignored"), F.count_if("is_added").alias("added"))


def batch_choice(t):
    """The payments of a program: those of draft entitlements are in a batch of their cycle."""
    taken = F.when(F.col("state") == "draft", F.concat(F.lit("batch-"), F.col("cycle_id").cast("string")))
    return records.assign_to_batch(t.entitlement.where("program_id = 2").withColumn("batch_id", taken), "new-batch")


@query("b32_assigned_payments", """
    SELECT entitlement_id, CASE WHEN state = 'draft' THEN 'batch-' || CAST(cycle_id AS VARCHAR) ELSE 'new-batch' END AS batch_id, state <> 'draft' AS is_added
    FROM entitlement WHERE program_id = 2""")
def _(t):
    return batch_choice(t).select("entitlement_id", "batch_id", "is_added")


@query("h01_lower_trim_nullif", """
    SELECT partner_id, lower(coalesce(gender, 'unknown')) AS gender,
           coalesce(nullif(sanitized_acc_number, ''), acc_number) AS account
    FROM registrant JOIN bank_account USING (partner_id)""")
def _(t):
    return t.registrant.join(t.bank_account.drop("active"), "partner_id").select(
        "partner_id", text.lower_or_unknown(F.col("gender")).alias("gender"),
        F.coalesce(text.blank_to_null(F.col("sanitized_acc_number")), "acc_number").alias("account"))
