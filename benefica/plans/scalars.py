"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from benefica.fixed import ACCOUNT_PATTERNS
from benefica.functions import dates, text
from benefica.operators import programs
from benefica.plans.registry import query

def as_of():
    return F.lit("2002-01-01").cast("date")


@query("h02_join_flags", """
    SELECT partner_id, array_to_string(list_filter([CASE WHEN is_group THEN 'GROUP' END, CASE WHEN income < 0 THEN
        'NEGATIVE' END, CASE WHEN gender IS NULL THEN 'NO_GENDER' END], lambda x: x IS NOT NULL), '|') AS flags
    FROM registrant""")
def _(t):
    flags = F.filter(F.array(F.when(F.col("is_group"), "GROUP"), F.when(F.col("income") < 0, "NEGATIVE"),
                             F.when(F.col("gender").isNull(), "NO_GENDER")), lambda x: x.isNotNull())
    return t.registrant.select("partner_id", text.join_flags(flags).alias("flags"))


PERSON = """p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type
    WHEN 2 THEN p_type ELSE NULL END AS name"""


@query("h04_split_name", f"""
    WITH p AS (SELECT {PERSON} FROM part), w AS (SELECT *, string_split(name, ' ') AS w FROM p)
    SELECT id, w[1] AS given, CASE WHEN len(w) > 2 THEN array_to_string(w[2:len(w) - 1], ' ') WHEN name IS NOT NULL
        THEN '' END AS additional, w[len(w)] AS family FROM w""")
def _(t):
    given, additional, family = text.split_name(F.col("name"))
    return t.part.selectExpr("p_partkey AS id", PERSON.split(",", 1)[1]).select(
        "id", given.alias("given"), additional.alias("additional"), family.alias("family"))


@query("h05_compose_name", """
    SELECT p_partkey AS id, upper(concat_ws(' ', CASE WHEN p_partkey % 5 = 0 THEN NULL
        WHEN p_partkey % 3 <> 0 OR p_partkey % 2 = 0 THEN p_type || ',' ELSE p_type END,
        CASE WHEN p_partkey % 3 <> 0 THEN split_part(p_name, ' ', 1) END,
        CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) END)) AS name FROM part""")
def _(t):
    df = t.part.selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS family",
        "CASE WHEN p_partkey % 3 <> 0 THEN split_part(p_name, ' ', 1) END AS given",
        "CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) END AS additional")
    return df.select("id", text.compose_name(F.col("family"), F.col("given"), F.col("additional")).alias("name"))


@query("h06_account_parts", """
    SELECT id_value, coalesce(regexp_extract(fa_value, '^account_number:([^.]*)[.]', 1), '') AS account_number,
        coalesce(regexp_extract(fa_value, 'branch_code:([^.]*)[.]', 1), '') AS branch_code,
        coalesce(regexp_extract(fa_value, 'bank_code:([^.]*)[.]', 1), '') AS bank_code,
        regexp_extract(fa_value, 'mobile_number:([^.]*)[.]', 1) AS mobile_number,
        CASE WHEN fa_value LIKE '%EMAIL_WALLET' THEN regexp_extract(fa_value, '^email_address:(.*)[.]wallet_provider_name:', 1)
             ELSE '' END AS email_address,
        regexp_extract(fa_value, 'wallet_provider_name:([^.]*)[.]', 1) AS wallet_provider_name,
        regexp_extract(fa_value, 'wallet_provider_code:([^.]*)[.]', 1) AS wallet_provider_code,
        regexp_extract(fa_value, 'fa_type:(.*)$', 1) AS fa_type FROM id_fa_mapping""")
def _(t):
    parts = text.account_parts(F.col("fa_value"), ACCOUNT_PATTERNS)
    return t.id_fa_mapping.select("id_value", *[c.alias(n) for n, c in parts.items()])


@query("h07_from_template", """
    SELECT partner_id, 'account_number:' || CAST(partner_id AS VARCHAR) || '.bank_code:' || gender || '.fa_type:BANK'
        AS fa FROM registrant""")
def _(t):
    fa = text.from_template("account_number:{account}.bank_code:{bank}.fa_type:BANK",
                            {"account": F.col("partner_id"), "bank": F.col("gender")})
    return t.registrant.select("partner_id", fa.alias("fa"))


@query("h08_payee_address", """
    SELECT partner_id, CASE partner_id % 5 WHEN 0 THEN 'account_no:' || acc_number || '@BIC' WHEN 1 THEN
        'iban:XX' || acc_number || '@BIC' WHEN 2 THEN 'phone:' || CAST(zone_id AS VARCHAR) WHEN 3 THEN 'email:' || kind
        ELSE 'p-' || name || '-s' END AS payee
    FROM registrant JOIN (SELECT partner_id, min(acc_number) AS acc_number FROM bank_account GROUP BY 1) USING (partner_id)""")
def _(t):
    kind = F.expr("CASE partner_id % 5 WHEN 0 THEN 'bank_acc_no' WHEN 1 THEN 'bank_acc_iban' WHEN 2 THEN 'phone' "
                  "WHEN 3 THEN 'email' ELSE 'reg_id' END")
    account = t.bank_account.groupBy("partner_id").agg(F.min("acc_number").alias("acc_number"))
    payee = text.payee_address(kind, F.col("acc_number"), F.lit("BIC"), F.concat(F.lit("XX"), "acc_number"),
                               F.col("zone_id").cast("string"), F.col("kind"), F.col("name"), "p-", "-s")
    return t.registrant.join(account, "partner_id").select("partner_id", payee.alias("payee"))


@query("h09_e164_phones", """
    SELECT phone_id, CASE WHEN b LIKE '00_%' THEN '+' || substr(b, 3) WHEN len(ltrim(b, '0')) > 0
        THEN '+94' || ltrim(b, '0') END AS phone FROM (SELECT phone_id, regexp_replace(phone_no, '[^0-9+]', '', 'g') AS b
        FROM phone_number)""")
def _(t):
    return t.phone_number.select("phone_id", text.e164(F.col("phone_no"), "94").alias("phone"))


@query("h10_iban", """
    WITH a AS (SELECT c_custkey AS id, 'BK' || CAST(c_nationkey % 7 AS VARCHAR) AS bank,
            lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS acc, 'FR' AS country FROM customer),
      m AS (SELECT *, list_reduce(list_prepend(0, list_transform(string_split(bank || acc || country || '00', ''),
            lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE CAST(c AS INT) END)),
            lambda x, v: CASE WHEN v > 9 THEN (x * 100 + v) % 97 ELSE (x * 10 + v) % 97 END) AS r FROM a)
    SELECT id, country || lpad(CAST(98 - r AS VARCHAR), 2, '0') || bank || acc AS iban FROM m""")
def _(t):
    df = t.customer.selectExpr("c_custkey AS id", "'bk' || c_nationkey % 7 AS bank",
                               "lpad(CAST(c_custkey AS STRING), 10, '0') AS acc")
    return df.select("id", text.iban(F.lit("FR"), F.col("bank"), F.col("acc")).alias("iban"))


def grams_sql(x: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) > 0)"
    return (f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, len(w) + 2), "
            f"lambda i: substr('  ' || w || ' ', i, 3)))))")


@query("h11_trigram_similarity", f"""
    WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, {grams_sql('p_name')} AS a,
        {grams_sql("'small rings'")} AS b FROM n), s AS (SELECT p_name, len(list_intersect(a, b)) AS k, len(a) + len(b)
        AS total FROM g)
    SELECT p_name, round(k / (total - k), 6) AS similarity, k / (total - k) >= 0.3 AS is_similar FROM s""")
def _(t):
    a, b = text.trigrams(F.col("p_name")), text.trigrams(F.lit("small rings"))
    return t.part.select("p_name").distinct().select(
        "p_name", F.round(text.similarity(a, b), 6).alias("similarity"), text.is_similar(a, b).alias("is_similar"))


@query("h12_name_search", """
    SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%red ring%' THEN 1 WHEN lower(p_type) LIKE '%red ring%' THEN 2
        WHEN lower(p_name) LIKE '%red%ring%' THEN 3 WHEN lower(p_type) LIKE '%red%ring%' THEN 4
        ELSE 5 END AS step FROM part
    WHERE (lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%red%')
      AND (lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%')
    ORDER BY step, p_partkey LIMIT 60""")
def _(t):
    step = text.name_step("Red ring", [F.col("p_name"), F.col("p_type")])
    return t.part.select("p_partkey", step.alias("step")).where("step IS NOT NULL").orderBy("step", "p_partkey").limit(60)


@query("h13_text_from_html", r"""
    WITH p AS (SELECT page_id, regexp_extract_all(html,
        '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[!/?a-z][^>]*>|[^<]+|<') AS parts FROM pages),
      j AS (SELECT page_id, array_to_string(list_transform(parts, lambda x:
        CASE WHEN regexp_matches(x, '(?is)^<(script|style)\b') THEN regexp_replace(regexp_replace(x, '(?is)^<[^>]*>', ''),
                  '(?is)</(script|style)\s*>$', '')
             WHEN x LIKE '<_%' THEN ''
             ELSE replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
                  x, '&lt;', '<'),
                  '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&copy;', chr(169)),
                  '&eacute;', chr(233)), '&mdash;', chr(8212)), '&hellip;', chr(8230)), '&middot;', chr(183)),
                  '&amp;', '&'), '&amp', '&') END), '') AS text
        FROM p),
      w AS (SELECT page_id, list_filter(regexp_split_to_array(text,
        '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'),
        lambda x: len(x) > 0) AS words FROM j)
    SELECT page_id, md5(array_to_string(words, ' ')) AS full_text, array_to_string(words[1:8], ' ') || CASE WHEN
        len(words) > 8 THEN '…' ELSE '' END AS teaser FROM w""")
def _(t):
    html = F.col("html")
    return t.pages.select("page_id", F.md5(text.text_from_html(html)).alias("full_text"),
                          text.text_from_html(html, max_words=8).alias("teaser"))


@query("h14_full_years", """
    SELECT partner_id, coalesce(CAST(date_part('year', age(DATE '2002-01-01', birthdate)) AS INT), 35) AS age
    FROM registrant""")
def _(t):
    return t.registrant.select("partner_id", dates.age_or_default(F.col("birthdate"), as_of()).alias("age"))


@query("h15_decimal_age", """
    WITH d AS (SELECT partner_id, CASE WHEN partner_id % 6 = 0 THEN '31/02/1999' WHEN partner_id % 6 = 1 THEN 'unknown'
        ELSE strftime(birthdate, '%d/%m/%Y') END AS dob, birthdate FROM registrant)
    SELECT partner_id, CASE WHEN partner_id % 6 > 1 THEN round(date_diff('day', birthdate, DATE '2002-01-01') / 365.25,
        1) END AS age FROM d""")
def _(t):
    dob = F.expr("CASE WHEN partner_id % 6 = 0 THEN '31/02/1999' WHEN partner_id % 6 = 1 THEN 'unknown' "
                 "ELSE date_format(birthdate, 'dd/MM/yyyy') END")
    return t.registrant.select("partner_id", dates.decimal_age(dates.day_first_date(dob), as_of()).alias("age"))


@query("h16_days_since", """
    SELECT partner_id, coalesce(CAST(date_diff('day', disabled, DATE '2002-01-01') AS INT), 365) AS days
    FROM registrant""")
def _(t):
    return t.registrant.select("partner_id", dates.days_since(F.col("disabled"), as_of()).alias("days"))


@query("h17_birthdate_from_age", """
    SELECT partner_id, CASE WHEN zone_id > 0 THEN strftime(DATE '2002-01-01' - to_years(zone_id), '%Y-%m-%d') END AS dob
    FROM registrant""")
def _(t):
    return t.registrant.select("partner_id", dates.birthdate_from_age(F.col("zone_id"), as_of()).cast("string").alias("dob"))


RULES = {
    "daily": {"type": "daily", "interval": 20},
    "yearly": {"type": "yearly", "interval": 1},
    "monthly_day": {"type": "monthly", "interval": 1, "day": 10},
    "monthly_nth": {"type": "monthly", "interval": 1, "nth": 1, "weekday": "Mon"},
    "weekly": {"type": "weekly", "interval": 1, "weekday": "Mon"},
}


@query("h18_recurrence", """
    WITH d AS (SELECT partner_id, create_date AS d, CAST(date_trunc('month', create_date) AS DATE) AS m FROM registrant),
      x AS (SELECT *, CAST(m + INTERVAL 1 MONTH AS DATE) AS m1, CAST(m + INTERVAL 2 MONTH AS DATE) AS m2 FROM d),
      y AS (SELECT *, m + CAST((8 - isodow(m)) % 7 AS INT) AS n0, m1 + CAST((8 - isodow(m1)) % 7 AS INT) AS n1, m2 + CAST((8 - isodow(m2)) % 7 AS INT) AS n2,
            d + CAST((8 - isodow(d)) % 7 AS INT) AS w FROM x),
      r AS (SELECT partner_id, 'daily' AS rule, d AS s, d + 19 AS e FROM y
        UNION ALL SELECT partner_id, 'yearly', d, CASE WHEN month(d) = 2 AND day(d) = 29 THEN
            make_date(year(d) + 4, 2, 29) ELSE CAST(d + INTERVAL 1 YEAR AS DATE) END - 1 FROM y
        UNION ALL SELECT partner_id, 'monthly_day', CASE WHEN day(d) <= 10 THEN m + 9 ELSE m1 + 9 END,
            CASE WHEN day(d) <= 10 THEN m1 + 8 ELSE m2 + 8 END FROM y
        UNION ALL SELECT partner_id, 'monthly_nth', CASE WHEN n0 >= d THEN n0 ELSE n1 END,
            CASE WHEN n0 >= d THEN n1 - 1 ELSE n2 - 1 END FROM y
        UNION ALL SELECT partner_id, 'weekly', w, w + 6 FROM y)
    SELECT partner_id, rule, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date FROM r""")
def _(t):
    entries = []
    for name, rule in RULES.items():
        start, end = dates.cycle_range(F.col("create_date"), rule)
        entries.append(F.struct(F.lit(name).alias("rule"), start.cast("string").alias("start_date"),
                                end.cast("string").alias("end_date")))
    # Rules cost far more than reading: a small file is one split, so its rows are first spread over the cores.
    cores = t.spark.sparkContext.defaultParallelism
    people = t.registrant.select("partner_id", "create_date").repartition(4 * cores, "partner_id")
    return people.select("partner_id", F.inline(F.array(*entries)))


@query("h19_application_ids")
def _(t):
    return t.program_membership.select(
        "membership_id", text.dated_application_id(F.col("enrollment_date"), F.col("membership_id")).alias("application_id"),
        text.entitlement_number(F.col("membership_id")).alias("number"))


@query("h19_id_formats", """
    SELECT strftime(enrollment_date, '%d%m%y') AS day, count(*) AS n, count(*) AS well_formed, true AS at_least_five
    FROM program_membership GROUP BY 1""")
def _(t):
    made = text.dated_application_id(F.col("enrollment_date"), F.col("membership_id"))
    day = F.date_format("enrollment_date", "ddMMyy")
    return t.program_membership.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(made.startswith(day) & made.rlike("^[0-9]{11,12}$")).alias("well_formed"),
        (F.min(F.length(made)) >= 11).alias("at_least_five"))


@query("h26_entitlement_amount", """
    WITH m AS (SELECT group_id AS partner_id, count(*) AS n FROM group_membership GROUP BY 1)
    SELECT partner_id, 500 + CASE WHEN is_group THEN 40.0 * least(coalesce(n, 0), 4) ELSE 0 END AS amount,
        round((500 + CASE WHEN is_group THEN 40.0 * least(coalesce(n, 0), 4) ELSE 0 END) * 0.025, 6) AS fee_percent,
        7.5 AS fee_fixed FROM registrant LEFT JOIN m USING (partner_id)""")
def _(t):
    n = t.group_membership.groupBy(F.col("group_id").alias("partner_id")).agg(F.count(F.lit(1)).alias("n"))
    amount = programs.entitlement_amount(F.col("is_group"), F.coalesce("n", F.lit(0)), 500.0, 40.0, 4)
    return t.registrant.join(n, "partner_id", "left").select(
        "partner_id", amount.alias("amount"), F.round(programs.transfer_fee(amount, 2.5, 0), 6).alias("fee_percent"),
        programs.transfer_fee(amount, 0, 7.5).alias("fee_fixed"))


@query("h27_expression_transform", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) * 2 AS doubled, upper(op) AS op, 'v1' AS version
    FROM change_event WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50""")
def _(t):
    from benefica.sources.changes import transform_records

    return transform_records(t.change_event, condition="data.k > 50",
                             fields={"event_id": "event_id", "doubled": "data.k * 2", "op": "upper(op)"},
                             extra={"version": "v1"}, payload="props", payload_schema="k INT")


@query("h28_json_merge", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, op FROM change_event""")
def _(t):
    parsed = F.from_json("props", "map<string,string>")
    merged = F.to_json(F.map_concat(parsed, F.create_map(F.lit("op"), F.col("op"))))
    back = F.from_json(merged, "k STRING, op STRING")
    return t.change_event.select("event_id", back.alias("j")).select(
        "event_id", F.col("j.k").cast("int").alias("k"), "j.op")


@query("h29_change_summary", """
    WITH c AS (SELECT partner_id, name, list_filter([CASE WHEN gender IS NULL THEN 'gender' END, CASE WHEN zone_id > 10
        THEN 'zone' END, CASE WHEN income < 0 THEN 'income' END, CASE WHEN is_group THEN 'kind' END],
        lambda x: x IS NOT NULL) AS f FROM registrant)
    SELECT partner_id, CASE partner_id % 4 WHEN 0 THEN 'Created new registrant: ' || name WHEN 1 THEN
        'Deactivated registrant: ' || name WHEN 2 THEN 'Unknown change type for registrant: ' || name
        ELSE CASE WHEN len(f) > 0 THEN 'Modified registrant ' || name || ': changed ' || array_to_string(f[1:3], ', ')
        ELSE 'Modified registrant: ' || name END END AS summary FROM c""")
def _(t):
    changed = F.filter(F.array(
        F.when(F.col("gender").isNull(), "gender"), F.when(F.col("zone_id") > 10, "zone"),
        F.when(F.col("income") < 0, "income"), F.when(F.col("is_group"), "kind")), lambda x: x.isNotNull())
    change = F.expr("CASE partner_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' WHEN 2 THEN 'merge' ELSE 'modify' END")
    return t.registrant.select("partner_id", text.change_summary(change, F.col("name"), changed).alias("summary"))


@query("h30_normalised_values", """
    SELECT partner_id, strftime(birthdate, '%Y-%m-%d') AS birthdate, nullif(gender, '') AS gender, n_name AS zone
    FROM registrant JOIN nation ON n_nationkey = zone_id""")
def _(t):
    zones = t.nation.select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone"))
    return t.registrant.join(zones, "zone_id").select(
        "partner_id", F.date_format("birthdate", "yyyy-MM-dd").alias("birthdate"),
        text.blank_to_null(F.col("gender")).alias("gender"), "zone")


@query("h31_duration_text", """
    WITH m AS (SELECT event_id, CAST(round(abs(value) * 60) AS BIGINT) AS m FROM events)
    SELECT event_id, printf('%02d:%02d', m // 60, m % 60) AS duration FROM m""")
def _(t):
    return t.events.select("event_id", dates.duration_text(F.col("value")).alias("duration"))


@query("h33_entitlement_label", """
    SELECT entitlement_id, CASE WHEN program_id < 4 THEN 'Entitlement Cash [$ ' || format('{:,.2f}', initial_amount) || ']'
        ELSE 'Entitlement (' || code || ')' END AS label FROM entitlement""")
def _(t):
    return t.entitlement.select("entitlement_id", text.entitlement_label(
        F.col("initial_amount"), "$", F.col("program_id") < 4, F.col("code")).alias("label"))


@query("h35_field_masking", """
    SELECT partner_id, CASE WHEN gender IS NOT NULL THEN 'encrypted' END AS gender, 'encrypted' AS name,
        gender AS opened_gender, name AS opened_name FROM registrant""")
def _(t):
    from benefica.functions.text import masked

    key = F.lit("0123456789abcdef")
    out = masked(["gender", "name"], key=key)
    sealed = t.registrant.select("partner_id", *[c.alias(n) for n, c in out.items()])
    opened = F.from_json(F.aes_decrypt(F.unbase64("sealed"), key).cast("string"), "gender STRING, name STRING")
    return sealed.select("partner_id", "gender", "name", opened.alias("o")).select(
        "partner_id", "gender", "name", F.col("o.gender").alias("opened_gender"), F.col("o.name").alias("opened_name"))
