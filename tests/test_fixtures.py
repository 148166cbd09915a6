"""Small hand-made cases for branches that the given tables do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from benefica.fixed import RULE_DEFAULTS
from benefica.functions import dates, scoring, text
from benefica.operators import dedup, households, payments, programs, records, rules, validation
from benefica.operators.domain import Relation, domain_filter
from benefica.sources import export, files, statements

D = dt.date


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


# Expected first and second cycle for a start on 2022-12-15.
@pytest.mark.parametrize("rule,first,second", [
    ({"type": "daily", "interval": 20}, ("2022-12-15", "2023-01-03"), ("2023-01-04", "2023-01-23")),
    ({"type": "yearly", "interval": 1}, ("2022-12-15", "2023-12-14"), ("2023-12-15", "2024-12-14")),
    ({"type": "monthly", "interval": 1, "day": 10}, ("2023-01-10", "2023-02-09"), ("2023-02-10", "2023-03-09")),
    ({"type": "monthly", "interval": 1, "nth": 1, "weekday": "Mon"}, ("2023-01-02", "2023-02-05"),
     ("2023-02-06", "2023-03-05")),
    ({"type": "weekly", "interval": 1, "weekday": "Mon"}, ("2022-12-19", "2022-12-25"), ("2022-12-26", "2023-01-01")),
])
def test_cycle_dates(spark, rule, first, second):
    for start, want in (("2022-12-15", first), (None, second)):
        if start is None:
            start = str(D.fromisoformat(first[1]) + dt.timedelta(days=1))
        a, b = dates.cycle_range(F.lit(start).cast("date"), rule)
        r = one(spark, a=a.cast("string"), b=b.cast("string"))
        assert (r.a, r.b) == want


def test_last_weekday_and_ages(spark):
    r = one(spark, last=dates.nth_weekday(F.lit("2023-02-01").cast("date"), -1, "Tue"),
            leap=dates.full_years(F.lit("2000-02-29").cast("date"), F.lit("2001-02-28").cast("date")),
            bad=dates.day_first_date(F.lit("31/02/1999")), good=dates.day_first_date(F.lit("5/3/1999")),
            text=dates.duration_text(F.lit(-1.5)))
    assert (r.last, r.leap, r.bad, r.good, r.text) == (D(2023, 2, 28), 0, None, D(1999, 3, 5), "-01:30")


def test_names_and_similarity(spark):
    df = spark.createDataFrame([("John Smith",), ("John Smizz",), ("Linus Torvalds",)], "name string")
    for asked in ("Jon Smith", "Smith John"):
        hit = [r.name for r in df.where(text.is_similar(text.trigrams(F.col("name")), text.trigrams(F.lit(asked)))).collect()]
        assert hit == ["John Smith", "John Smizz"]
    r = one(spark, a=text.compose_name(F.lit("Doe"), F.lit("Jane"), F.lit(None).cast("string")),
            b=text.compose_name(F.lit("Doe"), F.lit(""), F.lit(None).cast("string")),
            iban=text.iban(F.lit("GB"), F.lit("WEST123456"), F.lit("98765432")))
    assert (r.a, r.b, r.iban) == ("DOE, JANE", "DOE", "GB82WEST12345698765432")


def test_account_text(spark):
    full = ("account_number:A.branch_code:B.bank_code:C.mobile_number:D.email_address:E.fa_type:BANK_ACCOUNT")
    df = spark.createDataFrame([(full,), ("nonsense",), ("nonsense BANK_ACCOUNT",)], "fa string")
    rows = df.select(*[c.alias(n) for n, c in text.account_parts(F.col("fa")).items()]).collect()
    assert (rows[0].account_number, rows[0].email_address, rows[0].fa_type) == ("A", "E", "BANK_ACCOUNT")
    assert set(rows[1]) == {""} and set(rows[2]) == {""}
    with pytest.raises(KeyError):
        text.from_template("{a}.{b}", {"a": F.lit("x")})


def test_html_text(spark):
    html = "<p>Some &amp; <b>bold</b>\n text</p><!-- no --><script>if (a</p>b) x()</script>"
    r = one(spark, full=text.text_from_html(F.lit(html)), words=text.text_from_html(F.lit(html), max_words=2),
            chars=text.text_from_html(F.lit(html), max_chars=8), none=text.text_from_html(F.lit(None).cast("string")))
    assert r.full == "Some & bold textif (a</p>b) x()"
    assert (r.words, r.chars, r.none) == ("Some &…", "Some &…", "")


def test_rules_on_and_below_each_threshold(spark):
    edge = {"shared_account_count": 2, "shared_phone_count": 3, "nb_programs": 4, "pmt_score": 0.2, "payment_gap_ratio": 0.5,
            "household_size": 8, "income_per_person": 49.0, "network_risk": 0.6}
    below = {"shared_account_count": 1, "shared_phone_count": 1, "nb_programs": 2, "pmt_score": 0.21,
             "payment_gap_ratio": 0.29, "household_size": 7, "income_per_person": 70.0, "network_risk": 0.59}
    cols = list(edge)
    schema = "partner_id int, " + ", ".join(f"{c} double" for c in cols)
    rows = [(i, *[float(r[c]) if r else None for c in cols]) for i, r in enumerate((edge, below, None))]
    got = {r.beneficiary_id: r for r in rules.score_rules(spark.createDataFrame(rows, schema)).collect()}
    assert got[0].rule_score == 1.0 and got[0].n_rules_triggered == 10 and got[0].risk_level == "CRITICAL"
    assert not got[0].pass_to_ml
    assert got[1].rule_score == 0.0 and got[1].flags == [] and got[1].pass_to_ml
    assert got[2].rule_score == 0.0 and RULE_DEFAULTS["pmt_score"] == 1


def test_rule_text_is_checked(spark):
    df = spark.createDataFrame([(1, 0)], "a int, b int")
    ok = lambda c: df.select(rules.condition_column(c, df.columns)).first()[0]
    assert ok("a / b == 0") and ok("a % b == 0") and ok("0 < a <= 1") and ok("not missing") and ok("-a ** 2 < 0")
    for bad in ("__import__('os')", "a.b", "[a]", "a if b else 1"):
        with pytest.raises((ValueError, KeyError, SyntaxError)):
            rules.condition_column(bad, df.columns)


def test_levels(spark):
    r = one(spark, a=scoring.service_level(F.lit(0.95), F.lit(1), F.lit(0.1), F.lit(0.34)),
            b=scoring.service_level(F.lit(0.95), F.lit(1), F.lit(0.1), F.lit(0.35)),
            c=scoring.rule_level(F.lit(0.55)), d=scoring.staged_level(F.lit(0.6)))
    assert (r.a, r.b, r.c, r.d) == ("HIGH", "CRITICAL", "HIGH", "HIGH")


def test_domains(spark):
    df = spark.createDataFrame([(1, "Ann", None, True), (2, "Bob", 5, False), (3, None, 7, None)],
                               "id int, name string, n int, flag boolean")
    child = spark.createDataFrame([(1, "x"), (2, "y"), (2, "x")], "pid int, kind string")
    rel = {"kids": Relation(child, "id", "pid")}
    ids = lambda d: sorted(r.id for r in domain_filter(df, d, rel).collect())
    assert ids([]) == [1, 2, 3]
    assert ids([("n", "!=", 5)]) == [1, 3] and ids([("n", "not in", [7])]) == [1, 2]
    assert ids([("n", "=", False)]) == [1] and ids([("n", "!=", None)]) == [2, 3]
    assert ids([("flag", "=", False)]) == [2, 3] and ids([("name", "=?", None)]) == [1, 2, 3]
    assert ids(["|", ("kids.kind", "=", "y"), ("name", "ilike", "AN")]) == [1, 2]
    assert ids(["!", ("kids.kind", "=", "x")]) == [3] and ids([("kids.kind", "=", "x"), ("n", ">", 1)]) == [2]
    assert ids([("name", "%", "Anna")]) == [1]
    with pytest.raises(ValueError):
        ids([("n", "~", 1)])


def test_registry_duplicates(spark):
    reg = spark.createDataFrame([(1, False), (2, False), (3, True), (4, True), (5, False)], "partner_id int, is_group boolean")
    ids = spark.createDataFrame([(1, "National ID", "12345"), (2, "National ID", "12345"), (3, "Household ID", "123"),
                                 (4, "Household ID", "123"), (5, "National ID", "9")],
                                "partner_id int, id_type string, value string")
    members = spark.createDataFrame([(3, 1), (4, 1)], "group_id int, individual_id int")
    flags = {r.partner_id: r.is_duplicated for r in dedup.registry_flags(reg, ids, members, ["National ID"], ["Household ID"])
             .collect()}
    assert flags == {1: True, 2: True, 3: True, 4: True, 5: False}


@pytest.mark.parametrize("states,want", [
    (["enrolled", "draft"], ["enrolled", "duplicated"]), (["enrolled", "enrolled"], ["duplicated", "duplicated"]),
    (["draft", "draft"], ["duplicated", "duplicated"]), (["enrolled", "exited"], ["enrolled", "exited"]),
])
def test_survivors(spark, states, want):
    ben = spark.createDataFrame([(i, i, s) for i, s in enumerate(states)], "membership_id int, partner_id int, state string")
    pairs = spark.createDataFrame([(100, i) for i in range(len(states))], "individual_id int, group_id int")
    got = {r.membership_id: r.new_state for r in dedup.survivors(ben, pairs).collect()}
    assert [got[i] for i in range(len(states))] == want


def test_survivor_in_two_sets_is_marked_by_any(spark):
    ben = spark.createDataFrame([(1, 1, "enrolled"), (2, 2, "draft"), (3, 3, "enrolled")],
                                "membership_id int, partner_id int, state string")
    pairs = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 3)], "individual_id int, group_id int")
    got = {r.membership_id: r.new_state for r in dedup.survivors(ben, pairs).collect()}
    assert got == {1: "duplicated", 2: "duplicated", 3: "duplicated"}


def test_expired_documents_do_not_count(spark):
    ids = spark.createDataFrame([(1, "N", "7", D(2020, 1, 1)), (2, "N", "7", None), (3, "N", "8", None), (4, "N", "8", D(2030, 1, 1))],
                                "partner_id int, id_type string, value string, expiry_date date")
    members = spark.createDataFrame([(i, i, "enrolled") for i in (1, 2, 3, 4)], "membership_id int, partner_id int, state string")
    got = dedup.duplicates_by_document(members, ids, F.lit("2025-01-01").cast("date"), ["N"])
    assert sorted(r.partner_id for r in got.collect()) == [3, 4]


def test_household_indicator(spark):
    reg = spark.createDataFrame([(1, True, True, None), (2, True, True, None), (10, True, False, None), (11, True, False, D(2020, 1, 1))],
                                "partner_id int, is_registrant boolean, is_group boolean, disabled date")
    m = spark.createDataFrame([(1, 10, "head", None), (1, 11, "child", None), (2, 10, "head", D(2020, 1, 1))],
                              "group_id int, individual_id int, kind string, ended_date date")
    groups = spark.createDataFrame([(1,), (2,)], "group_id int")
    got = {r.group_id: r.n for r in households.indicator(groups, reg, m, "n").collect()}
    assert got == {1: 1, 2: 0}


LINE = "statement_id string, statement_order long, entry_sequence long, indicator string, reconciliation_id string, amount double"


def recon(spark, lines, stored=None):
    dis = spark.createDataFrame([("D1",), ("D2",)], "disbursement_id string")
    geo = spark.createDataFrame([("G1",)], "geo_batch_id string")
    return payments.reconcile(spark.createDataFrame(lines, LINE), dis, geo, stored)


def test_reconciliation_branches(spark):
    lines = [("s1", 1, 1, "RD", "D1", 5.0), ("s1", 1, 2, "D", "D1", 5.0), ("s1", 1, 3, "D", "D1", 5.0),
             ("s1", 1, 4, "D", "nope", 5.0), ("s1", 1, 5, "RD", "D2", 5.0), ("s2", 2, 1, "D", "D2", 1.0),
             ("s2", 2, 2, "D", "G1", 1.0), ("s2", 2, 3, "C", "D2", 1.0), ("s3", 3, 1, "RD", "D1", 5.0)]
    judged = recon(spark, lines)
    got = {(r.statement_id, r.entry_sequence): r.outcome for r in judged.collect()}
    assert got == {("s1", 1): "REVERSED", ("s1", 2): "RECONCILED", ("s1", 3): "DUPLICATE_DISBURSEMENT",
                   ("s1", 4): "INVALID_RECONCILIATION_ID", ("s1", 5): "INVALID_REVERSAL", ("s2", 1): "RECONCILED",
                   ("s2", 2): "RECONCILED", ("s3", 1): "REVERSED"}
    made = {r.reconciliation_id: r for r in payments.recon_records(judged).collect()}
    assert made["D1"].reversal_statement_id == "s3" and made["G1"].target == "geo_batch"
    assert payments.error_records(judged).count() == 3


def test_reconciliation_against_stored(spark):
    stored = spark.createDataFrame([("D1",)], "reconciliation_id string")
    judged = recon(spark, [("s9", 9, 1, "D", "D1", 5.0), ("s9", 9, 2, "RD", "D1", 5.0)], stored)
    assert [r.outcome for r in judged.orderBy("entry_sequence").collect()] == ["DUPLICATE_DISBURSEMENT", "REVERSED"]


STATEMENT = """:20:REF1
:25:ACC77
:28C:12/3
:60F:C240101USD0,00
:61:2401020102D100,50NTRFD1//BANK1
:86:Payee One
second line
:61:240103C7,NTRFX
:61:2401040104RD100,50NTRFD1//BANK2
:86:Returned
:62F:C240131USD0,00
-"""


def test_statement_files(spark, tmp_path):
    (tmp_path / "st1.txt").write_text(STATEMENT)
    (tmp_path / "st2.txt").write_text(":20:EMPTY\n:25:ACC0\n:28C:1/1\n:62F:C240131USD0,00\n")
    df = statements.read_statements(spark, str(tmp_path))
    heads = {r.statement_id: r for r in statements.headers(df).collect()}
    h = heads["st1"]
    assert (h.account_number, h.reference_number, h.statement_number, h.sequence_number) == ("ACC77", "REF1", "12", "3")
    rows = statements.transactions(df).orderBy("entry_sequence").collect()
    assert [(r.entry_sequence, r.indicator, r.amount, r.reconciliation_id, r.bank_reference, r.narrative) for r in rows] == [
        (1, "D", 100.5, "D1", "BANK1", "Payee One second line"), (2, "C", 7.0, "X", "", None),
        (3, "RD", 100.5, "D1", "BANK2", "Returned")]
    assert rows[0].value_date == D(2024, 1, 2)


def test_mapping_requests(spark):
    mapping = spark.createDataFrame([("a", "fa", "A")], "id_value string, fa_value string, name string")
    req = spark.createDataFrame([
        ("1", "link", None, "x", None), ("2", "link", "b", None, None), ("3", "link", "a", "x", None),
        ("4", "link", "b", "x", None), ("5", "link", "b", "y", None), ("6", "update", "zz", "x", None),
        ("7", "update", "a", "new", None), ("8", "unlink", "zz", None, None), ("9", "unlink", "a", "other", None)],
        "reference_id string, op string, id_value string, fa_value string, name string")
    judged = payments.judge_mapping_requests(req, mapping)
    got = {r.reference_id: r.reason for r in judged.collect()}
    assert [k for k, v in got.items() if v is None] == ["4", "7"] or sorted(k for k, v in got.items() if v is None) == ["4", "7"]
    after = {r.id_value: (r.fa_value, r.name) for r in payments.apply_mapping_requests(mapping, judged).collect()}
    assert after == {"a": ("new", "A"), "b": ("x", None)}


def test_approval_stops_at_the_first_misfit(spark):
    ent = spark.createDataFrame([(1, 1, 60.0, "draft"), (2, 1, 10.0, "cancelled"), (3, 1, 50.0, "draft"), (4, 1, 1.0, "draft")],
                                "entitlement_id int, program_id int, initial_amount double, state string")
    bal = spark.createDataFrame([(1, 100.0)], "program_id int, balance double")
    got = [r.decision for r in programs.approve(ent, bal).orderBy("entitlement_id").collect()]
    assert got == ["approved", "state_error", "insufficient_funds", "insufficient_funds"]


def test_write_difference_and_log(spark):
    before = spark.createDataFrame([(1, "A", None), (2, "B", "x"), (3, "C", "y")], "id int, name string, code string")
    after = spark.createDataFrame([(1, "A", "n"), (2, "B", "x"), (4, "D", None)], "id int, name string, code string")
    diffs = {r.id: r["diff"] for r in records.differences(before, after, "id", ["name", "code"]).collect()}
    assert diffs == {1: {"code": "n"}}
    log = {(r.id, r.field, r.change) for r in records.field_log(before, after, "id", ["name", "code"]).collect()}
    assert log == {(1, "code", "write"), (3, "name", "unlink"), (3, "code", "unlink"), (4, "name", "create")}


def test_parser_json(spark):
    df = spark.createDataFrame([(1, "", D(2020, 1, 2), [(7, "k")])], "id int, name string, day date, kids array<struct<id:int,n:string>>")
    got = df.select(export.jsonify(df, ["id:key", "name", "day", "nope", ("kids:children", ["id", "n:label"])])).first()[0]
    assert got == '{"key":1,"name":null,"day":"2020-01-02","kids":[{"id":7,"label":"k"}]}' or \
        '"children":[{"id":7,"label":"k"}]' in got
    with pytest.raises(KeyError):
        export.jsonify(df, ["nope"], strict=True)


def test_rule_file_and_csv(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"rules": [{"id": "A", "condition": "x > 1", "enabled": false}, '
                                         '{"id": "B", "condition": "x > 2", "enabled": true}]}')
    assert [r["id"] for r in rules.scan_rules(spark, str(tmp_path / "rules.json"))] == ["B"]
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\n2,oops\n")
    got = files.scan_csv(spark, str(tmp_path / "a.csv"), "id INT, v DOUBLE").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2.5), (2, None)]


def test_exception_changes_and_patterns(spark):
    df = spark.createDataFrame([(1, "AB12"), (2, "zz")], "id int, v string")
    found = validation.detect_exceptions(df, "id", {"bad": ~validation.pattern_matches(F.col("v"), "[A-Z]+")})
    stored = spark.createDataFrame([(1, "bad")], "id int, rule string")
    got = {(r.id, r.change) for r in validation.exception_changes(found, stored, "id").collect()}
    assert got == {(2, "add"), (1, "remove")}
    assert one(spark, m=validation.pattern_matches(F.lit("AB12?"), "[A-Z]+[0-9]")).m


def test_fuzzy_duplicates_match_all_pairs(spark):
    import random
    rnd = random.Random(2)
    first, last = ["maria", "mario", "jose", "josef", "anna"], ["silva", "silvas", "costa", "kosta"]
    rows = [(i, "maria silva" if i % 3 == 0 else f"{rnd.choice(first)} {rnd.choice(last)}", f"d{rnd.randint(0, 4)}",
             rnd.choice(["m", "f", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, name string, dob string, sex string")
    got = {(r.rep_a, r.rep_b): round(r.score, 6) for r in
           dedup.fuzzy_duplicates(df, "id", "name", 0.5, {"dob": 0.3, "sex": 0.2}, 0.7).collect()}

    def grams(s):
        return {f"  {w} "[i:i + 3] for w in s.split() for i in range(len(w) + 1)}

    reps = {}
    for r in rows:
        reps.setdefault(r[1:], r[0])
    want = {}
    tuples = sorted((i, *t) for t, i in reps.items())
    for a in tuples:
        for b in tuples:
            if a[0] < b[0]:
                x, y = grams(a[1]), grams(b[1])
                s = 0.5 * len(x & y) / len(x | y) + 0.3 * (a[2] == b[2]) + 0.2 * (a[3] == b[3] and a[3] is not None)
                if s >= 0.7 - 1e-12:
                    want[(a[0], b[0])] = round(s, 6)
    assert got == want


@pytest.mark.parametrize("rule,start,want", [
    ({"type": "monthly", "interval": 1, "day": 31}, "2023-02-05", ("2023-03-31", "2023-05-30")),
    ({"type": "monthly", "interval": 1, "day": 29}, "2023-02-05", ("2023-03-29", "2023-04-28")),
    ({"type": "monthly", "interval": 2, "day": 30}, "2023-12-31", ("2024-04-30", "2024-06-29")),
    ({"type": "monthly", "interval": 1, "nth": 5, "weekday": "Fri"}, "2023-07-01", ("2023-09-29", "2023-12-28")),
    ({"type": "monthly", "interval": 1, "nth": -1, "weekday": "Fri"}, "2023-02-05", ("2023-02-24", "2023-03-30")),
    ({"type": "monthly", "interval": 1}, "2023-01-31", ("2023-01-31", "2023-03-30")),
    ({"type": "yearly", "interval": 1}, "2024-02-29", ("2024-02-29", "2028-02-28")),
    ({"type": "weekly", "interval": 2, "weekday": "Mon"}, "2022-12-15", ("2022-12-26", "2023-01-08")),
])
def test_cycles_skip_days_that_do_not_exist(spark, rule, start, want):
    a, b = dates.cycle_range(F.lit(start).cast("date"), rule)
    r = one(spark, a=a.cast("string"), b=b.cast("string"))
    assert (r.a, r.b) == want


@pytest.mark.parametrize("html,want", [
    ("&#8217;&Agrave;&euro;&#x1F600;", "’À€\U0001f600"), ("&amp;lt; &ampx &nothing; & &#0; &copy2", "&lt; &x &nothing; & &#0; ©2")])
def test_html_references(spark, html, want):
    assert one(spark, t=text.text_from_html(F.lit(html))).t == want


def test_small_repairs(spark):
    df = spark.createDataFrame([(5, -3), (-5, 3), (6, 0)], "a long, b long")
    right = rules.condition_column("a % b == -1 or a % b == 1 or b == 0 and a % b == 0", df.columns)
    assert [r[0] for r in df.select(right).collect()] == [True, True, True]
    assert one(spark, p=text.e164(F.lit("00" + "1" * 40), "94")).p == "+" + "1" * 40
    ids = spark.range(200000).select(text.dated_application_id(F.lit("2024-01-02").cast("date"), F.col("id")).alias("x"))
    assert ids.where(~F.col("x").rlike("^020124([0-9]{5}|100000)$")).count() == 0
    mapped = records.map_records(df, direct=[(F.lit("2024-01-02").cast("date"), "day")], only_create=["day"])
    assert mapped.schema["day"].dataType.simpleString() == "date"


def test_fuzzy_pairs_that_exact_fields_alone_decide(spark):
    rows = [(1, "anna", "d1", "s1"), (2, "zzz", "d1", "s1"), (3, None, "d1", "s1"), (4, "anna", "d2", "s1"), (5, "anna", "d1", None),
            (6, "anne", "d3", "s2"), (7, "!!", "d3", "s2")]
    df = spark.createDataFrame(rows, "id long, name string, dob string, sex string")

    def grams(s):
        return {f"  {w} "[i:i + 3] for w in "".join(c if c.isalnum() else " " for c in (s or "").lower()).split() for i in range(len(w) + 1)}

    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            x, y = grams(a[1]), grams(b[1])
            score = 0.2 * (len(x & y) / len(x | y) if x | y else 0) + sum(0.4 for p, q in zip(a[2:], b[2:]) if p is not None and p == q)
            if score >= 0.75:
                want[a[0], b[0]] = round(score, 6)
    got = {(r.rep_a, r.rep_b): round(r.score, 6) for r in dedup.fuzzy_duplicates(df, "id", "name", 0.2, {"dob": 0.4, "sex": 0.4}, 0.75).collect()}
    assert got == want and len(got) == 4


def test_statement_pages_read_back_as_one_statement(spark):
    lines = spark.range(25).selectExpr(
        "CASE WHEN id < 22 THEN 'S1-202401' ELSE 'S2-202402' END AS statement_id", "id AS o", "DATE'2024-01-05' AS value_date", "'D' AS indicator",
        "id + 0.5D AS amount", "concat('D', id) AS reconciliation_id", "concat('B', id) AS reference")
    pages = statements.compose(lines, ["o"], page_size=5)
    assert pages.groupBy("statement_id").count().orderBy("statement_id").collect() == [("S1-202401", 5), ("S2-202402", 1)]
    assert {(r.statement_id, r.sequence_number) for r in statements.headers(pages).collect()} == {
        ("S1-202401", str(i)) for i in range(1, 6)} | {("S2-202402", "1")}
    got = [(r.statement_id, r.entry_sequence, r.reconciliation_id) for r in statements.transactions(pages).orderBy("statement_id", "entry_sequence").collect()]
    assert got == [("S1-202401", i + 1, f"D{i}") for i in range(22)] + [("S2-202402", i - 21, f"D{i}") for i in range(22, 25)]
