"""Merged registries, programs by settings, refreshed views, mapped children, assigned payments, first-seen order."""

import os

import pytest
from pyspark.sql import functions as F

from benefica.operators import dedup, managers, records
from benefica.plans.ordering import first_seen
from benefica.scale import staging_path
from benefica.sources import views

PEOPLE = [(1, "ann", 10.0, True), (2, "bob", None, None), (3, "cid", 30.0, False)]
IDS = [(1, "N", "n1"), (2, "H", "h2"), (3, "N", "n3"), (3, "H", "h3")]
PULL = [
    (10, [("N", "n1"), ("H", "new-h")], "Ann", None),  # known; gets the household id
    (11, [("N", "x"), ("H", "h2")], "Bob", 5.0), (12, [("H", "h2")], None, 6.0),  # both are 2, the last value wins
    (13, [("N", "q1"), ("H", "q")], "Dee", 1.0), (14, [("N", "q2"), ("H", "q")], "Deb", None), (15, [("N", "q2")], None, None),  # one new person
    (16, [("N", "z")], "Eve", 2.0), (17, [], "No", 1.0), (18, [("", "n1"), ("N", "")], "No", 1.0), (19, [("H", "new-h")], None, 7.0),
]


def registry(spark, people=PEOPLE, ids=IDS, members=((100, 1, 7, "draft"), (101, 3, 8, "draft"))):
    return (spark.createDataFrame(people, "partner_id long, name string, income double, is_registrant boolean"),
            spark.createDataFrame(ids, "partner_id long, id_type string, value string"),
            spark.createDataFrame(list(members), "membership_id long, partner_id long, program_id int, state string"))


def pull(spark, rows=PULL):
    return spark.createDataFrame(rows, "record_id long, ids array<struct<id_type:string,value:string>>, name string, income double")


def test_a_pull_is_merged_and_the_second_one_changes_nothing(spark):
    merge = lambda parts, links=None: dedup.merge_registry(pull(spark), *parts, ["name", "income"], 7, "pull", links=links)
    once = merge(registry(spark))
    people = {r.partner_id: (r.name, r.income, r.is_registrant, r.data_source) for r in once["registrants"].collect()}
    assert people == {1: ("Ann", 7.0, True, "pull"), 2: ("Bob", 6.0, True, "pull"), 3: ("cid", 30.0, False, None),
                      4: ("Deb", 1.0, True, "pull"), 5: ("Eve", 2.0, True, "pull")}
    assert {(r.partner_id, r.id_type, r.value) for r in once["ids"].collect()} == {
        (1, "H", "new-h"), (2, "N", "x"), (4, "N", "q1"), (4, "H", "q"), (5, "N", "z")}
    assert [(r.membership_id, r.partner_id, r.program_id) for r in once["memberships"].orderBy("membership_id").collect()] == [(102, 2, 7), (103, 4, 7), (104, 5, 7)]
    assert {(r.partner_id, r.is_created, r.is_updated) for r in once["imported"].collect()} == {(1, False, True), (2, False, True), (4, True, False), (5, True, False)}
    assert {r.record_id: r.partner_id for r in once["links"].collect()} == {10: 1, 11: 2, 12: 2, 13: 4, 14: 4, 15: 4, 16: 5, 19: 1}
    after = ([(r.partner_id, r.name, r.income, r.is_registrant) for r in once["registrants"].collect()],
             [*IDS, *[(r.partner_id, r.id_type, r.value) for r in once["ids"].collect()]],
             [(100, 1, 7, "draft"), (101, 3, 8, "draft"), *[tuple(r) for r in once["memberships"].collect()]])
    links = spark.createDataFrame([tuple(r) for r in once["links"].collect()], "record_id long, partner_id long")
    again = merge(registry(spark, *after), links)
    assert sorted(tuple(r)[:4] for r in again["registrants"].collect()) == sorted(after[0])
    assert again["ids"].count() == again["memberships"].count() == again["imported"].where("is_created").count() == 0


def test_an_empty_pull_and_an_empty_registry(spark):
    empty = registry(spark, [], [], ())
    out = dedup.merge_registry(pull(spark, []), *registry(spark), ["name", "income"], 7, "pull")
    assert out["registrants"].count() == 3 and out["ids"].count() == out["memberships"].count() == 0
    out = dedup.merge_registry(pull(spark), *empty, ["name", "income"], 7, "pull", without_id=True)
    assert sorted(r.partner_id for r in out["registrants"].collect()) == list(range(1, 7))  # 10 with 19, 11 with 12, 13 to 15, and three alone
    assert sorted(r.membership_id for r in out["memberships"].collect()) == list(range(1, 7))  # 10 with 19, 11 with 12, 13 to 15, and three alone


def test_an_identifier_that_most_records_share(spark):
    rows = [(i, [("N", f"n{i}"), ("H", "hot")], f"p{i}", None) for i in range(300)] + [(300 + i, [("N", f"n{i}")], None, 1.0) for i in range(5)]
    out = dedup.merge_registry(pull(spark, rows), *registry(spark, PEOPLE, [], ()), ["name", "income"], 7, "pull")
    assert {r.partner_id for r in out["links"].collect()} == {4} and out["ids"].count() == 2
    assert out["registrants"].where("partner_id = 4").first().name == "p299"


def test_programs_use_the_managers_of_their_settings(spark):
    people = spark.createDataFrame([(1, False, True, None, 100.0, 5, ["N"], None, True, None, None, True), (2, True, True, None, None, None, None, ["N"], None, None, 4, None),
                                    (3, False, None, None, 9.0, 1, ["H"], ["H"], True, True, None, None)],
                                   "partner_id long, is_group boolean, is_registrant boolean, disabled date, income double, zone_id int, documents array<string>, "
                                   "shared_documents array<string>, has_phone boolean, shares_phone boolean, members long, has_account boolean")
    members = spark.createDataFrame([(10 * p + i, i, p) for p in (1, 2, 3) for i in (1, 2, 3)], "membership_id long, partner_id long, program_id int")
    rows = [(1, "eligibility", "default", {}), (1, "entitlement", "default", {"base": "5"}), (1, "payment", "account", {}), (1, "cycle", "days", {"days": "7"}),
            (2, "eligibility", "rich", {"least": "50"}), (2, "deduplication", "id", {"id_type": "N"}), (2, "entitlement", "share_of_income", {"share": "x", "least": "3"})]
    schema = "program_id int, role string, name string, options map<string,string>"
    own = {**managers.MANAGERS, "eligibility": {**managers.MANAGERS["eligibility"], "rich": lambda o: F.coalesce("income", F.lit(99.0)) > managers.number(o, "least", 0)}}
    start = F.lit("2002-01-01").cast("date")
    got = {r.membership_id: (r.new_state, r.amount, r.batch, str(r.cycle_end)) for r in managers.run_programs(members, people, spark.createDataFrame(rows, schema), start, own).collect()}
    assert got == {
        11: ("enrolled", 5.0, "account/EUR", "2002-01-07"), 12: ("not_eligible", None, None, "2002-01-07"), 13: ("not_eligible", None, None, "2002-01-07"),
        21: ("enrolled", 3.0, None, "None"), 22: ("duplicated", None, None, "None"), 23: ("not_eligible", None, None, "None"),
        31: ("enrolled", None, None, "None"), 32: ("enrolled", None, None, "None"), 33: ("enrolled", None, None, "None")}
    with pytest.raises(ValueError, match="no eligibility manager rich"):
        managers.run_programs(members, people, spark.createDataFrame(rows, schema), start)


def test_a_refresh_writes_changed_partitions_only(spark):
    name, path = "view_of_test", staging_path(spark, "view")
    rows = spark.createDataFrame([("a'b", 1), ("c", 2), ("d", 3)], "part string, n int")
    views.create_view(rows, name, "part", path)
    files = lambda: {f for d, _, names in os.walk(path) for f in (os.path.join(d, x) for x in names) if f.endswith(".parquet")}
    before = files()
    after = spark.createDataFrame([("c", 20), ("c", 21), ("d", 99)], "part string, n int")
    got = sorted(tuple(r) for r in views.refresh_view(after, name, "part", ["a'b", "c"]).select("part", "n").collect())
    assert got == [("c", 20), ("c", 21), ("d", 3)]
    kept = before & files()
    assert {f for f in kept if "part=d" in f} and not {f for f in kept if "part=c" in f}
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert mode.lower() == "static"
    views.drop_view(spark, name)
    assert not spark.catalog.tableExists(name)
    views.drop_view(spark, name)


def test_children_are_mapped_under_their_own_conditions(spark):
    df = spark.createDataFrame([(1, True, [(7, "x", ["k"]), (8, "y", ["z"]), (9, None, None)]), (2, False, [(7, "x", ["k"])]), (3, True, []), (4, True, None)],
                               "id int, new boolean, kids array<struct<n:int,k:string,changed:array<string>>>")
    col = records.map_children("kids", [("n", "number"), (lambda c: F.upper(c["k"]), "kind"), (lambda c: c["n"] * 2, "born")], only_create=["born"], changed_by={"kind": ["k"]},
                               for_create=F.col("new"), changed_fields="changed", keep=lambda c: c["n"] != 8)
    got = {r.id: None if r.c is None else [tuple(x) for x in r.c] for r in df.select("id", col.alias("c")).collect()}
    assert got == {1: [(7, "X", 14), (9, None, 18)], 2: [(7, "X", None)], 3: [], 4: None}


def test_payments_are_assigned_or_refused(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, None)], "id int, batch_id string")
    got = {r.id: (r.batch_id, r.is_added) for r in records.assign_to_batch(df, "new").collect()}
    assert got == {1: ("new", True), 2: ("b", False), 3: ("new", True)}
    with pytest.raises(ValueError, match="in a batch already"):
        records.assign_to_batch(df.where("batch_id IS NOT NULL"), "new")
    with pytest.raises(ValueError, match="no payments"):
        records.assign_to_batch(df.where("false"), "new")


def test_values_keep_the_order_in_which_they_were_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (2, None, 1), (2, "a", 2), (1, None, 9)], "k int, v string, at int")
    got = sorted(tuple(r) for r in first_seen(df, ["k"], "v", ["at"]).collect())
    assert got == [(1, 1, "b"), (1, 2, "a"), (1, 3, None), (2, 1, None), (2, 2, "a")]


def test_a_pull_sends_no_side_of_a_join_whole_to_every_executor(spark):
    out = dedup.merge_registry(pull(spark), *registry(spark), ["name", "income"], 7, "pull")
    for part in ("registrants", "ids"):
        assert "BroadcastHashJoin" not in out[part]._jdf.queryExecution().executedPlan().toString()
    matched = dedup.match_incoming(pull(spark), registry(spark)[1])
    assert "BroadcastHashJoin" not in matched._jdf.queryExecution().executedPlan().toString()
