"""Duplicate registrants and households, survivors, fuzzy matches, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.functions.text import similarity, trigrams
from benefica.operators.near_texts import similar_texts
from benefica.scale import dealt, join_groups, running, stage


def valid_documents(reg_id: DataFrame, as_of: Column, id_types: Sequence[str]) -> DataFrame:
    return reg_id.where(F.col("id_type").isin(list(id_types)) & F.col("value").isNotNull()
                        & (F.col("expiry_date").isNull() | (F.col("expiry_date") > as_of)))


def repeated(rows: DataFrame, keys: Sequence[str], owner: str = "partner_id") -> DataFrame:
    """Owners of a key value that stands in more than one row.

    Rows are counted, not owners: two equal rows of one owner count as a duplicate.
    """
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return join_groups(rows, twice, keys, "left_semi").select(owner).distinct()


def mark_members(membership: DataFrame, duplicated: DataFrame) -> DataFrame:
    """Memberships of duplicated registrants; the enrolled ones become duplicated."""
    return membership.join(duplicated, "partner_id", "left_semi").withColumn(
        "new_state", F.when(F.col("state") == "enrolled", "duplicated").otherwise(F.col("state")))


def duplicates_by_document(membership: DataFrame, reg_id: DataFrame, as_of: Column, id_types: Sequence[str]) -> DataFrame:
    """Program members who share a valid id document with another member."""
    docs = valid_documents(reg_id, as_of, id_types).join(membership.select("partner_id"), "partner_id", "left_semi")
    return mark_members(membership, repeated(docs, ["id_type", "value"]))


def duplicates_by_phone(membership: DataFrame, phone_number: DataFrame) -> DataFrame:
    """Program members who share a sanitized number with another member."""
    numbers = phone_number.where("disabled IS NULL AND phone_sanitized IS NOT NULL").join(
        membership.select("partner_id"), "partner_id", "left_semi")
    return mark_members(membership, repeated(numbers, ["phone_sanitized"]))


def households_by_member(groups: DataFrame, group_membership: DataFrame) -> DataFrame:
    """(individual_id, group_id) for individuals who sit in several of the given groups."""
    inside = group_membership.join(groups.select("group_id"), "group_id", "left_semi").select("individual_id", "group_id")
    several = inside.groupBy("individual_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("individual_id")
    return join_groups(inside, several, ["individual_id"], "left_semi")


def households_by_attribute(groups: DataFrame, group_membership: DataFrame, attribute: DataFrame,
                            keys: Sequence[str]) -> DataFrame:
    """(individual_id, group_id) for members who share an attribute with another member or group of the program."""
    inside = group_membership.join(groups.select("group_id"), "group_id", "left_semi").select("individual_id", "group_id")
    owners = inside.select(F.col("individual_id").alias("partner_id")).union(
        groups.select(F.col("group_id").alias("partner_id"))).distinct()
    found = repeated(attribute.join(owners, "partner_id", "left_semi"), keys)
    return inside.join(found, F.col("individual_id") == F.col("partner_id"), "left_semi")


def survivors(beneficiaries: DataFrame, duplicate_pairs: DataFrame) -> DataFrame:
    """New state of every beneficiary in a duplicate set.

    A set (one ``individual_id``) with exactly one enrolled household keeps that
    one; all others turn duplicated unless they exited or are not eligible.  A
    household in several sets is marked when any set marks it.
    """
    pairs = duplicate_pairs.distinct().join(
        beneficiaries.select("membership_id", F.col("partner_id").alias("group_id"), "state"), "group_id")
    enrolled = pairs.groupBy("individual_id").agg(F.count_if(F.col("state") == "enrolled").alias("_enrolled"))
    spared = (F.col("_enrolled") == 1) & (F.col("state") == "enrolled")
    marks = ~spared & ~F.col("state").isin("exited", "not_eligible", "duplicated")
    return join_groups(pairs, enrolled, ["individual_id"]).groupBy("membership_id", "state").agg(
        F.bool_or(marks).alias("_mark")).select("membership_id", "state", F.when(
            F.col("_mark"), "duplicated").otherwise(F.col("state")).alias("new_state"))


def registry_flags(registrant: DataFrame, reg_id: DataFrame, group_membership: DataFrame,
                   individual_types: Sequence[str], group_types: Sequence[str]) -> DataFrame:
    """is_duplicated for the whole registry: individuals and groups by document, and groups of duplicate members."""
    def owners(is_group: bool, types: Sequence[str]) -> DataFrame:
        own = registrant.where(F.col("is_group") == is_group).select("partner_id")
        docs = reg_id.where(F.col("id_type").isin(list(types))).join(own, "partner_id", "left_semi")
        return repeated(docs, ["id_type", "value"])

    people = owners(False, individual_types)
    via_members = group_membership.join(people, F.col("individual_id") == F.col("partner_id"), "left_semi").select(
        F.col("group_id").alias("partner_id"))
    marked = people.union(owners(True, group_types)).union(via_members).distinct().withColumn("_dup", F.lit(True))
    return registrant.join(marked, "partner_id", "left").select(
        "partner_id", "is_group", F.coalesce("_dup", F.lit(False)).alias("is_duplicated"))


def new_duplicate_records(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found (manager, reason, member) rows whose set has no open record yet.

    A set is recorded already when one of its members is in an open record of
    the same manager and reason.
    """
    open_ = stored.where("state = 'duplicate'").select("manager", "reason", "member")
    known = found.join(open_, ["manager", "reason", "member"], "left_semi").select("manager", "reason", "set_id").distinct()
    return found.join(known, ["manager", "reason", "set_id"], "left_anti")


# --- fuzzy matches --------------------------------------------------------------------------------------------

def fuzzy_duplicates(df: DataFrame, key: str, text_field: str, text_weight: float, exact: dict[str, float],
                     threshold: float) -> DataFrame:
    """(rep_a, rep_b, score, records) for pairs of distinct field tuples that score at least the threshold.

    Score = text_weight x trigram similarity + the weights of equal exact fields.
    Equal tuples are merged first (a tuple meeting itself is a full match and
    shows as its number of records), so repeated values never multiply.  Texts
    are compared once per distinct text; a pair whose equal fields are E needs a
    similarity of (threshold - weight of E) / text_weight, so tuples are joined
    on (near text, E) for every E that can qualify.  Where E alone reaches the
    threshold, tuples are joined on E, whatever their texts: no pair is left out.
    """
    subsets = [c for size in range(len(exact) + 1) for c in combinations(exact, size)]
    least = {c: (threshold - sum(exact[f] for f in c)) / text_weight for c in subsets}
    least = {c: s for c, s in least.items() if s <= 1 + 1e-12}
    if not least:
        raise ValueError("the weights cannot reach the threshold")
    if () in least and least[()] <= 0:
        raise ValueError("every pair reaches the threshold")
    tuples = df.groupBy(text_field, *exact).agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("records"))
    by_text = [s for s in least.values() if s > 1e-12]
    texts = stage(similar_texts(tuples.select(text_field).where(F.col(text_field).isNotNull()).distinct(), text_field,
                                min(by_text)), "texts") if by_text else None
    side = lambda p: tuples.select(*[F.col(c).alias(f"{p}_{c}") for c in ("rep", "records", text_field, *exact)])
    found = None
    for chosen, s in least.items():
        on = F.col("a_rep") < F.col("b_rep")
        for c in chosen:
            on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
        score = text_weight * F.col("similarity")
        for c, w in exact.items():
            score = score + F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), w).otherwise(0.0)
        if s > 1e-12:
            near = texts.where(F.col("similarity") >= s - 1e-12)
            met = side("a").join(near, F.col(f"a_{text_field}") == F.col("text_a")).join(
                side("b"), on & (F.col("text_b") == F.col(f"b_{text_field}")))
        else:
            grams = [trigrams(F.col(f"{p}_{text_field}")) for p in "ab"]
            met = side("a").join(side("b"), on).withColumn("similarity", F.coalesce(similarity(*grams), F.lit(0.0)))
        pairs = met.select(
            F.col("a_rep").alias("rep_a"), F.col("b_rep").alias("rep_b"), score.alias("score"),
            (F.col("a_records") + F.col("b_records")).alias("records"))
        # A pair is reported once, by the largest field set it agrees on.
        for c in exact:
            if c not in chosen:
                pairs = pairs.where(~F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False)))
        found = pairs if found is None else found.unionByName(pairs)
    return found.where(F.col("score") >= threshold - 1e-12)


# --- upsert by identifier -------------------------------------------------------------------------------------

def match_incoming(incoming: DataFrame, reg_id: DataFrame) -> DataFrame:
    """(record_id, partner_id): the registrant of the first listed identifier that is known, NULL for new records.

    ``incoming`` holds record_id and ids, an array of (id_type, value).
    """
    listed = incoming.select("record_id", F.posexplode("ids").alias("place", "i")).select(
        "record_id", "place", "i.id_type", "i.value").where("id_type <> '' AND value <> ''")
    known = reg_id.groupBy("id_type", "value").agg(F.min("partner_id").alias("partner_id"))
    hit = listed.join(dealt(known), ["id_type", "value"]).groupBy("record_id").agg(
        F.min_by("partner_id", "place").alias("partner_id"))
    return incoming.select("record_id").join(dealt(hit), "record_id", "left")


def upsert(incoming: DataFrame, reg_id: DataFrame) -> dict[str, DataFrame]:
    """Create and update flags per record, and the identifiers that must be added."""
    matched = match_incoming(incoming, reg_id)
    records = matched.select("record_id", "partner_id", F.col("partner_id").isNull().alias("is_created"),
                             F.col("partner_id").isNotNull().alias("is_updated"))
    listed = incoming.join(dealt(matched), "record_id").select("record_id", "partner_id", F.inline("ids")).where(
        "id_type <> '' AND value <> ''")
    have = reg_id.select("partner_id", "id_type").distinct()
    missing = listed.join(dealt(have), ["partner_id", "id_type"], "left_anti")
    return {"records": records, "ids": missing}


def record_groups(listed: DataFrame) -> DataFrame:
    """(record_id, leader): records that share identifiers (record_id, id_type, value), directly or through others.

    Each round gives every record the smallest leader of its identifiers, then every leader the smallest one that its
    records have seen; an identifier that very many records share is one group with a minimum.
    """
    now = stage(listed.select("record_id", F.col("record_id").alias("leader")).distinct(), "leaders")
    ids = stage(listed.select("record_id", "id_type", "value").distinct(), "identifiers")
    while True:
        least = ids.join(dealt(now), "record_id").groupBy("id_type", "value").agg(F.min("leader").alias("_m"))
        seen = join_groups(ids, least, ["id_type", "value"]).groupBy("record_id").agg(F.min("_m").alias("_m"))
        step = stage(now.join(dealt(seen), "record_id").select("record_id", "leader", F.least("leader", "_m").alias("_m")), "step")
        up = step.groupBy("leader").agg(F.min("_m").alias("_up"))
        after = stage(join_groups(step, up, ["leader"]).select("record_id", F.col("_up").alias("leader"), (F.col("_up") < F.col("leader")).alias("_moved")), "leaders")
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return now


def merge_registry(incoming: DataFrame, registrant: DataFrame, reg_id: DataFrame, membership: DataFrame, fields: Sequence[str],
                   program_id: int, source: str, without_id: bool = False, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """A pulled batch of records merged into the registry: registrants, ids, memberships, what happened to whom, and links.

    ``incoming`` holds record_id, ids (an array of (id_type, value)) and ``fields``.  A record that an earlier pull has linked
    (``links``: record_id, partner_id) stays with its registrant; others belong to the registrant of their first known identifier; records without one that share an identifier with others of the batch belong where the
    first of those belongs, and the rest become new registrants, numbered without gaps behind the largest partner_id in
    the order of record_id.  Of a registrant's records the last one that has a value gives a field; empty ones leave it as
    it is.  An identifier type that a registrant lacks is added from its first record, and a membership of ``program_id``
    where there is none.  Records without identifiers are left out unless ``without_id``.  The same batch again changes nothing
    but for those.
    """
    listed = incoming.select("record_id", F.posexplode("ids").alias("place", "i")).select(
        "record_id", "place", "i.id_type", "i.value").where("id_type <> '' AND value <> ''")
    listed = stage(listed, "listed")
    if not without_id:
        incoming = incoming.join(dealt(listed.select("record_id").distinct()), "record_id", "left_semi")
    matched = match_incoming(incoming, reg_id)
    if links is not None:
        before = links.select("record_id", F.col("partner_id").alias("_linked"))
        matched = matched.join(dealt(before), "record_id", "left").select("record_id", F.coalesce("_linked", "partner_id").alias("partner_id"))
    matched = stage(matched, "matched")
    groups = record_groups(listed)
    known = groups.join(dealt(matched), "record_id").where("partner_id IS NOT NULL").groupBy("leader").agg(F.min_by("partner_id", "record_id").alias("_known"))
    placed = matched.join(dealt(groups), "record_id", "left").withColumn("leader", F.coalesce("leader", "record_id"))
    placed = stage(placed.join(dealt(known), "leader", "left").select("record_id", "leader", F.coalesce("partner_id", "_known").alias("partner_id")), "placed")
    base = registrant.agg(F.coalesce(F.max("partner_id"), F.lit(0)).cast("long").alias("m")).first().m
    fresh = running(placed.where("partner_id IS NULL").groupBy("leader").agg(F.lit(1).alias("_one")), [], [F.col("leader")], position="_p")
    fresh = stage(fresh.select("leader", (F.col("_p") + base).alias("_new")), "new_ids")
    owner = stage(placed.join(dealt(fresh), "leader", "left").select(
        "record_id", F.coalesce("partner_id", "_new").alias("partner_id"), F.col("partner_id").isNull().alias("is_created")), "owners")

    given = incoming.select("record_id", *fields).join(dealt(owner), "record_id")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("record_id"))).alias(f"_n_{f}") for f in fields]
    given = given.groupBy("partner_id").agg(F.bool_or("is_created").alias("is_created"), *last)
    given = stage(given, "given")
    rest = [c for c in registrant.columns if c not in ("partner_id", "is_registrant", *fields)]
    merged = registrant.join(given, "partner_id", "full").select(
        "partner_id", *[F.coalesce(f"_n_{f}", f).alias(f) for f in fields],
        F.when(F.col("is_created").isNotNull(), True).otherwise(F.col("is_registrant")).alias("is_registrant"), *rest,
        F.when(F.col("is_created").isNotNull(), F.lit(source)).alias("data_source"))

    missing = listed.join(dealt(owner), "record_id").join(dealt(reg_id.select("partner_id", "id_type").distinct()), ["partner_id", "id_type"], "left_anti")
    added = missing.groupBy("partner_id", "id_type").agg(F.min_by("value", F.struct("record_id", "place")).alias("value"))
    have = membership.where(F.col("program_id") == program_id).select("partner_id")
    joined = running(given.select("partner_id").join(dealt(have), "partner_id", "left_anti"), [], [F.col("partner_id")], position="_p")
    top = membership.agg(F.coalesce(F.max("membership_id"), F.lit(0)).cast("long").alias("m")).first().m
    joined = joined.select((F.col("_p") + top).alias("membership_id"), "partner_id", F.lit(program_id).alias("program_id"), F.lit("draft").alias("state"))
    imported = given.select("partner_id", "is_created", (~F.col("is_created")).alias("is_updated"))
    return {"registrants": merged, "ids": added, "memberships": joined, "imported": imported, "links": owner.select("record_id", "partner_id")}
