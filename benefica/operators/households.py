"""Groups and their members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.operators.domain import domain_filter


def live_members(registrant: DataFrame, membership: DataFrame, kinds: Sequence[str] = (),
                 member_domain: Sequence = ()) -> DataFrame:
    """(group_id, individual_id, kind): enabled members of enabled groups whose membership has not ended."""
    groups = registrant.where("is_registrant AND is_group AND disabled IS NULL").select(
        F.col("partner_id").alias("group_id"))
    people = registrant.where("disabled IS NULL")
    if member_domain:
        people = domain_filter(people, list(member_domain))
    people = people.select(F.col("partner_id").alias("individual_id"))
    m = membership.where("ended_date IS NULL")
    if kinds:
        m = m.where(F.col("kind").isin(list(kinds)))
    return m.join(people, "individual_id", "left_semi").join(groups, "group_id", "left_semi").select(
        "group_id", "individual_id", "kind")


def member_counts(registrant: DataFrame, membership: DataFrame, kinds: Sequence[str] = (),
                  member_domain: Sequence = ()) -> DataFrame:
    """Groups without a counted member do not appear."""
    return live_members(registrant, membership, kinds, member_domain).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"))


def indicator(groups: DataFrame, registrant: DataFrame, membership: DataFrame, name: str, kinds: Sequence[str] = (),
              member_domain: Sequence = (), presence_only: bool = False) -> DataFrame:
    """Count (or presence) of the matching members for every given group, 0 (false) when there is none."""
    counts = member_counts(registrant, membership, kinds, member_domain)
    n = F.coalesce("members", F.lit(0))
    value: Column = n > 0 if presence_only else n
    return groups.join(counts, "group_id", "left").select("group_id", value.alias(name))


def heads(membership: DataFrame, head_kind: str = "head") -> DataFrame:
    """(group_id, head_id): the first member with the head role."""
    return membership.where(F.col("kind") == head_kind).groupBy("group_id").agg(
        F.min("individual_id").alias("head_id"))


def payee_of(registrants: DataFrame, membership: DataFrame) -> DataFrame:
    """Individuals stand for themselves, groups for their head (NULL when there is none)."""
    h = heads(membership).withColumnRenamed("group_id", "partner_id")
    return registrants.join(h, "partner_id", "left").withColumn(
        "payee_id", F.when(F.col("is_group"), F.col("head_id")).otherwise(F.col("partner_id"))).drop("head_id")
