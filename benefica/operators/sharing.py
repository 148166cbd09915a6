"""How many other owners share a value with an owner, without joining owners to owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefica.scale import join_groups, stage


def other_owners(pairs: DataFrame, owner: str, value: str, strict: bool = True) -> DataFrame:
    """(owner, shared_count) for every owner that shares at least one value.

    Values with one owner are dropped.  An owner's most widely shared value counts by the size of its group alone.
    What the other values add is found on bitmaps: owners get dense numbers, a value's owners are words of 64 of them,
    the words of an owner's other values are joined by OR, and the bits that its first value does not have are counted.
    Owners with the same values are asked for once.  So a value that very many owners share costs its owners one
    row each, however many other values they have.  ``strict`` takes one off the count, as the scoring features expect.
    """
    own = pairs.select(F.col(owner).alias("_o"), F.col(value).alias("_v")).where("_o IS NOT NULL AND _v IS NOT NULL").distinct()
    several = own.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    own = stage(join_groups(own, several, ["_v"]), "shared")
    facts = own.groupBy("_o").agg(
        F.count(F.lit(1)).alias("_k"), F.max(F.struct("_n", "_v")).alias("_first"),
        # Two hashes stand for the set of values; they are only used to ask once for equal sets.
        F.bit_xor(F.xxhash64("_v")).alias("_x"), F.sum(F.xxhash64("_v", F.lit(1)).cast("decimal(38,0)")).alias("_y"))
    facts = facts.select("_o", "_k", F.col("_first._n").alias("_n1"), F.col("_first._v").alias("_v1"), "_x", "_y")
    # Numbers are dense in each range partition, so owners of one first value share words.
    facts = stage(facts.repartitionByRange("_v1", "_o").sortWithinPartitions("_v1", "_o").withColumn("_i", F.monotonically_increasing_id()), "owners")

    same = ["_v1", "_k", "_x", "_y"]
    asked = stage(facts.where("_k > 1").groupBy(*same).agg(F.min("_o").alias("_o")), "sets")
    theirs = own.select("_o", "_v").join(asked, "_o")  # one row per value of a set
    words = own.select("_o", "_v").join(theirs.select("_v").distinct(), "_v", "left_semi").join(facts.select("_o", "_i"), "_o").groupBy(
        "_v", F.shiftright("_i", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_i") % 64).cast("int"))).alias("_bits"))
    words = stage(words, "words")
    others = theirs.where("_v <> _v1").join(words, "_v").groupBy("_o", "_v1", "_word").agg(F.bit_or("_bits").alias("_u"))
    first = words.withColumnsRenamed({"_v": "_v1", "_bits": "_f"})
    new = F.bit_count(F.col("_u").bitwiseOR(F.coalesce("_f", F.lit(0)))) - F.bit_count(F.coalesce("_f", F.lit(0).cast("long")))
    added = others.join(first, ["_v1", "_word"], "left").groupBy("_o").agg(F.sum(new).alias("_more"))
    added = stage(asked.join(added, "_o").select(*same, "_more"), "added")
    n = F.col("_n1") - 1 + F.coalesce("_more", F.lit(0)) - (1 if strict else 0)
    return facts.join(added, same, "left").select(F.col("_o").alias(owner), n.cast("long").alias("shared_count"))
