"""Exact duplicates with two Bloom passes, in DataFrame functions only.

Pass one counts the filter positions that the hashes of all texts set and keeps, as bitmaps, those set at least
twice.  Pass two looks every row up in them: a row with a position that was set once has no copy and passes straight
through; only the others are shuffled.  No repeated hash is missed, and a false alarm only costs the shuffle of its
row, so results are exact for every filter size.

The filter has a fixed size, ``filter_bits`` / 8 bytes at most, which is why it may be broadcast.  At the default 16 MB
it spares most rows the shuffle up to about 50 million distinct texts; give it a larger size for larger corpora (8 bits
a text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import stage

BLOCK = 32768  # bits of one bitmap
FILTER_BITS = 1 << 27


def normal_text(text: str | Column) -> Column:
    """Runs of space and U+0009 to U+000D become one space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_key(text: str | Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(normal_text(text).cast("binary"), 256))


def _positions(key: str, filter_bits: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(key), F.lit(max(1, filter_bits // BLOCK)).cast("long")).cast("int")
    first, second = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    return block, [F.pmod(h, F.lit(BLOCK).cast("long")).cast("int") for h in (first, second)]


def repeated_positions(keys: DataFrame, key: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The filter of pass one: (_block, _bits), a bitmap of the positions set at least twice."""
    block, bits = _positions(key, filter_bits)
    twice = (
        keys.select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit"))
        .groupBy("_block", "_bit").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    return stage(twice.repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "filter")


def maybe_repeated(rows: DataFrame, key: str, positions: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Add ``_maybe``: whether all positions of the key were set at least twice."""
    block, bits = _positions(key, filter_bits)

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)))) != 0

    seen = F.col("_bits").isNotNull() & is_set(bits[0]) & is_set(bits[1])
    return (
        rows.withColumn("_block", block).join(F.broadcast(positions), "_block", "left")
        .withColumn("_maybe", F.coalesce(seen, F.lit(False))).drop("_block", "_bits")
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays.  A null text counts as empty; a null id comes after every other
    id; of rows that repeat both id and text exactly one stays.  An empty table gives no rows; other columns are
    not read.
    """
    keyed = stage(docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"))
                  .withColumn("_row", F.monotonically_increasing_id()), "keys")
    probed = maybe_repeated(keyed, "_key", repeated_positions(keyed, "_key", filter_bits), filter_bits)
    # The aggregate is staged, so both sides of the join below are plain shuffles and a hot text can be split.
    groups = stage(
        probed.where("_maybe").groupBy("_key").agg(
            F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_first"),
            F.count(F.lit(1)).alias("group_size")), "groups")
    alone = probed.where("NOT _maybe").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "_key")
    shared = probed.where("_maybe").join(groups, "_key").select(
        F.col("_id").alias(id_col), F.col("_first.id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_first.row")).alias("kept"), "_key")
    return alone.unionByName(shared).withColumn("text_sha256", F.lower(F.hex("_key"))).drop("_key")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one row per normalised text: the one with the smallest id.

    Rows without a copy are not shuffled.  Null ids and ties as in :func:`mark_duplicates`; among rows that share id and
    text any one may stay.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(id_col).alias("_id"), text_key(text_col).alias("_key"))
    probed = maybe_repeated(keyed, "_key", repeated_positions(keyed.select("_key"), "_key", filter_bits), filter_bits)
    alone = probed.where("NOT _maybe").select("_doc")
    first = probed.where("_maybe").groupBy("_key").agg(
        F.min_by("_doc", F.struct(F.col("_id").isNull(), F.col("_id"))).alias("_doc")).select("_doc")
    return alone.unionByName(first).select("_doc.*")
