"""Pairs of similar texts: an exact prefix join on trigrams for names, MinHash bands for long texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefica.functions.text import similarity, trigrams
from benefica.scale import dealt, join_groups, stage

LIST = 4096  # texts of one block of a trigram's list
BANDS, ROWS = 30, 5  # a pair at 0.8 shares one of the bands with probability 0.99999, one at 0.5 with 0.61


def numbered(texts: DataFrame, name: str) -> DataFrame:
    """Distinct texts that are not NULL with a number each, staged: (id, text)."""
    distinct = texts.select(F.col(name).alias("text")).where("text IS NOT NULL").distinct()
    return stage(distinct.withColumn("id", F.monotonically_increasing_id()), "numbered")


def similar_texts(texts: DataFrame, name: str, least: float) -> DataFrame:
    """(text_a, text_b, similarity) in both directions, each text with itself included; no pair is left out.

    Trigrams are ordered from rare to frequent.  Two texts that similar share one of their first
    size - ceil(least x size) + 1 trigrams, their sizes differ by the factor ``least`` at most, and behind the first trigram
    that they share both must have enough trigrams left (:func:`candidate_pairs`).  Only ids meet; trigrams join the pairs that are left.
    """
    all_ = numbered(texts, name)
    grams = stage(all_.select("id", trigrams(F.col("text")).alias("grams")), "grams")
    met = candidate_pairs(grams, least)
    near = met.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("_ga")), "a").join(
        grams.select(F.col("id").alias("b"), F.col("grams").alias("_gb")), "b").select("a", "b", similarity(F.col("_ga"), F.col("_gb")).alias("similarity"))
    near = stage(near.where(F.col("similarity") >= least - 1e-12), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    out = both.join(all_.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        all_.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    same = all_.select(F.col("text").alias("text_a"), F.col("text").alias("text_b"), F.lit(1.0).alias("similarity"))
    return out.select("text_a", "text_b", "similarity").unionByName(same)


def candidate_pairs(grams: DataFrame, least: float) -> DataFrame:
    """Distinct pairs a < b of ids of (id, grams) that the three filters leave.

    The key of the join is a trigram, a class of sizes and a block: the list of a frequent trigram is cut into blocks of
    about ``LIST`` texts, which are met by all others of the list, so no trigram is one task, however many texts have it.
    """
    exploded = grams.select("id", F.explode("grams").alias("gram"), F.size("grams").alias("size"))
    frequency = exploded.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = join_groups(exploded, frequency, ["gram"]).groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("rare"))
    keep = F.greatest(F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1, F.lit(1)).cast("int")
    # Sizes in one class or in neighbouring ones are all that the factor allows.
    width = -math.log(min(least, 0.99))
    index = ranked.select("id", "size", F.posexplode(F.slice("rare", 1, keep)).alias("place", "g")).select(
        "id", "size", "place", "g.gram", F.floor(F.log("size") / width + 1e-9).cast("int").alias("class"))
    lists = index.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("blocks"))
    index = stage(join_groups(index, lists, ["gram"]), "index")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    a = index.select(F.col("id").alias("a"), F.col("size").alias("sa"), F.col("place").alias("pa"), "gram", "class", own.alias("block"))
    asked = index.select(F.col("id").alias("b"), F.col("size").alias("sb"), F.col("place").alias("pb"), "gram",
                         F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), "blocks")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    needed = F.ceil((F.col("sa") + F.col("sb")) * (least / (1 + least)) - 1e-9)
    left = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    met = a.join(asked, ["gram", "class", "block"]).where(
        (F.col("a") < F.col("b")) & (F.least("sa", "sb") >= F.greatest("sa", "sb") * least - 1e-9) & (left >= needed))
    return met.select("a", "b").distinct()


# --- long texts -----------------------------------------------------------------------------------------------

def run_sets(texts: DataFrame, key: str, name: str, size: int) -> DataFrame:
    """(key, hashes, digest): sorted hashes of the distinct runs of ``size`` lower-case words and their SHA-256; a shorter text is one run, one without words is left out."""

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").lower().encode("utf-8", "surrogatepass").split()
                if words:
                    runs = {xxhash.xxh64_intdigest(b" ".join(words[k:k + size])) for k in range(max(1, len(words) - size + 1))}
                    keep.append(i)
                    out.append(np.sort(np.fromiter(runs, np.uint64, len(runs)).view(np.int64)))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(pa.array(keep, pa.int64())), "hashes": pa.array(out, pa.list_(pa.int64())),
                                              "digest": pa.array([hashlib.sha256(h.tobytes()).digest() for h in out], pa.binary())})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("key"), F.col(name).alias("text")).mapInArrow(hash_runs, f"key {kind}, hashes array<long>, digest binary")


def minhash_bands(sets: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """(key, digest, bands): for each set (key, hashes, digest) and band one hash of its smallest hashes under ``rows`` permutations."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_, out = batch.column("hashes"), []
            for i in range(len(sets_)):
                h = sets_[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                least = np.full(bands * rows, np.iinfo(np.uint64).max)
                for lo in range(0, len(h), 4096):  # bounded, however long the text
                    x = h[lo:lo + 4096, None] * a + b
                    x ^= x >> np.uint64(32)
                    least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
                key = np.zeros(bands, np.uint64)
                for r in least.reshape(bands, rows).T:
                    key = (key ^ r) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key ^= key >> np.uint64(29)
                out.append(key.view(np.int64))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "digest": batch.column("digest"), "bands": pa.array(out, pa.list_(pa.int64()))})

    return sets.select("key", "hashes", "digest").mapInArrow(sketch, f"key {sets.schema['key'].dataType.simpleString()}, digest binary, bands array<long>")


def similar_long_texts(texts: DataFrame, key: str, name: str, least: float = 0.8, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Pairs of near-equal long texts and what each row is a copy of: (a, b, similarity) and (key, id).

    Rows with the same set of word runs are one class, named by its smallest key; pairs are pairs of classes.  Bands only propose pairs, the exact
    share of common runs decides.  Bands miss a pair at 0.8 about once in 10^5; rows without words are in no pair.
    """
    sets = stage(run_sets(texts, key, name, size), "sets")
    # Sets are known by their digests; the hashes themselves are only moved to compare those that bands propose.
    classes = stage(minhash_bands(sets, bands, rows).groupBy("digest").agg(F.min("key").alias("id"), F.any_value("bands").alias("bands")), "classes")
    members = sets.select("key", "digest").join(dealt(classes.select("digest", "id")), "digest").select("key", "id")
    keys = stage(classes.select("id", F.posexplode("bands").alias("band", "key")), "bands")
    lists = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / LIST).cast("int")).drop("n")
    index = stage(join_groups(keys, lists, ["band", "key"]), "index")
    a = index.select(F.col("id").alias("a"), "band", "key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    b = index.select(F.col("id").alias("b"), "band", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = a.join(b, ["band", "key", "block"]).where("a < b").select("a", "b").distinct()
    met = stage(met, "met")
    named = met.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(dealt(classes.select("id", "digest")), "id")
    # One row per class that is in a pair: equal rows of the table would repeat it.
    held = stage(sets.join(named, (F.col("key") == F.col("id")) & (sets["digest"] == named["digest"]), "left_semi").dropDuplicates(["key", "digest"]).select("key", "hashes"), "held")
    near = met.join(held.select(F.col("key").alias("a"), F.col("hashes").alias("_ha")), "a").join(
        held.select(F.col("key").alias("b"), F.col("hashes").alias("_hb")), "b").select("a", "b", similarity(F.col("_ha"), F.col("_hb")).alias("similarity"))
    return near.where(F.col("similarity") >= least - 1e-12), members
