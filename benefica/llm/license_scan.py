"""Licences of files: sparse TF-IDF cosine of notices to templates, inherited from the nearest directory above.

Every line of a text is compared with every template, in DataFrame functions only.  The weights of the templates' words
come from their document frequencies over the whole corpus; words that no template has weigh as much as the rarest.  A
line can only reach the threshold for a template if the words it shares carry enough of the template's weight, so all
other lines are dropped where they stand, before anything is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import stage

# Names and notices of licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "LGPL-3.0-only": "licensed under the GNU Lesser General Public License, version 3",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.75
FILE_WORDS = 60  # a text of at most so many words that is a notice as a whole speaks for its directory
TOKEN = "[^a-z0-9]+"


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(TOKEN, text.lower()) if t]


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), TOKEN), lambda t: t != "")


def _frequencies(texts: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Texts, and texts that hold each word of the vocabulary, over the whole corpus."""
    held = F.array_intersect(F.split(F.lower("text"), TOKEN), F.array(*[F.lit(w) for w in vocabulary]))
    rows = texts.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return texts.count(), {r["w"]: r["n"] for r in rows}


def scan(files: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: id, path, own_license, own_cosine, license, origin ("own", "inherited" or "none"), from_dir.

    The licence of a file is the one of its best line or, failing that, of the nearest directory at or above it that holds
    a licence file: a file of at most ``FILE_WORDS`` words with a licence of its own.  Of equal cosines the licence first
    in the list counts, and for a directory the last one in the alphabet.  Null texts have no licence of their own; a null path inherits none; an empty table gives no rows;
    other columns are not read.
    """
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("id", "path", "text"))
    parts = {name: tokens_of(text) for name, text in templates.items()}
    vocabulary = sorted({t for ts in parts.values() for t in ts})
    total, df = _frequencies(base, vocabulary)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    rare = math.log(1 + total) + 1
    vectors = {}
    for name, ts in parts.items():
        v = {t: ts.count(t) * idf[t] for t in ts}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[name] = {t: x / norm for t, x in v.items()}
    # A line's cosine to a template is at most the length of the template's part that the line shares, so only lines that
    # share enough are taken apart.
    share = [sum((F.when(F.array_contains("held", t), x * x).otherwise(0.0) for t, x in v.items()), F.lit(0.0)) for v in vectors.values()]
    weighted = stage(
        base.select("row", F.posexplode(F.split("text", "\n")).alias("line", "said")).select("row", "line", _tokens(F.col("said")).alias("words"))
        .withColumn("held", F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])))
        .where(F.greatest(*share) >= threshold * threshold - 1e-9).select("row", "line", "words"), "lines")
    weight = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf[w])])
    counted = (
        weighted.distinct().select("row", "line", F.explode("words").alias("w")).groupBy("row", "line", "w").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("x", F.col("n") * F.coalesce(F.element_at(weight, F.col("w")), F.lit(rare))))
    dots = [F.sum(F.col("x") * F.coalesce(F.element_at(F.create_map(*[F.lit(i) for t in v.items() for i in t]), F.col("w")), F.lit(0.0))).alias(f"d{k}")
            for k, v in enumerate(vectors.values())]
    scored = counted.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    best = F.array_max(F.array(*[F.struct((F.col(f"d{k}") / F.col("norm")).alias("cosine"), F.lit(-k).alias("rank")) for k, _ in enumerate(vectors)]))
    names = F.array(*[F.lit(n) for n in vectors])
    own = stage(
        scored.select("row", best.alias("b")).where(F.col("b.cosine") >= threshold)
        .groupBy("row").agg(F.max("b").alias("b"))
        .select("row", F.get(names, -F.col("b.rank")).alias("own_license"), F.round("b.cosine", 6).alias("own_cosine")), "own")

    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    sized = base.select("row", "id", "path", F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).alias("n_words"), directory.alias("dir"))
    known = stage(sized.join(own, "row", "left").drop("row"), "known")
    speaks = stage(known.where(f"own_license IS NOT NULL AND dir IS NOT NULL AND n_words <= {FILE_WORDS}").groupBy("dir").agg(
        F.max(F.struct("own_cosine", F.col("own_license").alias("license"))).alias("b")).select("dir", "b.license"), "speaks")
    levels = F.sequence(F.lit(1), F.size(F.split("dir", "/")))
    above = known.where("dir IS NOT NULL").select("dir").distinct().select(
        F.col("dir").alias("of"), F.explode(F.transform(levels, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/").alias("dir")))).alias("a"))
    inherited = stage(above.select("of", "a.depth", "a.dir").join(speaks, "dir").groupBy("of").agg(
        F.max_by(F.struct("license", "dir"), "depth").alias("from")).select(F.col("of").alias("dir"), "from"), "inherited")
    return known.join(inherited, "dir", "left").select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "own_cosine",
        F.coalesce("own_license", "from.license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own_license").isNull(), F.col("from.dir")).alias("from_dir"))
