"""Language of texts: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies cover every text that may be learned from.  The classifier is fitted by follow-the-regularised-
leader (proximal form, elastic net) on a bounded sample of ``per_class`` different texts per language (all, if it has
fewer), a fifth of which sets the temperature of the scores instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import stage

DIM = 1 << 16
ORDERS = 3
PER_CLASS = 800
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, counts) of all character 1- to 3-grams of the lower-cased text, other characters as one space; None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    h, total = np.zeros(len(codes), np.uint64), np.zeros(DIM, np.int64)
    for order in range(1, ORDERS + 1):
        h = (h[: len(codes) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1:] + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)
        total += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=DIM)
        if len(codes) <= order:
            break
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts and unit length."""
    x = (1 + np.log(counts)) * idf
    return x / max(1e-12, math.sqrt(float((x * x).sum())))


@dataclass
class Model:
    """Languages, idf of all features, and the weights of the features that have any; the last row is the bias."""

    languages: list[str]
    idf: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x, rows = weights(counts, self.idf[at]), self.row[at]
        used = rows >= 0
        return x[used] @ self.weight[rows[used]] + self.weight[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = gram_counts(text)
        if grams is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*grams) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def follow_the_leader(samples: list, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> np.ndarray:
    """Weights (DIM + 1, classes) from samples (features, values, class)."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def lead(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(samples)):
            at, x, y = samples[k]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = lead(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    return lead(z, n)


def temperature(logits: list, classes: list) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not logits:
        return 1.0
    v, y = np.array(logits), np.array(classes)

    def loss(t: float) -> float:
        s = v / math.exp(t)
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def drawn(rows: DataFrame, per_class: int) -> tuple[DataFrame, dict[str, int], list]:
    """Of rows (text, lang) the ``per_class`` different texts of each language with the smallest hashes, all rows per language, and rows (feature, texts with it).

    Texts without letters do not count.  Copies count in the last two only.  Sums and hashes of about twice as many texts per language reach the driver.
    """
    def frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIM, np.int64)
        for some in parts:
            texts = {}
            for text, lang, h in zip(some["text"], some["lang"], some["h"]):
                grams = gram_counts(text)
                if grams is not None:
                    df[grams[0]] += 1
                    texts[lang, h] = texts.get((lang, h), 0) + 1
            yield pd.DataFrame({"feature": -1, "lang": pd.Series([k for k, _ in texts], dtype=object), "h": np.array([h for _, h in texts], np.int64),
                                "n": np.array(list(texts.values()), np.int64)})
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": at.astype(np.int32), "lang": None, "h": 0, "n": df[at]})

    h = F.shiftrightunsigned(F.xxhash64("text"), 1)  # 63 bits
    counted = stage(rows.select("text", "lang", h.alias("h")).mapInPandas(frequencies, "feature int, lang string, h long, n long"), "counted")
    sums = counted.where("feature >= 0").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    texts = stage(counted.where("feature < 0").groupBy("lang", "h").agg(F.sum("n").alias("n")), "texts")
    sizes = {r["lang"]: (r["texts"], r["n"]) for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).collect()}
    if not sizes:
        return rows.where("false"), {}, sums
    by_lang = lambda of: F.element_at(F.create_map(*[F.lit(x) for k in sizes for x in (k, of(k))]), F.col("lang"))
    low = texts.where(F.col("h") <= by_lang(lambda k: int(min(1.0, (2 * per_class + 100) / sizes[k][0]) * ((1 << 63) - 1025)) if sizes[k][0] > 2 * per_class + 100 else (1 << 63) - 1))
    hashes: dict[str, list[int]] = {}
    for lang, x in low.select("lang", "h").collect():
        hashes.setdefault(lang, []).append(x)
    limit = {k: sorted(hashes[k])[:per_class][-1] for k in sizes}
    return rows.where(h <= by_lang(limit.get)).dropDuplicates(["text", "lang"]), {k: n for k, (_, n) in sizes.items()}, sums


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> Model:
    """A model of all non-null values of ``lang_col``; rows with a null text, a text without letters or a null language teach nothing.

    Only sums, one row per language and the bounded sample reach the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kept, per_lang, sums = drawn(rows, per_class)
    languages, total = sorted(per_lang), sum(per_lang.values())
    df = np.zeros(DIM)
    for feature, n in sums:
        df[feature] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.full(DIM, -1, np.int32), np.zeros((1, 0)))

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in parts:
            found = [(g[0], g[1], lang) for t, lang in zip(some["text"], some["lang"]) if (g := gram_counts(t)) is not None]
            yield pd.DataFrame(found, columns=["at", "counts", "lang"])

    place = {k: i for i, k in enumerate(languages)}
    data = [(np.array(r["at"], np.int32), np.array(r["counts"], np.int64), place[r["lang"]])
            for r in kept.mapInPandas(features, "at array<int>, counts array<long>, lang string").toLocalIterator()]
    data.sort(key=lambda d: (len(d[0]), int(d[1].sum()), int(d[0].sum()), d[2]))  # the same order whatever the partitions
    learn = [(a, weights(c, idf[a]), y) for k, (a, c, y) in enumerate(data) if k % 5]
    w = follow_the_leader(learn, len(languages))
    used = np.flatnonzero(w[:DIM].any(axis=1))
    row = np.full(DIM, -1, np.int32)
    row[used] = np.arange(len(used))
    model = Model(languages, idf, row, np.vstack([w[used], w[DIM:]]))
    held = [(model.logits(a, c), y) for k, (a, c, y) in enumerate(data) if not k % 5]
    model.temperature = temperature([v for v, _ in held], [y for _, y in held])
    return model


def predictions(model: Model, text_col: str | Column = "text") -> Column:
    """Struct (lang, score) of each text."""
    def many(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = [model.predict(t) for t in texts]
            yield pd.DataFrame({"lang": pd.Series([k for k, _ in found], dtype=object), "score": np.array([p for _, p in found], np.float64)})

    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.pandas_udf(many, "lang string, score double")(text.cast("string"))


def is_held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """One row per row: id, held_out, lang_pred, score, learned from the rows that are not held out.

    ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn from.  An empty table gives no rows.
    """
    model = fit(docs.where(~is_held_out(id_col)), text_col, lang_col, per_class)
    return docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), predictions(model, text_col).alias("_p")).select(
        id_col, "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
