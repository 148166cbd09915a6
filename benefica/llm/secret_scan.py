"""Secrets in texts: three known patterns, and strings that pass a battery of randomness tests.

Candidates are runs of token characters of some length; of NAME=VALUE each side is one of its own.  For each the alphabet is inferred, and three tests are made on
the positions of its characters in it: chi-squared against equal frequencies, runs above and below the middle, and
serial correlation.  The null hypothesis is "ordinary text": character frequencies counted over all texts give the
non-central chi-squared law that ordinary text of this length would follow, and the p-value is the chance to look as
even as the candidate does.  A candidate that the runs or correlation test rejects as random keeps p = 1.  The p-values
are weighted by length and cut by Benjamini-Hochberg over all candidates of all texts, through a histogram of fixed size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import stage

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 20
# An equals sign ends a candidate, unless it is padding behind the last character.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % LEAST)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Inferred encodings, from the narrowest to the widest.
ALPHABETS = (DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
             LOWER + UPPER, DIGITS + LOWER + UPPER, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_",
             UPPER + LOWER + DIGITS + "+/-_")
SETS = [frozenset(a) for a in ALPHABETS]
PLACES = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
BINS, PER_UNIT = 1200, 20  # the histogram holds -log10 p in steps of 1/20


def base_spans(text: str, candidates: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns by start, then kind; offsets are code points."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for a, b in runs_of(text) if candidates is None else candidates:  # every long hexadecimal run lies in a candidate
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, a, b)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def runs_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def unevenness(counts: np.ndarray) -> list[float]:
    """For each alphabet: sum of (q - u)^2 / u of the character frequencies q against equal ones u."""
    out = []
    for a in ALPHABETS:
        q = np.array([counts[ord(c)] for c in a], float)
        q = q / q.sum() if q.sum() else np.full(len(a), 1 / len(a))
        out.append(float(len(a) * ((q - 1 / len(a)) ** 2).sum()))
    return out


def p_value(token: str, uneven: list[float], gate: float = 1e-3) -> float:
    """The chance that ordinary text of this length looks as even; 1 if it is not random by the other tests."""
    core = token.rstrip("=").strip("-_")
    have = set(core)
    kind = next((i for i, s in enumerate(SETS) if have <= s), None)
    n = len(core)
    if kind is None or n < LEAST:
        return 1.0
    size = len(ALPHABETS[kind])
    places = PLACES[kind]
    x = np.array([places[c] for c in core], np.int64)
    counts = np.bincount(x, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    high = x >= size / 2
    ones = int(high.sum())
    if not 0 < ones < n:
        return 1.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * ones * (n - ones) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    if var > 0 and math.erfc(abs(runs - mean) / math.sqrt(2 * var)) < gate:
        return 1.0
    d = x - x.mean()
    serial = float((d[1:] * d[:-1]).sum() / (d * d).sum())
    if math.erfc(abs(serial + 1 / n) * math.sqrt(n / 2)) < gate:
        return 1.0
    if math.erfc(max(0.0, (chi - (size - 1)) / math.sqrt(2 * (size - 1))) / math.sqrt(2)) < gate:
        return 1.0  # too uneven for its own alphabet
    shift = n * uneven[kind]
    k = size - 1
    h = 2 * (k + 2 * shift) / (9 * (k + shift) ** 2)  # cube-root form of the non-central law
    z = ((chi / (k + shift)) ** (1 / 3) - (1 - h)) / math.sqrt(h)
    return max(1e-60, 0.5 * math.erfc(-z / math.sqrt(2)))


def weighted(p: float, length: int) -> float:
    """Longer candidates get more weight: one of ``2 * LEAST`` characters has weight 1."""
    return min(1.0, p * 2 * LEAST / length)


def character_counts(docs: DataFrame, text_col: str) -> tuple[np.ndarray, float]:
    """Counts of the 128 ASCII characters over all texts."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for rows in parts:
            for t in rows["text"]:
                if t:
                    total += np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        yield pd.DataFrame({"c": np.arange(128, dtype=np.int32), "n": total[:128]})

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    counts = np.zeros(128, np.int64)
    for c, n in found.collect():
        counts[c] = n
    return counts


def cut_off(levels: list[tuple[int, int]], rate: float) -> float:
    """The largest p-value that counts as found (Benjamini-Hochberg) from rows (histogram bin, candidates)."""
    total, seen, best = sum(n for _, n in levels), 0, 0.0
    for at, n in sorted(levels, reverse=True):
        seen += n
        p = 10 ** (-at / PER_UNIT)  # the largest p of the bin
        if p <= rate * seen / total:
            best = p
    return best


def _model(docs: DataFrame, id_col: str, text_col: str, rate: float) -> tuple[DataFrame, float, list[float]]:
    """Staged rows (id, base spans, candidates with weighted p), the largest p that counts as found, the alphabets' unevenness."""
    uneven = unevenness(character_counts(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            base, tested = [], []
            for text in rows["text"]:
                text = text or ""
                runs = runs_of(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in base_spans(text, runs)])
                tested.append([{"start": a, "end": b, "p": weighted(p_value(text[a:b], uneven), b - a)} for a, b in runs])
            yield pd.DataFrame({"id": rows["id"], "base": base, "tested": tested})

    span = "start: int, end: int"
    scanned = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        scan, f"id {kind}, base array<struct<{span}, kind: string>>, tested array<struct<{span}, p: double>>"), "scanned")
    p = F.explode("tested.p").alias("p")
    level = F.least(F.lit(BINS - 1), F.floor(-F.log10("p") * PER_UNIT).cast("int"))
    levels = scanned.select(p).groupBy(level.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    return scanned, cut_off([(r["at"], r["n"]) for r in levels], rate), uneven


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per row: id and ``found``, all spans as (start, kind place, end, kind) by start and kind.

    ``rate`` is the false-discovery rate of the randomness battery.  A random string inside a span of a pattern is not
    reported again.  Null texts count as empty and have no spans; an empty table gives no rows; other columns are not read.
    """
    scanned, limit, _ = _model(docs, id_col, text_col, rate)
    place = F.expr(f"transform(base, s -> struct(s.start AS start, array_position(array({', '.join(repr(k) for k in KINDS)}), s.kind) AS place, s.end AS end, s.kind AS kind))")
    extra = F.expr(
        f"transform(filter(tested, t -> t.p <= {limit!r}D AND NOT exists(base, s -> s.start <= t.start AND t.end <= s.end)), "
        f"t -> struct(t.start AS start, {len(KINDS)}L AS place, t.end AS end, 'random' AS kind))")
    return scanned.select(F.col("id").alias(id_col), F.array_sort(F.concat(place, extra)).alias("found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; all rows and columns stay, null texts stay null."""
    _, limit, uneven = _model(docs, id_col, text_col, rate)

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for text in texts:
                if text:
                    runs = runs_of(text)
                    cuts = [(a, b) for a, b, _ in base_spans(text, runs)]
                    cuts += [(a, b) for a, b in runs if weighted(p_value(text[a:b], uneven), b - a) <= limit]
                    parts_, at = [], 0
                    for a, b in sorted(cuts):
                        if a >= at:
                            parts_ += [text[at:a], mark]
                        at = max(at, b)
                    text = "".join([*parts_, text[at:]])
                out.append(text)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(f"`{text_col}`").cast("string")))
