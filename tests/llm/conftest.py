"""A small table of documents with the cases every operator must take."""

import pytest

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(9000))
COPY = " ".join(f"alpha{i} beta{i * 7 % 31} gamma{i * 3 % 17}" for i in range(60))
ROWS = [
    (0, COPY, "en", "s0"), (1, COPY.replace(" ", "\n\t"), "en", "s0"), (2, None, None, "s0"), (3, "", "en", None), (4, " \t\n", "de", "s1"),
    (5, "Ein kurzer Text über nichts", "de", "s1"), (6, LONG, "en", "s0"), (7, LONG + " ende", "en", "s0"), (8, COPY + " one more", "en", "s2"),
    (9, "\x1f\x85   odd spaces ▁▁ 日本語 👍", "en", "s2"), (9, "\x1f\x85   odd spaces ▁▁ 日本語 👍", "en", "s2"), (10, "a " * 200, "fr", "s2"),
    (None, COPY, "en", "s0"), (11, "12345 +++ 67890", "es", "s3"), (12, "start " + COPY + " end", "en", "s3"), (13, "É é É é", "fr", "s3"),
]


@pytest.fixture(scope="session")
def corpus(spark):
    rows = [(i, t, lang, s, len(t) if t is not None else None, "x", "y") for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, row string")


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.where("false")
