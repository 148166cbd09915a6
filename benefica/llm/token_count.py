"""Token counts by greedy longest match: a vocabulary trie with failure links and precomputed counts of popped tokens.

A failed step at a node pops the tokens that cover its string and goes on from the node's failure link, so every word is
read once, character by character, and no piece is ever built.  Words start with the word mark; a character that no
piece holds counts as its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import words

MARK = "▁"
KNOWN_WORDS = 300_000


class LongestMatch:
    """Greedy token counts of single words over a vocabulary of pieces."""

    def __init__(self, pieces: Iterable[str]):
        step, ends, depth_of = [{}], [0], [0]  # children, tokens that a node's own string counts as, depth

        def add(piece: str, count: int) -> None:
            at = 0
            for c in piece:
                if c not in step[at]:
                    step[at][c] = len(step)
                    step.append({})
                    ends.append(0)
                    depth_of.append(depth_of[at] + 1)
                at = step[at][c]
            ends[at] = ends[at] or count

        pieces = set(pieces) - {""}
        for p in pieces:
            add(p, 1)
        for c in {c for p in pieces for c in p}:
            add(c, len(c.encode()))  # so that every character of the trie can be popped alone
        fail, pop = [0] * len(step), [0] * len(step)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in step[u].items():
                    below.append(v)
                    if ends[v]:
                        fail[v], pop[v] = 0, ends[v]
                        continue
                    at, popped = fail[u], pop[u]
                    while c not in step[at] and at:
                        popped += pop[at]
                        at = fail[at]
                    fail[v], pop[v] = step[at][c], popped
            level = below
        self.step, self.fail, self.pop = step, fail, pop

    def count(self, word: str) -> int:
        step, fail, pop = self.step, self.fail, self.pop
        at = n = 0
        for c in word:
            nxt = step[at].get(c)
            while nxt is None:
                if not at:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += pop[at]
                at = fail[at]
                nxt = step[at].get(c)
            else:
                at = nxt
                continue
            at = 0
        while at:
            n += pop[at]
            at = fail[at]
        return n


def pieces_of(model_file: str) -> list[str]:
    """The ordinary pieces of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, n_tokens; a null or empty text has none.  Other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, known = LongestMatch(pieces_of(model_file)), {}
        for rows in parts:
            n_words, n_tokens = [], []
            for text in rows["text"]:
                found = words(text)
                total = 0
                for w in found:
                    n = known.get(w)
                    if n is None:
                        if len(known) > KNOWN_WORDS:
                            known.clear()
                        n = known[w] = match.count(MARK + w.decode("utf-8", "surrogatepass"))
                    total += n
                n_words.append(len(found))
                n_tokens.append(total)
            yield pd.DataFrame({"id": rows["id"], "n_words": n_words, "n_tokens": n_tokens})

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInPandas(count, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
    )
