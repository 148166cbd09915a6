"""Sampled segmentation into SentencePiece pieces, reproducible by row key, and lossless decoding.

A text is cut into chunks where no piece can reach across: before spaces, around line ends, and between letters and a
comma or full stop if the vocabulary allows it.  For every distinct chunk a forward pass filters the weights of all ways
to a position; pieces are then drawn backwards from the end in proportion to those weights, for all chunks of a batch at
once.  The draws are hashes of the row key, the chunk's place and the step, so a repeated task gives the same pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
KNOWN_EDGES = 3_000_000  # about 60 MB with the chunks
TEXTS = 256  # texts sampled at a time
LONG = 48  # longer chunks are filtered one by one
STEP = 0xD1342543DE82EF95


class Lattices:
    """Forward-filtered lattices of chunks in flat arrays: the edges of a state, likeliest first, with cumulative chances."""

    def __init__(self, model_file: str, sharpness: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.weight, self.bytes = {}, [0] * 256  # pieces with spaces for marks, so a mark in a text is no piece
        # Scores that are ranks of merges (0 and below, in whole steps) are read as a Zipf law over the ranks.
        scores = [model.get_score(i) for i in range(model.get_piece_size())]
        ranks = all(s == int(s) for s in scores)
        for i, s in enumerate(scores):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.weight[piece.replace(MARK, " ")] = (i, float(np.exp(sharpness * (-np.log1p(-s) if ranks else s))))
        self.longest = max(map(len, self.weight))
        spans = [p for p in self.weight if re.search(f"[{LETTERS}][,.]|[^ ] |\n", p)]
        self.chunk = re.compile((rf" *[{LETTERS}]+(?=[,.])|" if not spans else "") + (" *[^ \n]+|\n| +" if not any("\n" in p for p in spans) else " *[^ ]+| +"))
        self._grow_trie()
        self.clear()

    def _grow_trie(self) -> None:
        """Nodes of the pieces' prefixes; steps as sorted (node, character) keys."""
        node, steps = {"": 0}, {}
        for piece in self.weight:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in node:
                    node[piece[:k]] = len(node)
                    steps[node[piece[: k - 1]] << 21 | ord(piece[k - 1])] = node[piece[:k]]
        keys = sorted(steps)
        self.step_key, self.step_to = np.array(keys, np.int64), np.array([steps[k] for k in keys], np.int32)
        self.node_piece, self.node_weight = np.full(len(node), -1, np.int32), np.zeros(len(node))
        for piece, (i, w) in self.weight.items():
            self.node_piece[node[piece]], self.node_weight[node[piece]] = i, w

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(0, np.int32)  # of each state: its first edge
        self.chance, self.came, self.piece = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ends(self, lists: list[list[str]]) -> list[list[int]]:
        """The last state of every chunk's lattice; -1 is the start of every lattice."""
        if len(self.chance) > KNOWN_EDGES:
            self.clear()
        known = self.known
        found = [list(map(known.get, chunks)) for chunks in lists]
        new = list({c for chunks, got in zip(lists, found) if None in got for c, x in zip(chunks, got) if x is None})
        if not new:
            return found
        short = [c for c in new if len(c) <= LONG]
        blocks = [self._filter_together(short, len(self.start))] if short else []
        states = len(self.start) + sum(len(b[0]) for b in blocks)
        for c in [c for c in new if c not in known]:  # long chunks, and those with characters that no piece holds
            blocks.append(self._filter_alone(c, states))
            states += len(blocks[-1][0])
        edge = len(self.chance)
        starts = []
        for sizes, *_ in blocks:
            upto = np.cumsum(sizes)
            starts.append((edge + upto - sizes).astype(np.int32))
            edge += int(upto[-1]) if len(upto) else 0
        self.start = np.concatenate([self.start, *starts])
        for at, name in enumerate(("chance", "came", "piece"), 1):
            setattr(self, name, np.concatenate([getattr(self, name), *[b[at] for b in blocks]]))
        return [list(map(known.__getitem__, chunks)) if None in got else got for chunks, got in zip(lists, found)]

    @staticmethod
    def _ordered(state: np.ndarray, w: np.ndarray, came: np.ndarray, piece: np.ndarray, states: int) -> tuple:
        """(edges of each state, cumulative chances, state before, piece) with the likeliest edge of a state first."""
        order = np.lexsort((-w, state))
        state, w = state[order], w[order]
        sizes = np.bincount(state, minlength=states)
        first = np.cumsum(sizes) - sizes
        upto = np.cumsum(w / np.add.reduceat(w, first)[state])
        chance = upto - np.concatenate([[0.0], upto])[first][state]
        chance[first + sizes - 1] = 1.0
        return sizes, chance.astype(np.float32), came[order].astype(np.int32), piece[order].astype(np.int32)

    def _filter_together(self, chunks: list[str], base: int) -> tuple:
        """Forward pass over many short chunks, place by place; chunks with a place that no piece ends at are left out."""
        sizes = np.array([len(c) for c in chunks])
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        end = (begin + sizes)[chunk]
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for depth in range(self.longest):
            key = node << 21 | codes[at + depth]
            k = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            alive = self.step_key[k] == key
            at, node = at[alive], self.step_to[k[alive]].astype(np.int64)
            whole = self.node_piece[node] >= 0
            found.append((at[whole], at[whole] + depth, node[whole]))
            more = at + depth + 1 < end[at]
            at, node = at[more], node[more]
        first, last, node = (np.concatenate(x) for x in zip(*found))
        reached = np.zeros(len(codes), bool)
        reached[last] = True
        complete = np.ones(len(chunks), bool)
        complete[chunk[~reached]] = False
        keep = complete[chunk[last]]
        first, last, node = first[keep], last[keep], node[keep]
        # The state of a place is its number among the places of complete chunks.
        state = np.cumsum(complete[chunk]) - 1
        place = np.arange(len(codes)) - begin[chunk]
        order = np.argsort(place[last], kind="stable")
        first, last, node = first[order], last[order], node[order]
        w, forward = self.node_weight[node].copy(), np.ones(len(codes))
        borders = np.searchsorted(place[last], np.arange(int(sizes.max()) + 1))
        for a, b in zip(borders, borders[1:]):
            inner = first[a:b] > begin[chunk[first[a:b]]]
            w[a:b] *= np.where(inner, forward[first[a:b] - 1], 1.0)
            total = np.bincount(chunk[last[a:b]], w[a:b], minlength=len(chunks))
            forward[last[a:b]] = total[chunk[last[a:b]]]
        n = int(complete[chunk].sum())
        came = np.where(first > begin[chunk[first]], base + state[first - 1], -1)
        ends = begin + sizes - 1
        self.known.update((c, base + int(state[e])) for c, e, ok in zip(chunks, ends, complete.tolist()) if ok)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        return self._ordered(state[last], w, came, self.node_piece[node], n)

    def _filter_alone(self, chunk: str, base: int) -> tuple:
        """Forward pass over one chunk of any length; characters that no piece holds are spelled as bytes."""
        weight, longest = self.weight, self.longest
        forward, state, edges, states = [1.0], [-1], [], 0
        for j in range(1, len(chunk) + 1):
            here = [(forward[i] * found[1], state[i], found[0]) for i in range(max(0, j - longest), j)
                    if (found := weight.get(chunk[i:j])) is not None and forward[i] * found[1] > 0]
            if here:
                edges += [(states, *e) for e in here]
                forward.append(sum(e[0] for e in here))
                state.append(base + states)
                states += 1
            else:  # no piece ends here: the bytes of the character, one after the other
                at = state[-1]
                for b in chunk[j - 1].encode("utf-8", "surrogatepass"):
                    edges.append((states, 1.0, at, self.bytes[b]))
                    at = base + states
                    states += 1
                state.append(at)
                forward.append(forward[-1] * 1e-6)
            if forward[-1] < 1e-200:  # only the proportions matter, and only among the places still in reach
                lo, top = max(0, len(forward) - longest - 1), forward[-1]
                forward[lo:] = [f / top for f in forward[lo:]]
        self.known[chunk] = state[-1]
        at, w, came, piece = (np.array(x) for x in zip(*edges))
        return self._ordered(at.astype(np.int64), w.astype(float), came, piece, states)

    def draw(self, ends: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all chunks in reading order, number of pieces of each chunk)."""
        at, rows, steps, lengths = ends.astype(np.int64), np.arange(len(ends)), [], np.zeros(len(ends), np.int64)
        step = 0
        while len(rows):
            u = ((mix(seeds[rows] + np.uint64(step * STEP % (1 << 64))) >> np.uint64(40)).astype(np.float32)) * np.float32(2.0 ** -24)
            e = self.start[at].astype(np.int64)
            todo = np.flatnonzero(u >= self.chance[e])
            while len(todo):
                e[todo] += 1
                todo = todo[u[todo] >= self.chance[e[todo]]]
            steps.append((rows, self.piece[e]))
            lengths[rows] += 1
            at = self.came[e].astype(np.int64)
            go = at >= 0
            at, rows = at[go], rows[go]
            step += 1
        after = np.cumsum(lengths)
        out = np.zeros(int(after[-1]) if len(after) else 0, np.int32)
        for k, (rows, p) in enumerate(steps):
            out[after[rows] - 1 - k] = p
        return out, lengths


_lattices: dict[tuple, Lattices] = {}


def lattices_of(model_file: str, sharpness: float) -> Lattices:
    """One table of known chunks per worker process, kept from task to task."""
    if (model_file, sharpness) not in _lattices:
        _lattices[model_file, sharpness] = Lattices(model_file, sharpness)
    return _lattices[model_file, sharpness]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Speller:
    """Texts from piece ids, whichever way they were cut."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode()
                      for i, p in enumerate(model.id_to_piece(i) for i in range(model.get_piece_size()))]

    def __call__(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def pieces(model_file: str, text: Column, key: Column, seed: int = 0, sharpness: float = 1.0, check: bool = False) -> Column:
    """Struct (pieces, lossless) of each text; ``seed`` and ``key`` choose the segmentation, ``sharpness`` is a power of all weights.

    A null text has null pieces.  Equal texts with equal keys get equal pieces; a null key counts as one key of its own.
    ``check`` spells the pieces at once and says whether that gives the text; otherwise lossless is null.
    """
    def many(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        lattices, spell = lattices_of(model_file, sharpness), Speller(model_file) if check else None
        for texts, keys in parts:
            out, texts, keys = [], texts.tolist(), keys.to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(texts), TEXTS):
                some = texts[lo:lo + TEXTS]
                ends = lattices.ends([lattices.chunk.findall(" " + t) if t is not None else [] for t in some])
                sizes = np.array([len(e) for e in ends])
                starts = np.cumsum(sizes) - sizes
                place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
                seeds = mix(np.repeat(keys[lo:lo + TEXTS], sizes) ^ mix(place.astype(np.uint64)))
                ids, lengths = lattices.draw(np.array([s for e in ends for s in e], np.int64), seeds)
                per_chunk = np.concatenate([[0], np.cumsum(lengths)])
                borders = per_chunk[np.concatenate([starts, [int(sizes.sum())]])]
                out += [ids[a:b] if t is not None else None for t, a, b in zip(some, borders, borders[1:])]
            same = [None if spell is None else p is None or spell(p) == t for t, p in zip(texts, out)]
            yield pd.DataFrame({"pieces": pd.Series(out, dtype=object), "lossless": pd.Series(same, dtype=object)})

    return F.pandas_udf(many, "pieces array<int>, lossless boolean")(text.cast("string"), F.xxhash64(key, F.lit(seed)))


def texts(model_file: str, ids: Column) -> Column:
    """The text that the pieces were sampled from, whichever way it was cut; null for null."""
    def many(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spell = Speller(model_file)
        for rows in parts:
            yield pd.Series([None if r is None else spell(r) for r in rows], dtype=object)

    return F.pandas_udf(many, "string")(ids)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, sharpness: float = 1.0,
           check: bool = False) -> DataFrame:
    """One row per row: id, text, pieces, lossless.  Other columns are not read; an empty table gives no rows."""
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).withColumn(
        "_p", pieces(model_file, F.col(text_col), F.col(id_col), seed, sharpness, check)).select(id_col, text_col, "_p.*")


def decode(rows: DataFrame, model_file: str, to: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``pieces`` in column ``to``."""
    return rows.withColumn(to, texts(model_file, F.col("pieces")))
