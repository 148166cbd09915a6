"""Packing in the order of the documents: dynamic programming chooses where the token stream is cut into sequences.

The documents of a partition form one stream of tokens in their order.  Cuts lie at the ends of documents (free) or of
sentences (a small penalty), and every few dozen tokens within a very long sentence (a larger one).  The cheapest set of
cuts minimises padding plus penalties: a sequence of L tokens costs ``seq_len`` - L, or nothing if L is a power of two.

    cost(j) = penalty(j) + min( min over i of cost(i) + at(i) + seq_len - at(j),  min over powers p of cost(at(j) - p) )

The first minimum runs over a window of positions that only moves forward, so a monotone queue gives it in constant
time; the second has at most 12 terms.  The stream is solved in stretches of ``CHAIN`` tokens, whose last sequence stays
open and is carried into the next one, so a partition has one sequence at most that is short for want of text.
Nothing is shuffled and nothing but the tokens of one stretch is held.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from benefica.llm.arrow_text import stretches, strings

SEQ_LEN = 2048
END = 1
CHAIN = 1 << 18
SENTENCE = 2  # tokens of padding that a cut between two sentences of a document is worth
INSIDE = 16  # the same for a cut within a sentence
LONG = 64  # tokens of a sentence after which it may be cut inside
KNOWN_CHUNKS = 500_000  # about 100 MB in a worker

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FULL = np.zeros(256, bool)  # characters of one byte that are neither white space nor control characters
_FULL[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_PLAIN = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class ChunkIds:
    """Ids of whole texts by a byte-level tokenizer whose tokens never cross the start of white space.

    A text is split before every run of ASCII white space that follows an ASCII or Latin-1 letter or mark, and between a
    letter and a mark; such a chunk has the same ids alone as in its text.  Distinct chunks are encoded once and
    remembered; new ones of one space and letters are encoded together as one text, whose ids are cut by the bytes that
    each token stands for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, decoders

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        size = self.tokenizer.get_vocab_size()
        decoder = decoders.ByteLevel()
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])  # one letter of a token is one byte
        texts = [decoder.decode([self.tokenizer.id_to_token(i) or ""]) for i in range(size)]
        self.stop = np.array([t.rstrip("\"')]}»”’").endswith((".", "!", "?", "。", "！", "？")) for t in texts])
        self.line = np.array(["\n" in t for t in texts])
        self.blank = np.array([t[:1].isspace() for t in texts])

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.known) > KNOWN_CHUNKS:
            self.known.clear()
        known = self.known
        new = [c for c in chunks if c not in known]
        plain = [c for c in new if _PLAIN.fullmatch(c)]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(c) for c in plain])) + 1)
            whole, ends = ids.tobytes(), [0, *ends.tolist()]
            known.update(zip(plain, [whole[a:b] for a, b in zip(ends, ends[1:])]))
        other = [c for c in new if c not in known]
        for c, e in zip(other, self.tokenizer.encode_batch_fast([c.decode() for c in other], add_special_tokens=False)):
            known[c] = np.array(e.ids, "<u4").tobytes()
        return [known[c] for c in chunks]

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and where each text's ids start (one more entry than texts)."""
        cut = np.zeros(len(data) + 1, bool)
        cut[starts] = True
        if len(data) > 1:
            blank = _BLANK[data]
            latin = np.zeros(len(data), bool)
            latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
            letter = _LETTER[data] | (latin & (data != 0x97) & (data != 0xB7))  # the signs of times and division are none
            cut[1:-1] |= (blank[1:] & (_FULL[data] | latin)[:-1]) | (_MARK[data[1:]] & letter[:-1])
        at = np.flatnonzero(cut)
        coded = strings(data, at).dictionary_encode()
        found = self._ids(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[take]
        return ids, ends[np.searchsorted(at, starts)]

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions behind the last token of a sentence or line, the end of ``ids`` left out."""
        if len(ids) < 2:
            return np.zeros(0, np.int64)
        here = ids[:-1]
        return np.flatnonzero(self.line[here] | (self.stop[here] & self.blank[ids[1:]])) + 1


_chunk_ids: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One table of known chunks per worker process, kept from task to task."""
    if path not in _chunk_ids:
        _chunk_ids[path] = ChunkIds(path)
    return _chunk_ids[path]


def places(docs: np.ndarray, sentences: np.ndarray, size: int = SEQ_LEN, sentence: int = SENTENCE, inside: int = INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of all possible cuts of a stream, its start included.

    ``docs`` holds the start of the stream and the ends of its documents, ``sentences`` other ends of sentences.
    """
    at = np.union1d(docs, sentences)
    step = min(LONG, size)
    extra = np.maximum(np.diff(at) - 1, 0) // step
    within = np.repeat(at[:-1], extra) + step * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    every = np.union1d(at, within)
    cost = np.full(len(every), inside, np.int64)
    cost[np.searchsorted(every, sentences)] = sentence
    cost[np.searchsorted(every, docs)] = 0
    return every, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, size: int = SEQ_LEN, open_end: bool = False) -> tuple[list[int], int]:
    """The cheapest cuts, as indices into ``at`` from 0 to the last one, and what they cost.

    Neighbouring positions are at most ``size`` apart.  Of equal sums the longer sequence wins.  With ``open_end`` the last
    sequence is not paid for; the list ends where it starts.
    """
    steps, froms = [], []
    for p in (1 << k for k in range(size.bit_length()) if 1 << k < size):
        s = np.searchsorted(at, at - p)
        hit = np.flatnonzero((at >= at[0] + p) & (at[s] == at - p))
        steps.append(hit)
        froms.append(s[hit])
    steps, froms = np.concatenate([*steps, [len(at)]]), np.concatenate([*froms, [0]])
    order = np.argsort(steps, kind="stable")
    steps, froms = steps[order].tolist(), froms[order].tolist()
    where, penalty = at.tolist(), cost.tolist()
    total, back, keys = [0] * len(where), [0] * len(where), [where[0]]
    queue, head, k = [0], 0, 0
    for t in range(1, len(where)):
        here = where[t]
        while where[queue[head]] < here - size:
            head += 1
        s = queue[head]
        best = keys[s] + size - here
        while steps[k] == t:
            i = froms[k]
            if total[i] < best or (total[i] == best and i < s):
                best, s = total[i], i
            k += 1
        best += penalty[t]
        total[t], back[t] = best, s
        key = best + here
        keys.append(key)
        while len(queue) > head and keys[queue[-1]] > key:
            queue.pop()
        queue.append(t)
    last = len(where) - 1
    if open_end:
        first = int(np.searchsorted(at, at[-1] - size))
        last = min(range(first, len(where)), key=lambda i: (total[i], i))
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1], total[last]


class Stream:
    """The documents of one partition that are not cut yet."""

    def __init__(self, ids_of: ChunkIds, seq_len: int, sentence: int, inside: int):
        self.ids_of, self.seq_len, self.penalties = ids_of, seq_len, (sentence, inside)
        self.ids, self.ends, self.sentences, self.keys, self.gone, self.whole = [], [], [], [], [], []
        self.n = self.sequence = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.sentences.append(self.ids_of.sentence_ends(ids) + self.n)
        self.ids.append(ids)
        self.ids.append(np.array([END], "<u4"))
        self.n += len(ids) + 1
        self.ends.append(self.n)
        self.keys.append(key)
        self.gone.append(0)
        self.whole.append(len(ids) + 1)

    def cut(self, open_end: bool) -> dict[str, list | np.ndarray | pa.Array]:
        """The pieces of the sequences that are complete; with ``open_end`` the last sequence stays for the next call."""
        ids = np.concatenate(self.ids)
        docs = np.array([0, *self.ends], np.int64)
        sentences = np.concatenate(self.sentences)
        at, cost = places(docs, np.setdiff1d(sentences, docs), self.seq_len, *self.penalties)
        windows = at[best_cuts(at, cost, self.seq_len, open_end)[0]]
        end = int(windows[-1])
        edges = np.union1d(docs[docs < end], windows)
        begin = edges[:-1]
        doc = np.searchsorted(docs, begin, "right") - 1
        window = np.searchsorted(windows, begin, "right") - 1
        out = {
            "key": [self.keys[i] for i in doc.tolist()], "start": begin - docs[doc] + np.array(self.gone, np.int64)[doc], "length": np.diff(edges),
            "ids": strings(ids[:end].view(np.uint8), 4 * edges).cast(pa.binary()), "doc_tokens": np.array(self.whole, np.int64)[doc],
            "sequence": self.sequence + window, "offset": begin - windows[window]}
        self.sequence += len(windows) - 1
        keep = int(np.searchsorted(docs, end, "right")) - 1  # the first document with tokens left
        if keep < len(self.keys):
            self.gone[keep] += end - int(docs[keep])
        self.ids, self.sentences = [ids[end:]], [sentences[sentences > end] - end]
        self.ends, self.n = [e - end for e in self.ends[keep:]], len(ids) - end
        self.keys, self.gone, self.whole = self.keys[keep:], self.gone[keep:], self.whole[keep:]
        return out


def pack_in_order(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
                  sentence: int = SENTENCE, inside: int = INSIDE) -> DataFrame:
    """Pieces of all rows: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The ids of a text are followed by id 1; a null or empty text is that id alone.  Every id lies in one piece, the pieces of
    a sequence follow each other without gaps and documents keep the order in which their partition holds them.
    Repeated rows and null ids are rows like others, an empty table gives no rows, and other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(chunk_ids(tokenizer), seq_len, sentence, inside)

        def cut(open_end: bool) -> pa.RecordBatch:
            out = stream.cut(open_end)
            out["key"] = pa.array(out["key"], arrow)
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            keys = batch.column("key").to_pylist()
            for rows, data, starts in stretches(batch):
                ids, at = stream.ids_of(data, starts)
                for key, a, b in zip(keys[rows], at.tolist(), at[1:].tolist()):
                    stream.add(key, ids[a:b])
                    if stream.n >= max(CHAIN, 2 * seq_len):
                        yield cut(True)
        if stream.n:
            yield cut(False)

    schema = f"key {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence long, offset long"
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The part of the id above 2^40 is the partition, so ids are unique and the same if a lost task runs again.
    number = F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("sequence")
    return rows.mapInArrow(pack, schema).select(
        F.col("key").alias(id_col), "start", "length", "ids", "doc_tokens", number.alias("sequence_id"), "offset")
