"""Best-fit packing of token sequences (operator 13).

Documents are encoded where they lie and cut to pieces of at most one sequence. How pieces are packed depends on their
lengths alone, so the plan is made from the number of pieces of each length: pieces above a third of a sequence are
matched greedily, at most two to a bin; shorter ones, longest first, go where they leave the least room. A step of the
plan deals with all bins of one gap at once, and covers a range of the numbers of the pieces of one length. Pieces get
their numbers in the tasks that make them, and each is placed by its own number and the plan: no task, and not the driver, sees them all.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.byte_bpe import BEYOND, spelled_out
from loomgraph.llm.common import map_batches, with_id, written

CAPACITY = 2048

#: Bytes of pre-tokens and their ids that a worker remembers, those of an entry besides, characters of a pre-token that it
#: remembers at most, and characters from which a text is encoded in parts. None of them changes a result.
REMEMBERED = 150_000_000
ENTRY = 160
LONGEST = 64
PART = 1_000_000

#: What byte-level tokenizers write for each byte: itself if it is printable, else the next free character from U+0100 (a fixed rule).
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_LEVEL = "".join(chr(b if b in _PRINTABLE else 256 + _OTHERS.index(b)) for b in range(256))

_CUT = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")


class _Known(dict):
    """Ids of pre-tokens as little-endian 32-bit numbers; a new one goes to the library's model once."""

    def __init__(self, model):
        self.model, self.size = model, 0

    def __missing__(self, token: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(charmap_decode(token.encode(), "strict", _BYTE_LEVEL)[0])]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= LONGEST:
            self.size += ENTRY + len(token) + len(out)
            if self.size > REMEMBERED:
                self.clear()
                self.size = 0
            self[token] = out
        return out


class Encoder:
    """Ids of a tokenizer file, text by text."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.found = re.compile(spelled_out(pattern)).findall
        self.known = _Known(self.library.model)

    def encode(self, text: str) -> bytes:
        if BEYOND.search(text):  # characters that the pattern doesn't know
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, self.found(text)))

    def whole(self, text: str | None) -> bytes:
        """The ids of a text. A very long one is encoded in parts that end where a word does and a space and a word follow: no pre-token spans that place."""
        text, start, out = text or "", 0, []
        while len(text) - start > PART and (m := _CUT.search(text, start + PART)):
            out.append(self.encode(text[start : m.end()]))
            start = m.end()
        return b"".join([*out, self.encode(text[start:])])


_LOADED: dict[tuple, Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(path, pattern)
    return _LOADED[path, pattern]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences after a first piece that has the rest."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces_of(docs: DataFrame, path: str, pattern: str, capacity: int, end: int = 0) -> DataFrame:
    """(part, number, doc_id, piece, start, length, ids_crc32) of docs (doc_id, text).

    Pieces of one length are numbered from 0 in each task, `part`. A task that is run again numbers the same rows alike
    only if it reads them in the same order, so the result must be written before it is counted.
    """
    names = ["part", "number", "doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, numbers = _encoder(path, pattern), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = coder.whole(text) + last
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((part, int(numbers[length]), doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    numbers[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_batches(docs, run, "part int, number long, doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Groups (count, first sequence) of bins by the room that is left in each."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def put(self, gap: int, count: int, first: int) -> None:
        if gap and count:
            if gap not in self.groups:
                self.groups[gap] = []
                heappush(self.gaps, gap)
            self.groups[gap].append((count, first))

    def tightest(self, length: int) -> int | None:
        """The smallest gap that takes `length`; lengths fall from call to call, smaller gaps may still serve later."""
        small = []
        while self.gaps and (self.gaps[0] < length or not self.groups[self.gaps[0]]):
            gap = heappop(self.gaps)
            if self.groups[gap]:
                small.append(gap)
            else:
                del self.groups[gap]
        best = self.gaps[0] if self.gaps else None
        self.gaps += small
        heapify(self.gaps)
        return best

    def open(self, count: int) -> int:
        first, self.opened = self.opened, self.opened + count
        return first


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Steps (length, number, first sequence, offset, each) that place `counts` pieces of each length, and the number of sequences.

    Of a length, the pieces from `number` on, up to the next step's, fill sequences from `first` on, `each` to a
    sequence, one after the other from `offset`. The steps are at most as many as pairs of a length and a gap that meet.
    """
    left = {n: c for n, c in counts.items() if c}
    used, steps, bins = dict.fromkeys(left, 0), [], _Bins(capacity)

    def place(length: int, count: int, first: int, offset: int, each: int = 1) -> None:
        steps.append((length, used[length], first, offset, each))
        used[length] += count
        left[length] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:  # a longest piece with the longest that fits beside it
        for other in (m for m in large if m <= capacity - n and m <= n):
            while left[n] and left[other] and (pairs := left[n] // 2 if n == other else min(left[n], left[other])):
                first = bins.open(pairs)
                place(n, pairs, first, 0)
                place(other, pairs, first, n)
                bins.put(capacity - n - other, pairs, first)
        if left[n]:
            first, count = bins.open(left[n]), left[n]
            place(n, count, first, 0)
            bins.put(capacity - n, count, first)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = bins.tightest(n)
            if gap is None:
                gap, fit = capacity, capacity // n
                bins.put(capacity, -(-left[n] // fit), bins.open(-(-left[n] // fit)))
            count, first = bins.groups[gap].pop()
            fit = gap // n
            full = min(count, left[n] // fit)
            if full:
                place(n, full * fit, first, capacity - gap, fit)
                bins.put(gap - fit * n, full, first)
            rest = count - full
            if rest and left[n]:  # fewer than one bin takes
                some = left[n]
                place(n, some, first + full, capacity - gap, some)
                bins.put(gap - some * n, 1, first + full)
                full, rest = full + 1, rest - 1
            bins.put(gap, rest, first + full)
    return np.array(sorted(steps), np.int64).reshape(-1, 5), bins.opened


def packed(documents: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of documents.

    A null or empty text is the end token alone. Rows that repeat are packed each; a null id is kept; other columns are
    ignored; an empty table gives no rows. The driver gets one number for each length, `capacity` of them at most.
    """
    pieces = written(pieces_of(with_id(documents, id_col, text_col), path, pattern, capacity), "pieces")
    sizes = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = plan(counts, capacity)
    shared = documents.sparkSession.sparkContext.broadcast(steps)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, number, first, offset, each = shared.value.T
        begin = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            if batch.num_rows:
                n, rank = (batch.column(k).to_numpy() for k in (3, 5))
                at = np.empty(len(n), np.int64)
                for own in np.unique(n):
                    here = np.flatnonzero(n == own)
                    at[here] = begin[own] + np.searchsorted(number[begin[own] : begin[own + 1]], rank[here], "right") - 1
                more = rank - number[at]
                places = [pa.array(first[at] + more // each[at]), pa.array(offset[at] + more % each[at] * n)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *places], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
