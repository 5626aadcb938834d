"""Byte-level BPE encoding and decoding (operator 3).

A pre-token that is in the vocabulary as a whole is found in one step by a minimal perfect hash over the
vocabulary; any other is merged by rank with a heap over linked byte segments. Results per distinct pre-token are
kept in a bounded table of the worker, so a word that recurs is encoded once. Texts are independent: the work is
one pass over the documents without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from loomgraph.llm.common import map_columns, mix, with_id

#: Distinct pre-tokens that a worker remembers, and the length from which a text is cut into chunks of pre-tokens.
REMEMBERED = 150_000
LONG_TEXT = 1_000_000
CHUNK = 100_000

#: Characters that the fast pattern doesn't know.
BEYOND = re.compile("[\U00010000-\U0010ffff]")

_STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    """A minimal perfect hash by displacement: n keys, n slots, one small number for each bucket of about four keys."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)
        if len(np.unique(h)) != n:
            raise ValueError("keys repeat")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        shift = np.zeros(self.buckets, np.int64)
        slot_of, free = np.full(n, -1, np.int64), np.ones(n, bool)
        sizes = np.diff(starts)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[starts[b] : starts[b + 1]]
            first = 0
            while True:
                tries = np.arange(first, first + 64)
                slots = self._slots(h[own][None, :], tries[:, None])
                fits = free[slots].all(axis=1)
                for t in np.flatnonzero(fits):
                    if len(np.unique(slots[t])) == len(own):
                        break
                else:
                    first += 64
                    continue
                shift[b], slot_of[own] = tries[t], slots[t]
                free[slots[t]] = False
                break
        rest = np.flatnonzero(free)
        alone = order[starts[:-1][sizes == 1]]
        slot_of[alone], shift[bucket[alone]] = rest[: len(alone)], -1 - rest[: len(alone)]
        self.shift = shift
        self.key_at = np.empty(n, np.int64)
        self.key_at[slot_of] = np.arange(n)

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + shift.astype(np.uint64) * np.uint64(_STEP)) % np.uint64(self.n)).astype(np.int64)

    def index(self, keys: list[bytes]) -> np.ndarray:
        """Of each key, the one place where it can be among the keys given first; the caller compares the key there."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[np.where(shift < 0, -1 - shift, self._slots(h, np.maximum(shift, 0)))]


@cache
def _ranges(name: str) -> str:
    """The characters of a Unicode property below U+10000, as the inside of a character class."""
    runs = regex.finditer(rf"[{name}]+", "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000))))
    return "".join(rf"\u{ord(m[0][0]):04x}-\u{ord(m[0][-1]):04x}" for m in runs)


def spelled_out(pattern: str) -> str:
    """A pattern for the standard library's matcher, which is faster but knows no properties, in texts below U+10000."""
    inside, out = False, []
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern):
        inside = part == "[" or inside and part != "]"
        name = {r"\s": r"\p{White_Space}", r"\S": r"\p{White_Space}"}.get(part, part)
        if name.startswith(r"\p"):
            part = _ranges(name) if inside else ("[^" if part == r"\S" else "[") + _ranges(name) + "]"
        out.append(part)
    return "".join(out)


class ByteBPE:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, tokens: dict[bytes, int], pattern: str):
        self.rank = tokens
        self.vocabulary, self.ranks = list(tokens), list(tokens.values())
        self.bytes_of = {r: t for t, r in tokens.items()}
        self.perfect = PerfectHash(self.vocabulary)
        self.fast = re.compile(spelled_out(pattern))
        # the library's \s is Unicode's White_Space
        self.general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # of a pre-token: the decimals of its ids, and the bytes that the ids decode to; plain values, which the
        # interpreter's cycle collector passes over
        self.known: dict[str, str] = {}
        self.plain: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)

    def merged(self, piece: bytes) -> list[int]:
        """Ranks of a pre-token by repeated merges of the lowest-ranked neighbours, leftmost first.

        An entry of the heap is one number: rank, start and stop of a pair of neighbouring segments.
        """
        n, rank = len(piece), self.rank.get
        bits = n.bit_length()
        low, both = (1 << bits) - 1, 2 * bits
        end = list(range(1, n + 1))  # of the segment that starts here; 0: merged into an earlier one
        end.append(0)
        before = list(range(-1, n))  # start of the segment before the one that starts here
        heap = [r << both | i << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            stop, i = entry & low, entry >> bits & low
            middle = end[i]
            if not middle or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                last = end[stop]
                if (r := rank(piece[i:last])) is not None:
                    heappush(heap, r << both | i << bits | last)
            if i:
                first = before[i]
                if (r := rank(piece[first:stop])) is not None:
                    heappush(heap, r << both | first << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]))
            i = end[i]
        return out

    def learn(self, tokens: list[str]) -> None:
        """Put each of tokens into the table of known ones."""
        new = set(tokens).difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:  # what isn't asked for again until the next time is forgotten then
            self.older, self.known, self.plain = (self.known, self.plain), {}, {}
            new = set(tokens)
        known, plain = self.known, self.plain
        decimals, parts = self.older
        for t in new:
            if t in decimals:
                known[t], plain[t] = decimals[t], parts[t]
        new = list(new.difference(known))
        pieces = [t.encode("utf-8", "replace") for t in new]
        for token, piece, at in zip(new, pieces, self.perfect.index(pieces).tolist(), strict=True):
            whole = self.vocabulary[at]
            ids = [self.ranks[at]] if whole == piece else self.merged(piece)
            known[token], plain[token] = " ".join(map(str, ids)), self.decode(ids)

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        pattern = self.general if BEYOND.search(text) else self.fast
        if len(text) < LONG_TEXT:
            yield pattern.findall(text)
        else:
            found = (m[0] for m in pattern.finditer(text))
            while chunk := list(islice(found, CHUNK)):
                yield chunk

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for chunk in self.pre_tokens(text or ""):
            self.learn(chunk)
            ids += map(int, " ".join(map(self.known.__getitem__, chunk)).split())
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of their decimals joined by spaces, and sha256 of the bytes that they decode to."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for chunk in self.pre_tokens(text or ""):
            if chunk:
                self.learn(chunk)
                decimals = " ".join(map(self.known.__getitem__, chunk))
                of_ids.update(((" " if n else "") + decimals).encode())
                of_bytes.update(b"".join(map(self.plain.__getitem__, chunk)))
                n += decimals.count(" ") + 1
        return n, of_ids.hexdigest(), of_bytes.hexdigest()


_LOADED: dict[tuple, ByteBPE] = {}


def _coder(shared) -> ByteBPE:
    """The worker's own coder of a broadcast (tokens, pattern, name)."""
    tokens, pattern, name = shared.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = ByteBPE(tokens, pattern)
    return _LOADED[name]


def _share(df: DataFrame, path: str, pattern: str):
    """The vocabulary, read once on the driver: a file of under a megabyte that does not grow with the documents."""
    coder = ByteBPE.from_file(path, pattern)
    return df.sparkSession.sparkContext.broadcast((coder.rank, pattern, (path, pattern)))


def token_digests(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of documents.

    A null text counts as empty: no ids, and the digests of nothing. Rows that repeat are encoded each; other columns
    are ignored; an empty table gives no rows.
    """
    docs = with_id(documents, id_col, text_col)
    shared = _share(docs, path, pattern)

    def run(ids: list, texts: list) -> dict:
        coder = _coder(shared)
        n, of_ids, of_bytes = zip(*map(coder.digest, texts), strict=True)
        return {"doc_id": ids, "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

    return map_columns(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_documents(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of documents; a null text has no ids."""
    docs = with_id(documents, id_col, text_col)
    shared = _share(docs, path, pattern)

    def run(doc_ids: list, texts: list) -> dict:
        coder = _coder(shared)
        ids = [np.array(coder.encode(t), np.int32) for t in texts]
        return {"doc_id": doc_ids, "n_tokens": list(map(len, ids)), "ids": ids}

    return map_columns(docs, run, "doc_id long, n_tokens long, ids array<int>")


def decoded_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); ids that don't end on a character give U+FFFD there; null ids, an empty text."""
    shared = _share(encoded, path, pattern)

    def run(doc_ids: list, ids: list) -> dict:
        coder = _coder(shared)
        return {"doc_id": doc_ids, "text": [coder.decode(x or []).decode("utf-8", "replace") for x in ids]}

    return map_columns(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
