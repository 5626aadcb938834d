"""Records of one very large JSON document, read by as many tasks as it has blocks.

Spark reads the document in pieces that end at a closing brace. What such a brace means, the end of an object or a character of a
string, depends on all that comes before, so a first pass finds for each block what it does to either state at its start: by how
much it changes the depth, whether it ends in a string, and which keys it leaves. A few numbers for each block are put together in
order; then each block knows where it begins, and a second pass cuts out the records. One that spans blocks is joined from its parts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGN = re.compile(r'"|\\.|[{}\[\]]', re.S)


class _Scan:
    """A walk over pieces of a document from a state: depth of brackets, inside a string or not."""

    def __init__(self, depth: int = 0, inside: bool = False):
        self.depth, self.inside, self.least = depth, inside, depth
        self.words: dict[int, str] = {}  # the last string at each depth
        self.first: str | None = None

    def signs(self, piece: str) -> Iterator[tuple[str, int]]:
        """(bracket, place after it) of the brackets outside strings, once they count."""
        start = 0
        for m in _SIGN.finditer(piece):
            c = m[0]
            if self.inside:
                if c == '"':
                    self.inside = False
                    self.words[self.depth] = piece[start : m.start()]
            elif c == '"':
                self.inside, start = True, m.end()
            elif c[0] != "\\":
                self.first = self.first or c
                self.depth += 1 if c in "{[" else -1
                self.least = min(self.least, self.depth)
                if c in "}]":
                    self.words.pop(self.depth + 1, None)
                yield c, m.end()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, start of the block), piece) of each row."""
    for batch in batches:
        for file, start, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield (file, start), piece + "}"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, scans = None, []

    def row() -> pa.RecordBatch:
        told = [{"depth": s.depth, "inside": s.inside, "least": s.least, "first": s.first, "words": {str(k): v for k, v in s.words.items()}} for s in scans]
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([json.dumps(told)])], names=["file", "start", "effect"])

    for at, piece in _blocks(batches):
        if at != now:
            if now:
                yield row()
            now, scans = at, [_Scan(), _Scan(inside=True)]
        for s in scans:
            for _ in s.signs(piece):
                pass
    if now:
        yield row()


def _starts(effects: list) -> dict[tuple[str, int], dict]:
    """For each block where it begins: depth, inside a string, key, depth around records, and the block where an open record began."""
    out, state, file = {}, {}, None
    for r in sorted(effects, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, state = r.file, {"depth": 0, "inside": False, "key": None, "around": None, "open": None}
        effect = json.loads(r.effect)[int(state["inside"])]
        if state["around"] is None and effect["first"]:
            state["around"] = 2 if effect["first"] == "{" else 1
        out[r.file, r.start] = dict(state)
        depth, around = state["depth"] + effect["depth"], state["around"] or 2
        passed = state["depth"] + effect["least"] <= around
        state["open"] = None if depth <= around else r.start if passed or state["depth"] <= around else state["open"]
        state["key"] = effect["words"].get(str(1 - state["depth"]), state["key"] if 1 - state["depth"] <= effect["least"] or state["depth"] > 0 else None)
        state |= {"depth": depth, "inside": effect["inside"]}
    return out


def json_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, record) of JSON documents: each object in an array that is a key's value in the document, or in the document itself,
    which is then an array; the key is null there.

    Values that aren't objects are passed over. A top-level key has no closing brace in it. An empty document has no records.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    effects = pieces.mapInArrow(_effects, "file string, start long, effect string").collect()  # a row for each block
    shared = spark.sparkContext.broadcast(_starts(effects))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, scan, parts, key, around, opened = None, None, [], None, 2, None

        def full(force: bool = False) -> Iterator[pa.RecordBatch]:
            if rows and (force or len(rows) >= 1000):
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "key", "open", "start", "text"])
                rows.clear()

        for at, piece in _blocks(batches):
            if at != now:
                if now and parts:
                    rows.append((now[0], key, now[1] if opened is None else opened, now[1], "".join(parts)))
                if at not in shared.value:
                    raise RuntimeError("the document was split in another way than before; read it again")
                begin, now = shared.value[at], at
                scan, key, around, opened = _Scan(begin["depth"], begin["inside"]), begin["key"], begin["around"] or 2, begin["open"]
                parts = [] if begin["depth"] <= around else [""]
            last = 0
            for c, end in scan.signs(piece):
                if c == "{" and scan.depth == around + 1:
                    parts, last, opened = [""], end - 1, None
                    key = scan.words.get(1, key) if around == 2 else None
                elif c == "}" and scan.depth == around and parts:
                    parts.append(piece[last:end])
                    rows.append((now[0], key, opened, now[1], "".join(parts)))
                    parts, opened = [], None
                elif c == "[" and scan.depth == 2 and around == 2:
                    key = scan.words.get(1, key)
            if parts:
                parts.append(piece[last:])
            yield from full()
        if now and parts:
            rows.append((now[0], key, now[1] if opened is None else opened, now[1], "".join(parts)))
        yield from full(True)

    found = pieces.mapInArrow(cut, "file string, key string, open long, start long, text string")
    whole = found.where("open IS NULL").select("file", "key", F.col("text").alias("record"))
    spanning = found.where("open IS NOT NULL").groupBy("file", "open").agg(F.min_by("key", "start").alias("key"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("record"))
    return whole.unionByName(spanning.where(F.rtrim("record").endswith("}")).select("file", "key", "record"))  # one record's blocks
