"""URL filters (operator 5): a blocked Bloom filter before an exact hash join.

Listed URLs are canonical prefixes, host and path. Every page asks for the few prefixes that could list it: the
suffixes of its host with the directories of its path, as far as the list's longest entries reach. A blocked Bloom filter of the list, one cache line a key,
drops nearly all of these at the scan; possible hits go to an exact join with the list, which removes the filter's
false positives. The filter's bits are aggregated block by block in Spark and its size is bounded; beyond the bound
it lets more through and the join decides as before.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, map_columns, mix

#: Words of 64 bits in a block; each key sets one bit of each. Blocks for each listed key, and blocks at most (16 MB).
LANES = 8
KEYS_PER_BLOCK = 24
MAX_BLOCKS = 1 << 18

#: Rules of host and path: the longest that fits decides. Fixed values.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: Unwanted sites of the example list. Fixed values.
LISTED_NAMES = ["cheap-pills", "casino-win", "adult-x"]
LISTED_ZONES = ["example.com", "example.net", "example.org"]

_UPPER = {i: i + 32 for i in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path from there up to `?`, `#` or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = re.search("[/?#]", rest)
    host, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    return host.translate(_UPPER), re.split("[?#]", tail, maxsplit=1)[0]


def _site(host: str) -> str:
    """A host without user info, port and dots at its ends."""
    return host.rpartition("@")[2].split(":")[0].strip(".")


def canonical(url: str | None) -> str | None:
    """The prefix that a listed URL stands for: its host without user info or port, and its path. Without a host, none."""
    host, path = host_and_path(url if "://" in (url or "") else f"http://{url or ''}")
    name = _site(host)
    return name + (path or "/") if name else None


def lookups(host: str, path: str, labels: int | None = None, chars: int | None = None) -> list[str]:
    """The canonical prefixes that would list a page: suffixes of its host with its path and the directories of that.

    Hosts of more labels and paths of more characters than any entry of the list has are left out.
    """
    names = _site(host).split(".")
    if not names[-1]:
        return []
    path = path or "/"
    reach = len(path) if chars is None else min(len(path), chars)
    ends = {1, *(m.end() for m in re.finditer("/", path[:reach])), *([len(path)] if len(path) <= reach else [])}
    first = 0 if labels is None else max(0, len(names) - labels)
    return [".".join(names[k:]) + p for k in range(first, len(names)) for p in dict.fromkeys("/" if e == 1 else path[:e] for e in sorted(ends))]


def rule_of(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[str, str] | tuple[None, None]:
    """The longest rule that fits; of equally long ones the first."""
    best: tuple = (None, None)
    for rule, verdict in rules:
        of, _, start = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + start) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each key hash: its block, and the bit in each of the block's words."""
    lane = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = mix(keys[:, None] ^ lane[None, :]) & np.uint64(63)
    return (keys % np.uint64(blocks)).astype(np.int64), np.uint64(1) << bits


def _hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k.encode("utf-8", "replace")) for k in keys), np.uint64, len(keys))


def bloom_filter(listed: DataFrame) -> np.ndarray:
    """Words (blocks, LANES) of the filter of listed (key). Bits are joined in Spark; MAX_BLOCKS bounds what comes back."""
    blocks = min(MAX_BLOCKS, 1 + listed.count() // KEYS_PER_BLOCK)

    def run(keys: list) -> dict:
        block, bits = _places(_hashes(keys), blocks)
        return {"block": block} | {f"w{k}": bits[:, k].view(np.int64) for k in range(LANES)}

    rows = map_columns(listed.select("key"), run, "block long, " + ", ".join(f"w{k} long" for k in range(LANES)))
    words = np.zeros((blocks, LANES), np.uint64)
    for row in rows.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LANES))).toLocalIterator():
        words[row.block] = np.array(row[1:], np.int64).view(np.uint64)
    return words


def possible(words: np.ndarray, keys: list[str]) -> np.ndarray:
    """Whether each key may be listed; never false for a listed one."""
    block, bits = _places(_hashes(keys), len(words))
    return ((words[block] & bits) != 0).all(axis=1)


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed_as) for each row of pages.

    verdict is the longest fitting rule's, else block if the list has a prefix of the page's URL, else allow.
    listed_as is the smallest such prefix, or null. A null URL, or one without `://`, has an empty host and path and is
    allowed. Repeated rows each get their verdict, as do rows without an id; repeated or null entries of listed
    (url) change nothing; other columns are ignored. Empty tables work.
    """

    def keys(urls: list) -> dict:
        return {"key": [canonical(u) for u in urls]}

    exact = map_columns(listed.select(F.col(url_col if url_col in listed.columns else listed.columns[0]).cast("string")), keys, "key string").dropna().distinct()
    exact = checkpointed(exact)
    host = F.substring_index("key", "/", 1)
    most = exact.agg(F.max(F.size(F.split(host, r"\."))).alias("labels"), F.max(F.length("key") - F.length(host)).alias("chars")).first()
    labels, chars = most.labels or 0, most.chars or 0
    words = pages.sparkSession.sparkContext.broadcast(bloom_filter(exact))

    def judge(ids: list, urls: list) -> dict:
        split = [host_and_path(u) for u in urls]
        asked = [lookups(*x, labels, chars) for x in split]
        flat = [k for x in asked for k in x]
        hit = iter(possible(words.value, flat).tolist() if flat else [])
        found = [rule_of(*x, rules) for x in split]
        return {
            "page_id": ids, "host": [h for h, _ in split], "path": [p for _, p in split], "rule": [r for r, _ in found], "verdict": [v for _, v in found],
            "maybe": [[k for k in x if next(hit)] for x in asked],
        }

    judged = map_columns(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")), judge, "page_id long, host string, path string, rule string, verdict string, maybe array<string>")
    judged = checkpointed(judged)
    # a URL that many pages have is looked up once
    asked = judged.where(F.size("maybe") > 0).select("host", "path", F.explode("maybe").alias("key")).distinct()
    listed = asked.join(exact, "key").groupBy("host", "path").agg(F.min("key").alias("listed_as"))
    clean = judged.where(F.size("maybe") == 0).withColumn("listed_as", F.lit(None).cast("string"))
    out = judged.where(F.size("maybe") > 0).join(listed, ["host", "path"], "left").select(*clean.columns).union(clean)
    verdict = F.coalesce("verdict", F.when(F.col("listed_as").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed_as")


def example_list(df: DataFrame) -> DataFrame:
    """The list of the query: every unwanted name in every zone."""
    return df.sparkSession.createDataFrame([(f"http://{n}.{z}/",) for n in LISTED_NAMES for z in LISTED_ZONES], "url string")
