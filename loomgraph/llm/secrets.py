"""Secret scans (operator 9): base patterns, and corpus-wide ownership of what they and wider patterns find.

One pass over the texts finds candidates. Their hashes are then aggregated over the corpus by distinct repositories
and owners: a string that many owners or many repositories have is an example that was copied around, one that a few
repositories of a single owner have looks live. Spans of the base patterns always stay; spans of the wider pattern are added where ownership makes them look
live. Here a document is a repository and its source the owner; both columns are parameters.
"""

from __future__ import annotations

import hashlib
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, map_columns

#: Kinds in the order of the spans, the base ones first.
KINDS = ["assign", "access", "hex", "key"]

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider candidates: known token shapes, and long mixed strings.
WIDER = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|AIza[A-Za-z0-9_-]{35}|[A-Za-z0-9+/_-]{32,})")

ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

#: A value of this many owners or more, or of this many repositories or more whoever owns them, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10


def mixed(value: str) -> bool:
    """Whether a string has a capital, a small letter and a digit, and many different characters."""
    return len(set(value)) >= 12 and bool(re.search("[A-Z]", value) and re.search("[a-z]", value) and re.search("[0-9]", value))


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, index of the kind, end, value) of a whole text, in order; code points, end exclusive.

    Wider candidates that overlap a base span are that span, so they are not repeated.
    """
    if not text:
        return []
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    k, reach = 0, 0
    for m in WIDER.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start() and (not re.fullmatch("[A-Za-z0-9+/_-]+", m[0]) or "_" in m[0][:8] or mixed(m[0])):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def secret_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_key, n_live, n_example) for each row of documents.

    n_key counts the added spans, n_live the spans in `spans` whose value fewer than EXAMPLE_OWNERS owners and fewer
    than EXAMPLE_REPOSITORIES repositories have, n_example the others. A null text counts as empty: no spans, and the digest of the empty string. A null owner
    counts as one owner, a null repository as one repository. Repeated rows are reported each, but count once
    towards ownership; other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"),
    )

    def scan(rows: list, ids: list, repositories: list, owners: list, texts: list) -> dict:
        found = [candidates(t) for t in texts]
        base = [[c for c in x if c[1] < 3] for x in found]
        counts = [[sum(c[1] == k for c in x) for x in base] for k in range(3)]
        return {
            "row": rows, "doc_id": ids, "repository": [r or "" for r in repositories], "owner": [o or "" for o in owners],
            "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_sha256": [hashlib.sha256(_joined([c[:3] for c in x]).encode()).hexdigest() for x in base],
            "found": [[{"start": s, "kind": k, "end": e, "value": xxhash.xxh3_64_intdigest(v.encode("utf-8", "replace")) - 2**63} for s, k, e, v in x] for x in found],
        }

    schema = "row long, doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:bigint,kind:bigint,end:bigint,value:bigint>>"
    scanned = checkpointed(map_columns(docs, scan, schema))
    # distinct counts go by value and owner or repository first, so that a value that fills the corpus is counted in parts
    each = scanned.select("row", "repository", "owner", F.explode("found").alias("c"))
    owned = each.groupBy(F.col("c.value").alias("value")).agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    widely = owned.where((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)).select("value", F.lit(True).alias("example"))
    known = each.select("row", "c.*").join(widely, "value", "left").withColumn("example", F.coalesce("example", F.lit(False)))
    known = known.where("kind < 3 OR NOT example")
    per_row = known.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        F.sum((F.col("kind") == 3).cast("long")).alias("n_key"),
        F.sum((~F.col("example")).cast("long")).alias("n_live"),
        F.sum(F.col("example").cast("long")).alias("n_example"),
    )
    label = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), (x["kind"] + 1).cast("int")), x["start"], x["end"])), ",")
    out = scanned.drop("found").join(per_row, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(label, F.lit("")).alias("spans"),
        *(F.coalesce(c, zero).alias(c) for c in ("n_key", "n_live", "n_example")),
    )
