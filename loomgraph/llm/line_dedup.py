"""Line dedup (operator 2) by winnowing, in DataFrame functions alone.

A document is the sequence of its lines that are not blank, each as the hash of the line without spaces at its
ends. A window starts at every line and has as many lines as make WORDS words, WINDOW lines at most: a long line is a
window alone. Of every window the smallest hash is selected as a fingerprint; windows next to each other mostly select
the same position, so that fewer positions are posted than there are windows, and yet no repeated run of WINDOW lines,
or of WORDS words in whole lines, can lack a common fingerprint. Fingerprints that occur once are dropped. The others
are joined with their positions in the windows that selected them: the match is extended to both sides as far as these
windows agree, and each window is compared with its first place in the corpus, in the order of the documents and lines;
its key has 128 bits, from two hashes of every line, so that no two texts of any real corpus share one.
Windows after their first place are put together into maximal runs, and the lines of these runs are deleted.

A fingerprint or window that fills the corpus is never joined with itself: first places are aggregated, in part where
the rows are, and every occurrence is joined with one of them; that join's sides can be split where a key is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written

#: Lines of a window at most, and words that make a window of fewer: repeated runs of so many lines, or of so many words
#: in whole lines, are found for certain; shorter ones stay.
WINDOW = 3
WORDS = 50

_BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with h: rows that repeat a doc_id are told apart by their texts."""
    return docs.withColumn("h", F.xxhash64("text"))


def _fingerprints(docs: DataFrame) -> DataFrame:
    """(f, doc_id, h, own): a posted position, and the windows (first line, last line, two independent hashes) that selected it."""
    bare = F.transform(_lines(F.col("text")), lambda x, i: F.struct(F.btrim(x, F.lit(_BLANKS)).alias("t"), i.alias("at")))
    count = lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    full = F.transform(F.filter(bare, lambda x: x["t"] != ""), lambda x, i: F.struct(F.xxhash64(x["t"]).alias("h"), (-i).alias("k"), F.xxhash64(F.lit(1), x["t"]).alias("g"), x["at"].alias("at"), count(x["t"]).alias("n")))
    docs = _keyed(docs.where("doc_id IS NOT NULL")).select("doc_id", "h", full.alias("seq")).where(F.size("seq") > 0)

    def window(s: Column) -> Column:
        words = lambda k: F.coalesce(F.get(F.col("seq"), s + k)["n"], F.lit(0))
        size = F.lit(WINDOW)
        for k in range(WINDOW - 1, 0, -1):
            size = F.when(sum((words(j) for j in range(1, k)), words(0)) >= WORDS, k).otherwise(size)
        part = F.slice("seq", s + 1, size)
        least = F.array_min(part)  # of equal hashes the last
        key = lambda c: F.xxhash64(F.transform(part, lambda x: x[c]))
        return F.struct(
            least["h"].alias("f"), (-least["k"]).alias("p"), part[0]["at"].alias("first"), F.element_at(part, -1)["at"].alias("last"), key("h").alias("w"), key("g").alias("v"), (F.size(part) == size).alias("whole"),
        )

    windows = F.transform(F.sequence(F.lit(0), F.size("seq") - 1), window)
    docs = docs.select("doc_id", "h", F.filter(windows, lambda x: x["whole"]).alias("windows"))  # only the last can be in part

    def posting(p: Column) -> Column:
        start = F.greatest(p - (WINDOW - 1), F.lit(0))
        own = F.filter(F.slice("windows", start + 1, F.lit(WINDOW)), lambda x: x["p"] == p)
        return F.struct(own[0]["f"].alias("f"), F.transform(own, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["w"].alias("w"), x["v"].alias("v"))).alias("own"))

    posted = F.transform(F.array_distinct(F.col("windows")["p"]), posting)
    return docs.select("doc_id", "h", F.explode(posted).alias("x")).select("x.f", "doc_id", "h", "x.own")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, h, runs) of docs (doc_id, text): the later repeated runs (first, last) of lines, for documents that have any."""
    posts = written(_fingerprints(docs), "fingerprints")  # read twice; Parquet takes less room than a checkpoint
    often = posts.groupBy("f").count().where("count > 1").select("f")
    return _runs(written(posts.join(often, "f").select("doc_id", "h", F.explode("own").alias("x")).select("doc_id", "h", "x.*"), "windows"))


def _runs(windows: DataFrame) -> DataFrame:
    """repeated_runs of windows (doc_id, h, first, last, w, v): those equal in both hashes have the same lines."""
    at = F.struct("doc_id", "h", "first")
    start = windows.groupBy("w", "v").agg(F.min(at).alias("start"), F.max(at).alias("end")).where("start < end").select("w", "v", "start")
    later = windows.join(start, ["w", "v"]).where(at > F.col("start")).select("doc_id", "h", "first", "last").distinct()
    by = Window.partitionBy("doc_id", "h").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1)))
    later = later.withColumn("run", F.sum("new").over(by))
    runs = later.groupBy("doc_id", "h", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _with_runs(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """documents with the column __runs."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = repeated_runs(docs).select(F.col("doc_id").alias("__run_id"), F.col("h").alias("__run_h"), F.col("runs").alias("__runs"))
    same = (documents[id_col].cast("long") == F.col("__run_id")) & (F.xxhash64(documents[text_col].cast("string")) == F.col("__run_h"))
    return documents.join(runs, same, "left").drop("__run_id", "__run_h")


def _kept(text: Column) -> Column:
    outside = lambda x, i: ~F.exists("__runs", lambda r: (r["first"] <= i) & (i <= r["last"]))
    return F.array_join(F.filter(_lines(text), outside), "\n")


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """documents with their later repeated runs of lines deleted, and length_col, if there, set to the new length.

    A document that only repeated others has an empty text afterwards. The first place of every line stays: each
    deleted line has an equal one before it. In a text that repeats itself without a break, one period stays. Null and
    empty texts, and rows without an id, are unchanged. Rows that repeat a doc_id and its text count as one document; with
    differing texts they are several, in the order of the texts' hashes. Other columns are passed on.
    """
    out = _with_runs(documents, id_col, text_col)
    cut = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(_kept(F.col(text_col)))
    out = out.withColumn(text_col, cut)
    if length_col in documents.columns:
        length = F.when(F.col("__runs").isNull(), F.col(length_col)).otherwise(F.length(text_col))
        out = out.withColumn(length_col, length.cast(documents.schema[length_col].dataType))
    return out.select(documents.columns)


def line_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_deleted, text_sha256) of each document after dedup_lines; a null text has one empty line."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _with_runs(docs, "doc_id", "text")
    deleted = F.aggregate(F.coalesce("__runs", F.expr("array()")), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    text = F.when(F.col("__runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(_kept(F.col("text")))
    return out.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"), F.sha2(text, 256).alias("text_sha256"))


LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents
), n AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), z AS (
  SELECT *, len(regexp_extract_all(t, '[^ \t-\r]+')) AS c FROM n
), v AS (
  SELECT *, CASE WHEN c >= 50 THEN 1 WHEN c + coalesce(lead(c, 1) OVER d, 0) >= 50 THEN 2 ELSE 3 END AS k FROM z WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), w AS (
  SELECT doc_id, pos AS "first", CASE k WHEN 1 THEN pos WHEN 2 THEN lead(pos, 1) OVER d ELSE lead(pos, 2) OVER d END AS "last",
         CASE k WHEN 1 THEN t WHEN 2 THEN t || chr(10) || lead(t, 1) OVER d ELSE t || chr(10) || lead(t, 1) OVER d || chr(10) || lead(t, 2) OVER d END AS g
  FROM v WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), f AS (
  SELECT doc_id, "first", "last", row_number() OVER (PARTITION BY g ORDER BY doc_id, "first") AS r FROM w WHERE "last" IS NOT NULL
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM l JOIN f ON l.doc_id = f.doc_id AND l.pos BETWEEN f."first" AND f."last" WHERE f.r > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '')) AS text_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos
GROUP BY l.doc_id
"""
