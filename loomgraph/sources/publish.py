"""Tables that are replaced as a whole: a new version is staged, then a manifest that names it is swapped in.

A table is a folder with `versions/` and a file `manifest.json`. A version is complete before the manifest names it, and the
manifest is renamed over the old one in one step, so readers see the old table or the new one, and a run that is
killed at any point leaves the old one. Old versions stay until `retire` removes them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Names and renames in the file system of a path, whichever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def swap(self, old: str, new: str) -> None:
        """Rename old over new, in one step where the file system has one."""
        context = self.hadoop.FileContext.getFileContext(self.path("").toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(self.path(old)), context.makeQualified(self.path(new)), options)

    def files(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't be renamed to {new}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the table's manifest says: version, params and rows; None where there is no table."""
    store = Store(spark, path)
    return json.loads(store.read("manifest.json")) if store.exists("manifest.json") else None


def read_published(spark: SparkSession, path: str) -> DataFrame:
    now = manifest(spark, path)
    if now is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/versions/{now['version']}")


def publish(df: DataFrame, path: str, params: dict | None = None, force: bool = False) -> bool:
    """Write df as the table's new version; False, and nothing done, if there is a table already and not `force`."""
    spark = df.sparkSession
    if not force and manifest(spark, path) is not None:
        return False
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    store = Store(spark, path)
    rows = spark.read.parquet(f"{path}/versions/{version}").count()
    store.write(f"manifest-{version}.json", json.dumps({"version": version, "params": params or {}, "rows": rows}, ensure_ascii=False, sort_keys=True))
    store.swap(f"manifest-{version}.json", "manifest.json")
    return True


def retire(spark: SparkSession, path: str) -> int:
    """Remove the versions that the manifest doesn't name, once no reader needs them; their number."""
    store, now = Store(spark, path), manifest(spark, path)
    old = [v for v in store.files("versions") if now is None or v != now["version"]]
    for v in old:
        store.remove(f"versions/{v}")
    return len(old)


def append_distinct(new: DataFrame, path: str, subset: list[str] | None = None) -> None:
    """Add new rows to the table, each once: by all columns, or the first of each `subset`.

    A row of the table stays before a new one of the same key; of several new ones the smallest. The same append again
    changes nothing. Columns that only one side has are null in the other.
    """
    spark = new.sparkSession
    if manifest(spark, path) is None:
        both = new.withColumn("__new", F.lit(1))
    else:
        both = read_published(spark, path).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "__new"]
    if subset is None:
        out = both.select(*columns).distinct()
    else:
        row = F.struct(*columns)
        out = both.groupBy(*(F.col(c).alias(f"__{c}") for c in subset)).agg(F.min_by(row, F.struct("__new", row)).alias("r")).select("r.*")
    publish(out, path, force=True)


def cached(spark: SparkSession, path: str, params: dict, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table for these parameters, built if it isn't there: each set of parameters has a folder of its own."""
    key = hashlib.sha256(json.dumps(params, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()[:24]
    at = f"{path}/{key}"
    if force or manifest(spark, at) is None:
        publish(build(), at, params, force=True)
    return read_published(spark, at)
