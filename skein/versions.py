"""Bucketed versions of tables under a folder, made current by one rename.

A version is a manifest: for each part (a table) its number of buckets and the folder of each bucket that holds rows. A writer replaces the buckets it
touches and keeps the folders of the others, so that a small change rewrites little. It publishes under the number after the one
it has read; if another writer was faster this fails, and nothing is lost. Readers see one manifest, never a mixture.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP = 3  # versions that stay readable


class Conflict(RuntimeError):
    """Another writer has published since the version was read."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, store: str) -> list[int]:
    fs, root = _fs(spark, store), spark._jvm.org.apache.hadoop.fs.Path(store)
    if not fs.exists(root):
        return []
    names = (p.getPath().getName() for p in fs.listStatus(root))
    return sorted(int(n[8:]) for n in names if n.startswith("CURRENT-"))


def _manifest(spark: SparkSession, store: str, number: int) -> dict:
    stream = _fs(spark, store).open(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/CURRENT-{number:012d}"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, store: str) -> tuple[int, dict]:
    """(number, manifest) of the current version; (0, {}) before the first."""
    numbers = _numbers(spark, store)
    return (numbers[-1], _manifest(spark, store, numbers[-1])) if numbers else (0, {})


def publish(spark: SparkSession, store: str, read: int, manifest: dict) -> int:
    """Make the manifest the version after the one that was read; Conflict if there is one already."""
    fs, hpath = _fs(spark, store), spark._jvm.org.apache.hadoop.fs.Path
    staged, final = hpath(f"{store}/.staged-{uuid.uuid4().hex}"), hpath(f"{store}/CURRENT-{read + 1:012d}")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if (numbers := _numbers(spark, store)) and numbers[-1] > read or not fs.rename(staged, final):
        fs.delete(staged, False)
        raise Conflict(f"{store}: version {read + 1} is another writer's")
    _prune(spark, store)
    return read + 1


def _folders(manifest: dict) -> set[str]:
    return {folder.rpartition("/")[0] for part in manifest.values() for folder in part["folders"].values()}


def _prune(spark: SparkSession, store: str) -> None:
    """Delete manifests before the last KEEP, and the folders that only they name."""
    numbers = _numbers(spark, store)
    old, kept = numbers[:-KEEP], numbers[-KEEP:]
    if not old:
        return
    fs, hpath = _fs(spark, store), spark._jvm.org.apache.hadoop.fs.Path
    held = set().union(*(_folders(_manifest(spark, store, n)) for n in kept))
    for n in old:
        for folder in _folders(_manifest(spark, store, n)) - held:
            fs.delete(hpath(folder), True)
        fs.delete(hpath(f"{store}/CURRENT-{n:012d}"), False)


def bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write(df: DataFrame, store: str, part: str, key: list[str], buckets: int, order: list[str] | None = None) -> dict[str, str]:
    """Write rows by bucket of their key: the folder of each bucket that has rows."""
    root = f"{store}/{part}-{uuid.uuid4().hex}"
    rows = df.withColumn("_bucket", bucket(key, buckets)).repartition("_bucket").sortWithinPartitions("_bucket", *(order or []))
    return written(rows, root)


def written(rows: DataFrame, root: str) -> dict[str, str]:
    """The same of rows that have _bucket and lie by it."""
    rows.write.partitionBy("_bucket").parquet(root)
    spark = rows.sparkSession
    names = (p.getPath().getName() for p in _fs(spark, root).listStatus(spark._jvm.org.apache.hadoop.fs.Path(root)))
    return {n.partition("=")[2]: f"{root}/{n}" for n in names if n.startswith("_bucket=")}


def read(spark: SparkSession, manifest: dict, part: str, schema: T.StructType, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a part, of some buckets only if given."""
    folders = manifest.get(part, {}).get("folders", {})
    paths = [p for b, p in sorted(folders.items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched(keys: DataFrame, key: list[str], buckets: int) -> set[int]:
    """The buckets of some keys: at most as many rows as there are buckets."""
    return {r[0] for r in keys.select(bucket(key, buckets).alias("b")).distinct().collect()}
