"""Versioned tables on a shared folder: a mutation writes the buckets it touches and publishes a new version at once; a writer that read an older one fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import schemas, versions


def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in the order; partial maxima before the shuffle. Order values must be comparable."""
    rest = [c for c in df.columns if c not in key and c not in order]
    comparable = [c for c in rest if not df.schema[c].dataType.typeName().startswith("map")]
    if len(comparable) == len(rest):
        best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
        return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]]).select(df.columns)
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order] or [F.lit(1)])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and the new ones whose key is new; of equal new keys one, the least."""
    fresh = new.join(old.select(*key).distinct(), key, "left_anti")
    w = Window.partitionBy(*key).orderBy(*[c for c in new.columns if not new.schema[c].dataType.typeName().startswith("map")])
    return old.unionByName(fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key is not new, and the new rows. new has one row a key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key).distinct(), key, "left_anti")


def changed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows that are not in old as they are (nulls equal): what an upsert would really write."""
    rest = [c for c in new.columns if c not in key]
    before = old.select(*key, F.struct(*rest).alias("_old"))
    rows = new.join(before, key, "left")
    return rows.where(F.col("_old").isNull() | ~F.struct(*rest).eqNullSafe(F.col("_old"))).drop("_old")


class Store:
    """Named tables under a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        """buckets: of a new table; each holds the rows a change of one key rewrites."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return versions.current(self.spark, self._path(name))[0] > 0

    def read(self, name: str) -> DataFrame:
        """The current version; empty if there is none."""
        return versions.read(self.spark, versions.current(self.spark, self._path(name))[1], name, schemas.TABLES[name].schema)

    def _write(self, name: str, df: DataFrame, number: int, buckets: int, kept: dict[str, str]) -> DataFrame:
        table = schemas.TABLES[name]
        folders = kept | versions.write(schemas.conform(df, name), self._path(name), name, list(table.key), buckets, list(table.partition))
        versions.publish(self.spark, self._path(name), number, {name: {"buckets": buckets, "folders": folders}})
        return self.read(name)

    def overwrite(self, name: str, df: DataFrame, read: int | None = None) -> DataFrame:
        """Replace all rows. read: the number of the version the rows were made from; versions.Conflict if it is current no more."""
        number = versions.current(self.spark, self._path(name))[0] if read is None else read
        return self._write(name, df, number, self.buckets, {})

    def number(self, name: str) -> int:
        return versions.current(self.spark, self._path(name))[0]

    def _changed(self, name: str, rows: DataFrame, key: list[str], how: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> DataFrame:
        """Rewrite the buckets of the rows' keys; all of them if the rows name only a part of the key."""
        number, manifest = versions.current(self.spark, self._path(name))
        part = manifest.get(name, {"buckets": self.buckets, "folders": {}})
        whole = key == list(schemas.TABLES[name].key)
        hit = versions.touched(rows, key, part["buckets"]) if whole else None
        kept = {b: f for b, f in part["folders"].items() if hit is not None and int(b) not in hit}
        if hit is not None and not hit and number:
            return self.read(name)
        old = versions.read(self.spark, manifest, name, schemas.TABLES[name].schema, hit)
        return self._write(name, how(old, rows, key), number, part["buckets"], kept)

    def append_new(self, name: str, df: DataFrame) -> DataFrame:
        return self._changed(name, schemas.conform(df, name), list(schemas.TABLES[name].key), insert_ignore)

    def merge(self, name: str, df: DataFrame) -> DataFrame:
        """Upsert by the key of the table; of several new rows of a key one."""
        key = list(schemas.TABLES[name].key)
        return self._changed(name, schemas.conform(df, name).dropDuplicates(key), key, upsert)

    def remove(self, name: str, keys: DataFrame) -> DataFrame:
        """Delete by the key of the table, or by those of its columns that keys has."""
        return self._changed(name, keys, [c for c in schemas.TABLES[name].key if c in keys.columns], delete)

    def drop(self, name: str) -> DataFrame:
        return self.overwrite(name, self.spark.createDataFrame([], schemas.TABLES[name].schema))

    def count(self, name: str) -> int:
        return self.read(name).count()

    def copy_to(self, other: Store) -> DataFrame:
        """A copy of all tables, and name, rows, copied, equal of each."""
        out = []
        for name in schemas.TABLES:
            if self.exists(name):
                rows = self.read(name)
                out.append((name, rows.count(), other.overwrite(name, rows).count()))
        return self.spark.createDataFrame(out or [], "name string, rows long, copied long").withColumn("equal", F.col("rows") == F.col("copied"))

    # feedback queue
    def submit_feedback(self, identifier: str, message: str, severity: str | None = None, context: str | None = None) -> DataFrame:
        """An unknown severity becomes null."""
        severity = severity if severity in ("low", "medium", "high", "critical") else None
        row = self.spark.createDataFrame([(identifier, "open", severity, message, context)], "id string, status string, severity string, message string, context string").withColumn("created_at", F.current_timestamp())
        return self.append_new("feedback", row)

    def open_feedback(self, limit: int = 50) -> DataFrame:
        return self.read("feedback").where(F.col("status").isin("open", "in_progress")).orderBy(F.desc("created_at"), "id").limit(limit)

    def set_feedback(self, identifier: str, status: str) -> DataFrame:
        if status not in ("open", "in_progress", "resolved", "wontfix"):
            raise ValueError(f"unknown status {status}")
        row = self.read("feedback").where(F.col("id") == identifier).withColumn("status", F.lit(status))
        return self.merge("feedback", row)

    def delete_feedback(self, identifier: str) -> DataFrame:
        return self.remove("feedback", self.spark.createDataFrame([(identifier,)], "id string"))

    def save_stats(self, values: dict[str, int]) -> DataFrame:
        return self.merge("stats", self.spark.createDataFrame(sorted(values.items()), "name string, value long"))

    def load_stats(self) -> dict[str, int]:
        """A row a statistic."""
        return {r.name: r.value for r in self.read("stats").collect()}
