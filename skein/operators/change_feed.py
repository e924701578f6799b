"""Current state of a table from a change feed that is delivered repeatedly, late and out of order.

Every key keeps the change with the largest sequence; the sequence is the number in the source cursor and, inside one
cursor, tombstones before upserts. The comparison is associative, so it runs twice with the same embedded DuckDB
upsert: over every input partition (so that a key with a third of all changes shrinks before the shuffle) and over
every bucket of keys. Tombstones stay in the state with their sequence, so that a late change cannot bring a key back. The times of
known cursors are kept too, and changes that no cursor is known for yet wait for a later delivery. Only the buckets
that a delivery touches are written anew, through Spark's committed write; one rename makes the new version current.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import runtime, versions

STATE = T.StructType([
    T.StructField("target_table", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("first_no", T.LongType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("row_json", T.StringType()),
    T.StructField("present", T.BooleanType()),
])
_COLUMNS = [f.name for f in STATE]
_ARROW = pa.schema([
    ("target_table", pa.string()), ("ref", pa.string()), ("seq", pa.int64()), ("phase", pa.int32()),
    ("first_no", pa.int64()), ("fingerprint", pa.string()), ("row_json", pa.string()), ("present", pa.bool_()), ("_bucket", pa.int32()),
])
_BUCKETED = T.StructType([*STATE, T.StructField("_bucket", T.IntegerType())])
CURSORS = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("seq", T.LongType())])
WAITING = T.StructType([T.StructField("at", T.TimestampType()), *[f for f in STATE if f.name != "seq"]])
KEY = ["target_table", "ref"]
BUCKET_ROWS, BUCKET_MEMORY = 200_000, "1GB"  # changes a bucket, and what DuckDB may take for one
_CREATE = """CREATE TABLE state (target_table VARCHAR, ref VARCHAR, seq BIGINT, phase INTEGER, first_no BIGINT,
    fingerprint VARCHAR, row_json VARCHAR, present BOOLEAN, PRIMARY KEY (target_table, ref))"""
# Of several upserts of a key in one cursor the one that was delivered last holds.
_UPSERT = """INSERT INTO state BY NAME
    SELECT * FROM incoming
    QUALIFY row_number() OVER (PARTITION BY target_table, ref ORDER BY seq DESC, phase DESC, first_no DESC, fingerprint DESC NULLS LAST) = 1
    ON CONFLICT (target_table, ref) DO UPDATE SET seq = excluded.seq, phase = excluded.phase, first_no = excluded.first_no,
        fingerprint = excluded.fingerprint, row_json = excluded.row_json, present = excluded.present
    WHERE (excluded.seq, excluded.phase, excluded.first_no) > (state.seq, state.phase, state.first_no)"""


def cursor_number(cursor: Column) -> Column:
    """The last number in a cursor, however the cursor is spelled; null where there is none."""
    return F.regexp_extract(cursor, r"([0-9]+)[^0-9]*$", 1).try_cast("bigint")


def parsed(changes: DataFrame) -> DataFrame:
    """Changes as STATE rows with `at`, whatever other columns the feed has. Rows without key or with an unknown change_type say nothing and are left out."""
    kind = F.lower(F.trim("change_type"))
    upsert = F.col("phase") == 1
    rows = changes.select(
        "target_table", "ref", cursor_number(F.col("source_cursor")).alias("seq"), F.coalesce("changed_at", "deleted_at").cast("timestamp").alias("at"),
        F.when(kind == "tombstone", 0).when(kind == "upsert", 1).cast("int").alias("phase"), F.coalesce("change_no", F.lit(0)).cast("long").alias("first_no"), "fingerprint", "row_json",
    ).where("target_table IS NOT NULL AND ref IS NOT NULL AND phase IS NOT NULL")
    return rows.withColumns({"fingerprint": F.when(upsert, F.col("fingerprint")), "row_json": F.when(upsert, F.col("row_json")), "present": upsert})


def cursors(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """at, seq: the cursor of every time, of the rows and of those known before."""
    pairs = rows.where("seq IS NOT NULL AND at IS NOT NULL").select("at", "seq")
    return (pairs if known is None else pairs.unionByName(known)).groupBy("at").agg(F.max("seq").alias("seq"))


def sequenced(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their sequence, rows that wait): a missing cursor is that of the row's time. Rows wait that have neither a cursor nor a time of a known one."""
    lost = rows.where("seq IS NULL").drop("seq")
    found = lost.join(known, "at")
    return rows.where("seq IS NOT NULL").select(*_COLUMNS).unionByName(found.select(*_COLUMNS)), lost.join(known.select("at"), "at", "left_anti").select(*WAITING.names)


def _upserted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One embedded DuckDB for each bucket of a task (its rows follow each other); before the shuffle all rows are of bucket -1."""
    import duckdb

    con, current, held = None, None, 0

    def state() -> Iterator[pa.RecordBatch]:
        result = con.sql(f"SELECT {', '.join(_COLUMNS)} FROM state").to_arrow_table()
        con.close()
        yield from result.append_column("_bucket", pa.array([current] * result.num_rows, pa.int32())).cast(_ARROW).to_batches(max_chunksize=10_000)

    for batch in batches:
        marks = batch.column(len(_COLUMNS)).to_numpy()
        edges = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)] if len(marks) and marks[0] != marks[-1] else [0, len(marks)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if con is not None and (marks[a] != current or marks[a] == -1 and held >= BUCKET_ROWS):
                yield from state()
                con = None
            if con is None:
                con, held = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": BUCKET_MEMORY}), 0
                con.execute(_CREATE)
            current, held = int(marks[a]), held + b - a
            con.register("incoming", pa.Table.from_batches([batch.slice(a, b - a)]).select(_COLUMNS))
            con.execute(_UPSERT)
            con.unregister("incoming")
    if con is not None:
        yield from state()


def merged_state(rows: DataFrame, buckets: int) -> DataFrame:
    """The winning change of every key, tombstones included, with its _bucket; rows lie by bucket."""
    partial = rows.select(*_COLUMNS, F.lit(-1).alias("_bucket")).mapInArrow(_upserted, _BUCKETED).withColumn("_bucket", versions.bucket(KEY, buckets))
    tasks = min(buckets, runtime.partitions(rows.sparkSession))
    return partial.repartition(tasks, "_bucket").sortWithinPartitions("_bucket").mapInArrow(_upserted, _BUCKETED)


def apply_changes(spark: SparkSession, changes: DataFrame, store: str, buckets: int | None = None) -> DataFrame:
    """Merge a delivery into the state kept under `store` and publish the new version at once.

    The state before takes part like changes, in the buckets the delivery touches; the other buckets stay where they are. The version is published under the
    number after the one that was read: if another delivery was applied meanwhile, versions.Conflict is raised and this one is to be applied again. Replaying a
    delivery changes nothing. An empty feed gives an empty state. The number of buckets is set with the first delivery, about BUCKET_ROWS changes each.
    """
    number, before = versions.current(spark, store)
    rows = parsed(changes)
    if not before:
        n = buckets or max(1, min(runtime.partitions(spark), rows.count() // 1000 + 1), -(-rows.count() // BUCKET_ROWS))
        known = runtime.materialize(cursors(rows), "cursors")
        placed, waiting = sequenced(rows, known)
        folders = versions.written(merged_state(placed, n), f"{store}/state-{runtime.unique()}")
    else:
        n = before["state"]["buckets"]
        rows = runtime.materialize(rows.unionByName(versions.read(spark, before, "waiting", WAITING).withColumn("seq", F.lit(None).cast("long"))), "changes")
        known = runtime.materialize(cursors(rows, versions.read(spark, before, "cursors", CURSORS)), "cursors")
        placed, waiting = sequenced(rows, known)
        hit = versions.touched(placed, KEY, n)
        fresh = versions.written(merged_state(placed.unionByName(versions.read(spark, before, "state", STATE, hit)), n), f"{store}/state-{runtime.unique()}") if hit else {}
        folders = before["state"]["folders"] | fresh
    after = {"state": {"buckets": n, "folders": folders}, "cursors": {"buckets": 1, "folders": versions.write(known, store, "cursors", ["at"], 1)}}
    after["waiting"] = {"buckets": 1, "folders": versions.write(waiting.distinct(), store, "waiting", KEY, 1)}
    versions.publish(spark, store, number, after)
    return published(spark, store)


def published(spark: SparkSession, store: str) -> DataFrame | None:
    """The state of the current version, or None before the first."""
    number, manifest = versions.current(spark, store)
    return versions.read(spark, manifest, "state", STATE) if number else None


def waiting(spark: SparkSession, store: str) -> DataFrame:
    """The changes that are not applied, as no cursor is known for them."""
    return versions.read(spark, versions.current(spark, store)[1], "waiting", WAITING)


def present_rows(state: DataFrame) -> DataFrame:
    return state.where("present").select("target_table", "ref", "fingerprint", "row_json")
