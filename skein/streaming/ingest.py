"""Incremental ingestion: classify, apply in order, resume, debounce, watch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import tables
from skein.functions import text as T

#: The order in which a delta is applied, after all tombstones and before the checkpoint.
PHASES = ("documents", "source_units", "chunks", "chunk_file_bindings", "provenance", "bindings", "fingerprints", "embeddings", "vector_components", "nodes", "relations", "feedback")


def classify(units: DataFrame, known: DataFrame) -> DataFrame:
    """Units (namespace, document_ref, unit_ref, fingerprint, standalone_search) with class: hidden, new, changed or skipped."""
    key = ["namespace", "document_ref", "unit_ref"]
    rows = units.join(known.select(*key, F.col("fingerprint").alias("_f")), key, "left")
    cls = F.when(~F.coalesce("standalone_search", F.lit(True)), "hidden").when(F.col("_f").isNull(), "new").when(F.col("_f") != F.col("fingerprint"), "changed").otherwise("skipped")
    return rows.withColumn("class", cls).drop("_f")


def manifest(changed: DataFrame, removed: DataFrame, table: str) -> DataFrame:
    """target_table, ref, change_type, row of changed rows (ref, ...) that are not removed, and of removed refs."""
    live = changed.join(removed.select("ref").distinct(), "ref", "left_anti")
    rest = [c for c in changed.columns if c != "ref"]
    up = live.select(F.lit(table).alias("target_table"), "ref", F.lit("upsert").alias("change_type"), F.to_json(F.struct(*rest)).alias("row"))
    return up.unionByName(removed.select(F.lit(table).alias("target_table"), "ref", F.lit("tombstone").alias("change_type"), F.lit(None).cast("string").alias("row")).distinct())


def validated(delta: DataFrame) -> DataFrame:
    """The delta; an empty one, one with an unknown table, or with a ref both upserted and removed is an error."""
    bad = delta.groupBy("target_table", "ref").agg(F.count_distinct("change_type").alias("n")).where("n > 1").limit(1).count()
    if bad:
        raise ValueError("a ref is upserted and removed at once")
    names = {r[0] for r in delta.select("target_table").distinct().limit(len(PHASES) + 2).collect()}
    if not names or not names <= set(PHASES):
        raise ValueError("empty or unknown tables: " + ", ".join(sorted(names)))
    return delta


def apply_delta(store: tables.Store, stream: str, batch_id: int, rows: dict[str, DataFrame], tombstones: dict[str, DataFrame], checkpoint: DataFrame | None = None) -> list[str]:
    """Tombstones, then the tables in PHASES order, then the checkpoint; each phase is logged, so that a retry goes on after the last. Returns the phases run."""
    done = {r.phase for r in store.read("commits").where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).select("phase").limit(1000).collect()}
    ran = []

    def phase(name: str, work: Callable[[], object]) -> None:
        if name in done:
            return
        work()
        store.merge("commits", store.spark.createDataFrame([(stream, batch_id, name)], "stream string, batch_id long, phase string"))
        ran.append(name)

    for t in PHASES:
        if t in tombstones:
            phase(f"tombstones:{t}", lambda t=t: store.remove(t, tombstones[t]))
    for t in PHASES:
        if t in rows:
            phase(t, lambda t=t: store.merge(t, rows[t]))
    if checkpoint is not None:
        phase("checkpoint", lambda: store.merge("checkpoints", checkpoint))
    return ran


def record_error(store: tables.Store, namespace: str, message: str) -> None:
    """The error beside the unchanged cursor."""
    held = store.read("checkpoints").where(F.col("namespace") == namespace)
    row = store.spark.createDataFrame([(namespace,)], "namespace string").join(held.drop("last_error"), "namespace", "left").withColumn("last_error", F.lit(message))
    store.merge("checkpoints", row)


def ingest_messages(store: tables.Store, batch: DataFrame, batch_id: int, stream: str = "telegram") -> DataFrame:
    """One micro-batch of telegram_changes into source_units and chunks; idempotent for its batch_id. Returns the counts by class."""
    units = batch.where("dialog_id IS NOT NULL AND message_id IS NOT NULL").select(
        F.lit("telegram").alias("namespace"), F.concat(F.lit("dialog:"), "dialog_id").alias("document_ref"), F.concat(F.lit("dialog:"), "dialog_id", F.lit(":message:"), "message_id").alias("unit_ref"),
        T.json_fingerprint(sender="sender", text="text", edit_date="edit_date").alias("fingerprint"), T.order_key("message_id").alias("order_key"), "text", "sender", "cursor", (F.coalesce("standalone_search", F.lit(True)) & ~T.low_signal("text")).alias("standalone_search"))
    last = tables.latest(units, ["namespace", "document_ref", "unit_ref"], "cursor")
    from skein import runtime

    found = runtime.materialize(classify(last, store.read("source_units")), "classified")
    fresh = found.where("class IN ('new', 'changed', 'hidden')")
    shown = found.where("class IN ('new', 'changed')")
    chunk = shown.select(F.sha2(F.concat_ws(":", "namespace", "unit_ref", "fingerprint", F.lit("message_1")), 256).alias("chunk_id"), F.lit("message_1").alias("chunk_strategy"), "document_ref", T.reference("namespace", "unit_ref").alias("ref"),
                         F.concat_ws("\n", F.concat(F.lit("Sender: "), "sender"), F.lit(""), "text").alias("text"), F.lit(0).alias("chunk_index"), F.array("unit_ref").alias("source_unit_refs"))
    old = store.read("chunks").select("chunk_id", F.explode_outer("source_unit_refs").alias("unit_ref")).join(found.where("class = 'changed'").select("unit_ref"), "unit_ref", "left_semi").select("chunk_id").distinct()
    top = batch.agg(F.max("cursor").alias("c")).select(F.lit(stream).alias("namespace"), F.concat(F.lit("offset:"), "c").alias("checkpoint_cursor"), F.current_timestamp().alias("last_success_at")).where("checkpoint_cursor IS NOT NULL")
    apply_delta(store, stream, batch_id, {"source_units": fresh, "chunks": chunk}, {"chunks": runtime.materialize(old, "replaced")}, top)
    return found.groupBy("class").count()


def start_ingest(spark: SparkSession, store: tables.Store, options: dict[str, str], checkpoint: str, interval: str | None = None):  # noqa: ANN201
    """A streaming query over telegram_changes; without an interval it takes one page (option limit) and ends."""
    stream = spark.readStream.format("telegram_changes").options(**options).load()
    writer = stream.writeStream.foreachBatch(lambda b, i: ingest_messages(store, b, i) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def watch_files(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, per_batch: int = 100, interval: str | None = None):  # noqa: ANN201
    """Backlog and then new files of a folder, some in each batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def debounced(events: DataFrame, key: str, at: str, gap_seconds: float = 2.0) -> DataFrame:
    """Of the events of a key in time order those at least the gap after the last accepted one; the first is accepted. Batch form.

    A task goes once through the events of its keys in order and holds the last accepted time only.
    """
    gap = int(gap_seconds * 1_000_000)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = None, None
        for batch in batches:
            keep = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if last is None or t - last >= gap or k != name:
                    keep.append(i)
                    name, last = k, t
            yield batch.select([key, at]).take(pa.array(keep, pa.int64()))

    rows = events.where(F.col(at).isNotNull()).select(key, at, F.unix_micros(F.col(at).cast("timestamp")).alias("_micros"))
    return rows.repartition(key).sortWithinPartitions(key, "_micros").mapInArrow(accept, rows.select(key, at).schema)


def debounced_stream(events: DataFrame, key: str, at: str, gap_seconds: float = 2.0) -> DataFrame:
    """The same over a stream: the last accepted time is the state of a key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def accept(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            keep = []
            for t in frame.sort_values(at)[at]:
                seconds = t.timestamp()
                if last is None or seconds - last >= gap_seconds:
                    keep.append(t)
                    last = seconds
            yield pd.DataFrame({key: [name[0]] * len(keep), at: keep})
        if last is not None:
            state.update((last,))

    kinds = dict(events.dtypes)
    return events.select(key, at).groupBy(key).applyInPandasWithState(accept, f"{key} {kinds[key]}, {at} {kinds[at]}", "last double", "append", GroupStateTimeout.NoTimeout)


def moved_as_events(events: DataFrame) -> DataFrame:
    """Events (kind, path, target) with a move as a deletion and a creation."""
    both = F.when(F.col("kind") == "moved", F.array(F.struct(F.lit("deleted").alias("kind"), F.col("path")), F.struct(F.lit("created").alias("kind"), F.col("target").alias("path")))).otherwise(F.array(F.struct("kind", "path")))
    return events.select(F.explode(both).alias("e"), *[c for c in events.columns if c not in ("kind", "path", "target")]).select("e.kind", "e.path", *[c for c in events.columns if c not in ("kind", "path", "target")])


def rates(events: DataFrame, at: str, width: str = "1 hour") -> DataFrame:
    """window_start, n: events in tumbling windows."""
    return events.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def eta(progress: DataFrame) -> DataFrame:
    """progress (done, total, seconds) with rate an hour and seconds left; both null under 3 done or 120 seconds."""
    known = (F.col("done") >= 3) & (F.col("seconds") >= 120)
    return progress.withColumn("per_hour", F.when(known, F.col("done") / F.col("seconds") * 3600)).withColumn("left_seconds", F.when(known, (F.col("total") - F.col("done")) * F.col("seconds") / F.col("done")))


def late_gap(units: DataFrame) -> DataFrame:
    """Deliveries in order of receipt with the running newest sent_at of their dialog; late where they are older."""
    w = Window.partitionBy("dialog_id").orderBy("received_at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("newest", F.max("sent_at").over(w)).withColumn("late", F.coalesce(F.col("sent_at") < F.col("newest"), F.lit(False)))


@contextmanager
def single_writer(path: str) -> Iterator[None]:
    """An exclusive lock that does not wait."""
    import fcntl

    with open(path, "w") as f:  # noqa: PTH123
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RuntimeError("another writer holds the lock") from e
        yield
