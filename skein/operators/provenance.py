"""Chunks, where they come from, and what of them may be seen.

chunks: chunk_id, ref, ...; provenance: chunk_id, namespace, document_ref, ref, ...; bindings: namespace, document_ref (or ref), active.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T


def provenance_of(chunks: DataFrame) -> DataFrame:
    """Distinct (chunk_id, namespace, document_ref, ref, chunk_strategy, source_unit_refs) of chunks with a ref."""
    return chunks.where("ref IS NOT NULL").select("chunk_id", T.namespace_of("ref").alias("namespace"), T.document_of("ref").alias("document_ref"), "ref", "chunk_strategy", "source_unit_refs").distinct()


def active_provenance(provenance: DataFrame, bindings: DataFrame) -> DataFrame:
    """The first provenance (by namespace, document_ref) of each chunk that has an active binding."""
    rows = provenance.join(bindings.where("active").select("ref").distinct(), "ref", "left_semi")
    return first_provenance(rows)


def first_provenance(provenance: DataFrame) -> DataFrame:
    least = F.min(F.struct("namespace", "document_ref", "ref")).alias("p")
    return provenance.groupBy("chunk_id").agg(least).select("chunk_id", "p.namespace", "p.document_ref", "p.ref")


def visible(hits: DataFrame, provenance: DataFrame, bindings: DataFrame) -> DataFrame:
    """Hits of chunks with an active binding. A hit without any provenance is an error; one that is bound but not active is dropped."""
    known = provenance.select("chunk_id", "ref").distinct().join(bindings.groupBy("ref").agg(F.max("active").alias("active")), "ref", "left")
    state = known.groupBy("chunk_id").agg(F.max(F.coalesce("active", F.lit(False))).alias("_active"))
    rows = hits.join(state, "chunk_id", "left")
    checked = F.when(F.col("_active").isNull(), F.raise_error(F.concat(F.lit("no provenance: "), "chunk_id"))).otherwise(F.col("_active"))
    return rows.where(checked.cast("boolean")).drop("_active")


def of_unit(provenance: DataFrame, chunks: DataFrame, unit: str) -> DataFrame:
    """Chunks that hold a source unit, in their order."""
    ids = provenance.where(F.array_contains("source_unit_refs", unit)).select("chunk_id").distinct()
    return chunks.join(ids, "chunk_id", "left_semi").orderBy("chunk_index", "chunk_id")


def file_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id, file_path, chunk_index: the files a chunk is held by."""
    return chunks.select("chunk_id", F.explode("file_paths").alias("file_path"), "chunk_index").distinct()


def in_range(file_bindings: DataFrame, chunks: DataFrame, path: str, begin: int, end: int) -> DataFrame:
    """Chunks begin <= chunk_index < end of a file."""
    own = file_bindings.where((F.col("file_path") == path) & (F.col("chunk_index") >= begin) & (F.col("chunk_index") < end)).select("chunk_id", "chunk_index").distinct()
    return own.join(chunks.drop("chunk_index"), "chunk_id").orderBy("chunk_index", "chunk_id")


def read(chunks: DataFrame, bindings: DataFrame, ref: str, begin: int = 0, end: int | None = None, most: int = 50) -> DataFrame:
    """Chunks of an active document, at most `most`; without an end only how many there are."""
    own = chunks.where(F.col("ref") == ref).join(bindings.where("active").select("ref").distinct(), "ref", "left_semi").dropDuplicates(["chunk_id"])
    if end is None:
        return own.groupBy("ref").agg(F.max("title").alias("title"), F.count("*").alias("chunks"))
    return own.where((F.col("chunk_index") >= begin) & (F.col("chunk_index") < min(end, begin + most))).orderBy("chunk_index", "chunk_id")


def drill(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document's metadata with its number of chunks; of several rows of a ref the one updated last."""
    n = chunks.groupBy("ref").agg(F.count_distinct("chunk_id").alias("chunks"))
    last = documents.where("ref IS NOT NULL").groupBy("ref").agg(F.max(F.struct("updated_at", "title", "kind", "media_type")).alias("d"))
    return last.select("ref", "d.title", "d.kind", "d.media_type", "d.updated_at").join(n, "ref", "left").na.fill(0, ["chunks"])


def without_provenance(chunks: DataFrame, provenance: DataFrame) -> DataFrame:
    return chunks.select("chunk_id").distinct().join(provenance, "chunk_id", "left_anti")


def without_document(provenance: DataFrame, documents: DataFrame) -> DataFrame:
    return provenance.select("ref").distinct().join(documents.select("ref"), "ref", "left_anti")


def backfilled(chunks: DataFrame, provenance: DataFrame, documents: DataFrame) -> DataFrame:
    """Provenance for chunks that have none, from the least of their files; the parser is that of the same file."""
    missing = chunks.select("chunk_id", "chunk_strategy", F.explode("file_paths").alias("path")).join(provenance.select("chunk_id"), "chunk_id", "left_anti")
    first = missing.groupBy("chunk_id").agg(F.min("path").alias("document_ref"), F.min_by("chunk_strategy", "path").alias("chunk_strategy"))
    held = documents.where("namespace = 'filesystem'").select("document_ref", "media_type").groupBy("document_ref").agg(F.max("media_type").alias("parser_name"))
    return first.join(held, "document_ref", "left").select("chunk_id", F.lit("filesystem").alias("namespace"), "document_ref", T.reference(F.lit("filesystem"), "document_ref").alias("ref"), "chunk_strategy", F.coalesce("parser_name", F.lit("text/markdown")).alias("parser_name"))


def retained(provenance: DataFrame, bindings: DataFrame) -> DataFrame:
    """Number of chunks that are kept for inactive documents only."""
    inactive = provenance.join(bindings.where("NOT active").select("ref"), "ref", "left_semi")
    return inactive.agg(F.count_distinct("chunk_id").alias("retained"))


def binding_counts(bindings: DataFrame) -> DataFrame:
    return bindings.agg(F.count("*").alias("total"), F.count_if(F.col("active")).alias("active"), F.count_if(~F.col("active")).alias("inactive"))


def labelled(labels: DataFrame, file_bindings: DataFrame, chunks: DataFrame) -> DataFrame:
    """label_id, chunk_id, matches: chunks whose file and content a label selects; a label that selects not exactly one is to be looked at."""
    rows = labels.join(file_bindings.select("chunk_id", "file_path").distinct(), "file_path").join(chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"]), "chunk_id")
    rows = rows.where(F.contains(F.col("text"), F.col("contains"))).select("label_id", "chunk_id").distinct()
    return rows.withColumn("matches", F.count("*").over(Window.partitionBy("label_id")))


def rebindable(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """Inactive bindings that a new file continues: both fingerprints are equal and the file's ref is not bound; one a file, the first by ref."""
    new = files.join(bindings.where("active").select("ref"), "ref", "left_anti").select(F.col("ref").alias("new_ref"), "content_fingerprint", "meta_fingerprint")
    return new.join(bindings.where("NOT active"), ["content_fingerprint", "meta_fingerprint"]).groupBy("new_ref").agg(F.min("ref").alias("ref"))


def holders_cascade(file_bindings: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings that stay, chunk_ids whose last holder is gone) when the files `removed` (file_path) are removed."""
    stay = file_bindings.join(removed.select("file_path").distinct(), "file_path", "left_anti")
    gone = file_bindings.join(removed.select("file_path").distinct(), "file_path", "left_semi").select("chunk_id").distinct().join(stay.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return stay, gone


def tombstones(file_bindings: DataFrame, path: str) -> DataFrame:
    """table, ref: the tombstones of one file; those of chunks only where the file is the only holder."""
    own = file_bindings.where(F.col("file_path") == path).select("chunk_id").distinct()
    holders = file_bindings.join(own, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count_distinct("file_path").alias("n")).where("n <= 1")
    out = own.sparkSession.createDataFrame([("documents", f"filesystem:{path}"), ("bindings", f"filesystem:{path}")], "target_table string, ref string")
    out = out.unionByName(own.select(F.lit("chunk_file_bindings").alias("target_table"), T.composite("chunk_id", F.lit(path)).alias("ref")))
    for name in ("chunks", "provenance", "embeddings"):
        out = out.unionByName(holders.select(F.lit(name).alias("target_table"), F.col("chunk_id").alias("ref")))
    return out


def unit_window(units: DataFrame, before: int, after: int, dialog: str = "dialog_id", order: str = "message_id") -> DataFrame:
    """Every unit with the ids of its neighbours in order; the frame is bounded."""
    w = Window.partitionBy(dialog).orderBy(order)
    return units.withColumn("window", F.collect_list(order).over(w.rowsBetween(-before, after)))


def routes(refs: DataFrame, bindings: DataFrame) -> DataFrame:
    """ref, route of asked refs: local (active binding), inactive (bound, may not be read), federated (not bound here)."""
    held = bindings.groupBy("ref").agg(F.max("active").alias("_a"))
    return refs.select("ref").distinct().join(held, "ref", "left").select("ref", F.when(F.col("_a"), "local").when(~F.col("_a"), "inactive").otherwise("federated").alias("route"))


def deactivated(bindings: DataFrame, removed: DataFrame) -> DataFrame:
    """Bindings of removed refs stay, but not active: what they hold can be bound again."""
    gone = removed.select("ref").distinct().withColumn("_gone", F.lit(True))
    return bindings.join(gone, "ref", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def denormalised(chunks: DataFrame, provenance: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, ref, document_title: each chunk with its first provenance and that document's title."""
    titles = documents.where("ref IS NOT NULL").groupBy("ref").agg(F.max("title").alias("document_title"))
    return chunks.select("chunk_id").distinct().join(first_provenance(provenance).select("chunk_id", "ref"), "chunk_id", "left").join(titles, "ref", "left").select("chunk_id", "ref", "document_title")
