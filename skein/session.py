"""The engine as one object: index, search, read, drill, status."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import runtime, schemas, tables
from skein.functions import text as T
from skein.operators import chunking, embedding, extraction, graph, provenance, quality, retrieval
from skein.sources import feeds, files
from skein.sources.registry import Settings, default_registry


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, encode: Callable[[list[str]], np.ndarray] | None = None, model: str = "hashing-64", predict: Callable[[list[str]], list[list[tuple[str, str]]]] | None = None) -> None:
        self.spark, self.store, self.settings = spark, tables.Store(spark, root), settings or Settings()
        self.predict = predict
        self.encode, self.model, self.sources = encode or embedding.hashing_encoder(), model, default_registry()
        self.strategy = f"heading_{self.settings.chunk_tokens}_{self.settings.chunk_overlap}"
        feeds.register(spark)

    def index(self, paths: list[str], force: bool = False) -> DataFrame:
        """Files that are new or changed become chunks, vectors and relations; those that are gone lose their binding. Returns the counts of changes."""
        info = runtime.materialize(files.file_info(files.discover(self.spark, paths, self.settings.excluded)).withColumn("checksum", F.sha2("text", 256)), "files")
        known = self.store.read("file_fingerprints").select(F.col("file_path").alias("path"), F.col("mtime").alias("modified"), "size_bytes", "checksum")
        current = info.select("path", F.col("modified").cast("double").alias("modified"), "size_bytes", "checksum")
        changes = runtime.materialize(files.diff(current, known.where("false") if force else known), "changes")
        todo = info.join(changes.where("change IN ('new', 'modified')"), "path", "left_semi")
        cut = chunking.chunked(files.source_documents(todo), self.settings.chunk_tokens, self.settings.chunk_overlap)
        cut = chunking.identified(cut.join(todo.select(F.col("path").alias("document_ref"), "kind", "title", "tags"), "document_ref"), F.col("kind"), F.lit(self.strategy))
        rows = cut.groupBy("chunk_id").agg(*[F.first(c).alias(c) for c in ("heading_hierarchy", "level", "document_ref", "title", "tags", "text", "chunk_index")], F.array_sort(F.collect_set("document_ref")).alias("file_paths"))
        rows = runtime.materialize(rows.select("*", F.lit(self.strategy).alias("chunk_strategy"), T.reference(F.lit("filesystem"), "document_ref").alias("ref"), T.tags_text("tags").alias("tags_text")), "chunks")
        bindings = cut.select("chunk_id", F.col("document_ref").alias("file_path"), "chunk_index").dropDuplicates(["chunk_id", "file_path"])
        touched = changes.where("change IN ('modified', 'deleted')").select(F.col("path").alias("file_path"))
        stay, gone = provenance.holders_cascade(self.store.read("chunk_file_bindings"), touched)
        kept = tables.delete(self.store.read("chunks"), gone, ["chunk_id"])
        self.store.overwrite("chunk_file_bindings", tables.insert_ignore(stay, bindings.select("chunk_id", "file_path", "chunk_index"), ["chunk_id", "file_path"]))
        chunks = self.store.overwrite("chunks", tables.upsert(kept, schemas.conform(rows, "chunks"), ["chunk_id"]))
        self.store.merge("provenance", provenance.provenance_of(rows.withColumn("source_unit_refs", F.array().cast("array<string>"))).withColumn("parser_name", F.lit("markdown")))
        self.store.merge("documents", files.source_documents(todo))
        bound = todo.select(T.reference(F.lit("filesystem"), "path").alias("ref"), F.lit("filesystem").alias("namespace"), F.col("path").alias("resource_ref"), F.lit(True).alias("active"), F.current_timestamp().alias("bound_at"), F.lit(None).cast("timestamp").alias("unbound_at"), "content_fingerprint", "meta_fingerprint")
        lost = changes.where("change = 'deleted'").select(T.reference(F.lit("filesystem"), "path").alias("ref"))
        merged = tables.upsert(self.store.read("bindings"), schemas.conform(bound, "bindings"), ["ref"]).join(lost.withColumn("_lost", F.lit(True)), "ref", "left")
        self.store.overwrite("bindings", merged.withColumn("active", F.col("active") & F.col("_lost").isNull()).withColumn("unbound_at", F.when(F.col("_lost"), F.current_timestamp()).otherwise(F.col("unbound_at"))))
        stored = self.store.read("embeddings").where(F.col("embedding_model") == self.model)
        vectors = embedding.embedded(rows.select("chunk_id", "text"), stored.select("chunk_id", "vector"), self.store.read("embedding_cache"), self.encode)
        self.store.merge("embeddings", vectors.select("chunk_id", F.lit(self.strategy).alias("chunk_strategy"), F.lit(self.model).alias("embedding_model"), "text_hash", T.stable_rowid(F.lit(self.strategy), F.lit(self.model), "chunk_id").alias("vector_rowid"), "vector"))
        self.store.merge("embedding_cache", vectors.select("text_hash", F.lit(self.model).alias("embedding_model"), "vector"))
        self.reindex_graph()
        prints = info.select(F.col("path").alias("file_path"), F.col("modified").cast("double").alias("mtime"), "size_bytes", "checksum", F.current_timestamp().alias("indexed_at"))
        self.store.overwrite("file_fingerprints", prints)
        return changes.groupBy("change").count()

    def reindex_graph(self) -> DataFrame:
        """Nodes and relations anew from the stored chunks: structure, key terms, and names if the engine has a predictor."""
        chunks = self.store.read("chunks")
        _, relations = extraction.extracted(chunks, self.predict)
        relations = graph.relation_id(relations).dropDuplicates(["relation_id"]).withColumn("source_table", F.when(F.col("rel_type") == "CO_OCCURS", "entities").otherwise("sections"))
        relations = self.store.overwrite("relations", relations.withColumn("target_table", F.when(F.col("rel_type") == "HAS_TAG", "tags").otherwise("entities")))
        nodes = chunks.select(F.lit("sections").alias("table"), F.col("chunk_id").alias("id"))
        names = relations.where("source_table = 'entities'").select(F.lit("entities").alias("table"), F.col("source_id").alias("id"))
        self.store.overwrite("nodes", graph.with_endpoints(nodes.unionByName(names).distinct(), relations).distinct())
        return relations

    def search(self, queries: DataFrame, k: int = 10, mode: str = "hybrid", enrich: bool = False) -> DataFrame:
        """query_id, rank, chunk_id, ref, title, score, engines, heading_path, snippet for a table of queries (query_id, text); k is 1 to 100."""
        if not 1 <= k <= 100:
            raise ValueError("k must be 1 to 100")
        chunks, bindings, found = self.store.read("chunks"), self.store.read("bindings"), self.store.read("provenance")
        live = chunks.join(provenance.active_provenance(found, bindings).select("chunk_id"), "chunk_id", "left_semi")
        text = retrieval.expanded(queries, extraction.acronym_dictionary(live))
        size = max(self.settings.rerank_pool, 5 * k, k + 50)
        keyword = retrieval.fielded(text, *self._keyword_indexes(live), size)
        vectors = self.store.read("embeddings").where(F.col("embedding_model") == self.model).join(live.select("chunk_id"), "chunk_id", "left_semi")
        semantic = retrieval.knn(embedding.encoded(text, "text", self.encode), vectors, size, self.settings.score_floor)
        names = graph.catalogue(self.store.read("nodes").where(F.col("table") == "entities").select(F.col("id").alias("name")))
        matches = graph.matched_entities(queries, names)
        relations = self.store.read("relations")
        direct = graph.direct(matches, relations, live, size)
        fused = retrieval.pool(mode, semantic, keyword, direct)
        if enrich:
            fused = retrieval.pool(mode, semantic, keyword, direct, graph.enriched(fused, relations, live, size))
        near = fused.where(F.col("rank") <= self.settings.rerank_pool).join(live.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        again = retrieval.reranked(near.select("query_id", "chunk_id", "query", "text"))
        mixed = retrieval.blended(fused.drop("rank").join(again.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"], "left"), self.settings.fused_weight, self.settings.rerank_weight)
        top = mixed.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("blended").alias("score"), "engines", "rank")
        return retrieval.candidates(top, live, queries)

    def _keyword_indexes(self, live: DataFrame) -> list[retrieval.Index]:
        """The stored indexes of titles and texts; built where the chunks, bindings or provenance have changed since."""
        state = "-".join(str(self.store.number(t)) for t in ("chunks", "bindings", "provenance"))
        paths = {column: f"{self.store.root}/_index/blocks-{column}-{state}" for column in ("title", "text")}
        missing = [c for c, path in paths.items() if not runtime.exists(self.spark, f"{path}/statistics/_SUCCESS")]
        if missing:
            texts = runtime.materialize(live.select("chunk_id", *missing), "texts")
            for c in missing:
                retrieval.index(texts, c, paths[c])
        return [retrieval.open_index(self.spark, path) for path in paths.values()]

    def read(self, ref: str, begin: int = 0, end: int | None = None) -> DataFrame:
        return provenance.read(self.store.read("chunks"), self.store.read("bindings"), ref, begin, end)

    def drill(self) -> DataFrame:
        documents = self.store.read("documents").withColumn("updated_at", F.lit(None).cast("timestamp")).withColumn("kind", F.lit(None).cast("string"))
        return provenance.drill(documents, self.store.read("chunks"))

    def status(self) -> DataFrame:
        """name, value: rows of the tables and the findings of the audit."""
        chunks = self.store.read("chunks")
        files_held = chunks.select(F.explode_outer("file_paths").alias("p")).agg(F.count_distinct("p").alias("n")).select(F.lit("files").alias("finding"), "n")
        return quality.completeness(chunks, self.store.read("provenance"), self.store.read("embeddings")).unionByName(files_held)

    def compare_rerankers(self, queries: DataFrame, scorers: list[str], k: int = 10) -> DataFrame:
        """One pool of candidates for all scorers: scorer, query_id, chunk_id, rerank_score, rank."""
        hits = self.search(queries, self.settings.rerank_pool).select("query_id", "chunk_id")
        pairs = hits.join(self.store.read("chunks").select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        pairs = runtime.materialize(pairs, "pairs")
        out = None
        for s in scorers:
            part = retrieval.reranked(pairs, s, k=k).select(F.lit(s).alias("scorer"), "query_id", "chunk_id", "rerank_score", "rank")
            out = part if out is None else out.unionByName(part)
        return out

    def graph(self) -> DataFrame:
        return graph.export(self.store.read("nodes"), self.store.read("relations"))
