"""Queries of tables, provenance, incremental operators, audits, and extensions over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import tables
from skein.functions import text as T
from skein.operators import graph, provenance, quality
from skein.plans.registry import Tables, query
from skein.plans.retrieval import _REL, _relations
from skein.sources import files
from skein.streaming import ingest

_PROV = "prov AS (SELECT DISTINCT chunk_id, split_part(ref, ':', 1) AS namespace, substr(ref, instr(ref, ':') + 1) AS document_ref, ref, chunk_strategy, source_unit_refs FROM chunks WHERE ref IS NOT NULL)"
_BIND = "bind AS (SELECT ref, coalesce(max(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END) = 1 AND max(ingested_at) IS NOT NULL AND bool_or(kind IS NOT NULL), false) AS active FROM documents WHERE ref IS NOT NULL GROUP BY ref)"


def _bindings(t: Tables) -> DataFrame:
    shown = (F.max(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", 1).otherwise(0)) == 1) & F.max("ingested_at").isNotNull() & F.bool_or(F.col("kind").isNotNull())
    return t.documents.where("ref IS NOT NULL").groupBy("ref").agg(F.coalesce(shown, F.lit(False)).alias("active"))


@query("b1_insert_ignore", "WITH o AS (SELECT DISTINCT chunk_id, 0 AS origin FROM chunk_vectors), n AS (SELECT DISTINCT chunk_id, 1 AS origin FROM vector_components) SELECT * FROM o UNION ALL SELECT * FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM o)")
def b1(t: Tables) -> DataFrame:
    old, new = t.chunk_vectors.select("chunk_id", F.lit(0).alias("origin")).distinct(), t.vector_components.select("chunk_id", F.lit(1).alias("origin"))
    return tables.insert_ignore(old, new, ["chunk_id"])


@query("b3_upsert", "WITH o AS (SELECT DISTINCT chunk_id, 0 AS origin FROM chunk_vectors), n AS (SELECT DISTINCT chunk_id, 1 AS origin FROM vector_components) SELECT * FROM n UNION ALL SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n)")
def b3(t: Tables) -> DataFrame:
    old, new = t.chunk_vectors.select("chunk_id", F.lit(0).alias("origin")).distinct(), t.vector_components.select("chunk_id", F.lit(1).alias("origin")).distinct()
    return tables.upsert(old, new, ["chunk_id"])


@query("b6_changed_rows", "SELECT l.doc_id, l.quality FROM (SELECT doc_id, max(toxic) AS quality FROM labels GROUP BY 1) l LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) o USING (doc_id) WHERE l.quality IS DISTINCT FROM o.quality")
def b6(t: Tables) -> DataFrame:
    old, new = (t.labels.groupBy("doc_id").agg(f(c).alias("quality")) for f, c in ((F.min, "quality"), (F.max, "toxic")))  # two columns stand for two versions
    return tables.changed(old, new, ["doc_id"])


@query("b7_tombstones", "SELECT DISTINCT ref FROM documents WHERE ref IS NOT NULL AND ref NOT IN (SELECT ref FROM delta_changes WHERE lower(trim(change_type)) = 'tombstone' AND ref IS NOT NULL)")
def b7(t: Tables) -> DataFrame:
    gone = t.delta_changes.where(F.lower(F.trim("change_type")) == "tombstone")
    return tables.delete(t.documents.where("ref IS NOT NULL").select("ref").distinct(), gone, ["ref"])


@query("b11_implied_endpoints", rf"WITH {_REL} SELECT DISTINCT 'sections' AS \"table\", source_id AS id FROM rel UNION SELECT DISTINCT 'entities', target_id FROM rel WHERE target_id NOT IN (SELECT source_id FROM rel)".replace('\\"', '"'))
def b11(t: Tables) -> DataFrame:
    r = _relations(t)
    nodes = r.select(F.lit("sections").alias("table"), F.col("source_id").alias("id")).distinct()
    return graph.with_endpoints(nodes, r)


@query("b13_purged_namespace", "SELECT doc_id FROM documents WHERE namespace <> 'telegram'")
def b13(t: Tables) -> DataFrame:
    return tables.delete(t.documents.select("doc_id", "namespace"), t.documents.where("namespace = 'telegram'"), ["namespace"]).where("namespace IS NOT NULL").select("doc_id")


@query("b18_copied_counts", "SELECT 'chunks' AS name, count(*) AS rows FROM chunks UNION ALL SELECT 'documents', count(*) FROM documents")
def b18(t: Tables) -> DataFrame:
    one = lambda n: getattr(t, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
    return one("chunks").unionByName(one("documents"))


@query("e9_visible_hits", f"WITH {_PROV}, {_BIND} SELECT DISTINCT v.chunk_id FROM chunk_vectors v JOIN prov USING (chunk_id) JOIN bind USING (ref) WHERE active")
def e9(t: Tables) -> DataFrame:
    prov = provenance.provenance_of(t.chunks)
    hits = t.chunk_vectors.select("chunk_id").distinct().join(prov.select("chunk_id"), "chunk_id", "left_semi")
    return provenance.visible(hits, prov, _bindings(t))


@query("e13_unit_members", "SELECT DISTINCT chunk_id, source_unit_refs[1] AS unit FROM chunks WHERE list_contains(source_unit_refs, source_unit_refs[1])")
def e13(t: Tables) -> DataFrame:
    return t.chunks.where("size(source_unit_refs) > 0").where(F.array_contains("source_unit_refs", F.col("source_unit_refs")[0])).select("chunk_id", F.col("source_unit_refs")[0].alias("unit")).distinct()


@query("f1_active_provenance", f"WITH {_PROV}, {_BIND} SELECT chunk_id, p.namespace, p.document_ref, p.ref FROM (SELECT chunk_id, min(struct_pack(namespace := namespace, document_ref := document_ref, ref := ref)) AS p FROM prov JOIN bind USING (ref) WHERE active GROUP BY 1)")
def f1(t: Tables) -> DataFrame:
    return provenance.active_provenance(provenance.provenance_of(t.chunks), _bindings(t))


@query("f3_chunk_ranges", "SELECT DISTINCT chunk_id, file_path, chunk_index FROM (SELECT chunk_id, unnest(file_paths) AS file_path, chunk_index FROM chunks) WHERE chunk_index >= 1 AND chunk_index < 4")
def f3(t: Tables) -> DataFrame:
    return provenance.file_chunks(t.chunks).where("chunk_index >= 1 AND chunk_index < 4")


@query("f4_missing_provenance", "SELECT DISTINCT chunk_id FROM vector_components WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks JOIN chunk_vectors USING (chunk_id) WHERE ref IS NOT NULL)")
def f4(t: Tables) -> DataFrame:
    """Provenance is that of the chunks that have a vector."""
    return provenance.without_provenance(t.vector_components, provenance.provenance_of(t.chunks.join(t.chunk_vectors.select("chunk_id"), "chunk_id", "left_semi")))


@query("f5_backfilled_provenance", f"""
WITH {_PROV}, telegram AS (SELECT chunk_id FROM prov WHERE namespace = 'telegram'), m AS (SELECT chunk_id, chunk_strategy, unnest(file_paths) AS path FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM telegram)),
f AS (SELECT chunk_id, min(path) AS document_ref, arg_min(chunk_strategy, path) AS chunk_strategy FROM m GROUP BY 1), h AS (SELECT document_ref, max(media_type) AS parser FROM documents WHERE namespace = 'filesystem' GROUP BY 1)
SELECT chunk_id, document_ref, 'filesystem:' || document_ref AS ref, coalesce(parser, 'text/markdown') AS parser_name FROM f LEFT JOIN h USING (document_ref)""")
def f5(t: Tables) -> DataFrame:
    held = provenance.provenance_of(t.chunks).where("namespace = 'telegram'")
    return provenance.backfilled(t.chunks, held, t.documents).select("chunk_id", "document_ref", "ref", "parser_name")


@query("f6_missing_documents", f"WITH {_PROV} SELECT DISTINCT ref FROM prov WHERE ref NOT IN (SELECT ref FROM documents WHERE ref IS NOT NULL AND lang IS NOT NULL)")
def f6(t: Tables) -> DataFrame:
    return provenance.without_document(provenance.provenance_of(t.chunks), t.documents.where("lang IS NOT NULL"))  # documents with a label count as stored


@query("f7_retained_chunks", f"WITH {_PROV}, {_BIND} SELECT count(DISTINCT chunk_id) AS retained FROM prov JOIN bind USING (ref) WHERE NOT active")
def f7(t: Tables) -> DataFrame:
    return provenance.retained(provenance.provenance_of(t.chunks), _bindings(t))


@query("f16_labelled_chunks", """
WITH l AS (SELECT DISTINCT id AS label_id, x.ref AS ref, x.contains AS part FROM (SELECT id, unnest(relevant) AS x FROM surreal_golden_queries)), c AS (SELECT chunk_id, ref, text FROM chunks),
h AS (SELECT DISTINCT label_id, chunk_id FROM l JOIN c USING (ref) WHERE contains(text, part)) SELECT label_id, chunk_id, count(*) OVER (PARTITION BY label_id) AS matches FROM h""")
def f16(t: Tables) -> DataFrame:
    labels = t.surreal_golden_queries.select(F.col("id").alias("label_id"), F.explode("relevant").alias("x")).select("label_id", F.col("x.ref").alias("file_path"), F.col("x.contains").alias("contains")).distinct()
    return provenance.labelled(labels, t.chunks.select("chunk_id", F.col("ref").alias("file_path")), t.chunks)


@query("f19_rebindable", """
WITH a AS (SELECT ref, min(sha256(text)) AS fp FROM documents WHERE ref IS NOT NULL AND text IS NOT NULL GROUP BY ref), o AS (SELECT * FROM a WHERE starts_with(ref, 'filesystem')), n AS (SELECT * FROM a WHERE NOT starts_with(ref, 'filesystem'))
SELECT n.ref AS new_ref, min(o.ref) AS ref FROM n JOIN o USING (fp) GROUP BY 1""")
def f19(t: Tables) -> DataFrame:
    a = t.documents.where("ref IS NOT NULL AND text IS NOT NULL").groupBy("ref").agg(F.min(F.sha2("text", 256)).alias("content_fingerprint")).withColumn("meta_fingerprint", F.lit(""))
    return provenance.rebindable(a.where("NOT startswith(ref, 'filesystem')"), a.where("startswith(ref, 'filesystem')").withColumn("active", F.lit(False)))


@query("g1_weight_sums", rf"WITH {_REL} SELECT source_id, round(sum(weight), 6) AS weight FROM rel GROUP BY 1")
def g1(t: Tables) -> DataFrame:
    return _relations(t).groupBy("source_id").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query("g3_binding_counts", f"WITH {_BIND} SELECT count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS inactive FROM bind")
def g3(t: Tables) -> DataFrame:
    return provenance.binding_counts(_bindings(t))


@query("g14_status", "SELECT count(DISTINCT p) AS files FROM (SELECT unnest(file_paths) AS p FROM chunks)")
def g14(t: Tables) -> DataFrame:
    return t.chunks.select(F.explode("file_paths").alias("p")).agg(F.count_distinct("p").alias("files"))


@query("g16_lengths", "WITH r AS (SELECT embedding_model, len(vector) AS length, count(*) AS n FROM chunk_vectors WHERE vector IS NOT NULL GROUP BY 1, 2), u AS (SELECT embedding_model, arg_max(length, struct_pack(n := n, l := length)) AS usual FROM r GROUP BY 1) SELECT embedding_model, length, n, length <> usual AS mismatch FROM r JOIN u USING (embedding_model)")
def g16(t: Tables) -> DataFrame:
    return quality.distribution(t.chunk_vectors.where("vector IS NOT NULL")).withColumn("length", F.col("length").cast("long"))


@query("g17_coverage", " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS different FROM documents" for c in ("lang", "source", "n_chars", "kind", "media_type", "text")))
def g17(t: Tables) -> DataFrame:
    return quality.coverage(t.documents, ["lang", "source", "n_chars", "kind", "media_type", "text"])


@query("g18_duplicates", "SELECT chunk_strategy, embedding_model, chunk_id, count(*) AS n FROM chunk_vectors GROUP BY ALL HAVING count(*) > 1")
def g18(t: Tables) -> DataFrame:
    return quality.duplicates(t.chunk_vectors, ["chunk_strategy", "embedding_model", "chunk_id"])


@query("g18_fan_out", f"WITH {_PROV}, p AS (SELECT chunk_id, count(*) AS provenances FROM prov GROUP BY 1) SELECT provenances, count(*) AS chunks FROM p GROUP BY 1")
def g18f(t: Tables) -> DataFrame:
    return quality.fan_out(provenance.provenance_of(t.chunks))


@query("g19_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def g19(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.95), 4).alias("p95"))


@query("g22_json_sum", "SELECT target_table, sum(CAST(json_extract_string(row_json, '$.len') AS BIGINT))::BIGINT AS len FROM delta_changes GROUP BY 1")
def g22(t: Tables) -> DataFrame:
    return t.delta_changes.groupBy("target_table").agg(F.sum(F.get_json_object("row_json", "$.len").try_cast("bigint")).alias("len"))


@query("g24_latest", "SELECT ref, epoch_us(max(updated_at)) AS updated FROM documents WHERE ref IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1")
def g24(t: Tables) -> DataFrame:
    return tables.latest(t.documents.where("ref IS NOT NULL AND updated_at IS NOT NULL").select("ref", "updated_at", "doc_id"), ["ref"], "updated_at").select("ref", F.unix_micros("updated_at").alias("updated"))


@query("g26_paths_by_strategy", "SELECT DISTINCT chunk_strategy, unnest(file_paths) AS path FROM chunks")
def g26(t: Tables) -> DataFrame:
    return t.chunks.select("chunk_strategy", F.explode("file_paths").alias("path")).distinct()


@query("h3_unit_windows", "WITH m AS (SELECT DISTINCT dialog_id, message_id FROM telegram_messages WHERE dialog_id IS NOT NULL AND message_id IS NOT NULL) SELECT dialog_id, message_id, array_to_string(list(message_id) OVER (PARTITION BY dialog_id ORDER BY message_id ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING), ',') AS around FROM m")
def h3(t: Tables) -> DataFrame:
    m = t.telegram_messages.where("dialog_id IS NOT NULL AND message_id IS NOT NULL").select("dialog_id", "message_id").distinct()
    return provenance.unit_window(m, 2, 3).select("dialog_id", "message_id", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("around"))


@query("h9_debounced", """
WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL
SELECT a.user_id, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 2 SECOND GROUP BY a.user_id) SELECT user_id, ts FROM a""")
def h9(t: Tables) -> DataFrame:
    return ingest.debounced(t.events, "user_id", "ts", 2.0)


@query("j2_difference", "SELECT DISTINCT chunk_id FROM chunk_vectors EXCEPT SELECT DISTINCT chunk_id FROM vector_components")
def j2(t: Tables) -> DataFrame:
    return t.chunk_vectors.select("chunk_id").distinct().join(t.vector_components.select("chunk_id"), "chunk_id", "left_anti")


@query("j3_intersection", "SELECT DISTINCT chunk_id FROM chunk_vectors INTERSECT SELECT DISTINCT chunk_id FROM vector_components")
def j3(t: Tables) -> DataFrame:
    return t.chunk_vectors.select("chunk_id").intersect(t.vector_components.select("chunk_id"))


@query("k34_drill", "WITH d AS (SELECT ref, max(updated_at) AS updated_at FROM documents WHERE ref IS NOT NULL GROUP BY 1), n AS (SELECT ref, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY 1) SELECT d.ref, epoch_us(updated_at) AS updated, coalesce(chunks, 0) AS chunks FROM d LEFT JOIN n USING (ref)")
def k34(t: Tables) -> DataFrame:
    return provenance.drill(t.documents, t.chunks).select("ref", F.unix_micros("updated_at").alias("updated"), "chunks")


@query("k36_chunks_by_entity", rf"WITH {_REL} SELECT DISTINCT target_id AS entity, source_id AS chunk_id FROM rel")
def k36(t: Tables) -> DataFrame:
    return _relations(t).select(F.col("target_id").alias("entity"), F.col("source_id").alias("chunk_id")).distinct()


def _prints(t: Tables, order: str) -> DataFrame:
    best = getattr(F, order)("updated_at")
    return t.documents.where("document_ref IS NOT NULL").groupBy(F.col("document_ref").alias("path")).agg(best.alias("modified"), getattr(F, order)(F.length("text")).cast("long").alias("size_bytes"), getattr(F, order)(F.md5("text")).alias("checksum"))


@query("m1_file_diff", """
WITH c AS (SELECT document_ref AS path, max(updated_at) AS m, max(length(text)) AS s, max(md5(text)) AS x FROM documents WHERE document_ref IS NOT NULL AND namespace <> 'gmail' GROUP BY 1), k AS (SELECT document_ref AS path, min(updated_at) AS m, min(length(text)) AS s, min(md5(text)) AS x FROM documents WHERE document_ref IS NOT NULL AND namespace <> 'telegram' GROUP BY 1)
SELECT path, CASE WHEN k.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' WHEN c.m = k.m AND c.s = k.s THEN 'unchanged' WHEN c.x IS NOT DISTINCT FROM k.x THEN 'touched' ELSE 'modified' END AS change FROM c FULL JOIN k USING (path)""")
def m1(t: Tables) -> DataFrame:
    class Part:
        def __init__(self, drop: str) -> None:
            self.documents = t.documents.where(f"namespace <> '{drop}'")

    return files.diff(_prints(Part("gmail"), "max"), _prints(Part("telegram"), "min"))


@query("m2_routes", """
WITH d AS (SELECT document_ref AS path, max(md5(text)) AS c, max(title) AS m, min(md5(text)) AS c0, min(title) AS m0 FROM documents WHERE document_ref IS NOT NULL GROUP BY 1)
SELECT path, CASE WHEN c IS DISTINCT FROM c0 THEN 'rechunk' WHEN m IS DISTINCT FROM m0 THEN 'reembed' ELSE 'skip' END AS route FROM d""")
def m2(t: Tables) -> DataFrame:
    part = lambda f: t.documents.where("document_ref IS NOT NULL").groupBy(F.col("document_ref").alias("path")).agg(f(F.md5("text")).alias("content_fingerprint"), f("title").alias("meta_fingerprint"))
    return files.route(part(F.max), part(F.min))


@query("m6_classified", """
WITH u AS (SELECT dialog_id, message_id, max(md5(coalesce(text, ''))) AS fp, min(md5(coalesce(text, ''))) AS fp0, bool_or(is_deleted) AS hidden FROM telegram_messages WHERE dialog_id IS NOT NULL AND message_id IS NOT NULL GROUP BY 1, 2)
SELECT CASE WHEN hidden THEN 'hidden' WHEN message_id < 1000 THEN 'new' WHEN fp <> fp0 THEN 'changed' ELSE 'skipped' END AS class, count(*) AS n FROM u GROUP BY 1""")
def m6(t: Tables) -> DataFrame:
    text = F.md5(F.coalesce("text", F.lit("")))
    u = t.telegram_messages.where("dialog_id IS NOT NULL AND message_id IS NOT NULL").groupBy("dialog_id", "message_id").agg(F.max(text).alias("fingerprint"), F.min(text).alias("f0"), F.bool_or("is_deleted").alias("hidden"))
    key = [F.lit("telegram").alias("namespace"), F.col("dialog_id").cast("string").alias("document_ref"), F.col("message_id").cast("string").alias("unit_ref")]
    known = u.where("message_id >= 1000").select(*key, F.col("f0").alias("fingerprint"))
    return ingest.classify(u.select(*key, "fingerprint", (~F.col("hidden")).alias("standalone_search")), known).groupBy("class").agg(F.count("*").alias("n"))


@query("m10_manifest", """
WITH c AS (SELECT DISTINCT ref, title FROM documents WHERE ref IS NOT NULL), r AS (SELECT DISTINCT ref FROM delta_changes WHERE lower(trim(change_type)) = 'tombstone')
SELECT 'documents' AS target_table, ref, 'upsert' AS change_type FROM c WHERE ref NOT IN (SELECT ref FROM r) UNION ALL SELECT 'documents', ref, 'tombstone' FROM r""")
def m10(t: Tables) -> DataFrame:
    removed = t.delta_changes.where(F.lower(F.trim("change_type")) == "tombstone").select("ref").distinct()
    return ingest.manifest(t.documents.where("ref IS NOT NULL").select("ref", "title").distinct(), removed, "documents").select("target_table", "ref", "change_type")


@query("m12_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def m12(t: Tables) -> DataFrame:
    return ingest.rates(t.events, "ts")


@query("m14_cascade", """
WITH b AS (SELECT DISTINCT chunk_id, unnest(file_paths) AS path FROM chunks), r AS (SELECT DISTINCT path FROM b WHERE contains(path, '/vault/')), s AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM r))
SELECT DISTINCT chunk_id FROM b WHERE path IN (SELECT path FROM r) AND chunk_id NOT IN (SELECT chunk_id FROM s)""")
def m14(t: Tables) -> DataFrame:
    b = provenance.file_chunks(t.chunks)
    return provenance.holders_cascade(b, b.where(F.contains("file_path", F.lit("/vault/"))))[1]


@query("m15_orphans", "SELECT DISTINCT p FROM (SELECT unnest(file_paths) AS p FROM chunks) WHERE p NOT IN (SELECT document_ref FROM documents WHERE document_ref IS NOT NULL AND lang IS NOT NULL)")
def m15(t: Tables) -> DataFrame:
    return t.chunks.select(F.explode("file_paths").alias("p")).distinct().join(t.documents.where("lang IS NOT NULL").select(F.col("document_ref").alias("p")), "p", "left_anti")  # documents with a label count as files on disk


@query("m16_stale_relations")
def m16(t: Tables) -> DataFrame:
    r = _relations(t).withColumn("rel_type", F.lit("HAS_TAG"))
    touched = r.select(F.col("source_id").alias("document_ref"))
    return graph.stale_frontmatter(r, touched, r.where("weight > 1")).select("source_id", "target_id")


@query("n1_completeness", f"""
WITH {_PROV}, c AS (SELECT DISTINCT chunk_id FROM chunks), v AS (SELECT DISTINCT chunk_id FROM chunk_vectors)
SELECT 'chunks' AS finding, count(*) AS n FROM c UNION ALL SELECT 'chunks_without_vector', count(*) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM v) UNION ALL SELECT 'chunks_without_provenance', count(*) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM prov)
UNION ALL SELECT 'vectors_without_chunk', count(*) FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM c) UNION ALL SELECT 'repeated_chunks', count(*) FROM (SELECT chunk_id FROM chunks GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated_vectors', count(*) FROM (SELECT 1 FROM chunk_vectors GROUP BY chunk_strategy, embedding_model, chunk_id HAVING count(*) > 1)""")
def n1(t: Tables) -> DataFrame:
    return quality.completeness(t.chunks, provenance.provenance_of(t.chunks), t.chunk_vectors)


@query("n2_isolated_nodes", rf"WITH {_REL} SELECT DISTINCT chunk_id AS id FROM chunks WHERE chunk_id NOT IN (SELECT source_id FROM rel)")
def n2(t: Tables) -> DataFrame:
    return graph.isolated(t.chunks.select(F.col("chunk_id").alias("id")).distinct(), _relations(t)).select("id")


@query("r1_chunk_lookup", "SELECT DISTINCT v.chunk_id, c.title FROM chunk_vectors v JOIN chunks c USING (chunk_id)")
def r1(t: Tables) -> DataFrame:
    return t.chunk_vectors.select("chunk_id").distinct().join(t.chunks.select("chunk_id", "title"), "chunk_id").distinct()


@query("r3_chunks_of_files", "SELECT p AS file_path, count(DISTINCT chunk_id) AS chunks FROM (SELECT chunk_id, unnest(file_paths) AS p FROM chunks) GROUP BY 1")
def r3(t: Tables) -> DataFrame:
    return provenance.file_chunks(t.chunks).groupBy("file_path").agg(F.count_distinct("chunk_id").alias("chunks"))


@query("r4_files_of_chunks", "SELECT chunk_id, array_to_string(list_sort(list(DISTINCT p)), '|') AS paths FROM (SELECT chunk_id, unnest(file_paths) AS p FROM chunks) GROUP BY 1")
def r4(t: Tables) -> DataFrame:
    return provenance.file_chunks(t.chunks).groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("file_path")), "|").alias("paths"))


@query("r5_first_provenance", f"WITH {_PROV} SELECT chunk_id, p.namespace, p.document_ref, p.ref FROM (SELECT chunk_id, min(struct_pack(namespace := namespace, document_ref := document_ref, ref := ref)) AS p FROM prov GROUP BY 1)")
def r5(t: Tables) -> DataFrame:
    return provenance.first_provenance(provenance.provenance_of(t.chunks))


@query("r9_graph_without", rf"WITH {_REL}, g AS (SELECT DISTINCT source_id AS id FROM rel WHERE source_id < '8') SELECT source_id, target_id FROM rel WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)")
def r9(t: Tables) -> DataFrame:
    r = _relations(t)
    return graph.without(r, r.where("source_id < '8'").select(F.col("source_id").alias("id"))).select("source_id", "target_id")


@query("r13_holders", "SELECT chunk_id, count(DISTINCT p) AS holders FROM (SELECT chunk_id, unnest(file_paths) AS p FROM chunks) GROUP BY 1 HAVING count(DISTINCT p) <= 1")
def r13(t: Tables) -> DataFrame:
    return provenance.file_chunks(t.chunks).groupBy("chunk_id").agg(F.count_distinct("file_path").alias("holders")).where("holders <= 1")


# Extensions on the star schema: not in the reference, free with Spark.


@query("x1_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def x1(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("x2_region_cube", "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)")
def x2(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("x3_top_orders", "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def x3(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("x4_session_events", """
WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def x4(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


@query("l22_idf", "SELECT source, count(*) AS df, round(ln((SELECT count(*) FROM documents)::DOUBLE / count(*)), 6) AS idf FROM documents GROUP BY 1")
def l22(t: Tables) -> DataFrame:
    total = F.broadcast(t.documents.agg(F.count("*").alias("n")))  # one row
    return t.documents.groupBy("source").agg(F.count("*").alias("df")).crossJoin(total).select("source", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


@query("r12_row_builders", "SELECT DISTINCT chunk_id, document_ref, 'filesystem' || chr(31) || coalesce(document_ref, '') AS key FROM chunks")
def r12(t: Tables) -> DataFrame:
    return t.chunks.select("chunk_id", "document_ref", T.composite(F.lit("filesystem"), "document_ref").alias("key")).distinct()


# Further row selections, cascades and graph rows.

_TOMB = "tomb AS (SELECT DISTINCT ref FROM delta_changes WHERE lower(trim(change_type)) = 'tombstone' AND ref IS NOT NULL)"


def _tombstones(t: Tables) -> DataFrame:
    return t.delta_changes.where((F.lower(F.trim("change_type")) == "tombstone") & F.col("ref").isNotNull()).select("ref").distinct()


@query("b4_backfilled_bindings", "SELECT DISTINCT ref, true AS active FROM documents WHERE ref IS NOT NULL AND ref NOT IN (SELECT ref FROM delta_changes WHERE target_table = 'bindings' AND ref IS NOT NULL)")
def b4(t: Tables) -> DataFrame:
    held = t.delta_changes.where("target_table = 'bindings' AND ref IS NOT NULL").select("ref").distinct()
    new = t.documents.where("ref IS NOT NULL").select("ref").distinct()
    return tables.delete(new, held, ["ref"]).withColumn("active", F.lit(True))


@query("d10_mentions", rf"WITH {_REL}, e AS (SELECT target_id, list_sort(list(DISTINCT source_id)) AS ids FROM rel GROUP BY 1) SELECT unnest(ids) AS source_id, target_id, 'MENTIONS' AS rel_type FROM e")
def d10(t: Tables) -> DataFrame:
    from skein.operators import extraction

    e = _relations(t).groupBy(F.col("target_id").alias("name")).agg(F.array_sort(F.collect_set("source_id")).alias("chunk_ids"))
    return extraction.mentions(e).select("source_id", "target_id", "rel_type")


@query("d15_cache_split", "WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks), h AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE text IS NOT NULL) SELECT chunk_id, sha256(text) IN (SELECT k FROM h) AS hit FROM c")
def d15(t: Tables) -> DataFrame:
    from skein.operators import extraction

    cache = t.documents.where("text IS NOT NULL").select(F.sha2(F.concat_ws(":", F.sha2("text", 256), F.lit("m")), 256).alias("cache_key")).distinct()
    hits, misses = extraction.cached_split(t.chunks.select("chunk_id", "text").distinct(), cache, "m")
    return hits.select("chunk_id", F.lit(True).alias("hit")).unionByName(misses.select("chunk_id", F.lit(False).alias("hit")))


@query("d19_graph_rows", rf"WITH {_REL} SELECT 'edge' AS item, count(*) AS n FROM rel UNION ALL SELECT 'node', (SELECT count(*) FROM (SELECT DISTINCT source_id FROM rel UNION SELECT DISTINCT target_id FROM rel))")
def d19(t: Tables) -> DataFrame:
    r = _relations(t)
    nodes = graph.with_endpoints(r.select(F.lit("sections").alias("table"), F.col("source_id").alias("id")).distinct(), r)
    return graph.export(nodes, r).groupBy("item").agg(F.count("*").alias("n"))


@query("e11_selected_rows", f"WITH {_TOMB} SELECT DISTINCT target_table, ref FROM delta_changes WHERE lower(trim(change_type)) = 'upsert' AND ref IS NOT NULL AND ref NOT IN (SELECT ref FROM tomb)")
def e11(t: Tables) -> DataFrame:
    up = t.delta_changes.where(F.lower(F.trim("change_type")) == "upsert").where("ref IS NOT NULL")
    return up.join(_tombstones(t), "ref", "left_anti").select("target_table", "ref").distinct()


@query("f2_unit_chunks", "SELECT DISTINCT unnest(source_unit_refs) AS unit, chunk_id, chunk_index FROM chunks")
def f2(t: Tables) -> DataFrame:
    return t.chunks.select(F.explode("source_unit_refs").alias("unit"), "chunk_id", "chunk_index").distinct()


@query("f12_denormalised", f"WITH {_PROV}, p AS (SELECT chunk_id, min(struct_pack(namespace := namespace, document_ref := document_ref, ref := ref)) AS p FROM prov GROUP BY 1), d AS (SELECT ref, max(title) AS document_title FROM documents WHERE ref IS NOT NULL GROUP BY 1) SELECT c.chunk_id, p.p.ref AS ref, document_title FROM (SELECT DISTINCT chunk_id FROM chunks) c LEFT JOIN p USING (chunk_id) LEFT JOIN d ON d.ref = p.p.ref")
def f12(t: Tables) -> DataFrame:
    return provenance.denormalised(t.chunks, provenance.provenance_of(t.chunks), t.documents)


@query("f13_component_pairs", "SELECT embedding_model, count(*) AS n FROM (SELECT DISTINCT chunk_id, chunk_strategy, embedding_model FROM vector_components WHERE component = 'text') JOIN (SELECT DISTINCT chunk_id, chunk_strategy, embedding_model FROM vector_components WHERE component = 'meta') USING (chunk_id, chunk_strategy, embedding_model) GROUP BY 1")
def f13(t: Tables) -> DataFrame:
    key = ["chunk_id", "chunk_strategy", "embedding_model"]
    text, meta = (t.vector_components.where(F.col("component") == c).select(*key).distinct() for c in ("text", "meta"))
    return text.join(meta, key).groupBy("embedding_model").agg(F.count("*").alias("n"))


@query("k35_message_routes", f"WITH {_BIND} SELECT DISTINCT m.ref, CASE WHEN active THEN 'local' WHEN NOT active THEN 'inactive' ELSE 'federated' END AS route FROM (SELECT DISTINCT ref FROM delta_changes WHERE ref IS NOT NULL) m LEFT JOIN bind ON bind.ref = m.ref")
def k35(t: Tables) -> DataFrame:
    return provenance.routes(t.delta_changes.where("ref IS NOT NULL"), _bindings(t))


@query("m13_soft_deleted", f"WITH {_BIND}, {_TOMB} SELECT ref, active AND ref NOT IN (SELECT ref FROM tomb) AS active FROM bind")
def m13(t: Tables) -> DataFrame:
    return provenance.deactivated(_bindings(t), _tombstones(t)).select("ref", "active")


@query("n3_pruned_cache", "SELECT DISTINCT text_hash, embedding_model FROM chunk_vectors WHERE text_hash IN (SELECT v.text_hash FROM chunk_vectors v JOIN vector_components c ON v.chunk_id = c.chunk_id)")
def n3(t: Tables) -> DataFrame:
    cache = t.chunk_vectors.select("text_hash", "embedding_model").distinct()
    live = t.chunk_vectors.join(t.vector_components.select("chunk_id"), "chunk_id", "left_semi").select("text_hash").distinct()
    return cache.join(live, "text_hash", "left_semi")


@query("r15_path_titles", "SELECT document_ref AS path, max(title) AS title, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ', '), '') AS tags FROM documents WHERE document_ref IS NOT NULL GROUP BY 1")
def r15(t: Tables) -> DataFrame:
    return t.documents.where("document_ref IS NOT NULL").groupBy(F.col("document_ref").alias("path")).agg(F.max("title").alias("title"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("tags"))


@query("r23_label_inventory", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def r23(t: Tables) -> DataFrame:
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))
