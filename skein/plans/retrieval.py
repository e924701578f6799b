"""Queries of retrieval: keyword, vectors, graph, fusion, rerank, snippets, and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import runtime
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import embedding, extraction, graph, quality, retrieval
from skein.plans.registry import Tables, query

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(query, '\p{C}', ' ', 'g'), '[^\p{L}\p{N}_\s''\-]', ' ', 'g'), '\s+', ' ', 'g'))"
_BM25 = rf"""
text1 AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY chunk_id),
w AS (SELECT chunk_id, {_WORDS.format('text')} AS w FROM text1),
post AS (SELECT term, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL),
stat AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT DISTINCT chunk_id, len FROM post)),
q AS (SELECT DISTINCT id AS query_id, unnest({_WORDS.format(_CLEAN)}) AS term FROM (SELECT id, max(query) AS query FROM surreal_golden_queries GROUP BY id)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hits AS (SELECT query_id, chunk_id, count(*) AS matched, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))), 6) AS score
  FROM q JOIN post USING (term) JOIN df USING (term), stat GROUP BY query_id, chunk_id),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 10)"""


def _queries(t: Tables) -> DataFrame:
    return t.surreal_golden_queries.groupBy(F.col("id").alias("query_id")).agg(F.max("query").alias("text")).where("text IS NOT NULL")


def _texts(t: Tables) -> DataFrame:
    """The texts once, stored: indexes read them several times."""
    return runtime.materialize(t.chunks.groupBy("chunk_id").agg(F.max("text").alias("text"), F.max("title").alias("title")), "texts")


@query("k3_bm25", f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM keyword")
def k3(t: Tables) -> DataFrame:
    return retrieval.bm25(_queries(t), retrieval.index(_texts(t), "text"), 10)


@query("k3_bm25_every_term", f"""WITH {_BM25}, n AS (SELECT query_id, count(*) AS terms FROM q GROUP BY 1)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits JOIN n USING (query_id) WHERE matched = terms QUALIFY rank <= 10""")
def k3_every(t: Tables) -> DataFrame:
    return retrieval.bm25(_queries(t), retrieval.index(_texts(t), "text"), 10, every_term=True)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = f"CASE WHEN sqrt({_DOT.format(a='q.v', b='q.v')}) * sqrt({_DOT.format(a='e.v', b='e.v')}) > 0 THEN {_DOT.format(a='q.v', b='e.v')} / (sqrt({_DOT.format(a='q.v', b='q.v')}) * sqrt({_DOT.format(a='e.v', b='e.v')})) ELSE 0 END"


@query("k5_knn", f"""
WITH e AS (SELECT vec_id AS chunk_id, embedding AS v FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, chunk_id, round({_COS}, 6) AS score FROM q, e)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""")
def k5(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return retrieval.knn(e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), e, 10)


@query("k5_relative_floor", f"""
WITH e AS (SELECT vec_id AS chunk_id, embedding AS v FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, chunk_id, round({_COS}, 6) AS score FROM q, e), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM k) WHERE score >= best * 0.6e0""")
def k5_floor(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return retrieval.knn(e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), e, 10, floor=0.6)


@query("k7_preconditions", "SELECT embedding_model, count(*) AS n, min(len(vector)) AS least, max(len(vector)) AS most, coalesce(min(len(vector)) = max(len(vector)) AND min(len(vector)) > 0, false) AS ready FROM chunk_vectors WHERE vector IS NOT NULL GROUP BY 1")
def k7(t: Tables) -> DataFrame:
    return retrieval.preconditions(t.chunk_vectors.where("vector IS NOT NULL"))


@query("i2_sharded_topk", f"""
WITH e AS (SELECT vec_id AS chunk_id, embedding AS v, label FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, chunk_id, label, round({_COS}, 6) AS score FROM q, e), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, chunk_id) AS r FROM s QUALIFY r <= 10)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p QUALIFY rank <= 10""")
def i2(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    hits = retrieval.knn(e.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), e, e.count()).drop("rank")
    return retrieval.sharded_topk(hits.join(e.select("chunk_id", "label"), "chunk_id"), F.col("label"), 10).drop("label")


def _relations(t: Tables) -> DataFrame:
    rows = extraction.wikilinks(t.chunks)
    return rows.select(F.lit("sections").alias("source_table"), "source_id", F.lit("entities").alias("target_table"), F.regexp_replace("target_id", r"-\d+$", "").alias("target_id"), F.lit("MENTIONS").alias("rel_type"), (F.length("target_id") / 10.0).alias("weight")).distinct()


_REL = r"rel AS (SELECT DISTINCT chunk_id AS source_id, regexp_replace(x, '-\d+$', '') AS target_id, length(x) / 10.0e0 AS weight FROM (SELECT chunk_id, trim(unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1))) AS x FROM chunks) WHERE x <> '')"
_MATCH = rf"""
names AS (SELECT lower(target_id) AS key, max(target_id) AS name FROM rel GROUP BY 1),
q AS (SELECT id AS query_id, {_WORDS.format('max(query)')} AS w FROM surreal_golden_queries GROUP BY id),
match AS (SELECT DISTINCT query_id, name FROM (SELECT query_id, unnest(w) AS word FROM q) JOIN names ON word = key)"""


def _matches(t: Tables, relations: DataFrame) -> DataFrame:
    names = graph.catalogue(relations.select(F.col("target_id").alias("name")))
    return graph.matched_entities(_queries(t).withColumn("query_id", F.col("query_id")), names)


@query("k10_catalogue", rf"WITH {_REL} SELECT lower(target_id) AS key, max(target_id) AS name FROM rel GROUP BY 1")
def k10(t: Tables) -> DataFrame:
    return graph.catalogue(_relations(t).select(F.col("target_id").alias("name")))


@query("k11_matched_entities", rf"WITH {_REL}, {_MATCH} SELECT query_id, name FROM match")
def k11(t: Tables) -> DataFrame:
    return _matches(t, _relations(t))


@query("k12_graph_direct", rf"""WITH {_REL}, {_MATCH},
s AS (SELECT query_id, source_id AS chunk_id, sum(weight) AS total FROM match JOIN rel ON name = target_id GROUP BY 1, 2), n AS (SELECT query_id, chunk_id, total / max(total) OVER (PARTITION BY query_id) AS score FROM s)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM n QUALIFY rank <= 10""")
def k12(t: Tables) -> DataFrame:
    relations = _relations(t)
    words = _queries(t).select("query_id", F.explode(T.words("text")).alias("word"))
    names = graph.catalogue(relations.select(F.col("target_id").alias("name")))
    return graph.direct(words.join(names, F.col("word") == F.col("key")).select("query_id", "name").distinct(), relations, t.chunks.select("chunk_id"), 10)


@query("k13_graph_counts", rf"""WITH {_REL}, {_MATCH},
s AS (SELECT query_id, source_id AS chunk_id, count(DISTINCT name) AS n FROM match JOIN rel ON name = target_id GROUP BY 1, 2), n AS (SELECT query_id, chunk_id, n / max(n) OVER (PARTITION BY query_id) AS score FROM s)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM n QUALIFY rank <= 10""")
def k13(t: Tables) -> DataFrame:
    relations = _relations(t)
    words = _queries(t).select("query_id", F.explode(T.words("text")).alias("word"))
    names = graph.catalogue(relations.select(F.col("target_id").alias("name")))
    return graph.counted(words.join(names, F.col("word") == F.col("key")).select("query_id", "name").distinct(), relations, 10)


@query("k14_graph_enrich", rf"""WITH {_REL}, {_BM25},
seed AS (SELECT DISTINCT query_id, chunk_id AS seed FROM keyword WHERE rank <= 8),
via AS (SELECT query_id, seed, target_id AS via FROM seed JOIN rel ON seed = source_id),
far AS (SELECT query_id, source_id AS chunk_id, round(sum(weight), 6) AS score FROM via JOIN rel ON via = target_id WHERE source_id <> seed GROUP BY 1, 2),
kept AS (SELECT far.* FROM far WHERE NOT EXISTS (SELECT 1 FROM seed WHERE seed.query_id = far.query_id AND seed = chunk_id))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kept QUALIFY rank <= 10""")
def k14(t: Tables) -> DataFrame:
    seeds = retrieval.bm25(_queries(t), retrieval.indexes(t.chunks, ("text",))[0], 10)
    return graph.enriched(seeds, runtime.materialize(_relations(t), "relations"), t.chunks, 10, most_seeds=8, digits=6)


@query("f11_related_all", rf"WITH {_REL} SELECT l.source_id AS section, r.source_id AS other, round(sum(r.weight), 6) AS weight FROM (SELECT DISTINCT source_id, target_id FROM rel) l JOIN rel r USING (target_id) WHERE l.source_id <> r.source_id GROUP BY 1, 2")
def f11_all(t: Tables) -> DataFrame:
    return graph.related(_relations(t)).withColumn("weight", F.round("weight", 6))


_LISTS = rf"""WITH {_BM25},
title1 AS (SELECT chunk_id, max(title) AS text FROM chunks GROUP BY chunk_id), tw AS (SELECT chunk_id, {_WORDS.format('text')} AS w FROM title1),
tpost AS (SELECT term, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM tw) GROUP BY ALL), tstat AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT DISTINCT chunk_id, len FROM tpost)),
tdf AS (SELECT term, count(*) AS df FROM tpost GROUP BY term),
thits AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))), 6) AS score FROM q JOIN tpost USING (term) JOIN tdf USING (term), tstat GROUP BY query_id, chunk_id),
titles AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM thits QUALIFY rank <= 10),
lists AS (SELECT query_id, 0 AS o, chunk_id, rank FROM titles UNION ALL SELECT query_id, 1, chunk_id, rank FROM keyword),
fused AS (SELECT query_id, chunk_id, round(sum(1.0e0 / (60 + rank)), 9) AS score, min(struct_pack(o := o, r := rank)) AS t FROM lists GROUP BY 1, 2),
final AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t.o, t.r, chunk_id) AS rank FROM fused)"""


@query("k3_fielded", rf"""{_LISTS}, f AS (SELECT query_id, chunk_id, 5.0e0 * score AS score FROM titles UNION ALL SELECT query_id, chunk_id, 1.0e0 * score FROM keyword),
s AS (SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM f GROUP BY 1, 2)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""")
def k3_fielded(t: Tables) -> DataFrame:
    return retrieval.fielded(_queries(t), *retrieval.indexes(t.chunks, ("title", "text")), 10)


def _fused(t: Tables, texts: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """texts, titles: the stored texts and the hits in titles where a query has them already."""
    q = _queries(t)
    held = retrieval.indexes(t.chunks, ("title", "text")) if texts is None else [None if titles is not None else retrieval.index(texts, "title"), retrieval.index(texts, "text")]
    titles = retrieval.bm25(q, held[0], 10) if titles is None else titles
    lists = titles.select("query_id", F.lit("semantic").alias("engine"), "chunk_id", "rank").unionByName(
        retrieval.bm25(q, held[1], 10).select("query_id", F.lit("keyword").alias("engine"), "chunk_id", "rank"))
    return retrieval.reciprocal_rank_fusion(lists)


@query("k16_rrf", f"{_LISTS} SELECT query_id, chunk_id, score, rank FROM final")
def k16(t: Tables) -> DataFrame:
    return _fused(t).select("query_id", "chunk_id", "score", "rank")


@query("hybrid_search")
def hybrid(t: Tables) -> DataFrame:
    """Keyword over both fields, hashed vectors of all chunks, graph; fused, reranked, blended, with snippets."""
    q, texts, relations = _queries(t), _texts(t), runtime.materialize(_relations(t), "relations")
    titles, words = (retrieval.index(texts, c) for c in ("title", "text"))
    keyword = retrieval.fielded(q, titles, words, 20)
    encode = embedding.hashing_encoder()
    vectors = runtime.materialize(embedding.encoded(texts, "text", encode).select("chunk_id", "vector"), "vectors")
    semantic = retrieval.knn(embedding.encoded(q, "text", encode), vectors, 20, 0.85)
    fused = runtime.materialize(retrieval.pool("hybrid", semantic, keyword, graph.direct(_matches(t, relations), relations, texts, 20)), "fused")
    near = fused.where("rank <= 20").join(texts.select("chunk_id", "text"), "chunk_id").join(q.select("query_id", F.col("text").alias("query")), "query_id")
    again = retrieval.reranked(near.select("query_id", "chunk_id", "query", "text"))
    mixed = retrieval.blended(fused.drop("rank").join(again.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"], "left"))
    top = mixed.where("rank <= 10").select("query_id", "chunk_id", F.col("blended").alias("score"), "engines", "rank")
    return retrieval.candidates(top, t.chunks, q)


@query("k18_length_penalty", "SELECT DISTINCT chunk_id, round(CASE WHEN length(text) < 200 THEN 1.0e0 - 0.2e0 * (1 - length(text) / 200.0e0) ELSE 1.0e0 END, 6) AS score FROM chunks")
def k18(t: Tables) -> DataFrame:
    return t.chunks.select("chunk_id", F.round(retrieval.length_penalty(F.lit(1.0), F.col("text"), 200), 6).alias("score")).distinct()


@query("k18_reranked", rf"""WITH {_BM25}, top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM hits QUALIFY r <= 20),
asked AS (SELECT id AS query_id, list_distinct({_WORDS.format('max(query)')}) AS qw FROM surreal_golden_queries GROUP BY id),
p AS (SELECT query_id, chunk_id, text, len(list_intersect(qw, list_distinct({_WORDS.format('text')}))) / greatest(1, len(qw))::DOUBLE AS score FROM top JOIN text1 USING (chunk_id) JOIN asked USING (query_id)),
f AS (SELECT query_id, chunk_id, round(CASE WHEN length(text) < 200 THEN score - 0.2e0 * (1 - length(text) / 200.0e0) ELSE score END, 6) AS rerank_score FROM p)
SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM f""")
def k18_reranked(t: Tables) -> DataFrame:
    texts = _texts(t)
    hits = retrieval.bm25(_queries(t), retrieval.index(texts, "text"), 20)
    pairs = hits.join(texts.select("chunk_id", "text"), "chunk_id").join(_queries(t).select("query_id", F.col("text").alias("query")), "query_id")
    return retrieval.reranked(pairs.select("query_id", "chunk_id", "query", "text")).select("query_id", "chunk_id", "rerank_score", "rank")


@query("k19_blend", rf"""{_LISTS},
c AS (SELECT f.query_id, f.chunk_id, f.score, CASE WHEN f.rank <= 5 THEN length(text) / 1000.0e0 END AS r FROM final f JOIN text1 USING (chunk_id)),
m AS (SELECT *, min(CASE WHEN r IS NOT NULL THEN score END) OVER w AS lo, max(CASE WHEN r IS NOT NULL THEN score END) OVER w AS hi, min(r) OVER w AS rlo, max(r) OVER w AS rhi FROM c WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, round(CASE WHEN r IS NULL THEN score ELSE 0.4e0 * (score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END + 0.6e0 * (r - rlo) / CASE WHEN rhi > rlo THEN rhi - rlo ELSE 1 END END, 6) AS blended FROM m""")
def k19(t: Tables) -> DataFrame:
    texts = _texts(t)
    rows = _fused(t, texts).join(texts.select("chunk_id", F.length("text").alias("length")), "chunk_id").withColumn("rerank_score", F.when(F.col("rank") <= 5, F.col("length") / 1000.0)).drop("rank", "length", "engines")
    return retrieval.blended(rows).select("query_id", "chunk_id", "blended")


@query("k20_snippets")
def k20(t: Tables) -> DataFrame:
    hits = retrieval.bm25(_queries(t), retrieval.indexes(t.chunks, ("text",))[0], 5).withColumn("engines", F.array(F.lit("keyword")))
    return retrieval.candidates(hits, t.chunks, _queries(t))


@query("k22_public_refs", "SELECT DISTINCT chunk_id, CASE WHEN split_part(ref, ':', 1) = 'telegram' AND len(source_unit_refs) = 1 THEN 'telegram:' || source_unit_refs[1] ELSE ref END AS public_ref FROM chunks WHERE ref IS NOT NULL")
def k22(t: Tables) -> DataFrame:
    return t.chunks.where("ref IS NOT NULL").select("chunk_id", retrieval.public_ref(T.namespace_of("ref"), F.col("ref"), F.col("source_unit_refs")).alias("public_ref")).distinct()


@query("k25_quota_merge", rf"""{_LISTS},
fed AS (SELECT query_id, CAST(chunk_id AS VARCHAR) AS ref, rank AS n FROM titles WHERE rank <= 3), slots AS (SELECT query_id, count(*) AS slots FROM fed GROUP BY 1),
own AS (SELECT query_id, chunk_id AS ref, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM final),
al AS (SELECT own.query_id, ref, 'local' AS origin, 0 AS o, n FROM own LEFT JOIN slots USING (query_id) WHERE n <= 10 - coalesce(slots, 0) UNION ALL SELECT query_id, ref, 'federated', 1, n FROM fed)
SELECT query_id, ref, origin, row_number() OVER (PARTITION BY query_id ORDER BY o, n) AS position FROM al""")
def k25(t: Tables) -> DataFrame:
    texts = _texts(t)
    titles = retrieval.bm25(_queries(t), retrieval.index(texts, "title"), 10)
    local = _fused(t, texts, titles).select("query_id", F.col("chunk_id").alias("ref"), "score")
    fed = titles.select("query_id", F.col("chunk_id").alias("ref"), F.lit("gmail").alias("namespace"), F.lit("").alias("snippet"), F.col("rank").alias("native_rank"))
    return retrieval.quota_merge(local, fed, 10, 3)


@query("f9_first_of_ref", rf"""{_LISTS}, h AS (SELECT query_id, CASE o WHEN 0 THEN 'semantic' ELSE 'keyword' END AS engine, l.chunk_id, rank, ref FROM lists l JOIN (SELECT DISTINCT chunk_id, ref FROM chunks WHERE ref IS NOT NULL) p USING (chunk_id))
SELECT query_id, engine, ref, chunk_id, rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id, engine, ref ORDER BY rank, chunk_id) = 1""")
def f9(t: Tables) -> DataFrame:
    q, texts = _queries(t), _texts(t)
    lists = retrieval.bm25(q, retrieval.index(texts, "title"), 10).withColumn("engine", F.lit("semantic")).unionByName(retrieval.bm25(q, retrieval.index(texts, "text"), 10).withColumn("engine", F.lit("keyword")))
    return retrieval.first_of_ref(lists, t.chunks.where("ref IS NOT NULL")).select("query_id", "engine", "ref", "chunk_id", "rank")


@query("g23_overlap", rf"{_LISTS}, a AS (SELECT query_id, list(chunk_id) AS x FROM titles GROUP BY 1), b AS (SELECT query_id, list(chunk_id) AS y FROM keyword GROUP BY 1) SELECT query_id, len(list_intersect(x, y)) AS shared FROM a JOIN b USING (query_id)")
def g23(t: Tables) -> DataFrame:
    q = _queries(t)
    a, b = (retrieval.bm25(q, held, 10) for held in retrieval.indexes(t.chunks, ("title", "text")))
    return retrieval.overlap(a, b, 10).withColumn("shared", F.col("shared").cast("long"))


@query("k1_expanded_queries")
def k1(t: Tables) -> DataFrame:
    known = t.mix_targets.select(F.upper(F.regexp_replace("source", "[^a-z]", "")).substr(1, 4).alias("acronym"), F.array("source").alias("expansions")).dropDuplicates(["acronym"])
    return retrieval.expanded(_queries(t), known)


@query("f18_fuzzy_terms", "SELECT DISTINCT s.sender AS a, d.display_name AS b FROM senders s, senders d WHERE levenshtein(split_part(s.sender, '_', 1), lower(d.display_name)) <= 1")
def f18(t: Tables) -> DataFrame:
    handle, name = F.split("sender", "_")[0], F.lower("display_name")
    a = t.senders.where("sender IS NOT NULL").select(F.col("sender").alias("a"), handle.alias("x"), F.explode(retrieval.deletions(handle, 1)).alias("left"))
    b = t.senders.where("display_name IS NOT NULL").select(F.col("display_name").alias("b"), name.alias("y"), F.explode(retrieval.deletions(name, 1)).alias("left"))
    return a.join(b, "left").where(F.levenshtein("x", "y") <= 1).select("a", "b").distinct()


@query("k29_cache_layers", """
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks), s AS (SELECT DISTINCT chunk_id FROM chunk_vectors), h AS (SELECT DISTINCT sha256(text) AS h FROM c JOIN s USING (chunk_id))
SELECT chunk_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM s) THEN 'stored' WHEN sha256(text) IN (SELECT h FROM h) THEN 'cached' ELSE 'missing' END AS layer FROM c""")
def k29(t: Tables) -> DataFrame:
    c = t.chunks.select("chunk_id", "text").distinct()
    cache = c.join(t.chunk_vectors, "chunk_id", "left_semi").select(F.sha2("text", 256).alias("text_hash"))
    return embedding.cache_layers(c, t.chunk_vectors, cache).select("chunk_id", "layer")


@query("k30_fused_vectors")
def k30(t: Tables) -> DataFrame:
    v = embedding.fused_components(t.vector_components.where("embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> isnan(x))"))
    return v.select("chunk_id", "chunk_strategy", "embedding_model", F.round(V.norm(F.col("vector")), 4).alias("norm"), F.size("vector").alias("length"))


@query("k31_embedded")
def k31(t: Tables) -> DataFrame:
    c = t.chunks.select("chunk_id", "text").distinct()
    none = t.chunk_vectors.where("false")
    v = embedding.embedded(c, none.select("chunk_id", "vector"), none.select("text_hash", "vector"), embedding.hashing_encoder())
    return v.select("chunk_id", "text_hash", F.size("vector").alias("length"))


@query("k32_shards")
def k32(t: Tables) -> DataFrame:
    return t.chunk_vectors.groupBy(embedding.shard("chunk_strategy", "embedding_model", "chunk_id", 8).alias("shard")).agg(F.count("*").alias("n"))


@query("n7_backfill", """
WITH c AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY 1), w AS (SELECT chunk_id FROM c UNION SELECT chunk_id FROM vector_components), s AS (SELECT DISTINCT chunk_id, 1 AS e FROM chunk_vectors)
SELECT w.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'missing_chunk' WHEN trim(text) = '' THEN 'empty_text' WHEN e = 1 THEN 'embedded' ELSE 'pending' END AS status FROM w LEFT JOIN c USING (chunk_id) LEFT JOIN s USING (chunk_id)""")
def n7(t: Tables) -> DataFrame:
    return embedding.backfill(t.chunks.select("chunk_id").unionByName(t.vector_components.select("chunk_id")), t.chunks, t.chunk_vectors)


def _judged(t: Tables) -> DataFrame:
    one = t.surreal_golden_queries.dropDuplicates(["id"])
    rel = one.select(F.col("id").alias("query_id"), F.explode("relevant").alias("x")).select("query_id", F.col("x.ref").alias("item"), F.lit("relevant").alias("grade"))
    return rel.unionByName(one.select(F.col("id").alias("query_id"), F.explode("maybe").alias("x")).select("query_id", F.col("x.ref").alias("item"), F.lit("maybe").alias("grade"))).distinct()


@query("n11_measures", rf"""{_LISTS},
g AS (SELECT id AS query_id, any_value(relevant) AS rel, any_value(maybe) AS may FROM surreal_golden_queries GROUP BY id),
r AS (SELECT DISTINCT query_id, x.ref AS item FROM (SELECT query_id, unnest(rel) AS x FROM g)), m AS (SELECT DISTINCT query_id, x.ref AS item FROM (SELECT query_id, unnest(may) AS x FROM g) EXCEPT SELECT * FROM r),
grade AS (SELECT *, 2 AS gain FROM r UNION ALL SELECT *, 1 FROM m),
h AS (SELECT query_id, ref AS item, row_number() OVER (PARTITION BY query_id ORDER BY rank, ref) AS rank FROM (SELECT query_id, ref, min(rank) AS rank FROM final JOIN (SELECT DISTINCT chunk_id, ref FROM chunks WHERE ref IS NOT NULL) p USING (chunk_id) GROUP BY 1, 2)),
j AS (SELECT h.*, coalesce(gain, 0) AS gain FROM h LEFT JOIN grade USING (query_id, item)),
got AS (SELECT query_id, min(CASE WHEN gain > 0 AND rank <= 10 THEN rank END) AS f, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg FROM j GROUP BY 1),
ideal AS (SELECT query_id, sum(gain / log2(k + 1)) AS ideal FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS k FROM grade QUALIFY k <= 10) GROUP BY 1)
SELECT i.query_id, coalesce(CAST(f <= 1 AS INTEGER), 0) AS hit1, coalesce(CAST(f <= 3 AS INTEGER), 0) AS hit3, coalesce(CAST(f <= 5 AS INTEGER), 0) AS hit5, round(coalesce(1.0e0 / f, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM ideal i LEFT JOIN got USING (query_id)""")
def n11(t: Tables) -> DataFrame:
    refs = _fused(t).join(t.chunks.where("ref IS NOT NULL").select("chunk_id", "ref").distinct(), "chunk_id").groupBy("query_id", F.col("ref").alias("item")).agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "item")
    return quality.measures(refs.withColumn("rank", F.row_number().over(order)), _judged(t))


def _timed(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 10 == 0, "cold").otherwise("hot").alias("pass_kind"), (F.col("value") * 100).alias("elapsed_ms"))


@query("g21_latencies", """
WITH e AS (SELECT event_type AS model, CASE WHEN event_id % 10 = 0 THEN 'cold' ELSE 'hot' END AS pass_kind, value * 100 AS ms FROM events),
g AS (SELECT model, pass_kind, count(*) AS n, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95 FROM e GROUP BY 1, 2)
SELECT model, pass_kind, n, round(p50, 4) AS p50, round(p95, 4) AS p95, CASE WHEN p95 <= 10000 THEN 'fast' WHEN p95 <= 30000 THEN 'acceptable' WHEN p95 <= 120000 THEN 'slow' ELSE 'unusable' END AS band FROM g""")
def g21(t: Tables) -> DataFrame:
    return quality.latencies(_timed(t)).withColumns({"p50": F.round("p50", 4), "p95": F.round("p95", 4)})


@query("g20_summary")
def g20(t: Tables) -> DataFrame:
    rows = _timed(t).withColumn("error", F.lit(None).cast("string")).withColumn("pool_miss", F.col("pass_kind") == "cold")
    return quality.summary(rows.withColumns({c: F.round(F.col("elapsed_ms") / 1e6, 6) for c in ("hit1", "hit3", "hit5", "mrr", "ndcg")}))


@query("h6_min_max", "SELECT event_id, round((value - min(value) OVER w) / CASE WHEN max(value) OVER w > min(value) OVER w THEN max(value) OVER w - min(value) OVER w ELSE 1 END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def h6(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(retrieval.min_max(F.col("value"), "user_id"), 6).alias("scaled"))
