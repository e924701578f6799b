"""Queries of scans and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import chunking
from skein.plans.registry import Tables, query
from skein.sources import files

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
LOW = ", ".join(f"'{w}'" for w in T.LOW_SIGNAL)


@query("a5_excluded_paths", "SELECT doc_id FROM documents WHERE list_has_any(string_split(document_ref, '/'), ['vault', 'node_modules'])")
def a5(t: Tables) -> DataFrame:
    return t.documents.where(files.is_excluded(F.col("document_ref"), files.excluded_names(["**/vault/**", "node_modules", "a/*/b"]))).select("doc_id")


@query("a7_frontmatter_body", r"""
SELECT doc_id, CASE WHEN starts_with(text, '---') AND contains(substr(text, 4), '---') THEN md5(regexp_replace(substr(text, 4 + instr(substr(text, 4), '---') + 2), '^\n+', '')) ELSE md5(text) END AS body FROM documents WHERE text IS NOT NULL""")
def a7(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(chunking.body_text(F.col("text"))).alias("body"))


@query("a8_titles", r"""
WITH d AS (SELECT doc_id, document_ref, text, CASE WHEN text LIKE '---%' AND instr(text[4:], '---') > 0 THEN split_part(text[4:], '---', 1) END AS front FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, CASE WHEN front IS NULL THEN text ELSE text[length(front) + 7:] END AS body FROM d)
SELECT doc_id, coalesce(nullif(trim(regexp_extract(front, '(?m)^title:[ ]*(.*)$', 1), ' ' || chr(34) || chr(39)), ''), nullif(trim(regexp_extract(body, '(?m)^# (.+)$', 1)), ''), regexp_replace(split_part(document_ref, '/', -1), '\.[^.]*$', '')) AS title FROM b""")
def a8(t: Tables) -> DataFrame:
    d = t.documents.where("text IS NOT NULL").select("doc_id", F.col("document_ref").alias("path"), F.col("text"))
    d = d.withColumn("fields", chunking.frontmatter_map(chunking.frontmatter_block(F.col("text"))))
    return d.select("doc_id", chunking.title(F.col("fields"), chunking.body_text(F.col("text")), F.col("path")).alias("title"))


@query("a16_counts", """SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'embeddings', count(*) FROM chunk_vectors""")
def a16(t: Tables) -> DataFrame:
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one(t.documents, "documents").unionByName(one(t.chunks, "chunks")).unionByName(one(t.chunk_vectors, "embeddings"))


@query("e3_noise_tokens", f"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM chunks)
SELECT token, count(*) AS n FROM w WHERE token IN ({STOP}) OR regexp_matches(token, '^[0-9a-f]{{3,8}}$') GROUP BY token""")
def e3(t: Tables) -> DataFrame:
    return t.chunks.select(F.explode(T.words("text")).alias("token")).where(T.is_noise(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query("e4_low_signal", f"""
SELECT dialog_id, message_id, epoch_us(received_at) AS received FROM telegram_messages WHERE trim(coalesce(text, '')) = '' OR lower(trim(text)) IN ({LOW}) OR NOT regexp_matches(lower(trim(text)), '[\\p{{L}}\\p{{N}}]') OR regexp_matches(lower(trim(text)), '\\p{{S}}')""")
def e4(t: Tables) -> DataFrame:
    return t.telegram_messages.where(T.low_signal("text")).select("dialog_id", "message_id", F.unix_micros("received_at").alias("received"))


@query("e10_kept_metadata", "SELECT dialog_id, message_id, sender, epoch_us(sent_at) AS sent, dialog_name FROM telegram_messages WHERE dialog_name IS NOT NULL")
def e10(t: Tables) -> DataFrame:
    return t.telegram_messages.select("dialog_id", "message_id", "sender", F.unix_micros("sent_at").alias("sent"), "dialog_name").where("dialog_name IS NOT NULL")


@query("e14_display_text", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '^---\n(.|\n)*?\n---\n?', ''), '\[\d{2}:\d{2}:\d{2}\]\s*', '', 'g'), ' ')) AS shown FROM documents WHERE text IS NOT NULL""")
def e14(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(T.display_text("text")).alias("shown"))


@query("l1_tokens", "SELECT doc_id, CAST(greatest(1, strlen(text) // 4) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def l1(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", T.estimated_tokens("text").alias("tokens"))


@query("l2_tokenize", f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM documents)
SELECT doc_id, count(*) AS n FROM w WHERE NOT (token IN ({STOP}) OR regexp_matches(token, '^[0-9a-f]{{3,8}}$')) GROUP BY doc_id""")
def l2(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.tokens("text")).cast("long").alias("n")).where("n > 0")


@query("l4_sentences", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS at, unnest(l) AS sentence FROM s""")
def l4(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.posexplode(T.sentences("text")).alias("at", "sentence"))


@query("l5_cleaned", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text FROM documents WHERE text IS NOT NULL""")
def l5(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(T.cleaned("text")).alias("text"))


@query("l6_levenshtein", "SELECT a.source AS a, b.source AS b, levenshtein(a.source, b.source) AS d FROM mix_targets a, mix_targets b WHERE a.source < b.source")
def l6(t: Tables) -> DataFrame:
    a, b = t.mix_targets.select(F.col("source").alias("a")), t.mix_targets.select(F.col("source").alias("b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("d", F.levenshtein("a", "b").cast("long"))  # eleven fixed rows


@query("l8_refs", "SELECT doc_id, split_part(ref, ':', 1) AS namespace, substr(ref, instr(ref, ':') + 1) AS document_ref FROM documents WHERE ref IS NOT NULL")
def l8(t: Tables) -> DataFrame:
    return t.documents.where("ref IS NOT NULL").select("doc_id", T.namespace_of("ref").alias("namespace"), T.document_of("ref").alias("document_ref"))


@query("l8_message_refs", r"SELECT DISTINCT ref, CAST(regexp_extract(ref, '^telegram:dialog:(\d+):message:(\d+)$', 1) AS BIGINT) AS dialog_id, CAST(regexp_extract(ref, '^telegram:dialog:(\d+):message:(\d+)$', 2) AS BIGINT) AS message_id FROM delta_changes WHERE regexp_matches(ref, '^telegram:dialog:\d+:message:\d+$')")
def l8m(t: Tables) -> DataFrame:
    return t.delta_changes.select("ref", T.message_dialog("ref").alias("dialog_id"), T.message_number("ref").alias("message_id")).where("dialog_id IS NOT NULL").distinct()


@query("l9_composite_key", "SELECT DISTINCT chunk_id, chunk_strategy || chr(31) || coalesce(embedding_model, '') AS key FROM chunk_vectors")
def l9(t: Tables) -> DataFrame:
    return t.chunk_vectors.select("chunk_id", T.composite("chunk_strategy", "embedding_model").alias("key")).distinct()


@query("l10_record_ids", "SELECT DISTINCT ref, 'u8_' || rtrim(replace(replace(to_base64(encode(ref)), '+', '-'), '/', '_'), '=') AS record_id, ref AS back FROM documents WHERE ref IS NOT NULL")
def l10(t: Tables) -> DataFrame:
    return t.documents.where("ref IS NOT NULL").select("ref", T.record_id("ref").alias("record_id"), T.record_text(T.record_id("ref")).alias("back")).distinct()


@query("l11_checksums", "SELECT doc_id, sha256(concat_ws(chr(10), kind, text)) AS content, sha256(concat_ws(chr(10), coalesce(title, ''), source)) AS meta FROM documents WHERE source IS NOT NULL")
def l11(t: Tables) -> DataFrame:
    return t.documents.where("source IS NOT NULL").select("doc_id", T.chunk_checksum("kind", "text").alias("content"), T.meta_checksum("title", F.array("source")).alias("meta"))


@query("l13_json_fingerprints")
def l13(t: Tables) -> DataFrame:
    return t.telegram_messages.where("message_id IS NOT NULL").select("dialog_id", "message_id", T.json_fingerprint(sender="sender", text="text", edit_date="edit_date").alias("fingerprint")).distinct()


@query("l14_json_fields", "SELECT change_no, json_extract_string(row_json, '$.title') AS title, json_extract_string(row_json, '$.len') AS len FROM delta_changes WHERE row_json IS NOT NULL")
def l14(t: Tables) -> DataFrame:
    m = T.json_map("row_json")
    return t.delta_changes.where("row_json IS NOT NULL").select("change_no", F.try_element_at(m, F.lit("title")).alias("title"), F.try_element_at(m, F.lit("len")).alias("len"))


@query("l16_moments", "SELECT doc_id, epoch(updated_at)::BIGINT AS iso, epoch(updated_at)::BIGINT AS seconds FROM documents WHERE updated_at IS NOT NULL")
def l16(t: Tables) -> DataFrame:
    d = t.documents.where("updated_at IS NOT NULL").select("doc_id", F.unix_timestamp("updated_at").cast("string").alias("s"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("i"))
    return d.select("doc_id", F.unix_timestamp(T.moment("i")).alias("iso"), F.unix_timestamp(T.moment("s")).alias("seconds"))


@query("l17_order_keys", "SELECT DISTINCT message_id, lpad(CAST(message_id AS VARCHAR), 20, '0') AS order_key FROM telegram_messages WHERE message_id IS NOT NULL")
def l17(t: Tables) -> DataFrame:
    return t.telegram_messages.where("message_id IS NOT NULL").select("message_id", T.order_key("message_id").alias("order_key")).distinct()


@query("l18_durations", """
SELECT doc_id, CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%dh%02dm', s // 3600, (s // 60) % 60) END AS duration
FROM (SELECT doc_id, CAST(epoch(ingested_at) AS BIGINT) - CAST(epoch(updated_at) AS BIGINT) AS s FROM documents) WHERE s >= 0""")
def l18(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", (F.unix_timestamp("ingested_at") - F.unix_timestamp("updated_at")).alias("s")).where("s >= 0")
    return d.select("doc_id", T.duration_text("s").alias("duration"))


@query("l20_tags_text", "SELECT id, array_to_string(list_filter(list_transform(expected_engines, lambda x: trim(x)), lambda x: x <> ''), ' ') AS tags FROM surreal_golden_queries WHERE expected_engines IS NOT NULL")
def l20(t: Tables) -> DataFrame:
    return t.surreal_golden_queries.where("expected_engines IS NOT NULL").select("id", T.tags_text("expected_engines").alias("tags"))


@query("l21_unit_vectors", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS square, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 4) AS itself FROM embeddings""")
def l21(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(V.dot(e, e), 4).alias("square"), F.round(V.cosine(e, V.normalized(e)), 4).alias("itself"))


@query("l26_prefixed", "SELECT id, 'query: ' || query AS text FROM surreal_golden_queries WHERE query IS NOT NULL")
def l26(t: Tables) -> DataFrame:
    return t.surreal_golden_queries.where("query IS NOT NULL").select("id", F.concat(F.lit("query: "), "query").alias("text"))


@query("l27_model_suffix", "SELECT DISTINCT embedding_model, trim(regexp_replace(lower(split_part(embedding_model, '/', -1)), '[^a-z0-9]+', '_', 'g'), '_') AS suffix FROM chunk_vectors WHERE embedding_model IS NOT NULL")
def l27(t: Tables) -> DataFrame:
    return t.chunk_vectors.where("embedding_model IS NOT NULL").select("embedding_model", T.model_suffix("embedding_model").alias("suffix")).distinct()


@query("n10_synthetic_vectors", "SELECT doc_id, round(sin((doc_id + 1) * 1 * 0.017e0) * 0.5e0 + 0.5e0, 6) AS first, round(sin((doc_id + 1) * 8 * 0.017e0) * 0.5e0 + 0.5e0, 6) AS last FROM documents")
def n10(t: Tables) -> DataFrame:
    v = V.synthetic(F.col("doc_id"), 8)
    return t.documents.select("doc_id", v[0].alias("first"), v[7].alias("last"))


@query("k2_keyword_query", r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(query, '\p{C}', ' ', 'g'), '[^\p{L}\p{N}_\s''\-]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM surreal_golden_queries WHERE query IS NOT NULL")
def k2(t: Tables) -> DataFrame:
    return t.surreal_golden_queries.where("query IS NOT NULL").select("id", T.keyword_query("query").alias("text"))


@query("c14_html_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL""")
def c14(t: Tables) -> DataFrame:
    page = F.concat(F.lit("<html><style>p{}</style><p>"), F.regexp_replace("text", "&", "&amp;"), F.lit("</p></html>"))
    return t.documents.where("text IS NOT NULL").select("doc_id", T.html_text(page).alias("text"))
