"""Queries of chunking and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking, extraction
from skein.plans.registry import Tables, query
from skein.plans.scalars import STOP

_BODY = r"""CASE WHEN starts_with(text, '---') AND contains(substr(text, 4), '---') THEN regexp_replace(substr(text, 4 + instr(substr(text, 4), '---') + 2), '^\n+', '') ELSE text END"""
_SECTIONS = rf"""
lines AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS i FROM (SELECT doc_id, {_BODY} AS body FROM documents WHERE text IS NOT NULL)),
marked AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+.+$') AS heads FROM lines),
numbered AS (SELECT *, CAST(sum(CASE WHEN heads AND i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS section_index FROM marked),
sections AS (SELECT doc_id, section_index, max(CASE WHEN heads THEN length(regexp_extract(line, '^(#{{1,6}})\s', 1)) ELSE 0 END) AS level, max(CASE WHEN heads THEN trim(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1)) END) AS heading,
  regexp_replace(string_agg(CASE WHEN NOT heads THEN line END, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body FROM numbered GROUP BY doc_id, section_index)"""


def _documents(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("document_ref"), chunking.body_text(F.col("text")).alias("body"))


@query("c2_sections", f"WITH {_SECTIONS} SELECT CAST(doc_id AS VARCHAR) AS document_ref, section_index, level, heading, md5(coalesce(body, '')) AS body FROM sections WHERE level > 0 OR coalesce(body, '') <> ''")
def c2(t: Tables) -> DataFrame:
    return chunking.sections(_documents(t)).withColumn("body", F.md5("body"))


@query("c3_hierarchy", f"""
WITH {_SECTIONS},
kept AS (SELECT *, {', '.join(f"max(CASE WHEN level = {k} THEN section_index END) OVER w AS a{k}, max(CASE WHEN level < {k} AND level > 0 THEN section_index END) OVER w AS c{k}" for k in range(1, 7))} FROM sections WHERE level > 0 OR coalesce(body, '') <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY section_index))
SELECT CAST(k.doc_id AS VARCHAR) AS document_ref, k.section_index, concat_ws(' > ', {', '.join(f"(CASE WHEN k.level >= {j} AND k.a{j} IS NOT NULL AND coalesce(k.c{j}, -1) <= k.a{j} THEN nullif(h{j}.heading, '') END)" for j in range(1, 7))}) AS path
FROM kept k {' '.join(f"LEFT JOIN sections h{j} ON h{j}.doc_id = k.doc_id AND h{j}.section_index = k.a{j}" for j in range(1, 7))}""")
def c3(t: Tables) -> DataFrame:
    return chunking.hierarchy(chunking.sections(_documents(t))).select("document_ref", "section_index", F.array_join("heading_hierarchy", " > ").alias("path"))


@query("c4_chunked")
def c4(t: Tables) -> DataFrame:
    return chunking.chunked(t.documents.select(F.col("doc_id").cast("string").alias("document_ref"), "kind", "text"))


@query("c5_speaker_turns", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n(\[\d{2}:\d{2}:\d{2}\]\s*\*\*)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents WHERE kind = 'meeting_transcript' AND text IS NOT NULL)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS at, unnest(l) AS turn FROM s""")
def c5(t: Tables) -> DataFrame:
    return t.documents.where("kind = 'meeting_transcript'").select("doc_id", F.posexplode(chunking.speaker_turns(F.col("text"))).alias("at", "turn"))


@query("c6_paragraphs", r"""
WITH p AS (SELECT doc_id, CASE WHEN len(string_split(text, chr(10) || chr(10))) > 3 THEN list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') WHEN trim(text) <> '' THEN [text] ELSE [] END AS l FROM documents WHERE kind = 'voicenote' AND text IS NOT NULL)
SELECT doc_id, len(l) AS parts, md5(array_to_string(l, '|')) AS text FROM p""")
def c6(t: Tables) -> DataFrame:
    return t.documents.where("kind = 'voicenote' AND text IS NOT NULL").select("doc_id", chunking.paragraphs(F.col("text")).alias("l")).select("doc_id", F.size("l").cast("long").alias("parts"), F.md5(F.array_join("l", "|")).alias("text"))


@query("c9_chunk_ids", "SELECT DISTINCT chunk_id, chunk_index, sha256(concat_ws(':', sha256(concat_ws(chr(10), kind, text)), CAST(chunk_index AS VARCHAR), chunk_strategy)) AS made FROM chunks WHERE chunk_index IS NOT NULL")
def c9(t: Tables) -> DataFrame:
    return t.chunks.where("chunk_index IS NOT NULL").select("chunk_id", "chunk_index", T.chunk_id("kind", "text", "chunk_index", "chunk_strategy").alias("made")).distinct()


@query("c10_message_chunks", """
SELECT DISTINCT dialog_id, message_id, epoch_us(received_at) AS received, concat_ws(chr(10), 'Dialog: ' || dialog_name, 'Sender: ' || sender, 'Sent: ' || strftime(sent_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'), 'Topic: ' || CAST(topic_id AS VARCHAR), 'Reply to: ' || CAST(reply_to_msg_id AS VARCHAR)) || chr(10) || chr(10) || coalesce(text, '') AS text
FROM telegram_messages WHERE message_id IS NOT NULL""")
def c10(t: Tables) -> DataFrame:
    m = t.telegram_messages.where("message_id IS NOT NULL")
    return m.select("dialog_id", "message_id", F.unix_micros("received_at").alias("received"), chunking.message_chunk_text(*[F.col(c) for c in ("dialog_name", "sender", "sent_at", "topic_id", "reply_to_msg_id", "text")]).alias("text")).distinct()


@query("c11_segments")
def c11(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(chunking.segments("text", F.lit(320))).alias("at", "segment"))


@query("c12_index_rows", """
WITH d AS (SELECT ref, max(title) AS dt FROM documents GROUP BY ref)
SELECT DISTINCT chunk_id, c.ref, coalesce(nullif(heading_hierarchy[-1], ''), dt, '') AS index_title FROM chunks c LEFT JOIN d ON c.ref = d.ref""")
def c12(t: Tables) -> DataFrame:
    return chunking.index_rows(t.chunks, t.documents).select("chunk_id", "ref", "index_title").distinct()


@query("c13_meta_text", "SELECT doc_id, CASE WHEN namespace = 'filesystem' THEN trim(concat_ws(' ', title, source)) ELSE concat_ws(' ', namespace, title, media_type, collection_ref) END AS meta FROM documents WHERE source IS NOT NULL")
def c13(t: Tables) -> DataFrame:
    d = t.documents.where("source IS NOT NULL")
    return d.select("doc_id", chunking.meta_text(F.col("title"), F.array("source"), F.col("namespace"), F.col("media_type"), F.col("collection_ref")).alias("meta"))


@query("d1_wikilinks", r"SELECT DISTINCT chunk_id AS source_id, trim(target) AS target_id FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) AS target FROM chunks) WHERE trim(target) <> ''")
def d1(t: Tables) -> DataFrame:
    return extraction.wikilinks(t.chunks).select("source_id", "target_id")


_TAGGED = "(SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'of #' || lower(kind) || chr(10) || '#' || namespace || ' here' || chr(10) || '# not #one' AS text FROM documents WHERE kind IS NOT NULL AND namespace IS NOT NULL)"


@query("d2_inline_tags", rf"""
WITH l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line FROM {_TAGGED})
SELECT DISTINCT chunk_id AS source_id, unnest(regexp_extract_all(line, '(?:^|\s)#([A-Za-z_][A-Za-z0-9_/-]*)', 1)) AS target_id FROM l WHERE NOT regexp_matches(line, '^#{{1,6}}\s')""")
def d2(t: Tables) -> DataFrame:
    """No text here has tags: kinds and namespaces are written as such."""
    text = F.concat(F.lit("of #"), F.lower("kind"), F.lit("\n#"), "namespace", F.lit(" here\n# not #one"))
    return extraction.inline_tags(t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), text.alias("text")).where("text IS NOT NULL")).select("source_id", "target_id")


@query("d3_markdown_links", r"""
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'see [' || title || '](' || document_ref || '#top) and [x](y.txt)' AS text FROM documents),
l AS (SELECT chunk_id, unnest(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+\.md(?:#[^)]*)?)\)', 1)) AS link_text, unnest(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+\.md(?:#[^)]*)?)\)', 2)) AS target FROM c)
SELECT DISTINCT chunk_id AS source_id, regexp_replace(target, '#.*$', '') AS target_id, link_text FROM l""")
def d3(t: Tables) -> DataFrame:
    """No text here links to files: titles are linked to the paths of their documents."""
    text = F.concat(F.lit("see ["), "title", F.lit("]("), "document_ref", F.lit("#top) and [x](y.txt)"))
    return extraction.markdown_links(t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), text.alias("text"))).select("source_id", "target_id", "link_text")


@query("d4_parents", """
WITH p AS (SELECT document_ref, heading_hierarchy, arg_max(chunk_id, struct_pack(i := chunk_index, c := chunk_id)) AS parent FROM chunks WHERE len(heading_hierarchy) > 0 AND chunk_index IS NOT NULL AND document_ref IS NOT NULL GROUP BY 1, 2)
SELECT DISTINCT parent AS source_id, chunk_id AS target_id FROM chunks c JOIN p ON c.document_ref = p.document_ref AND c.heading_hierarchy[1:len(c.heading_hierarchy) - 1] = p.heading_hierarchy WHERE len(c.heading_hierarchy) > 1 AND c.chunk_index IS NOT NULL AND parent <> chunk_id""")
def d4(t: Tables) -> DataFrame:
    return extraction.parents(t.chunks.where("chunk_index IS NOT NULL")).select("source_id", "target_id")


@query("d6_acronyms", f"""
WITH a AS (SELECT chunk_id, unnest(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][A-Z0-9]{{1,9}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS name FROM chunks)
SELECT name, count(*) AS occurrences, len(list_distinct(list(chunk_id))) AS chunks FROM a WHERE NOT (lower(name) IN ({STOP}) OR regexp_matches(lower(name), '^[0-9a-f]{{3,8}}$')) GROUP BY name HAVING count(*) >= 2""")
def d6(t: Tables) -> DataFrame:
    return extraction.acronyms(t.chunks).select("name", "occurrences", F.size("chunk_ids").cast("long").alias("chunks"))


@query("d7_heading_terms", f"""
WITH w AS (SELECT chunk_id, regexp_replace(unnest(string_split_regex(h, '\\s+')), '[^A-Za-z]', '', 'g') AS name FROM (SELECT chunk_id, unnest(heading_hierarchy) AS h FROM chunks)),
d AS (SELECT name, count(DISTINCT chunk_id) AS df FROM w WHERE regexp_matches(name, '^[A-Z]') AND length(name) > 3 AND NOT (lower(name) IN ({STOP}) OR regexp_matches(lower(name), '^[0-9a-f]{{3,8}}$')) GROUP BY name)
SELECT name, df FROM d WHERE df >= 2 AND df <= (SELECT floor(count(*) * 0.6) FROM chunks)""")
def d7(t: Tables) -> DataFrame:
    return extraction.heading_terms(t.chunks)


@query("d8_tfidf_terms", f"""
WITH w AS (SELECT chunk_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])([a-z][a-z0-9_]{{2,}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM w WHERE NOT (term IN ({STOP}) OR regexp_matches(term, '^[0-9a-f]{{3,8}}$')) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= (SELECT floor(count(*) * 0.6) FROM chunks)),
s AS (SELECT chunk_id, term, tf, df, round(tf * ln((SELECT count(*) FROM chunks)::DOUBLE / df), 6) AS score FROM tf JOIN df USING (term))
SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 8""")
def d8(t: Tables) -> DataFrame:
    return extraction.tfidf_terms(t.chunks)


@query("d9_widest_entities", f"""
WITH e AS (SELECT name, count(DISTINCT chunk_id) AS n FROM (SELECT chunk_id, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1))) AS name FROM chunks) WHERE name <> '' GROUP BY name)
SELECT name, n FROM e ORDER BY n DESC, name LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS INTEGER)) FROM e)""")
def d9(t: Tables) -> DataFrame:
    e = extraction.wikilinks(t.chunks).groupBy(F.col("target_id").alias("name")).agg(F.array_sort(F.collect_set("source_id")).alias("chunk_ids"))
    return extraction.widest(e).select("name", F.size("chunk_ids").cast("long").alias("n"))


@query("d11_co_occurrences", """
WITH f AS (SELECT DISTINCT chunk_id, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1))) AS name FROM chunks)
SELECT a.name AS source_id, b.name AS target_id, CAST(count(*) AS DOUBLE) AS weight FROM f a JOIN f b ON a.chunk_id = b.chunk_id AND a.name < b.name WHERE a.name <> '' GROUP BY 1, 2""")
def d11(t: Tables) -> DataFrame:
    found = extraction.wikilinks(t.chunks).select(F.col("source_id").alias("chunk_id"), F.col("target_id").alias("name"))
    return extraction.co_occurrences(found).select("source_id", "target_id", "weight")


@query("d13_predicted_names")
def d13(t: Tables) -> DataFrame:
    return extraction.predicted(t.chunks, extraction.capitalised_names)


@query("d14_merged_entities", """
WITH n AS (SELECT DISTINCT chunk_id, coalesce(title, '') AS name FROM chunks WHERE title IS NOT NULL)
SELECT arg_min(name, struct_pack(c := chunk_id, n := name)) AS name, count(DISTINCT chunk_id) AS chunks FROM n GROUP BY lower(name)""")
def d14(t: Tables) -> DataFrame:
    found = t.chunks.where("title IS NOT NULL").select("chunk_id", F.col("title").alias("name"), F.lit("TITLE").alias("type"))
    return extraction.merged_entities(found).select("name", F.size("chunk_ids").cast("long").alias("chunks"))


@query("d16_acronym_definitions")
def d16(t: Tables) -> DataFrame:
    return extraction.acronym_dictionary(t.chunks)


@query("d18_frontmatter_relations", r"""
WITH f AS (SELECT document_ref, kind, regexp_extract(text, '^---\n(?:.|\n)*?\ntags: \[([^\]\n]*)\]', 1) AS tags FROM documents WHERE text IS NOT NULL AND document_ref IS NOT NULL),
x AS (SELECT document_ref, trim(unnest(string_split(tags, ','))) AS t FROM f WHERE tags <> '')
SELECT DISTINCT document_ref AS source_id, CASE WHEN regexp_matches(t, '^[^:]+:.+$') THEN trim(regexp_extract(t, '^[^:]+:(.+)$', 1)) ELSE t END AS target_id, 'HAS_TAG' AS rel_type FROM x WHERE t <> ''""")
def d18(t: Tables) -> DataFrame:
    d = t.documents.where("text IS NOT NULL AND document_ref IS NOT NULL").select("document_ref", "kind", F.regexp_extract("text", r"^---\n(?s:.*?)\ntags: \[([^\]\n]*)\]", 1).alias("tags"))
    return extraction.frontmatter_relations(d.select("document_ref", "kind", F.split("tags", ",").alias("tags"), F.array().cast("array<string>").alias("participants"))).select("source_id", "target_id", "rel_type")
