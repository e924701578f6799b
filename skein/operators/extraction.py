"""Entities and relations from chunks: structure, key terms, names, acronyms, frontmatter. Chunks: chunk_id, text, heading_hierarchy.

Relations have source_id, target_id, rel_type, weight; entities have name, type, source, chunk_ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from skein.functions import text as T

#: How links, tags and acronyms are written, and the words that join an acronym to its expansion.
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
TAG = r"(?:^|\s)#([A-Za-z_][A-Za-z0-9_/-]*)"
MD_LINK = r"\[([^\]]+)\]\(([^)]+\.md(?:#[^)]*)?)\)"
ACRONYM = r"(?<![\p{L}\p{N}_])([A-Z][A-Z0-9]{1,9})(?![\p{L}\p{N}_])"
EXPLAINING = ("stands for", "is short for", "means")
NAMING = ("or", "abbreviated as")


def _relation(rows: DataFrame, source: str, target: Column, kind: str) -> DataFrame:
    return rows.select(F.col(source).alias("source_id"), target.alias("target_id"), F.lit(kind).alias("rel_type"), F.lit(1.0).alias("weight"))


def wikilinks(chunks: DataFrame) -> DataFrame:
    found = chunks.select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))).alias("x"))
    return _relation(found, "chunk_id", F.trim("x"), "LINKS_TO").where("target_id <> ''").distinct()


def inline_tags(chunks: DataFrame) -> DataFrame:
    """#tags at a line begin or after white space, outside heading lines."""
    lines = chunks.select("chunk_id", F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike(r"^#{1,6}\s"))
    found = lines.select("chunk_id", F.explode(F.regexp_extract_all("line", F.lit(TAG), F.lit(1))).alias("x"))
    return _relation(found, "chunk_id", F.col("x"), "HAS_TAG").distinct()


def markdown_links(chunks: DataFrame) -> DataFrame:
    """Links to .md files without their anchors; link_text is a property."""
    names, targets = (F.regexp_extract_all("text", F.lit(MD_LINK), F.lit(g)) for g in (1, 2))
    found = chunks.select("chunk_id", F.explode(F.arrays_zip(names.alias("name"), targets.alias("target"))).alias("x"))
    return found.select(F.col("chunk_id").alias("source_id"), F.regexp_replace("x.target", "#.*$", "").alias("target_id"), F.lit("LINKS_TO").alias("rel_type"), F.lit(1.0).alias("weight"), F.col("x.name").alias("link_text")).distinct()


def parents(chunks: DataFrame, scope: str = "document_ref", order: str = "chunk_index") -> DataFrame:
    """PARENT_OF from the last chunk with the heading path above to every chunk under it, inside the scope."""
    paths = chunks.where(F.size("heading_hierarchy") > 0)
    last = paths.groupBy(scope, "heading_hierarchy").agg(F.max_by("chunk_id", F.struct(order, "chunk_id")).alias("parent"))
    above = paths.where(F.size("heading_hierarchy") > 1).select(scope, "chunk_id", F.slice("heading_hierarchy", 1, F.size("heading_hierarchy") - 1).alias("heading_hierarchy"))
    found = above.join(last, [scope, "heading_hierarchy"]).where("parent <> chunk_id")
    return _relation(found.withColumnRenamed("parent", "source"), "source", F.col("chunk_id"), "PARENT_OF").distinct()


def structural(chunks: DataFrame) -> DataFrame:
    links = markdown_links(chunks)
    none = F.lit(None).cast("string").alias("link_text")
    parts = [wikilinks(chunks), inline_tags(chunks), parents(chunks)]
    out = links
    for p in parts:
        out = out.unionByName(p.select("*", none))
    return out


def acronyms(chunks: DataFrame, least: int = 2) -> DataFrame:
    """Acronyms with at least `least` occurrences (not chunks): name, occurrences, chunk_ids."""
    found = chunks.select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(ACRONYM), F.lit(1))).alias("name")).where(~T.is_noise(F.col("name")))
    return found.groupBy("name").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids")).where(F.col("occurrences") >= least)


def heading_terms(chunks: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """Capitalised heading words of over three letters in at least `least` and at most `share` of all chunks: name, df."""
    heads = chunks.select("chunk_id", F.explode("heading_hierarchy").alias("h"))
    words = heads.select("chunk_id", F.explode(F.split("h", r"\s+")).alias("w")).select("chunk_id", F.regexp_replace("w", "[^A-Za-z]", "").alias("name"))
    words = words.where(F.col("name").rlike("^[A-Z]") & (F.length("name") > 3) & ~T.is_noise(F.col("name")))
    total = chunks.agg(F.floor(F.count("*") * share).alias("most"))
    df = words.groupBy("name").agg(F.count_distinct("chunk_id").alias("df"))
    return df.crossJoin(F.broadcast(total)).where((F.col("df") >= least) & (F.col("df") <= F.col("most"))).drop("most")  # one row


def tfidf_terms(chunks: DataFrame, top: int = 8, least: int = 2, share: float = 0.6) -> DataFrame:
    """The `top` terms of each chunk by tf * ln(N / df): chunk_id, term, tf, df, score, rank; ties by term."""
    terms = chunks.select("chunk_id", F.explode(T.term_tokens("text")).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    total = F.broadcast(chunks.agg(F.count("*").alias("n")))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(total).where((F.col("df") >= least) & (F.col("df") <= F.floor(F.col("n") * share)))
    scored = terms.join(df, "term").withColumn("score", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6))
    order = Window.partitionBy("chunk_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("n")


def widest(entities: DataFrame, share: float = 0.10) -> DataFrame:
    """The share of entities (one at least) that cover most chunks: name, chunk_ids; ties by name.

    The numbers of entities by coverage, a row a coverage, tell where the cut lies; only the names at the cut are put in order.
    """
    sized = entities.withColumn("_n", F.size("chunk_ids"))
    steps = sized.groupBy("_n").count().orderBy(F.desc("_n")).collect()
    left = max(1, int(sum(r["count"] for r in steps) * share))
    at = None
    for r in steps:
        at = r["_n"]
        if r["count"] >= left:
            break
        left -= r["count"]
    if at is None:
        return entities
    cut = sized.where(F.col("_n") == at).orderBy("name").limit(left)
    return sized.where(F.col("_n") > at).unionByName(cut).drop("_n")


def mentions(entities: DataFrame) -> DataFrame:
    return entities.select(F.explode("chunk_ids").alias("source_id"), F.col("name").alias("target_id"), F.lit("MENTIONS").alias("rel_type"), F.lit(1.0).alias("weight"))


def co_occurrences(found: DataFrame) -> DataFrame:
    """CO_OCCURS of different names (chunk_id, name) that share a chunk, with the number of chunks; a chunk has a bounded number of names."""
    left = found.select("chunk_id", F.col("name").alias("a")).distinct()
    right = found.select("chunk_id", F.col("name").alias("b")).distinct()
    pairs = left.join(right, "chunk_id").where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("CO_OCCURS").alias("rel_type"), "weight")


def key_terms(chunks: DataFrame, share: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of acronyms, heading terms and the telling terms of each chunk; of the entities the share that covers most chunks.

    Names that differ in case only are one. Relations: MENTIONS from the chunks, CO_OCCURS between names that share one.
    """
    short = acronyms(chunks).select(F.explode("chunk_ids").alias("chunk_id"), "name", F.lit("acronym").alias("type"))
    words = chunks.select("chunk_id", F.explode("heading_hierarchy").alias("h")).select("chunk_id", F.explode(F.split("h", r"\s+")).alias("w"))
    heads = words.select("chunk_id", F.regexp_replace("w", "[^A-Za-z]", "").alias("name")).join(heading_terms(chunks).select("name"), "name", "left_semi").select("chunk_id", "name", F.lit("heading").alias("type"))
    telling = tfidf_terms(chunks).select("chunk_id", F.col("term").alias("name"), F.lit("term").alias("type"))
    found = short.unionByName(heads).unionByName(telling)
    named = found.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("type", "name")).alias("x"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    entities = widest(named.select("x.name", "x.type", "chunk_ids"), share)
    held = entities.select(F.explode("chunk_ids").alias("chunk_id"), "name")
    return entities, mentions(entities).unionByName(co_occurrences(held))


def extracted(chunks: DataFrame, predict: Callable[[list[str]], list[list[tuple[str, str]]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of structure, key terms and, with a predictor, names; an entity that several find is one, with all its chunks."""
    entities, relations = key_terms(chunks)
    if predict is not None:
        names = merged_entities(predicted(chunks, predict))
        entities = entities.unionByName(names)
        relations = relations.unionByName(mentions(names))
    together = entities.groupBy("name").agg(F.min("type").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"))
    return together, structural(chunks).drop("link_text").unionByName(relations).distinct()


def predicted(chunks: DataFrame, predict: Callable[[list[str]], list[list[tuple[str, str]]]]) -> DataFrame:
    """Names a model finds, per chunk: chunk_id, name, type, n. predict maps texts to (name, type) lists and runs on Arrow batches."""
    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            rows = [(c, n, t) for c, spans in zip(frame["chunk_id"], predict(frame["text"].fillna("").tolist()), strict=True) for n, t in spans]
            yield pd.DataFrame(rows, columns=["chunk_id", "name", "type"])

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, name string, type string").groupBy("chunk_id", "name", "type").agg(F.count("*").alias("n"))


def capitalised_names(texts: list[str]) -> list[list[tuple[str, str]]]:
    """The built-in predictor: runs of capitalised words that do not begin a sentence."""
    import re

    pattern = re.compile(r"(?<=[a-zа-я,;] )([A-ZА-ЯЁ][\w-]+(?: [A-ZА-ЯЁ][\w-]+)*)")
    return [[(m, "NAME") for m in pattern.findall(t)] for t in texts]


def merged_entities(found: DataFrame) -> DataFrame:
    """Names that differ in case only are one: the casing of the first chunk, all chunks."""
    rows = found.groupBy(F.lower("name").alias("key"), F.lower("type").alias("kind"))
    return rows.agg(F.min_by("name", F.struct("chunk_id", "name")).alias("name"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids")).select("name", F.col("kind").alias("type"), "chunk_ids")


_CAPITALS = re.compile(r"(?<!\w)[A-Z]{2,}(?!\w)")
_WORDS_BEFORE = re.compile(r"(?:[A-Za-z&][A-Za-z&-]*\s+)+\Z")
_WORDS_AFTER = re.compile(r"\s*((?:[A-Za-z&][A-Za-z&-]*\s*)+)")
_EXPLAINED = re.compile(rf"\s+(?:{'|'.join(EXPLAINING)})\s")
_NAMED = re.compile(rf",\s+(?:{'|'.join(NAMING)})\s+\Z")


def _spelled(acronym: str, words: list[str]) -> bool:
    """Whether several words, the first with a capital, have the letters of the acronym among their initials, in order."""
    initials = iter(w[0].upper() for w in words if w[0].isalpha())
    return len(words) > 1 and words[0][0].isupper() and all(c in initials for c in acronym)


def _defined(text: str) -> set[tuple[str, str]]:
    """Acronyms of a text with the words beside them: in or before brackets, after or before a joining phrase, in the next cell of a table row. Of words without an end of their own the fewest that spell the acronym."""
    out = set()
    for m in _CAPITALS.finditer(text):
        acronym, reach = m.group(), 12 * (len(m.group()) + 2) * 2
        before, after = text[max(0, m.start() - reach) : m.start()], text[m.end() : m.end() + reach]
        runs: list[list[str]] = []
        bracket, named = before.endswith("(") and after.startswith(")"), _NAMED.search(before)
        if bracket or named:
            words = _WORDS_BEFORE.search((before[:-1] if bracket else before[: named.start()]) + " ")
            held = words.group().split() if words else []
            runs += [held[i:] for i in range(len(held) - 1, -1, -1)]
        if (inside := re.match(r"\s*\(([^()\n]*)\)", after)) and re.fullmatch(r"[A-Za-z&\s-]+", inside.group(1)):
            runs.append(inside.group(1).split())
        if explained := _EXPLAINED.match(after):
            words = _WORDS_AFTER.match(after, explained.end() - 1)
            held = words.group(1).split() if words else []
            runs += [held[:i] for i in range(2, len(held) + 1)]
        if re.search(r"\|[\s*]*\Z", before) and (cell := re.match(r"[\s*]*\|\s*([A-Za-z\s]+?)\s*\|", after)):
            runs.append(cell.group(1).split())
        found = next((words for words in runs if _spelled(acronym, words)), None)
        if found:
            out.add((acronym, " ".join(found)))
    return out


@F.pandas_udf(S.ArrayType(S.StructType([S.StructField("acronym", S.StringType()), S.StructField("expansion", S.StringType())])))
def definitions(texts: pd.Series) -> pd.Series:
    """Acronyms of each text with expansions whose initials have the acronym in order, sorted."""
    return texts.map(lambda t: [{"acronym": a, "expansion": e} for a, e in sorted(_defined(t or ""))])


def acronym_dictionary(chunks: DataFrame) -> DataFrame:
    """acronym, expansions (sorted) over all chunks."""
    rows = chunks.select(F.explode(definitions("text")).alias("d")).select("d.acronym", "d.expansion")
    return rows.groupBy("acronym").agg(F.array_sort(F.collect_set("expansion")).alias("expansions"))


def frontmatter_relations(documents: DataFrame) -> DataFrame:
    """Relations of documents (document_ref, kind, tags array, participants array): HAS_TAG to a tag or, for type:name, to an entity; HAS_PARTICIPANT of meetings."""
    tags = documents.select("document_ref", F.explode("tags").alias("t")).select("document_ref", F.trim("t").alias("t")).where("t <> ''")
    typed = F.col("t").rlike("^[^:]+:.+$")
    tag_rows = tags.select(F.col("document_ref").alias("source_id"), F.when(typed, F.trim(F.regexp_extract("t", "^[^:]+:(.+)$", 1))).otherwise(F.col("t")).alias("target_id"),
                           F.lit("HAS_TAG").alias("rel_type"), F.when(typed, "entities").otherwise("tags").alias("target_table"), F.when(typed, F.regexp_extract("t", "^([^:]+):", 1)).alias("entity_type"))
    people = documents.where("kind = 'meeting_transcript'").select("document_ref", F.explode("participants").alias("p"))
    rows = people.select(F.col("document_ref").alias("source_id"), F.trim("p").alias("target_id"), F.lit("HAS_PARTICIPANT").alias("rel_type"), F.lit("entities").alias("target_table"), F.lit("PERSON").alias("entity_type")).where("target_id <> ''")
    return tag_rows.unionByName(rows).distinct()


def cached_split(chunks: DataFrame, cache: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their payload, misses) by the hash of text and model signature."""
    keyed = chunks.withColumn("cache_key", F.sha2(F.concat_ws(":", F.sha2("text", 256), F.lit(signature)), 256))
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")
