"""The graph as two tables, nodes (table, id) and relations (source_table, source_id, target_table, target_id, rel_type, weight), and retrieval in it."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import runtime
from skein.functions import text as T


def relation_id(relations: DataFrame) -> DataFrame:
    return relations.withColumn("relation_id", T.composite("source_id", "target_id", "rel_type"))


def with_endpoints(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes and those that relations imply: unknown sources are sections, unknown targets tags (of HAS_TAG) or entities."""
    ends = relations.select(F.lit("sections").alias("table"), F.col("source_id").alias("id")).unionByName(
        relations.select(F.when(F.col("rel_type") == "HAS_TAG", "tags").otherwise("entities").alias("table"), F.col("target_id").alias("id")))
    unknown = ends.join(nodes.select("id").distinct(), "id", "left_anti").distinct()
    return nodes.select("table", "id").unionByName(unknown.select("table", "id"))


def isolated(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes without any relation."""
    ends = relations.select(F.col("source_id").alias("id")).unionByName(relations.select(F.col("target_id").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def without(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations of which neither end is among the ids."""
    return relations.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_anti")


def finite(relations: DataFrame) -> DataFrame:
    return relations.where("weight IS NOT NULL AND NOT isnan(weight) AND abs(weight) < double('inf')")


def catalogue(entities: DataFrame, most: int | None = None) -> DataFrame:
    """key (lower-case name) and name: of names that differ in case the last in order; if given, of the first `most` names only."""
    names = entities.select("name").distinct()
    return (names if most is None else names.orderBy("name").limit(most)).groupBy(F.lower("name").alias("key")).agg(F.max("name").alias("name"))


def phrases(queries: DataFrame, longest: int = 4) -> DataFrame:
    """query_id, at, n, phrase: all runs of up to `longest` words."""
    rows = queries.select("query_id", T.words("text").alias("w"))
    rows = rows.select("query_id", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.size("w") >= F.col("n"))
    rows = rows.select("query_id", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    return rows.select("query_id", "at", "n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase"))


def matched_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, name: catalogue names in a query, longest first, from the left, without overlap."""
    hits = phrases(queries).join(names, F.col("phrase") == F.col("key")).select("query_id", "at", "n", "name")

    def greedy(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for row in frame.sort_values(["n", "at"], ascending=[False, True]).itertuples():
            span = set(range(row.at, row.at + row.n))
            if not span & used:
                used |= span
                out.append((key[0], row.name))
        return pd.DataFrame(out, columns=["query_id", "name"]).drop_duplicates()

    return hits.groupBy("query_id").applyInPandas(greedy, "query_id string, name string")  # as many rows as a query has phrases


def direct(matches: DataFrame, relations: DataFrame, active: DataFrame, k: int, strategy_chunks: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: sums of weights of MENTIONS and HAS_TAG relations to the matched names, by the largest; chunks in `active` only.

    The semi-join stands before the limit, so that a limit is filled with what may be shown.
    """
    edges = finite(relations).where("source_table = 'sections' AND rel_type IN ('MENTIONS', 'HAS_TAG')")
    edges = edges.join(active.select(F.col("chunk_id").alias("source_id")).distinct(), "source_id", "left_semi")
    summed = matches.join(edges, matches["name"] == edges["target_id"]).groupBy("query_id", F.col("source_id").alias("chunk_id")).agg(F.sum("weight").alias("total"))
    top = F.max("total").over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return summed.withColumn("score", F.when(top > 0, F.col("total") / top).otherwise(0.0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def counted(matches: DataFrame, relations: DataFrame, k: int) -> DataFrame:
    """The same by the number of matched names."""
    n = matches.join(relations, matches["name"] == relations["target_id"]).groupBy("query_id", F.col("source_id").alias("chunk_id")).agg(F.count_distinct("name").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return n.withColumn("score", F.col("n") / F.max("n").over(Window.partitionBy("query_id"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def enriched(seeds: DataFrame, relations: DataFrame, active: DataFrame, k: int, most_seeds: int | None = None, decay: float = 1.0, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: sections two relations away from the first seeds (query_id, chunk_id, rank), by the sum of weights; seeds are left out.

    most_seeds: only the first so many seeds of a query, if given. digits: those of scores, before they are ranked, if given.
    Queries whose seeds have the same targets, each as often, have the same scores, and so have sections with the same targets and weights. So different lists of targets of queries meet
    different lists of sections, not queries sections. Of sections with the same list only the first k and as many as there are seeds to leave out can be among the k best.
    """
    if digits is None:  # the engine's plan goes on from here, where stored tables in between break its union
        first = seeds if most_seeds is None else seeds.where(F.col("rank") <= most_seeds)
        first = first.select("query_id", F.col("chunk_id").alias("seed")).distinct()
        edges = finite(relations).select("source_id", "target_id", "weight")
        mine = first.join(edges, F.col("seed") == F.col("source_id")).select("query_id", "seed", F.col("target_id").alias("via"))
        far = mine.join(edges, F.col("via") == F.col("target_id")).where("source_id <> seed")
        total = far.groupBy("query_id", F.col("source_id").alias("chunk_id")).agg((F.sum("weight") * decay).alias("score"))
        total = total.join(first.withColumnRenamed("seed", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(active.select("chunk_id").distinct(), "chunk_id", "left_semi")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
    first = seeds if most_seeds is None else seeds.where(F.col("rank") <= most_seeds)
    first = runtime.materialize(first.select("query_id", F.col("chunk_id").alias("seed")).distinct(), "seeds")
    spare = k + ((first.groupBy("query_id").count().agg(F.max("count")).head()[0] or 0) if most_seeds is None else most_seeds)
    edges = finite(relations).select("source_id", "target_id", "weight")

    def numbered(lists: DataFrame, name: str) -> DataFrame:
        return runtime.materialize(lists.select("links").distinct().withColumn(name, F.monotonically_increasing_id()), name)

    mine = first.join(edges, F.col("seed") == F.col("source_id")).groupBy("query_id", "target_id").agg(F.count("*").alias("n"))
    asked = runtime.materialize(mine.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "n"))).alias("links")), "asked")
    shown = edges.join(active.select(F.col("chunk_id").alias("source_id")).distinct(), "source_id", "left_semi").groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))
    shown = shown.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "weight"))).alias("links"))
    shown = runtime.materialize(shown.withColumn("n", F.row_number().over(Window.partitionBy("links").orderBy("source_id"))).where(F.col("n") <= spare), "shown")
    asking, showing = numbered(asked, "asking"), numbered(shown.where("n = 1"), "showing")
    heads = shown.where("n = 1").join(showing, "links").select("showing", F.col("source_id").alias("head"), F.explode("links").alias("x")).select("showing", "head", "x.*")
    pairs = asking.select("asking", F.explode("links").alias("x")).select("asking", "x.*").join(heads, "target_id").groupBy("asking", "showing", "head").agg((F.sum(F.col("n") * F.col("weight")) * decay).alias("score"))
    pairs = pairs if digits is None else pairs.withColumn("score", F.round("score", digits))

    def best(rows: DataFrame, most: int, by: str, tie: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))).where(F.col("rank") <= most)

    lists = best(pairs, spare, "asking", "head").select("asking", "showing", "score")
    near = best(lists.join(shown.join(showing, "links").select("showing", F.col("source_id").alias("chunk_id")), "showing"), spare, "asking", "chunk_id").select("asking", "chunk_id", "score")
    near = asked.join(asking, "links").select("query_id", "asking").join(near, "asking").select("query_id", "chunk_id", "score")
    return best(near.join(first.withColumnRenamed("seed", "chunk_id"), ["query_id", "chunk_id"], "left_anti"), k, "query_id", "chunk_id").select("query_id", "chunk_id", "score", "rank")


def related(relations: DataFrame, salts: int = 8) -> DataFrame:
    """section, other, weight: sections that share a target, with the sum of the other's weights.

    Only two sections with several targets each can meet more than once, so that other pairs are not shuffled for the sum. The sections of a
    frequent target are spread over `salts` tasks.
    """
    edges = relations.groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))
    edges = edges.withColumn("several", F.count("*").over(Window.partitionBy("source_id")) > 1)
    left = edges.select(F.col("source_id").alias("section"), "target_id", F.col("several").alias("mine"), F.pmod(F.hash("source_id"), F.lit(salts)).alias("salt"))
    right = edges.select(F.col("source_id").alias("other"), "target_id", "weight", F.col("several").alias("its"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spread = left.repartition(4 * runtime.partitions(relations.sparkSession), "target_id", "salt")
    pairs = spread.join(right.hint("shuffle_hash"), ["target_id", "salt"]).where("section <> other")
    once = pairs.where("NOT (mine AND its)").select("section", "other", "weight")
    return once.unionByName(pairs.where("mine AND its").groupBy("section", "other").agg(F.sum("weight").alias("weight")))


def export(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes and edges in one table."""
    none = F.lit(None).cast("string")
    return nodes.select(F.lit("node").alias("item"), "table", "id", none.alias("target_id"), none.alias("rel_type"), F.lit(None).cast("double").alias("weight")).unionByName(
        relations.select(F.lit("edge").alias("item"), none.alias("table"), F.col("source_id").alias("id"), "target_id", "rel_type", F.col("weight").cast("double").alias("weight")))


def stale_frontmatter(relations: DataFrame, touched: DataFrame, desired: DataFrame) -> DataFrame:
    """Frontmatter relations of touched files that are desired no more."""
    own = relations.where("rel_type IN ('HAS_TAG', 'HAS_PARTICIPANT')").join(touched.select(F.col("document_ref").alias("source_id")).distinct(), "source_id", "left_semi")
    return own.join(desired.select("source_id", "target_id", "rel_type").distinct(), ["source_id", "target_id", "rel_type"], "left_anti")


