"""Audits of the tables and measures of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distribution(embeddings: DataFrame) -> DataFrame:
    """Rows by model and length of the vector; mismatch where the length is not the model's usual one."""
    rows = embeddings.groupBy("embedding_model", F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    usual = rows.groupBy("embedding_model").agg(F.max_by("length", F.struct("n", "length")).alias("usual"))
    return rows.join(F.broadcast(usual), "embedding_model").withColumn("mismatch", F.col("length") != F.col("usual")).drop("usual")  # a row a model


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, present, missing, different: of each column, in one scan."""
    agg = [x for c in columns for x in (F.count(c).alias(f"{c}_p"), F.count_distinct(c).alias(f"{c}_d"))]
    one = rows.agg(F.count("*").alias("n"), *agg)
    parts = [F.struct(F.lit(c).alias("field"), F.col(f"{c}_p").alias("present"), (F.col("n") - F.col(f"{c}_p")).alias("missing"), F.col(f"{c}_d").alias("different")) for c in columns]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def fan_out(provenance: DataFrame) -> DataFrame:
    """How many chunks have how many provenances."""
    return provenance.groupBy("chunk_id").agg(F.count("*").alias("provenances")).groupBy("provenances").agg(F.count("*").alias("chunks"))


def completeness(chunks: DataFrame, provenance: DataFrame, embeddings: DataFrame) -> DataFrame:
    """finding, n: chunks, those without vector or provenance, vectors without chunk, repeated chunk and vector keys."""
    ids, has = chunks.select("chunk_id").distinct(), embeddings.select("chunk_id").distinct()
    parts = [
        ("chunks", ids), ("chunks_without_vector", ids.join(has, "chunk_id", "left_anti")), ("chunks_without_provenance", ids.join(provenance, "chunk_id", "left_anti")),
        ("vectors_without_chunk", has.join(ids, "chunk_id", "left_anti")), ("repeated_chunks", duplicates(chunks, ["chunk_id"])),
        ("repeated_vectors", duplicates(embeddings, ["chunk_strategy", "embedding_model", "chunk_id"])),
    ]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def gains(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """ranked (query_id, item, rank) with gain: 2 for relevant, 1 for maybe that is not relevant too, else 0."""
    relevant = labels.where("grade = 'relevant'").select("query_id", "item").distinct()
    maybe = labels.where("grade = 'maybe'").select("query_id", "item").distinct().join(relevant, ["query_id", "item"], "left_anti")
    graded = relevant.withColumn("gain", F.lit(2)).unionByName(maybe.withColumn("gain", F.lit(1)))
    return ranked.join(graded, ["query_id", "item"], "left").na.fill(0, ["gain"])


def measures(ranked: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, hit1, hit3, hit5, mrr, ndcg of the first k, for every query with labels; queries without a hit have 0."""
    rows = gains(ranked, labels)
    first = F.min(F.when((F.col("gain") > 0) & (F.col("rank") <= k), F.col("rank")))
    dcg = F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    got = rows.groupBy("query_id").agg(first.alias("first"), dcg.alias("dcg"))
    grades = gains(labels.select("query_id", "item").distinct().withColumn("rank", F.lit(1)), labels).where("gain > 0")
    per = grades.groupBy("query_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("gain"))), 1, k).alias("g"))
    ideal = F.aggregate(F.transform("g", lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    out = per.select("query_id", ideal.alias("ideal")).join(got, "query_id", "left")
    hit = lambda n: F.coalesce((F.col("first") <= n).cast("int"), F.lit(0)).alias(f"hit{n}")
    return out.select("query_id", hit(1), hit(3), hit(5), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"))


def summary(results: DataFrame) -> DataFrame:
    """Means per model over rows that are neither pool_miss nor error, best first: ndcg, mrr, hit3, then the quicker."""
    valid = ~F.coalesce("pool_miss", F.lit(False)) & F.col("error").isNull()
    mean = lambda c: F.round(F.avg(F.when(valid, F.col(c))), 6).alias(c)
    rows = results.groupBy("model").agg(F.count("*").alias("queries"), F.count_if(valid).alias("valid"), *[mean(c) for c in ("hit1", "hit3", "hit5", "mrr", "ndcg")],
                                        F.round(F.percentile("elapsed_ms", 0.5), 3).alias("p50"), F.round(F.percentile("elapsed_ms", 0.95), 3).alias("p95"))
    return rows.orderBy(F.desc("ndcg"), F.desc("mrr"), F.desc("hit3"), "p95", "model")


def band(p95_ms):  # noqa: ANN001, ANN201
    return F.when(p95_ms <= 10_000, "fast").when(p95_ms <= 30_000, "acceptable").when(p95_ms <= 120_000, "slow").otherwise("unusable")


def latencies(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("model", "pass_kind").agg(F.count("*").alias("n"), F.percentile("elapsed_ms", 0.5).alias("p50"), F.percentile("elapsed_ms", 0.95).alias("p95"))
    return out.withColumn("band", band(F.col("p95")))
