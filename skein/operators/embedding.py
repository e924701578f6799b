"""Embeddings: providers, caches, components, shards."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V


def hashing_encoder(length: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The built-in provider: signed hashes of words, unit length. Deterministic, without a model."""
    import zlib

    word = re.compile(r"\w+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), length), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in word.findall((t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % length] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def encoded(rows: DataFrame, column: str, encode: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """Adds `vector`; the provider gets batches and is loaded once a worker. A batch that it refuses as too large is halved."""
    def attempt(texts: list[str]) -> list[np.ndarray]:
        try:
            return list(encode(texts))
        except ValueError:
            if len(texts) == 1:
                raise
            h = len(texts) // 2
            return attempt(texts[:h]) + attempt(texts[h:])

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in attempt(texts[i : i + batch])], index=part.index)

    return rows.withColumn("vector", run(F.col(column)))


def cache_layers(chunks: DataFrame, stored: DataFrame, cache: DataFrame) -> DataFrame:
    """Each chunk (chunk_id, text) with layer: stored (has a vector), cached (its text has one) or missing."""
    rows = chunks.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = rows.join(stored.select("chunk_id", F.lit(True).alias("_s")).distinct(), "chunk_id", "left").join(cache.select("text_hash", F.lit(True).alias("_c")).distinct(), "text_hash", "left")
    return rows.withColumn("layer", F.when(F.col("_s"), "stored").when(F.col("_c"), "cached").otherwise("missing")).drop("_s", "_c")


def embedded(chunks: DataFrame, stored: DataFrame, cache: DataFrame, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """chunk_id, text_hash, vector of all chunks: from the store, the cache, or encoded, one encoding a different text."""
    rows = cache_layers(chunks, stored, cache)
    have = rows.where("layer = 'stored'").select("chunk_id", "text_hash").join(stored.select("chunk_id", "vector"), "chunk_id")
    hit = rows.where("layer = 'cached'").select("chunk_id", "text_hash").join(cache.select("text_hash", "vector"), "text_hash")
    new = rows.where("layer = 'missing'")
    texts = encoded(new.groupBy("text_hash").agg(F.first("text").alias("text")), "text", encode).select("text_hash", "vector")
    fresh = new.select("chunk_id", "text_hash").join(texts, "text_hash")
    return have.select("chunk_id", "text_hash", "vector").unionByName(hit.select("chunk_id", "text_hash", "vector")).unionByName(fresh.select("chunk_id", "text_hash", "vector"))


def fused_components(components: DataFrame, text_weight: float = 0.7, meta_weight: float = 0.3) -> DataFrame:
    """The fused vector of every (chunk, strategy, model) that has both components of one length."""
    key = ["chunk_id", "chunk_strategy", "embedding_model"]
    rows = components.dropDuplicates([*key, "component"])
    text = rows.where("component = 'text'").select(*key, F.col("embedding").alias("t"))
    meta = rows.where("component = 'meta'").select(*key, F.col("embedding").alias("m"))
    return text.join(meta, key).select(*key, V.fused(F.col("t"), F.col("m"), text_weight, meta_weight).alias("vector")).where("vector IS NOT NULL")


def shard(strategy: str, model: str, chunk: str, shards: int):  # noqa: ANN201
    """Number of the shard of a key."""
    return F.pmod(F.xxhash64(T.composite(strategy, model, chunk)), F.lit(shards)).cast("int")


def backfill(wanted: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """chunk_id, status of listed chunks: missing_chunk, empty_text, embedded, or pending (to be encoded)."""
    text = chunks.groupBy("chunk_id").agg(F.max("text").alias("text"))
    rows = wanted.select("chunk_id").distinct().join(text.withColumn("_k", F.lit(True)), "chunk_id", "left").join(embeddings.select("chunk_id", F.lit(True).alias("_e")).distinct(), "chunk_id", "left")
    return rows.select("chunk_id", F.when(F.col("_k").isNull(), "missing_chunk").when(F.trim("text") == "", "empty_text").when(F.col("_e"), "embedded").otherwise("pending").alias("status"))
