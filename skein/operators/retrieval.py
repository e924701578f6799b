"""Retrieval for a table of queries (query_id, text): keyword, vectors, fusion, rerank, snippets, merges.

Every engine returns query_id, chunk_id, score, rank with ties by chunk_id; one plan serves all queries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from skein import runtime
from skein.functions import text as T

K1, B = 1.2, 0.75
TITLE_BOOST, TEXT_BOOST = 5.0, 1.0


def ranked(rows: DataFrame, k: int | None = None, score: str = "score", tie: str = "chunk_id", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """rank 1.. inside each query, best first; the limit is a group limit before the shuffle."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))
    return out if k is None else out.where(F.col("rank") <= k)


#: Texts and bytes of text of a block of the index, at most; bytes of the frequent terms of a block that a search spreads out.
BLOCK_TEXTS, BLOCK_BYTES, DENSE_BYTES = 32_768, 32_000_000, 32_000_000


@dataclass(frozen=True)
class Index:
    """A stored inverted index: postings by blocks of texts and terms, its texts, document frequencies, number of texts and their mean length.

    postings: a row for each block and term (block, term, n, and in place each text's number in the block, occurrences and length); all of a block lie in
    one file. Blocks and the numbers in them are in the order of the ids.
    """

    postings: DataFrame
    texts: DataFrame
    frequencies: DataFrame
    n: int
    mean: float


def index(texts: DataFrame, column: str, path: str | None = None) -> Index:
    """Build the index of a column of (chunk_id, column) and store it under path (a new folder without one); open_index reads it again.

    Texts go to blocks of at most about BLOCK_TEXTS and BLOCK_BYTES by ranges of their ids. They are read three times, so that costly ones should be stored.
    """
    return _stored(texts, (column,), path or runtime.new_path(texts.sparkSession, "index"))[0]


def indexes(rows: DataFrame, columns: tuple[str, ...]) -> list[Index]:
    """The indexes of columns of (chunk_id, *columns) by one shuffle, without a stored copy of the texts. Of a chunk_id that comes several times the largest value of each column counts."""
    largest = [F.max(c).alias(c) for c in columns]
    return _stored(rows, columns, runtime.new_path(rows.sparkSession, "index"), lambda x: x.groupBy("chunk_id").agg(*largest))


def _stored(texts: DataFrame, columns: tuple[str, ...], path: str, merged: Callable[[DataFrame], DataFrame] = lambda x: x) -> list[Index]:
    """merged: what is done with the rows of a block, of which all of a chunk_id lie in one."""
    spark = texts.sparkSession
    total = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in columns)
    size = texts.agg(F.count("*").alias("n"), F.sum(total).alias("bytes")).head()
    tasks = min(runtime.partitions(spark), -(-(size.bytes or 0) // 1_000_000))
    blocks = max(1, -(-size.n // BLOCK_TEXTS), -(-(size.bytes or 0) // BLOCK_BYTES), min(tasks, spark.sparkContext.defaultParallelism))
    kind = texts.select("chunk_id").schema["chunk_id"].dataType
    schema = S.StructType([S.StructField("field", S.StringType()), S.StructField("kind", S.StringType()), S.StructField("block", S.IntegerType()), S.StructField("at", S.IntegerType()), S.StructField("chunk_id", kind), S.StructField("len", S.IntegerType()),
                           S.StructField("term", S.StringType()), S.StructField("n", S.IntegerType()), *[S.StructField(c, S.BinaryType()) for c in ("texts", "tf", "lens")]])
    rows = merged(texts.select("chunk_id", *columns).repartitionByRange(blocks, "chunk_id")).sortWithinPartitions("chunk_id").select("chunk_id", *[T.words(c).alias(c) for c in columns])
    made = rows.mapInArrow(_blocks(schema, columns), schema)
    several = len(columns) > 1
    runtime.write((made if several else made.drop("field")).write.mode("overwrite").partitionBy(*["field"] * several, "kind").option("parquet.block.size", str(1 << 30)).option("compression", "zstd"), spark, f"{path}/rows")
    found = []
    for field in columns:
        part = f"/field={field}" if several else ""
        there = runtime.exists(spark, f"{path}/rows{part}")
        stored = spark.read.schema(schema).parquet(f"{path}/rows{part}") if there else spark.createDataFrame([], schema)
        runtime.write(stored.where("kind = 'term'").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite"), spark, f"{path}/frequencies{part}")
        runtime.write(stored.where("kind = 'text'").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).write.mode("overwrite"), spark, f"{path}/statistics{part}")
        found.append(open_index(spark, path, part))
    return found


def open_index(spark, path: str, part: str = "") -> Index:  # noqa: ANN001
    stat = spark.read.parquet(f"{path}/statistics{part}").head()
    rows = spark.read.parquet(f"{path}/rows{part}") if stat.n else spark.createDataFrame([], "kind string, block int, at int, chunk_id string, len int, term string, n int, texts binary, tf binary, lens binary")
    return Index(rows.where("kind = 'term'").select("block", "term", "n", "texts", "tf", "lens"), rows.where("kind = 'text'").select("block", "at", "chunk_id", "len"), spark.read.parquet(f"{path}/frequencies{part}"), stat.n, stat.mean or 1.0)


def _blocks(schema: S.StructType, columns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition of (chunk_id, words of each column) as one block: for each column a row for each text with words and each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, block = to_arrow_schema(schema), TaskContext.get().partitionId()

        def out(rows: int, **values: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([values[f.name].cast(f.type) if f.name in values else pa.nulls(rows, f.type) for f in arrow], schema=arrow)

        names: dict[str, dict[str, int]] = {c: {} for c in columns}
        codes: dict[str, list[np.ndarray]] = {c: [] for c in columns}
        sizes: dict[str, list[np.ndarray]] = {c: [] for c in columns}
        for batch in batches:
            for i, c in enumerate(columns, 1):
                size = batch.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
                told = size > 0
                size = size[told]
                if not len(size):
                    continue
                yield out(len(size), field=pa.array([c] * len(size)), kind=pa.array(["text"] * len(size)), block=pa.array(np.full(len(size), block, np.int32)), at=pa.array(np.arange(len(size), dtype=np.int32) + sum(map(len, sizes[c]))),
                          chunk_id=batch.column(0).filter(pa.array(told)), len=pa.array(size))
                words = batch.column(i).flatten().dictionary_encode()
                codes[c].append(np.array([names[c].setdefault(w, len(names[c])) for w in words.dictionary.to_pylist()], dtype=np.int64)[words.indices.to_numpy()])
                sizes[c].append(size)
        for c in columns:
            if not sizes[c]:
                continue
            size = np.concatenate(sizes[c])
            key = np.concatenate(codes.pop(c)) * len(size) + np.repeat(np.arange(len(size)), size)
            key, tf = np.unique(key, return_counts=True)
            text = (key % len(size)).astype(np.int32)
            begin = np.searchsorted(key, np.arange(len(names[c]) + 1, dtype=np.int64) * len(size))
            tf, lens, terms = tf.astype(np.int32), size[text], list(names[c])
            for a in range(0, len(terms), 2_000):
                b = min(a + 2_000, len(terms))
                cut = [(begin[i], begin[i + 1]) for i in range(a, b)]
                parts = {name: pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for name, x in (("texts", text), ("tf", tf), ("lens", lens))}
                yield out(b - a, field=pa.array([c] * (b - a)), kind=pa.array(["term"] * (b - a)), block=pa.array(np.full(b - a, block, np.int32)), term=pa.array(terms[a:b]), n=pa.array(np.diff(begin[a : b + 1]).astype(np.int32)), **parts)

    return run


def bm25(queries: DataFrame, held: Index, k: int, every_term: bool = False, block: int = 10_000) -> DataFrame:
    """BM25 of an index; idf = ln(1 + (N - df + 0.5) / (df + 0.5)). every_term: texts must hold all terms of the query.

    Queries go in blocks of at most `block`, each over all texts in a few tasks. A task reads the postings of its queries' terms as they are stored, keeps the k best a query from
    one block of texts to the next, and leaves out what can't be among them; so nothing is shuffled but k rows a query and task.
    """
    spark = queries.sparkSession
    terms = runtime.materialize(queries.select("query_id", F.array_sort(F.array_distinct(T.words(T.keyword_query("text")))).alias("terms")).where(F.size("terms") > 0), "terms")
    kinds = {f.name: f.dataType for f in terms.schema}
    schema = S.StructType([S.StructField("query_id", kinds["query_id"]), S.StructField("block", S.IntegerType()), S.StructField("at", S.IntegerType()), S.StructField("score", S.DoubleType())])
    n, tasks = terms.count(), 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(tasks, -(-n // 250)))
    rounds = -(-blocks // tasks)
    path = runtime.new_path(spark, "hits")
    spark.createDataFrame([], schema).write.parquet(path)
    for r in range(rounds):
        table = _alike(terms if rounds == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r))  # about `block` queries a task
        size = max(1, -(-table.num_rows // -(-blocks // rounds)))
        known = held.frequencies.join(F.broadcast(_terms(spark, table)), "term", "left_semi").toArrow()  # at most their terms
        idf = dict(zip(known["term"].to_pylist(), np.log(1 + (held.n - known["df"].to_numpy() + 0.5) / (known["df"].to_numpy() + 0.5)).tolist(), strict=True))
        parts = [table.take(np.arange(i, min(i + size, table.num_rows))) for i in range(0, table.num_rows, size)]  # a slice would be sent with the whole table
        out = None
        for part in parts:
            rows = held.postings.join(F.broadcast(_terms(spark, part)), "term").coalesce(max(1, -(-tasks // len(parts)))).select("block", "term", "texts", "tf", "lens")
            hits = rows.mapInArrow(_best(spark.sparkContext.broadcast((part, idf)), k, every_term, held.mean, schema), schema)
            out = hits if out is None else out.unionByName(hits)
        if out is not None:
            _append(out, path)
    found = spark.read.schema(schema).parquet(path)
    return ranked(found.join(held.texts.select("block", "at", "chunk_id"), ["block", "at"]).select("query_id", "chunk_id", "score"), k)


def _append(out: DataFrame, path: str, rows: int = 500) -> None:
    """Write a union of blocks of queries, each in its own tasks, which get few rows at once: blocks of one partition each would else be united to one task."""
    conf = out.sparkSession.conf
    before = {name: conf.get(name, None) for name in ("spark.sql.unionOutputPartitioning", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    conf.set("spark.sql.unionOutputPartitioning", "false")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        runtime.write(out.write.mode("append"), out.sparkSession, path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def _alike(terms: DataFrame) -> pa.Table:
    """(query_id, terms) with queries of the same terms one after another: they come to one task, which answers them once."""
    return terms.withColumn("same", F.xxhash64("terms")).toArrow().sort_by("same").drop_columns("same")


def _terms(spark, asked: pa.Table) -> DataFrame:  # noqa: ANN001
    """The different terms of (query_id, terms)."""
    return spark.createDataFrame(pa.table({"term": asked["terms"].combine_chunks().flatten().unique().cast(pa.string())}))


def _best(asked, k: int, every_term: bool, mean: float, schema: S.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Posting rows that lie by block, as the k best of each query: query_id, block, at, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idf = asked.value
        sets: dict[tuple, list[int]] = {}  # queries of the same terms are answered once
        for i, terms in enumerate(queries.column("terms").to_pylist()):
            sets.setdefault(tuple(terms), []).append(i)
        search = _Search(list(sets), k, every_term)
        lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        now, done = None, set()
        for batch in batches:
            blocks, terms, columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [_cells(c) for c in batch.columns[2:]]
            for i, (block, term) in enumerate(zip(blocks, terms, strict=True)):
                if block != now:
                    if lists:
                        search.take(now, lists)
                        lists = {}
                    if block in done:
                        raise ValueError("the postings of a block do not lie together")
                    done.add(block)
                    now = block
                text, tf, lens = (values[at[i] >> 2 : at[i + 1] >> 2] for values, at in columns)
                lists[term] = text, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens / mean))
            del columns
        if lists:
            search.take(now, lists)
        from pyspark.sql.pandas.types import to_arrow_schema

        ids, arrow = queries.column("query_id").combine_chunks(), to_arrow_schema(schema)
        which = np.repeat(np.arange(len(sets)), [len(same) for same in sets.values()])  # each query's set
        order = np.array([i for same in sets.values() for i in same], dtype=np.int64)
        for a in range(0, len(order), 1_000):
            score, place = search.score[which[a : a + 1_000]], search.place[which[a : a + 1_000]]
            there = score > -np.inf
            of, score, place = np.repeat(order[a : a + 1_000], there.sum(axis=1)), score[there], place[there]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array((place >> 32).astype(np.int32)), pa.array((place & 0xFFFFFFFF).astype(np.int32)), pa.array(score)], schema=arrow)

    return run


def _cells(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The 32-bit numbers of a column of binary cells, in place, and where each cell begins and ends in bytes."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1]
    base = int(at[0])
    return np.frombuffer(data, np.int32, (int(at[-1]) - base) // 4, base), (at - base).tolist()


class _Search:
    """The k best (score, place) of each of some sets of terms, block by block.

    Terms go by their largest weight in the block: what holds only terms whose largest weights add up to less than the k-th best score need not be looked at, and of
    what is looked at only what may still reach it is followed through the other terms. Frequent terms are spread out, a number a text, so that they are added and looked up in place.
    """

    def __init__(self, sets: list[tuple], k: int, every_term: bool) -> None:
        self.sets, self.k, self.every_term = sets, k, every_term
        self.names = {t: i for i, t in enumerate(dict.fromkeys(t for terms in sets for t in terms))}
        self.score = np.full((len(sets), k), -np.inf)
        self.place = np.full((len(sets), k), np.iinfo(np.int64).max)
        self.terms = np.full((len(sets), max(map(len, sets), default=1)), len(self.names))  # the last stands for none
        for i, terms in enumerate(sets):
            self.terms[i, : len(terms)] = [self.names[t] for t in terms]

    def take(self, block: int, lists: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """lists: texts in order and weights of a term, in the block."""
        most = np.zeros(len(self.names) + 1)
        size = 1
        numbered: list = [None] * len(self.names)
        for t, x in lists.items():
            most[self.names[t]] = x[1].max()
            size = max(size, int(x[0][-1]) + 1)
            numbered[self.names[t]] = x
        # Of scores like the k-th best only those of an earlier text count. Scores are rounded to 6 places.
        last = self.score[:, -1]
        floors = np.where(last > -np.inf, np.where(block > self.place[:, -1] >> 32, last + 4e-7, last - 2e-6), -1.0)
        if self.every_term:
            for q in np.flatnonzero((most[self.terms].sum(axis=1) >= floors) & ((most[self.terms] > 0).sum(axis=1) == (self.terms < len(self.names)).sum(axis=1))).tolist():
                known = sorted((numbered[i] for i in self.terms[q].tolist() if i < len(numbered)), key=lambda x: len(x[0]))
                if known:
                    self._keep(q, block, *_common(known), floors[q])
            return
        dense: dict[int, np.ndarray] = {}
        for i in sorted((i for i, x in enumerate(numbered) if x is not None and 256 * len(x[0]) >= size), key=lambda i: -len(numbered[i][0]))[: max(1, DENSE_BYTES // (8 * size))]:
            dense[i] = np.zeros(size)
            dense[i][numbered[i][0]] = numbered[i][1]
        total, held = np.zeros(size), np.zeros(size)
        for a in range(0, len(self.sets), 10_000):
            some = slice(a, a + 10_000)
            large = most[self.terms[some]]
            order = np.argsort(-large, axis=1, kind="stable")
            large = np.take_along_axis(large, order, axis=1)
            terms, known = np.take_along_axis(self.terms[some], order, axis=1), (large > 0).sum(axis=1)
            rest = np.concatenate([np.cumsum(large[:, ::-1], axis=1)[:, ::-1], np.zeros((len(large), 1))], axis=1)
            first = np.maximum(1, np.minimum(known, (rest[:, :-1] >= floors[some, None]).sum(axis=1)))  # every text that can reach the floor has one of these
            for q in np.flatnonzero((known > 0) & (rest[:, 0] >= floors[some])).tolist():
                n, f, floor = int(known[q]), int(first[q]), float(floors[a + q])
                mine, left = terms[q, :n].tolist(), rest[q].tolist()
                least = floor - left[f]
                if f == 1:
                    found, score = numbered[mine[0]]
                    if least > 0:
                        found = found[fits := score >= least]
                        score = score[fits]
                elif 8 * sum(len(numbered[i][0]) for i in mine[:f]) < size:
                    parts = [numbered[i] for i in mine[:f]]
                    for text, weight in parts:
                        total[text] += weight
                    found = np.concatenate([text for text, _ in parts])
                    score = total[found]
                    fits = score >= max(least, 1e-300)
                    found, at = np.unique(found[fits], return_index=True)
                    score = score[fits][at]
                    for text, _ in parts:
                        total[text] = 0.0
                else:
                    np.copyto(total, dense[mine[0]]) if mine[0] in dense else _add(total, numbered[mine[0]])
                    for i in mine[1:f]:
                        np.add(total, dense[i], out=total) if i in dense else _add(total, numbered[i])
                    found = np.flatnonzero(total >= max(least, 1e-300))
                    score = total[found]
                    total.fill(0.0)
                for j in range(f, n):
                    if not len(found):
                        break
                    if mine[j] in dense:
                        score = score + dense[mine[j]][found]
                    else:
                        text, weight = numbered[mine[j]]
                        if 12 * len(found) < len(text):
                            at = np.minimum(np.searchsorted(text, found), len(text) - 1)
                            score = score + np.where(text[at] == found, weight[at], 0.0)
                        else:
                            held[text] = weight
                            score = score + held[found]
                            held[text] = 0.0
                    if (least := floor - left[j + 1]) > 0:
                        found = found[fits := score >= least]
                        score = score[fits]
                if len(found):
                    self._keep(a + q, block, found, score, floor)

    def _keep(self, q: int, block: int, found: np.ndarray, score: np.ndarray, floor: float) -> None:
        k, score = self.k, np.round(score, 6)
        fits = score >= floor
        found, score = found[fits], score[fits]
        if len(found) > 4 * k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[near], score[near]
        if not len(found):
            return
        score, place = np.concatenate([self.score[q], score]), np.concatenate([self.place[q], (block << 32) | found.astype(np.int64)])
        order = np.lexsort((place, -score))[:k]
        self.score[q], self.place[q] = score[order], place[order]


def _add(total: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> None:
    total[held[0]] += held[1]


def _common(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Texts that are in all lists, and the sums of their weights."""
    found, score = lists[0]
    for text, weight in lists[1:]:
        at = np.minimum(np.searchsorted(text, found), len(text) - 1)
        both = text[at] == found
        found, score = found[both], score[both] + weight[at[both]]
    return found, score


def fielded(queries: DataFrame, title_index: Index, text_index: Index, k: int) -> DataFrame:
    """Both fields by themselves, each limited to k, then 5 * title + 1 * text."""
    parts = bm25(queries, title_index, k).select("query_id", "chunk_id", (F.col("score") * TITLE_BOOST).alias("score")).unionByName(
        bm25(queries, text_index, k).select("query_id", "chunk_id", (F.col("score") * TEXT_BOOST).alias("score")))
    return ranked(parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score")), k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, floor: float = 0.0, block: int = 10_000) -> DataFrame:
    """Exact cosine of a stated set of queries (query_id, vector) against all vectors (chunk_id, vector); score >= floor * best.

    The queries go in blocks of at most `block`, each over all vectors in a few tasks, so that the shuffle holds k rows a query and task of its block. A task multiplies a few
    of its queries with a batch of vectors at once, in 32-bit numbers, and exactly what may be among the k best. The vectors are read once a block, so that costly ones should be stored.
    Vectors of another length, empty or zero ones score 0, as do such queries.
    """
    spark = queries.sparkSession
    held = runtime.materialize(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "asked")
    kinds = {f.name: f.dataType for f in (*held.select("query_id").schema, *vectors.select("chunk_id").schema)}
    schema = S.StructType([S.StructField("query_id", kinds["query_id"]), S.StructField("chunk_id", kinds["chunk_id"]), S.StructField("score", S.DoubleType())])
    n, tasks = held.count(), 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(tasks, -(-n // 250)))
    rounds = -(-blocks // tasks)
    length = held.agg(F.max(F.size("vector"))).head()[0] or 0
    path = runtime.new_path(spark, "near")
    spark.createDataFrame([], schema).write.parquet(path)
    for r in range(rounds):
        table = (held if rounds == 1 else held.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)).toArrow()  # about `block` queries a task
        size = max(1, -(-table.num_rows // -(-blocks // rounds)))
        parts = [table.take(np.arange(i, min(i + size, table.num_rows))) for i in range(0, table.num_rows, size)]  # a slice would be sent with the whole table
        out = None
        for part in parts:
            rows = vectors.where("chunk_id IS NOT NULL").select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).coalesce(max(1, -(-tasks // len(parts))))
            top = rows.mapInArrow(_nearest(spark.sparkContext.broadcast(part), max(0, length), k, floor, schema), schema)
            out = top if out is None else out.unionByName(top)
        if out is not None:
            _append(out, path, 4_000)
    return floored(ranked(spark.read.schema(schema).parquet(path), k), floor)


def _unit(column: pa.Array, length: int) -> np.ndarray:
    """Lists of numbers as rows of unit length; those of another length are 0."""
    out = np.zeros((len(column), length))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == length
    if length and right.any():
        out[right] = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.nan_to_num(out / np.where(norm > 0, norm, 1.0))


def _nearest(asked, length: int, k: int, floor: float, schema: S.StructType, cells: int = 2_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """The k best of each query; of those under `floor` times the best some are left out. cells: scores that are held at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = asked.value.column("query_id").combine_chunks()
        exact = _unit(asked.value.column("vector"), length)
        exact, same = np.unique(exact, axis=0, return_inverse=True)  # equal queries are answered once
        rough, n = exact.astype(np.float32), len(exact)
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by the first query of a slice: query, score, name in order
        floors = np.full(n, -np.inf)
        step, slack = max(1, cells // 4_000), 2e-6 + 1.2e-7 * length
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            names = batch.column(0)
            names = np.array([x.encode() for x in names.to_pylist()]) if pa.types.is_string(names.type) or pa.types.is_large_string(names.type) else names.to_numpy(zero_copy_only=False)
            vectors = _unit(batch.column(1), length)
            few = vectors.astype(np.float32).T
            for a in range(0, n, step):
                b = min(n, a + step)
                score = rough[a:b] @ few
                least = floors[a:b].copy()
                new = least == -np.inf
                if new.any():
                    least[new] = np.partition(score[new], len(names) - k, axis=1)[:, len(names) - k] if len(names) > k else -np.inf
                row, col = np.nonzero(score >= (least - slack)[:, None].astype(np.float32))
                if not len(row):
                    continue
                value = np.concatenate([np.round(np.einsum("ij,ij->i", exact[a + row[i : i + 50_000]], vectors[col[i : i + 50_000]]), 6) + 0.0 for i in range(0, len(row), 50_000)])
                good = value >= floors[a + row]
                row, value, name = row[good], value[good], names[col[good]]
                if a in best:
                    row, value, name = (np.concatenate([x, y]) for x, y in zip(best[a], (row, value, name), strict=True))
                order = np.lexsort((name, -value, row))
                row, value, name = row[order], value[order], name[order]
                begin = np.searchsorted(row, np.arange(b - a + 1))
                at = np.arange(len(row)) - begin[row]
                kept = at < k
                last = kept & (at == k - 1)
                best[a] = row[kept], value[kept], name[kept]
                floors[a + row[last]] = value[last]
                first = at == 0  # what is under `floor` times the best is left out in the end
                if floor > 0:
                    floors[a + row[first]] = np.where(value[first] > 0, np.maximum(floors[a + row[first]], np.round(value[first] * floor, 6) - 1e-6), floors[a + row[first]])
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        whose = np.argsort(same.ravel(), kind="stable")
        starts = np.searchsorted(same.ravel()[whose], np.arange(n + 1))
        for a, (row, value, name) in best.items():
            times = np.diff(starts)[a + row]
            for i in range(0, len(row), 10_000):
                cut = slice(i, i + 10_000)
                of = np.concatenate([whose[starts[a + r] : starts[a + r + 1]] for r in row[cut].tolist()])
                named = np.repeat(name[cut], times[cut])
                named = pa.array([x.decode() for x in named.tolist()]) if named.dtype.kind == "S" else pa.array(named)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), named.cast(arrow.field(1).type), pa.array(np.repeat(value[cut], times[cut]))], schema=arrow)

    return run


def floored(hits: DataFrame, floor: float) -> DataFrame:
    """Hits of at least `floor` times the best score of their query."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("_best", best).where(F.col("score") >= F.col("_best") * floor).drop("_best")


def preconditions(vectors: DataFrame) -> DataFrame:
    """Per model: rows, least and largest length, and whether it can be searched (one length, not empty)."""
    rows = vectors.groupBy("embedding_model").agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"))
    return rows.withColumn("ready", (F.col("least") == F.col("most")) & (F.col("least") > 0))


def sharded_topk(hits: DataFrame, shard: Column, k: int, cap: int | None = None) -> DataFrame:
    """Top k of the union of the best k of every shard; of the best `cap` only where one is given, which may lose hits for k beyond it."""
    part = ranked(hits.withColumn("_shard", shard), k if cap is None else min(k, cap), by=("query_id", "_shard")).drop("rank", "_shard")
    return ranked(part, k)


def reciprocal_rank_fusion(lists: DataFrame, k0: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, chunk_id, score, engines, rank of lists (query_id, engine, chunk_id, rank): sums of weight / (k0 + rank).

    Ties keep the order in which engines come (semantic, keyword, graph_direct) and their ranks.
    """
    weight, order = F.lit(1.0), F.lit(9)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("engine") == name, float(w)).otherwise(weight)
    for i, name in enumerate(("semantic", "keyword", "graph_direct", "graph")):
        order = F.when(F.col("engine") == name, i).otherwise(order)
    rows = lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(weight / (k0 + F.col("rank"))), 9).alias("score"), F.min(F.struct(order.alias("o"), F.col("rank").alias("r"))).alias("_t"), F.array_sort(F.collect_set("engine")).alias("engines"))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "_t.o", "_t.r", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(window)).drop("_t")


def pool(mode: str, semantic: DataFrame, keyword: DataFrame, direct: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """The fused candidates of a mode; enrichment hits that are new come after, at half the lowest fused score of their query."""
    engines = {"semantic": [("semantic", semantic)], "keyword": [("keyword", keyword)]}.get(mode, [("semantic", semantic), ("keyword", keyword), ("graph_direct", direct)])
    lists = None
    for name, hits in engines:
        part = hits.select("query_id", F.lit(name).alias("engine"), "chunk_id", "rank")
        lists = part if lists is None else lists.unionByName(part)
    fused = reciprocal_rank_fusion(lists)
    if enrichment is None:
        return fused
    low = fused.groupBy("query_id").agg((F.min("score") * 0.5).alias("score"), F.max("rank").alias("_last"))
    new = enrichment.join(fused, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.col("rank").alias("_r")).join(low, "query_id")
    new = new.withColumn("rank", F.col("_last") + F.row_number().over(Window.partitionBy("query_id").orderBy("_r")))
    return fused.unionByName(new.select("query_id", "chunk_id", "score", F.array(F.lit("graph")).alias("engines"), "rank"))


def length_penalty(score: Column, text: Column, least: int) -> Column:
    """Texts shorter than `least` lose up to 0.2."""
    n = F.length(text)
    return F.when(n < least, score - 0.2 * (1 - n / F.lit(float(least)))).otherwise(score)


def overlap_score(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """The built-in scorer: the share of the query's words that the text has."""
    word = re.compile(r"\w+")
    return pd.Series([len(a & set(word.findall(t.lower()))) / max(1, len(a)) for q, t in zip(queries, texts, strict=True) for a in [set(word.findall(q.lower()))]], dtype="float64")


RERANKERS: dict[str, Callable[[pd.Series, pd.Series], pd.Series]] = {"overlap": overlap_score}


def reranked(pairs: DataFrame, scorer: str = "overlap", least: int = 200, floor: float | None = None, k: int | None = None) -> DataFrame:
    """pairs (query_id, chunk_id, query, text, ...) with rerank_score and rank. The scorer runs over Arrow batches of the candidates only."""
    score = RERANKERS[scorer]

    @F.pandas_udf(S.DoubleType())
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return score(q.fillna(""), t.fillna(""))

    rows = pairs.withColumn("rerank_score", F.round(length_penalty(scored("query", "text"), F.coalesce("text", F.lit("")), least), 6))
    if floor is not None:
        rows = rows.where(F.col("rerank_score") >= floor)
    return ranked(rows, k, "rerank_score")


def min_max(score: Column, by: str = "query_id") -> Column:
    """Score between the least and the largest of its query; a flat range counts as 1."""
    w = Window.partitionBy(by)
    width = F.max(score).over(w) - F.min(score).over(w)
    return (score - F.min(score).over(w)) / F.when(width > 0, width).otherwise(1.0)


def blended(candidates: DataFrame, fused_weight: float = 0.4, rerank_weight: float = 0.6) -> DataFrame:
    """candidates (query_id, chunk_id, score, rerank_score or null): 0.4 fused + 0.6 rerank, both min-max scaled over the reranked; others keep the raw score."""
    inside = F.when(F.col("rerank_score").isNotNull(), F.col("score"))
    value = fused_weight * min_max(inside) + rerank_weight * min_max(F.col("rerank_score"))
    return ranked(candidates.withColumn("blended", F.round(F.coalesce(value, "score"), 6)), score="blended")


_SENTENCE_END = re.compile(r"[.?!]+(?=\s)\s*|\n\s*\n\s*")


def _excerpt(text: str, wanted: frozenset, length: int) -> str:
    """The sentences around the stretch of `length` characters that holds most different words of the query."""
    starts = np.array([0, *(m.end() for m in _SENTENCE_END.finditer(text) if m.end() < len(text))])
    ends = np.append(starts[1:], len(text))
    hits = [(m.start(), m.end(), held) for m in re.finditer(r"\w+", text) if (held := [q for q in wanted if q in m.group().lower()])]
    best, first, last, left = 0, 0, 0, 0
    inside: Counter[str] = Counter()
    for begin, end, held in hits:
        inside.update(held)
        while end - hits[left][0] > length and hits[left][0] < begin:
            inside.subtract(hits[left][2])
            left += 1
        found = sum(n > 0 for n in inside.values())
        if found > best:
            best, first, last = found, hits[left][0], end
    a, b = int(np.searchsorted(starts, first, side="right")) - 1, int(np.searchsorted(ends, last))
    while b + 1 < len(ends) and ends[b + 1] - starts[a] <= length:
        b += 1
    while a > 0 and ends[b] - starts[a - 1] <= length:
        a -= 1
    begin, end = int(starts[a]), int(ends[b])
    if end - begin > 2 * length:  # one long sentence: as many whole words of it as fit
        begin = first
        end = max((m.end() for m in re.finditer(r"\S+", text[begin : begin + length])), default=length) + begin
        if end < len(text) and not text[end].isspace() and (space := text.rfind(" ", begin, end)) > begin:
            end = space
    return ("..." if begin else "") + text[begin:end].strip() + ("..." if end < len(text) else "")


@F.pandas_udf(S.StringType())
def snippet(texts: pd.Series, queries: pd.Series, lengths: pd.Series) -> pd.Series:
    """Texts of up to `length` characters as they are, of longer ones the sentences with most words of the query, up to twice the length, else whole words up to it. Null stays null."""
    words = queries.map(lambda q: frozenset(re.findall(r"\w+", (q or "").lower())))
    return pd.Series([t if t is None or len(t) <= n else _excerpt(t, w, int(n)) for t, w, n in zip(texts, words, lengths, strict=True)], dtype=object)


def deletions(word: Column, distance: int) -> Column:
    """The word and all that is left of it after up to `distance` letters are taken out."""
    out = F.array(word)
    for _ in range(distance):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))))))
    return out


def expanded(queries: DataFrame, acronyms: DataFrame, distance: int = 1) -> DataFrame:
    """query_id, original, text, expansions: acronyms of a query (exact, else the nearest within the distance, ties by name) with their expansions after them and again at the end.

    acronyms (acronym, expansions), one row each. Two words within the distance share a word that is left of either after as many deletions, so that near ones
    meet by an equi-join, whatever the number of acronyms; the distance itself is then checked.
    """
    tokens = queries.select("query_id", "text", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("at", "token")).withColumn("clean", F.regexp_replace(F.upper("token"), "[^A-Z]", ""))
    asked = tokens.where(F.length("clean") >= 2).select("query_id", "at", "clean", F.explode(deletions(F.col("clean"), distance)).alias("left"))
    known = acronyms.select(F.col("acronym").alias("a"), "expansions", F.explode(deletions(F.col("acronym"), distance)).alias("left"))
    near = asked.join(known, "left").where(F.levenshtein(F.col("clean"), F.col("a"), distance).between(0, distance))
    best = near.groupBy("query_id", "at").agg(F.min_by("expansions", F.struct(F.levenshtein("clean", "a"), "a")).alias("e"))
    rows = tokens.join(best, ["query_id", "at"], "left").withColumn("e", F.coalesce("e", F.array().cast("array<string>")))
    word = F.struct("at", F.array_join(F.concat(F.array("token"), "e"), " ").alias("x"), "e")
    out = rows.groupBy("query_id", F.col("text").alias("original")).agg(F.array_sort(F.collect_list(word)).alias("l"))
    extra = F.flatten(F.transform("l", lambda x: x["e"]))
    joined = F.array_join(F.transform("l", lambda x: x["x"]), " ")
    return out.select("query_id", "original", F.when(F.size(extra) > 0, F.concat_ws(" ", joined, F.array_join(extra, " "))).otherwise(joined).alias("text"), extra.alias("expansions"))


def quota_merge(local: DataFrame, federated: DataFrame, k: int, quota: int) -> DataFrame:
    """query_id, ref, origin, position: min(quota, number of telling federated hits) places for these in their own order, the rest for the best local ones."""
    telling = federated.where(~((F.col("namespace") == "telegram") & T.low_signal("snippet")))
    fed = telling.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("native_rank", "ref"))).where(F.col("n") <= quota)
    slots = fed.groupBy("query_id").agg(F.count("*").alias("slots"))
    own = local.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ref"))).join(slots, "query_id", "left").where(F.col("n") <= k - F.coalesce("slots", F.lit(0)))
    rows = own.select("query_id", "ref", F.lit("local").alias("origin"), F.lit(0).alias("o"), "n").unionByName(fed.select("query_id", "ref", F.lit("federated").alias("origin"), F.lit(1).alias("o"), "n"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "n"))).drop("o", "n")


def public_ref(namespace: Column, ref: Column, units: Column) -> Column:
    """telegram:<unit> for a message chunk of one unit, else the ref of the document."""
    return F.when((namespace == "telegram") & (F.size(units) == 1), F.concat(F.lit("telegram:"), units[0])).otherwise(ref)


def candidates(hits: DataFrame, chunks: DataFrame, queries: DataFrame, length: int = 300) -> DataFrame:
    """Hits (query_id, chunk_id, score, engines, rank) with ref, title, heading path and snippet; unknown chunks are left out."""
    rows = hits.join(chunks.select("chunk_id", "ref", "title", "heading_hierarchy", "text").dropDuplicates(["chunk_id"]), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return rows.select("query_id", "rank", "chunk_id", "ref", "title", "score", "engines", F.array_join("heading_hierarchy", " > ").alias("heading_path"), snippet("text", "query", F.lit(length)).alias("snippet"))


def first_of_ref(hits: DataFrame, provenance: DataFrame) -> DataFrame:
    """Engine hits as refs, the best of each ref."""
    rows = hits.join(provenance.select("chunk_id", "ref").distinct(), "chunk_id")
    order = Window.partitionBy("query_id", "engine", "ref").orderBy("rank", "chunk_id")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, shared: chunks that both lists have among their first k."""
    left = a.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("chunk_id").alias("x"))
    right = b.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("chunk_id").alias("y"))
    return left.join(right, "query_id").select("query_id", F.size(F.array_intersect("x", "y")).alias("shared"))


def fan_out(providers: dict[str, Callable[[], list[dict]]], seconds: float = 5.0) -> tuple[list[dict], list[dict]]:
    """(hits, statuses) of federated providers asked at once; a late one is skipped, a failing one an error, neither fails the search."""
    import concurrent.futures as cf
    import time

    hits, status = [], []
    began = time.monotonic()
    executor = cf.ThreadPoolExecutor(max_workers=max(1, len(providers)))
    futures = {name: executor.submit(f) for name, f in providers.items()}
    for name, future in futures.items():
        try:
            found = future.result(timeout=max(0.0, seconds - (time.monotonic() - began)))
            hits += [{**h, "source": name, "native_rank": i} for i, h in enumerate(found)]
            status.append({"source": name, "status": "ok", "count": len(found)})
        except cf.TimeoutError:
            status.append({"source": name, "status": "skipped", "count": 0})
        except Exception as e:  # noqa: BLE001
            status.append({"source": name, "status": "error", "count": 0, "error": str(e)})
    executor.shutdown(wait=False, cancel_futures=True)
    return hits, status


