"""Queries and operators against brute force, where they once did less than the whole job."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import plans
from skein.llm import language, neighbours, prose, toxicity
from skein.operators import graph, retrieval
from skein.streaming import ingest
from tests.conftest import DATA

FOLDER = DATA / "sf0.001"
needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@needs_tables
def test_related_sections_of_all(spark):
    links = set()
    for r in spark.read.parquet(str(FOLDER / "chunks.parquet")).select("chunk_id", "text").collect():
        for x in re.findall(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", r.text):
            if x.strip():
                links.add((r.chunk_id, re.sub(r"-\d+$", "", x.strip()), len(x.strip()) / 10))
    want: dict[tuple, float] = defaultdict(float)
    for section, target in {(s, t) for s, t, _ in links}:
        for other, t, weight in links:
            if t == target and other != section:
                want[section, other] += weight
    got = {(r.section, r.other): r.weight for r in plans.QUERIES["f11_related_all"](spark, str(FOLDER)).collect()}
    assert max(section for section, _ in want) > "02"
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_nearest_of_every_vector(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.repeat(rng.standard_normal((1, 8)), 15, axis=0), rng.standard_normal((30, 8))]).astype(np.float32)
    rows = [("fused", "s_1_0", "m", f"c{i:02d}", [float(y) for y in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "component string, chunk_strategy string, embedding_model string, chunk_id string, vector array<float>")
    got: dict[str, dict[int, str]] = defaultdict(dict)
    for r in neighbours.nearest(neighbours.usable(df)).collect():
        got[r.chunk_id][r.rank] = r.neighbour
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    assert got == {f"c{i:02d}": {n + 1: f"c{j:02d}" for n, j in enumerate(np.argsort(-s[i], kind="stable")[:10])} for i in range(len(v))}


def test_catalogue_of_all_names(spark):
    names = graph.catalogue(spark.range(100_001).select(F.format_string("Name %06d", "id").alias("name")))
    assert names.count() == 100_001
    assert [r.name for r in names.where("key = 'name 100000'").collect()] == ["Name 100000"]


def test_language_of_whole_words():
    models = {"en": language.Model({"the": 5.0, "there": 3.0, "other": 2.0}), "de": language.Model({"die": 5.0, "dieser": 3.0, "oder": 2.0})}
    known = language.Identifier(models, np.zeros(2))
    words = ["x" * 40 + "there" * 4, "x" * 40 + "dieser" * 4, "the", "y" * 900_000, "oder"]
    known.learn(set(words))
    for w in words:
        want = [m.score(language._windows([w]), 1)[0] for m in models.values()]
        assert known.scores[known.known[w]].tolist() == pytest.approx(want)
        assert known.letters[known.known[w]] == len(w) + 1
    assert known.scores[known.known[words[0]]].argmax() != known.scores[known.known[words[1]]].argmax()


def test_offences_are_scored_everywhere():
    text = "---\ntitle: you moron\n---\n# Second moron\n\n| third | moron |\n\n    fourth moron\n\nSubject: fifth moron\nx=1 sixth moron\nseventh: moron\n\n```\neighth moron\n\nninth moron"
    words = [w for s in toxicity.sentences(text) for w in toxicity.tokens(s)]
    assert words.count("moron") == 9


def test_open_fence_ends_at_blank_line():
    assert [s.strip() for s in prose.sentences("Before it.\n\n```\ncode here\n\nAfter it all.\n\nThe end.")] == ["Before it.", "After it all.", "The end."]
    assert [s.strip() for s in prose.sentences("Before it.\n\n```\ncode\n\nmore code\n```\nAfter it.")] == ["Before it.", "After it."]
    assert [s.strip() for s in prose.sentences("Before it.\n\n~~~\ncode here")] == ["Before it."]


def test_debounced_in_one_pass(spark):
    rows = [(k, 1_000 * i * (k + 1) + i % 7) for k in range(5) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k long, micros long").select("k", F.timestamp_micros("micros").alias("ts"))
    want = []
    for k in range(5):
        last = None
        for t in sorted(m for x, m in rows if x == k):
            if last is None or t - last >= 2_000_000:
                want.append((k, t))
                last = t
    out = ingest.debounced(df, "k", "ts", 2.0)
    assert sorted((r.k, r.m) for r in out.select("k", F.unix_micros("ts").alias("m")).collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroups" not in plan  # nor a Python call a burst


def test_keyword_scores_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_TEXTS", 40)
    rng = np.random.default_rng(3)
    texts = {f"c{i:04d}": " ".join(rng.choice(list("abcdefghijkl"), rng.integers(1, 6))) for i in range(700)}
    texts |= {f"d{i:04d}": "same text" for i in range(100)}
    texts["e"] = ""
    df = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    held = retrieval.index(df, "text")
    blocks = held.postings.select("block").distinct().count()
    assert blocks >= 15 and held.n == 800
    assert held.postings.count() <= 14 * blocks  # a row a block and term, not a row a text and term
    asked = {f"q{i:03d}": " ".join(rng.choice(list("abcdefghijklz"), rng.integers(1, 6))) for i in range(300)} | {"same": "same", "both": "TEXT same a"}
    words = {c: t.split() for c, t in texts.items() if t}
    mean = sum(map(len, words.values())) / len(words)
    df = defaultdict(int)
    for w in words.values():
        for t in set(w):
            df[t] += 1
    got: dict[str, list] = defaultdict(list)
    hits = retrieval.bm25(spark.createDataFrame(list(asked.items()), "query_id string, text string"), held, 5, block=19)
    assert len({f for f in hits.inputFiles() if "/hits-" in f}) >= 2 * spark.sparkContext.defaultParallelism  # a task for each block of queries
    assert "InPandas" not in hits._jdf.queryExecution().executedPlan().toString()
    for r in hits.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.score))
    for q, text in asked.items():
        terms = {t for t in text.lower().split() if t in df}
        score = {c: sum(np.log(1 + (800 - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in w) for c, w in words.items() if terms & set(w)}
        want = sorted(((-round(s, 6), c) for c, s in score.items()))[:5]
        assert [c for c, _ in got[q]] == [c for _, c in want]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_search_takes_few_rows_at_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    real = retrieval._best

    def best(*args):
        run = real(*args)

        def watched(batches):
            def each():
                for b in batches:
                    if b.num_rows > 500:
                        seen.add(1)
                    yield b
            return run(each())
        return watched

    monkeypatch.setattr(retrieval, "_best", best)
    df = spark.createDataFrame([(f"c{i:04d}", f"w{i} w{i + 1} same") for i in range(2_000)], "chunk_id string, text string")
    hits = retrieval.bm25(spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(2_000))), ("r", "same")], "query_id string, text string"), retrieval.index(df, "text"), 3)
    assert [r.chunk_id for r in hits.where("query_id = 'r'").orderBy("rank").collect()] == ["c0000", "c0001", "c0002"]
    assert seen.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "4000"


@needs_tables
@pytest.mark.parametrize(("name", "indexes"), [("k18_reranked", 1), ("k19_blend", 2), ("k25_quota_merge", 2)])
def test_texts_and_indexes_are_made_once(spark, monkeypatch, name, indexes):
    made = defaultdict(int)
    write, index = plans.retrieval.runtime.materialize, retrieval.index
    monkeypatch.setattr(plans.retrieval.runtime, "materialize", lambda df, n, path=None: made.update({n: made[n] + 1}) or write(df, n, path))
    monkeypatch.setattr(retrieval, "index", lambda *a: made.update({"index": made["index"] + 1}) or index(*a))
    assert plans.QUERIES[name](spark, str(FOLDER)).count() > 0
    assert (made["texts"], made["index"]) == (1, indexes)


def test_nearest_of_queries_in_bounded_memory(spark):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    v = np.round(rng.standard_normal((300, 6))).tolist() + [[0.0] * 6, [1.0] * 5, None]
    q = np.round(rng.standard_normal((40, 6))).tolist() + [[0.0] * 6]
    vectors = spark.createDataFrame([(f"c{i:03d}", x) for i, x in enumerate(v)], "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([(f"q{i:02d}", x) for i, x in enumerate(q)], "query_id string, vector array<double>")
    got: dict[str, list] = defaultdict(list)
    for r in retrieval.knn(asked, vectors, 4, 0.7, block=9).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.score))

    def unit(x):
        return np.array(x) / np.linalg.norm(x) if x is not None and len(x) == 6 and any(x) else np.zeros(6)

    for i, x in enumerate(q):
        best = sorted((-round(float(unit(x) @ unit(y)), 6), f"c{j:03d}") for j, y in enumerate(v))[:4]
        want = [(c, pytest.approx(-s, abs=2e-6)) for s, c in best if -s >= -best[0][0] * 0.7]
        assert got[f"q{i:02d}"] == want

    class Held:
        value = pa.table({"query_id": [f"q{i}" for i in range(10_000)], "vector": rng.standard_normal((10_000, 16)).tolist()})

    schema = spark.createDataFrame([], "query_id string, chunk_id string, score double").schema
    batch = pa.RecordBatch.from_pydict({"chunk_id": [f"c{i}" for i in range(4_000)], "vector": rng.standard_normal((4_000, 16)).tolist()})
    run = retrieval._nearest(Held, 16, 5, 0.0, schema)
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) == 50_000
    assert tracemalloc.get_traced_memory()[1] < 100_000_000  # the scores of all pairs take 320 MB
    tracemalloc.stop()


def test_ordinary_words_of_all_documents(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(
        F.lit("everybody writes."), F.when(F.col("id") % 340 == 0, " enough").otherwise(""), F.when(F.col("id") % 350 == 0, " seldom").otherwise("")).alias("text"))
    n = {w: docs.where(F.col("text").contains(w)).count() for w in ("enough", "seldom")}
    assert n == {"enough": 27, "seldom": 26}  # 0.003 of all documents, and one less
    assert toxicity.ordinary_words(toxicity.sentences_of(docs)) == {toxicity.plain(w) for w in ("everybody", "writes", "enough")}


def test_indexes_of_several_columns(spark):
    rows = [(f"c{i:03d}", None if i % 3 == 0 else f"title w{i % 5}", "" if i % 7 == 0 else " ".join(f"w{j % 11}" for j in range(i % 9 + 1))) for i in range(200)]
    rows += [(c, "a smaller title", "a smaller text") for c, _, _ in rows[:50]] + [("none", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, title string, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", f"w{i} title smaller w{i + 3}") for i in range(9)], "query_id string, text string")
    both = retrieval.indexes(df, ("title", "text"))
    for column, held in zip(("title", "text"), both, strict=True):
        one = retrieval.index(df.groupBy("chunk_id").agg(F.max(column).alias(column)), column)
        assert (held.n, held.mean) == (one.n, one.mean)
        want, got = (sorted(map(tuple, retrieval.bm25(asked, x, 7).collect())) for x in (one, held))
        assert got == want and len(got) > 20
    empty = retrieval.indexes(df.where("chunk_id = 'none'"), ("title", "text"))
    assert [x.n for x in empty] == [0, 0] and retrieval.bm25(asked, empty[0], 7).count() == 0


def test_shuffle_files_of_stored_tables_are_deleted(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (str(x) for x in disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = shuffles()
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    assert plans.retrieval.runtime.materialize(df, "counts").where("n = 100").count() == 100
    held = [f for f in shuffles() - before if f.endswith(".data")]
    assert len(held) <= 1  # of the count here, which is no stored table


@needs_tables
@pytest.mark.parametrize("name", ["n11_measures", "k20_snippets", "g23_overlap", "k3_fielded", "k16_rrf"])
def test_no_copy_of_the_texts(spark, monkeypatch, name):
    made = defaultdict(int)
    write, indexes = plans.retrieval.runtime.materialize, getattr(retrieval, "indexes", None)
    monkeypatch.setattr(plans.retrieval.runtime, "materialize", lambda df, n, path=None: made.update({n: made[n] + 1}) or write(df, n, path))
    monkeypatch.setattr(retrieval, "indexes", lambda *a: made.update({"indexes": made["indexes"] + 1}) or indexes(*a), raising=False)
    assert plans.QUERIES[name](spark, str(FOLDER)).count() > 0
    assert (made["texts"], made["indexes"]) == (0, 1)


@pytest.mark.parametrize("most", [2, None])
def test_enriched_by_lists_of_targets(spark, monkeypatch, most):
    rng = np.random.default_rng(11)
    edges = {(f"c{i:04d}", f"e{j}", float(w)) for i in range(2_000) for j, w in zip(rng.integers(0, 3, 2), rng.integers(1, 3, 2) / 10, strict=True)} | {("hidden", "e0", 9.0), ("bad", "e0", float("nan"))}
    seeds = {(f"q{i:03d}", f"c{j:04d}", r + 1) for i in range(200) for r, j in enumerate(rng.choice(200, rng.integers(1, 5), replace=False))} | {("alone", "unlinked", 1)}
    made, write = {}, graph.runtime.materialize
    monkeypatch.setattr(graph.runtime, "materialize", lambda df, n, path=None: made.setdefault(n, write(df, n, path)))
    relations = spark.createDataFrame(list(edges), "source_id string, target_id string, weight double")
    active = relations.select(F.col("source_id").alias("chunk_id")).where("chunk_id <> 'hidden'")
    got: dict[str, list] = defaultdict(list)
    hits = graph.enriched(spark.createDataFrame(list(seeds), "query_id string, chunk_id string, rank int"), relations, active, 6, most_seeds=most, decay=0.5, digits=6)
    for r in hits.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.score))
    links = defaultdict(list)
    for s, t, w in edges:
        if np.isfinite(w):
            links[s].append((t, w))
    want = {}
    for q in {q for q, _, _ in seeds}:
        own = {c for x, c, r in seeds if x == q and (most is None or r <= most)}
        vias = [t for c in own for t, _ in links[c]]
        score = {c: round(0.5 * sum(w * vias.count(t) for t, w in ts), 6) for c, ts in links.items() if c not in own | {"hidden"} and {t for t, _ in ts} & set(vias)}
        if best := sorted((-s, c) for c, s in score.items())[:6]:
            want[q] = [(c, pytest.approx(-s, abs=2e-6)) for s, c in best]
    assert len(want) == 200 and got == want
    assert made["showing"].count() < 100 and made["asking"].count() < 200  # lists of targets, not 2,000 sections


def test_equal_queries_lie_together(spark, monkeypatch):
    parts, terms = [], retrieval._terms
    monkeypatch.setattr(retrieval, "_terms", lambda s, asked: parts.append(asked) or terms(s, asked))
    df = spark.createDataFrame([(f"c{i:03d}", " ".join(f"w{j % 50}" for j in range(i, i + 6))) for i in range(300)], "chunk_id string, text string")
    asked = spark.createDataFrame([(f"q{i:04d}", f"w{i % 50} w{(i + 1) % 50}") for i in range(3_000)], "query_id string, text string").repartition(7)
    hits: dict[str, list] = defaultdict(list)
    for r in retrieval.bm25(asked, retrieval.index(df, "text"), 5).orderBy("query_id", "rank").collect():
        hits[r.query_id].append((r.chunk_id, r.score))
    assert len(hits) == 3_000 and all(hits[f"q{i:04d}"] == hits[f"q{i % 50:04d}"] and len(hits[f"q{i:04d}"]) == 5 for i in range(3_000))
    parts = [p for p in parts if p.num_rows < 3_000]  # the first is the whole table
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == 3_000
    assert sum(len({tuple(t) for t in p["terms"].to_pylist()}) for p in parts) < 50 + len(parts)  # a set lies in two parts only where one ends
