from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein import runtime, schemas, tables
from skein.functions import text as T
from skein.operators import chunking, extraction, graph, provenance, retrieval
from skein.session import Engine
from skein.sources import feeds, registry
from skein.streaming import ingest


@pytest.fixture
def store(spark):
    return tables.Store(spark, runtime.new_path(spark, "store"))


def test_engine_end_to_end(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.md").write_text("# Hidden\n\nnothing")
    (tmp_path / "a.md").write_text("---\ntitle: Retrieval notes\ntags: [search, kind:Index]\n---\n\n# Retrieval notes\n\nBM25 and vectors. BM25 again, see [[graph]].\n\n## Fusion\n\nReciprocal ranks are added.")
    (tmp_path / "b.md").write_text("# Garden\n\nTomatoes need water. #garden")
    (tmp_path / "empty.md").write_text("")
    e = Engine(spark, runtime.new_path(spark, "engine"))
    assert {r["change"]: r["count"] for r in e.index([str(tmp_path)]).collect()} == {"new": 2}
    q = spark.createDataFrame([("q1", "tomatoes water"), ("q2", "reciprocal ranks")], "query_id string, text string")
    top = {r.query_id: r.title for r in e.search(q, 3).where("rank = 1").collect()}
    assert top == {"q1": "Garden", "q2": "Retrieval notes"}
    (tmp_path / "b.md").unlink()
    assert {r["change"] for r in e.index([str(tmp_path)]).collect()} == {"unchanged", "deleted"}
    assert {r.title for r in e.search(q, 10).collect()} == {"Retrieval notes"}
    assert e.read(f"filesystem:{tmp_path}/a.md").head().chunks == 2
    assert {r.finding: r.n for r in e.status().collect()}["chunks_without_vector"] == 0
    assert e.graph().where("item = 'edge'").count() >= 1


def test_graph_golden_cases(spark):
    rel = spark.createDataFrame([("sections", "alpha", "Surreal", "MENTIONS", 2.0), ("sections", "alpha", "retrieval", "MENTIONS", 1.0), ("sections", "beta", "Surreal", "MENTIONS", 1.0), ("sections", "gamma", "retrieval", "HAS_TAG", 1.0), ("sections", "stale", "retrieval", "MENTIONS", 9.0)],
                                "source_table string, source_id string, target_id string, rel_type string, weight double")
    q = spark.createDataFrame([("q", "surreal retrieval")], "query_id string, text string")
    names = graph.catalogue(spark.createDataFrame([("Surreal",), ("retrieval",)], "name string"))
    active = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "chunk_id string")
    m = graph.matched_entities(q, names)
    assert [(r.chunk_id, round(r.score, 6)) for r in graph.direct(m, rel, active, 10).orderBy("rank").collect()] == [("alpha", 1.0), ("beta", 0.333333), ("gamma", 0.333333)]
    assert [(r.chunk_id, r.score) for r in graph.direct(m, rel, active, 1).collect()] == [("alpha", 1.0)]


def test_floor_keeps_equal(spark):
    hits = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.59), ("q", "c", 0.60)], "query_id string, chunk_id string, score double")
    assert {r.chunk_id for r in retrieval.floored(hits, 0.6).collect()} == {"a", "c"}


def test_snippets(spark):
    long = "Short opener. This target sentence is deliberately longer than the requested window. Short closer."
    df = spark.createDataFrame([(long, "target", 40), ("Short complete chunk.", "chunk", 80), (None, "x", 80)], "t string, q string, n int")
    got = [r.s for r in df.select(retrieval.snippet("t", "q", "n").alias("s")).collect()]
    assert got == ["...This target sentence is deliberately longer than the requested window....", "Short complete chunk.", None]


def test_acronyms(spark):
    c = spark.createDataFrame([("1", "Security Information and Event Management (SIEM) is a platform. Random Words Here (ABC).")], "chunk_id string, text string")
    assert [(r.acronym, r.expansions) for r in extraction.acronym_dictionary(c).collect()] == [("SIEM", ["Security Information and Event Management"])]


def test_expansion(spark):
    q = spark.createDataFrame([("q", "what is SIEN now"), ("r", "plain words")], "query_id string, text string")
    a = spark.createDataFrame([("SIEM", ["Security Events"])], "acronym string, expansions array<string>")
    got = {r.query_id: r.text for r in retrieval.expanded(q, a).collect()}
    assert got == {"q": "what is SIEN Security Events now Security Events", "r": "plain words"}


def test_scalars(spark):
    df = spark.createDataFrame([("60s", "text=0.7,meta=0.3", "2024-01-02T03:04:05Z", "1704164645")], "d string, w string, iso string, epoch string")
    r = df.select(T.duration_seconds("d").alias("d"), T.duration_seconds(F.lit("0s")).alias("zero"), T.weights("w").alias("w"), T.weights(F.lit("text=1,meta=1")).alias("bad"), T.moment("iso").alias("a"), T.moment("epoch").alias("b"),
                  T.moment(F.lit("Tue, 2 Jan 2024 03:04:05 +0000")).alias("c"), T.moment(F.lit("soon")).alias("e"), T.base64url_text(F.lit("0L_QsA")).alias("t"), T.base64url_text(F.lit("?")).alias("u"),
                  T.elapsed_text(F.lit(3723000)).alias("x"), T.duration_text(F.lit(185)).alias("y"), T.model_suffix(F.lit("org/Some-Model.v2")).alias("m")).head()
    assert (r.d, r.zero, r.w, r.bad, r.e) == (60, None, {"text": 0.7, "meta": 0.3}, None, None)
    assert r.a == r.b == r.c == datetime(2024, 1, 2, 3, 4, 5)
    assert (r.t, r.u, r.x, r.y, r.m) == ("па", "", "1h02m03s", "3m05s", "some_model_v2")


def test_splitting_invariants(spark):
    text = " ".join(f"Sentence number {i} has some words." for i in range(200))
    pieces = chunking.packed(text, 50, 10)
    assert all(len(p.encode()) // 4 <= 60 for p in pieces)
    assert all(any(s in p for p in pieces) for s in text.split(". ")[:-1])
    assert all(b.split(". ")[0] in a for a, b in zip(pieces, pieces[1:], strict=False))


def test_visibility(spark):
    prov = spark.createDataFrame([("a", "r1"), ("b", "r2")], "chunk_id string, ref string")
    bind = spark.createDataFrame([("r1", True), ("r2", False)], "ref string, active boolean")
    hits = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert [r.chunk_id for r in provenance.visible(hits, prov, bind).collect()] == ["a"]
    with pytest.raises(Exception, match="no provenance"):
        provenance.visible(spark.createDataFrame([("z",)], "chunk_id string"), prov, bind).collect()


def test_store(spark, store):
    doc = lambda ref, title: spark.createDataFrame([(ref, "n", ref, title, 1)], "ref string, namespace string, document_ref string, title string, extra int")
    store.append_new("documents", doc("a", "1"))
    store.append_new("documents", doc("a", "2"))
    assert [r.title for r in store.read("documents").collect()] == ["1"]
    store.merge("documents", doc("a", "3").unionByName(doc("b", "4")))
    store.remove("documents", doc("b", "").select("ref"))
    assert [(r.ref, r.title) for r in store.read("documents").collect()] == [("a", "3")]
    with pytest.raises(Exception, match="lacks"):
        store.merge("documents", doc(None, "x"))
    other = tables.Store(spark, runtime.new_path(spark, "copy"))
    assert all(r["equal"] for r in store.copy_to(other).collect())
    store.submit_feedback("f", "broken", "extreme")
    assert store.open_feedback().head().severity is None
    store.set_feedback("f", "resolved")
    assert store.open_feedback().count() == 0
    assert schemas.differences(store.read("documents").schema, "documents") == []
    store.drop("documents")
    assert store.count("documents") == 0


def test_delta_resumes(spark, store):
    rows = {"documents": spark.createDataFrame([("a", "n", "a")], "ref string, namespace string, document_ref string"), "stats": None}
    rows.pop("stats")
    dead = {"documents": spark.createDataFrame([("z",)], "ref string")}
    assert ingest.apply_delta(store, "s", 1, rows, dead) == ["tombstones:documents", "documents"]
    assert ingest.apply_delta(store, "s", 1, rows, dead) == []
    assert ingest.apply_delta(store, "s", 2, rows, {}) == ["documents"]


def test_streaming_ingest(spark, store, tmp_path):
    feeds.register(spark)
    feed = tmp_path / "changes.jsonl"
    change = lambda c, m, text, **x: json.dumps({"cursor": c, "dialog_id": 1, "message_id": m, "sender": "s", "text": text, **x})
    feed.write_text("\n".join([change(1, 1, "first message here"), "", change(2, 2, "ok"), change(3, 3, "third message")]))
    run = lambda: ingest.start_ingest(spark, store, {"path": str(feed), "limit": "2"}, str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    assert store.count("source_units") == 3
    assert sorted(r.text.split("\n")[-1] for r in store.read("chunks").collect()) == ["first message here", "third message"]
    with feed.open("a") as f:
        f.write("\n" + change(4, 1, "first message edited", edit_date="2024"))
    run()
    assert sorted(r.text.split("\n")[-1] for r in store.read("chunks").collect()) == ["first message edited", "third message"]
    assert store.read("checkpoints").head().checkpoint_cursor == "offset:4"
    assert spark.read.format("telegram_changes").option("path", str(feed)).load().count() == 4


def test_debounce_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 3, 4, 6)], "k string, at timestamp").coalesce(1).write.parquet(str(src))
    q = ingest.debounced_stream(spark.readStream.schema("k string, at timestamp").parquet(str(src)), "k", "at").writeStream.format("memory").queryName("deb").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.at.second for r in spark.table("deb").orderBy("at").collect()] == [0, 3, 6]


def test_federated():
    import time

    hits, status = retrieval.fan_out({"good": lambda: [{"ref": "a"}], "bad": lambda: 1 / 0, "slow": lambda: time.sleep(2) or []}, seconds=0.3)
    assert [h["ref"] for h in hits] == ["a"]
    assert {s["source"]: s["status"] for s in status} == {"good": "ok", "bad": "error", "slow": "skipped"}


def test_registry_and_lock(tmp_path, monkeypatch):
    r = registry.default_registry()
    assert r.get("telegram").normalized == ("change_feed", "read_unit", "federated_search")
    with pytest.raises(KeyError):
        r.get("nope")
    monkeypatch.setenv("SKEIN_CHUNK_TOKENS", "100")
    assert registry.Settings.load().chunk_tokens == 100
    with ingest.single_writer(str(tmp_path / "l")), pytest.raises(RuntimeError), ingest.single_writer(str(tmp_path / "l")):
        pass


def test_mail_body(spark):
    import base64

    enc = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    plain = json.dumps({"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": enc("<b>x</b>")}}, {"mimeType": "text/plain", "body": {"data": enc("plain ü")}}]})
    html = json.dumps({"mimeType": "text/html", "body": {"data": enc("<style>p{}</style><p>a &amp; b</p>")}})
    df = spark.createDataFrame([(plain,), (html,), ("no json",), (None,)], "p string")
    assert [r.t for r in df.select(chunking.mail_body("p", F.lit(1 << 20)).alias("t")).collect()] == ["plain ü", "a & b", "", ""]


def test_key_terms_and_combined_extraction(spark):
    rows = [(str(i), f"alpha{i % 2} shared words about pumps. The SIEM and the SIEM.", ["Cooling Pumps"] if i < 3 else []) for i in range(6)]
    chunks = spark.createDataFrame([(c, c, 0, *x) for c, *x in rows], "chunk_id string, document_ref string, chunk_index int, text string, heading_hierarchy array<string>")
    entities, relations = extraction.key_terms(chunks, share=1.0)
    got = {r.name: (r.type, r.chunk_ids) for r in entities.collect()}
    assert got["SIEM"] == ("acronym", [str(i) for i in range(6)]) and got["Cooling"] == ("heading", ["0", "1", "2"]) and got["alpha0"][0] == "term"
    kinds = {(r.source_id, r.target_id, r.rel_type) for r in relations.collect()}
    assert ("0", "SIEM", "MENTIONS") in kinds and ("Cooling", "SIEM", "CO_OCCURS") in kinds
    assert extraction.key_terms(chunks, share=0.01)[0].count() == 1
    both, _ = extraction.extracted(chunks, lambda texts: [[("SIEM", "TOOL"), ("Pump", "THING")] for _ in texts])
    assert {r.name for r in both.where("type = 'thing'").collect()} == {"Pump"}
    assert extraction.key_terms(chunks.where("false"))[0].count() == 0


def test_near_acronyms_by_deletions(spark):
    words = ["SIEM", "SIEN", "SEM", "SIEMS", "AB", "BA", "SMIE", "X"]
    q = spark.createDataFrame([(w, w) for w in words], "query_id string, text string")
    a = spark.createDataFrame([(w, [w.lower()]) for w in ("SIEM", "AB")], "acronym string, expansions array<string>")
    got = {r.query_id: r.expansions for r in retrieval.expanded(q, a).collect()}
    assert got == {"SIEM": ["siem"], "SIEN": ["siem"], "SEM": ["siem"], "SIEMS": ["siem"], "AB": ["ab"], "BA": [], "SMIE": [], "X": []}


def test_keyword_scores_against_brute_force(spark):
    import math
    import random
    from collections import Counter

    r = random.Random(7)
    texts = {f"c{i:03d}": [r.choice("abcdefgh") for _ in range(r.randrange(0, 30))] for i in range(150)}
    index = retrieval.index(spark.createDataFrame([(c, " ".join(w)) for c, w in texts.items()], "chunk_id string, text string"), "text")
    asked = {"q1": "a b b", "q2": "h", "q3": "zz", "q4": ""}
    held = {c: w for c, w in texts.items() if w}
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(t for w in held.values() for t in set(w))
    score = lambda w, t: math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    for every in (False, True):
        got = {(x.query_id, x["rank"]): (x.chunk_id, x.score) for x in retrieval.bm25(spark.createDataFrame(list(asked.items()), "query_id string, text string"), index, 5, every, block=3).collect()}
        want = {}
        for q, t in asked.items():
            terms = set(t.split())
            rows = [(-round(sum(score(w, x) for x in terms if x in w), 6), c) for c, w in held.items() if terms & set(w) and (not every or terms <= set(w))]
            want |= {(q, i): (c, -s) for i, (s, c) in enumerate(sorted(rows)[:5], 1)}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
