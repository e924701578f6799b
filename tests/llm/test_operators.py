"""The operators for training text: brute force, round trips, held-out accuracy, and dirty inputs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import conversations, language, leaks, mixing, neighbours, plans, prose, splitting, textnorm, toxicity
from tests.conftest import DATA

FOLDER = DATA / "sf0.001"


# splitting


@pytest.mark.parametrize("seed", range(30))
def test_split_round_trip(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcё日") for _ in range(r.choice([1, 3, 8, 400 if r.random() < 0.05 else 5]))) for _ in range(r.randrange(1, 400))]
    text = "".join(w + r.choice([" ", " ", " ", ". ", "\n", "\n\n", ", "]) for w in words)
    size = r.choice([5, 30, 100])
    overlap = r.choice([0, 2, size // 4])
    cuts = splitting.split_text(text, size, overlap)
    assert all(len(text[b:e].encode()) // 4 <= size for b, e, _ in cuts)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b2 <= e1 < e2 for (_, e1, _), (b2, e2, _) in zip(cuts, cuts[1:], strict=False))
    rebuilt, at = "", 0
    for b, e, _ in cuts:
        rebuilt, at = rebuilt + text[max(b, at) : e], e
    assert rebuilt == text
    hard = any(len(w.encode()) // 4 > size for w in text.split())
    assert any(k == 0 for *_, k in cuts[:-1]) == (hard and len(text.encode()) // 4 > size)


def test_split_dirty(spark):
    long = "word " * 200_000
    rows = [("a", "x_10_2", "one two " * 20), ("a", "x_10_2", "one two " * 20), ("b", "x_10_2", None), ("c", "odd", "w " * 100), (None, "x_10_2", "w " * 100), ("d", "x_10_2", ""), ("e", "x_512_50", long), ("f", "x_10_20", "x" * 100)]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_strategy string, text string").withColumn("size", F.lit(1)).withColumn("boundary", F.lit("clash"))
    pieces = splitting.split_oversized(df)
    assert {(r.chunk_id, r.cut) for r in splitting.cut_kinds(pieces).collect()} == {("a", "natural"), (None, "natural"), ("e", "natural"), ("f", "inside_run")}
    assert pieces.where("chunk_id = 'e' AND octet_length(text) div 4 > 512").count() == 0
    assert splitting.split_oversized(df.where("false")).count() == 0


# leaks


def brute_aligned(item, passage):
    """Any span of at least 24 words, of whatever length, with at most a tenth of them edited."""
    for i in range(len(item) - 23):
        cost = [0] * (len(passage) + 1)
        for n, w in enumerate(item[i:], 1):
            new = [cost[0] + 1]
            for j, p in enumerate(passage, 1):
                new.append(min(cost[j - 1] + (p != w), cost[j] + 1, new[j - 1] + 1))
            cost = new
            if n >= 24 and min(cost) <= n // 10:
                return True
    return False


@pytest.mark.parametrize(("length", "edits"), [(24, (5, 14)), (30, (9, 16, 23)), (40, (8, 15, 23, 31)), (57, (9, 16, 23, 31, 39))])
def test_leak_with_spread_edits(spark, length, edits):
    words = [f"w{i}" for i in range(length)]
    changed = ["new" if i in edits else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "before it " + " ".join(changed) + " after it"), (2, " ".join(["new", *changed[1:]] if length == 24 else changed[:23]))], "doc_id long, text string")
    assert {tuple(r) for r in leaks.leaked(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()} == {(1, 7)}


@pytest.mark.parametrize("seed", range(4))
def test_leaks_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [r.choice(vocabulary) for _ in range(r.randrange(24, 60))]) for i in range(30)]
    docs = []
    for d in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 60))]
        _, w = r.choice(items)
        s = r.randrange(0, len(w) - 23)
        span = list(w[s : s + r.choice([20, 24, 24, 30])])
        for _ in range(r.randrange(0, 4)):
            k = r.randrange(len(span))
            span[k : k + 1] = r.choice([[], ["other"], [span[k], "added"]])
        docs.append((d, words + span + [r.choice(vocabulary) for _ in range(10)]))
    got = {(x.doc_id, x.item_id) for x in leaks.leaked(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    assert got == {(d, i) for d, dw in docs for i, iw in items if brute_aligned(iw, dw)}


def test_leaks_dirty(spark):
    item = " ".join(f"item{i}" for i in range(30))
    marked = "<p>" + " ".join(f"**Item{i}**,\n" for i in range(26)) + "</p>"
    docs = spark.createDataFrame([(1, marked), (1, marked), (2, None), (3, ""), (4, "item1 " * 50_000), (None, item), (5, "x " * 100_000 + item)], "doc_id long, text string").withColumn("item_id", F.lit(9))
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "too short"), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {tuple(r) for r in leaks.leaked(docs, items).collect()} == {(1, 7), (5, 7)}
    assert leaks.leaked(docs, items.where("false")).count() == 0
    assert leaks.leaked(docs.where("false"), items).count() == 0


def test_wand_is_exact():
    r = random.Random(5)
    index = leaks.Index([(i, " ".join(f"w{r.randrange(12)}" for _ in range(60))) for i in range(80)], block=4)
    for _ in range(20):
        terms = sorted(r.sample(range(len(index.terms)), 40))
        want = {}
        for t in terms:
            for d, x in zip(*index.postings[t][:2], strict=True):
                want[d] = want.get(d, 0) + x
        for threshold in (0.5, 3.0, 6.0):
            assert {d for d, _ in index.wand(terms, threshold)} == {d for d, s in want.items() if s >= threshold}


# neighbours


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 64))
    v = np.concatenate([centres + 0.25 * rng.standard_normal((300, 64)) for _ in range(8)])
    rows = [(f"c{i:05d}", "s_1_0", "lumen", [float(y) for y in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_strategy string, embedding_model string, vector array<float>").withColumn("component", F.lit("fused"))
    nodes = neighbours.nodes_of(neighbours.usable(df), copies=11)
    links = neighbours.graph(nodes)
    got = {}
    for x in neighbours.similar(nodes, links, k=10).collect():
        got.setdefault(x.chunk_id, set()).add(x.neighbour)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :10]
    recall = np.mean([len(got[f"c{i:05d}"] & {f"c{j:05d}" for j in true[i]}) / 10 for i in range(len(v))])
    assert recall >= 0.9
    queries = nodes.where("id % 50 = 0").select(F.col("members")[0].alias("query_id"), "g", "vector")
    top = neighbours.search(queries, nodes, links, k=5).join(nodes.select("id", F.col("members")[0].alias("name")), "id").groupBy("query_id").agg(F.collect_set("name").alias("names")).collect()
    assert np.mean([len(set(r.names) & ({r.query_id} | {f"c{j:05d}" for j in true[int(r.query_id[1:])][:4]})) / 5 for r in top]) >= 0.9


def test_neighbours_dirty(spark):
    v = [1.0, 0.0, 0.0, 1.0]
    rows = [("a", v), ("b", [2.0, 0.0, 0.0, 2.0]), ("c", [float("nan")] * 4), ("d", None), ("e", []), ("f", [0.0] * 4), ("g", [1.0, 2.0]), ("a", v), ("h", [0.0, 1.0, 0.0, 0.0]), (None, v), ("i", v)]
    df = spark.createDataFrame([("fused", "s", "m", *r) for r in rows], "component string, chunk_strategy string, embedding_model string, chunk_id string, vector array<float>").withColumn("g", F.lit("x")).withColumn("part", F.lit(1))
    nodes = neighbours.nodes_of(neighbours.usable(df), copies=11)
    pairs = {(r.chunk_id_a, r.chunk_id_b) for r in neighbours.mutual(neighbours.similar(nodes, neighbours.graph(nodes), 10, 0.9)).collect()}
    assert pairs == {("a", "b"), ("a", "i"), ("b", "i")}
    empty = neighbours.nodes_of(neighbours.usable(df.where("false")), copies=11)
    assert neighbours.mutual(neighbours.similar(empty, neighbours.graph(empty), 10, 0.9)).count() == 0


# language


@pytest.fixture(scope="module")
def identifier(spark):
    t = lambda n: spark.read.parquet(str(DATA / "sf0.01" / f"{n}.parquet"))
    rows = language.training_rows(t("documents"), t("surreal_golden_queries"), 12_000)
    return language.train([r for i, r in enumerate(rows) if i % 4]), [r for i, r in enumerate(rows) if not i % 4]


def test_language_held_out(identifier):
    model, held = identifier
    right = total = 0
    for text, label in held:
        f = model.languages_of([prose.sentences(text)], 4, 6)[0]
        if f:
            total += 1
            right += model.languages[max(f, key=lambda j: f[j][0])] == label
    assert total > 100 and right / total > 0.85  # about a tenth of the labels is wrong


@pytest.mark.parametrize(("text", "want"), [
    ("After the second sync, nobody opened the draft outline.", {"en"}), ("Posle vtoroy sinkhronizatsii, nikto ne otkryl chernovoy plan.", {"ru"}), ("Aussitot apres le dejeuner, elle a raccourci le releve illisible.", {"fr"}),
    ("ПЕРЕД САМОЙ ВСТРЕЧЕЙ, МЫ ПЕРЕСОБРАЛИ СТАРЫЙ СЛОВАРЬ.", {"ru"}), ("# Der kurze Plan\n\n| a | b |\n\n```\nfor row in rows:\n```", set()), ("Zirkon-DB Kelpie 2.1", set()),
    ("The local heading replaces the archived table. Перед самой встречей, мы пересобрали старый словарь.", {"en", "ru"}),
])
def test_language_cases(identifier, text, want):
    model, _ = identifier
    assert {model.languages[j] for j in model.languages_of([prose.sentences(text)], 4, 6)[0]} == want


def test_language_segments(identifier):
    model, _ = identifier
    texts = [prose.sentences(t) for t in ("The local heading replaces the archived table. The plan follows the quiet draft. Перед самой встречей, мы пересобрали старый словарь.", "# Title", "")]
    mixed, title, empty = model.segments_of(texts, 4, 6)
    assert [(lang, words) for lang, words, *_ in mixed] == [("en", 13), ("ru", 7)]
    assert mixed[0][3].startswith("The local") and mixed[1][3].endswith("словарь.") and all(0.9 < c <= 1 for _, _, c, _ in mixed)
    assert title == empty == [("und", 0, 0.0, "")]


def test_confidence_is_calibrated(identifier):
    """Of held-out beginnings of sentences those given a confidence near c are right about as often."""
    model, held = identifier
    given, right = [], []
    for text, label in held:
        for s in prose.sentences(text)[:3]:
            words = language._tokens(s)[:3]
            if len(words) == 3:
                model.learn(set(words))
                total = model.scores[[model.known[w] for w in words]].sum(axis=0)
                order = np.argsort(total)
                given.append(float(model.confidence(np.array(total[order[-1]] - total[order[-2]]))))
                right.append(model.languages[order[-1]] == label)
    given, right = np.array(given), np.array(right)
    assert len(given) > 200 and abs(given.mean() - right.mean()) < 0.15  # about a tenth of the labels is wrong


def test_language_dirty(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "The quiet index was copied from the local plan. " * 20_000, "de"), (4, "The quiet index was copied from the local plan.", "en-US"), (4, "The quiet index was copied from the local plan.", "en-US"), (None, "x", "en")], "doc_id long, text string, lang string").withColumn("rec_id", F.lit("clash"))
    chunks = spark.createDataFrame([], "chunk_id string, text string, lang string")
    queries = spark.createDataFrame([("q", None, None)], "id string, query string, languages array<string>")
    got = {tuple(r) for r in language.unlabelled(language.languages(docs, chunks, queries)).collect()}
    assert got <= {("documents", "3", "de"), ("documents", "3", "en"), ("documents", "4", "de")}
    assert language.languages(docs.where("false"), chunks, queries).count() == 0


def test_label_names(spark):
    labels = ["en", "EN", " eng", "en-US", "en_GB", "rus", "und", "", None, "english", "xx"]
    got = [r.l for r in spark.createDataFrame([(x,) for x in labels], "x string").select(language.named(F.col("x")).alias("l")).collect()]
    assert got == ["en", "en", "en", "en", "en", "ru", None, None, None, None, None]


# conversations

MESSAGES = "dialog_id long, message_id long, sender string, sent_at timestamp, text string, reply_to_msg_id long, topic_id long, edit_date timestamp, is_deleted boolean, received_at timestamp, path string, place int"
T0 = datetime(2024, 1, 1)


def message(d, m, who="u", text="hello there", reply=None, edit=None, deleted=False, at=0):
    return (d, m, who, T0, text, reply, None, edit, deleted, T0 + timedelta(seconds=at), "clash", 1)


def faults(spark, rows):
    senders = spark.createDataFrame([("u", "user"), ("@Bot ", "assistant"), (None, "user")], "sender string, role string")
    ordered, found = conversations.rebuilt(spark.createDataFrame(rows, MESSAGES), senders)
    return {tuple(r) for r in found.collect()}, ordered, found


def test_conversation_faults(spark):
    rows = [message(1, 1), message(1, 2, "@U "), message(1, 3, "bot"),  # sound
            message(2, 1, "bot"), message(2, 2),  # the answer is before the question
            message(3, 1, text=" ​"), message(3, 2, deleted=True),  # nothing visible
            message(4, 1), message(4, 2, "bot", reply=9), message(5, 1, "stranger"), message(5, 2, "bot"), message(6, None), message(7, 1), message(7, 2, None),
            message(8, 1), message(8, 2, "bot"), message(8, 2, "bot", text="", edit=T0), message(None, 1), message(9, 1, text=None)]
    got, ordered, found = faults(spark, rows)
    assert got == {(2, "no_reply"), (3, "empty"), (4, "broken"), (5, "broken"), (5, "no_reply"), (6, "broken"), (6, "empty"), (7, "broken"), (7, "no_reply"), (8, "no_reply"), (9, "empty")}
    assert [(r.dialog_id, r.message_id, r.role, r.turn) for r in conversations.sound(ordered, found).orderBy("message_id").collect()] == [(1, 1, "user", 1), (1, 2, "user", 2), (1, 3, "assistant", 3)]


def test_long_dialog_is_numbered_through(spark):
    rows = [message(1, 3 * i, "u" if i % 2 == 0 else "Bot", at=i) for i in range(5000)]
    got, ordered, found = faults(spark, rows * 2)
    assert got == set()
    assert [(r.message_id, r.turn) for r in conversations.sound(ordered, found).orderBy("turn").collect()] == [(3 * i, i + 1) for i in range(5000)]


def fragments(spark, parts):
    """parts: {frag: messages}; messages stand for their hashes."""
    return spark.createDataFrame([(1, f, i, m * 7919) for f, ms in parts.items() for i, m in enumerate(ms)], "dialog_id long, frag long, pos int, hash long")


def test_fragments_assemble(spark):
    cut = {5: range(0, 10), 2: range(6, 20), 9: range(17, 30), 4: range(26, 41)}
    parts = fragments(spark, cut | {7: range(6, 20), 8: range(17, 25)})  # a repeated one, and one that another begins with
    paths = conversations.assembled(parts)
    got = {r.frag: (r.path, r.place, r.shared) for r in paths.collect()}
    assert got == {5: (5, 0, 0), 2: (5, 1, 4), 9: (5, 2, 3), 4: (5, 3, 4), 7: (5, -1, 0), 8: (5, -1, 0)}
    assert conversations.gaps(paths).count() == 0
    rows = conversations.merged(parts, paths).orderBy("place", "pos").collect()
    assert [r.hash for r in rows] == [m * 7919 for m in range(41)]


def test_gap_is_broken(spark):
    paths = conversations.assembled(fragments(spark, {1: range(0, 10), 2: range(7, 20), 3: range(25, 30)}))
    assert {r.frag: r.path for r in paths.collect()} == {1: 1, 2: 1, 3: 3}
    assert [tuple(r) for r in conversations.gaps(paths).collect()] == [(1, "broken")]


def test_order_of_messages_matters_and_forks_end_a_path(spark):
    swapped = conversations.assembled(fragments(spark, {1: [0, 1, 2, 3, 4], 2: [3, 2, 4, 5, 6]}))
    assert {r.path for r in swapped.collect()} == {1, 2}
    fork = conversations.assembled(fragments(spark, {1: [0, 1, 2, 3, 4], 2: [2, 3, 4, 5, 6], 3: [2, 3, 4, 8, 9]}))
    assert {r.frag: r.path for r in fork.collect()} == {1: 1, 2: 2, 3: 3}
    assert conversations.assembled(fragments(spark, {1: [0]}).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_fragments_round_trip(spark, seed):
    r = random.Random(seed)
    cuts, at = [], 0
    while at < 3000:
        end = at + r.randrange(20, 200)
        cuts.append(range(at, end))
        at = end - r.randrange(3, 15)
    order = list(range(len(cuts)))
    r.shuffle(order)
    parts = fragments(spark, {f: cuts[i] for i, f in enumerate(order)})
    paths = conversations.assembled(parts)
    assert conversations.gaps(paths).count() == 0
    assert [x.hash for x in conversations.merged(parts, paths).orderBy("place", "pos").collect()] == [m * 7919 for m in range(cuts[-1].stop)]


def test_no_messages(spark):
    assert faults(spark, [])[0] == set()


# mixture


def mixture(spark, docs, targets, **options):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash")).withColumn("block", F.lit(1))
    return mixing.Mixture(d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), block=64, **options)


def test_mixture_shares(spark):
    r = random.Random(1)
    docs = [(i, r.choice(["a", "A ", "b_x", "B-X", "c"]), "word " * r.randrange(0, 60)) for i in range(3000)] + [(5000, None, "x"), (5001, "a", None)]
    targets = [("a", 0.5, 1), ("b-x", 0.3, 2), ("c", 0.2, 3), ("none", None, 1), ("nan", float("nan"), 1)]
    m = mixture(spark, docs, targets)
    report = {x.source: x for x in m.report().collect()}
    assert set(report) == {"a", "b-x", "c", "none", "nan"} and report["none"].target_share is None and report["nan"].reached_share == 0
    shared = [report[s] for s in ("a", "b-x", "c")]
    assert all(abs(x.reached_share - x.target_share) < 0.01 for x in shared)
    assert all(x.most_uses <= {"a": 1, "b-x": 2, "c": 3}[x.source] for x in shared)
    uses = {x.doc_id: x.uses for x in m.uses().collect()}
    streamed = {x["doc_id"]: x["count"] for x in m.stream().where("begin_token = 0").groupBy("doc_id").count().collect()}
    assert {k: v for k, v in uses.items() if v} == streamed
    first = {x.source: x["count"] for x in m.schedule().where("slot < 100").groupBy("source").count().collect()}
    assert abs(first["a"] - 50) <= 2 and abs(first["b-x"] - 30) <= 2


def test_mixture_fills_every_slot(spark):
    r = random.Random(4)
    m = mixture(spark, [(i, "ab"[i % 2], "word " * r.choice([1, 5, 60, 700])) for i in range(200)], [("a", 0.6, 2), ("b", 0.4, 2)])
    rows = m.stream().orderBy("slot", "place").collect()
    sizes: dict = {}
    for x in rows:
        assert x.place == len(sizes.setdefault(x.slot, []))
        sizes[x.slot].append(x.end_token - x.begin_token)
    assert sorted(sizes) == list(range(m.slots))
    assert sum(sum(v) != 64 for v in sizes.values()) <= 4  # the last block of a source may be smaller
    share = sum(x.end_token - x.begin_token for x in rows if x.source == "a") / sum(map(sum, sizes.values()))
    assert abs(share - 0.6) < 0.01


def test_mixture_small_source_is_capped(spark):
    docs = [(i, "big" if i else "small", "word " * 50) for i in range(200)]
    m = mixture(spark, docs, [("big", 0.5, 1), ("small", 0.5, 2)], total=5000)
    assert {x.doc_id: x.uses for x in m.uses().collect()}[0] <= 2
    empty = mixture(spark, [], [("big", 1.0, 1)])
    assert empty.uses().count() == 0 and empty.stream().count() == 0 and empty.report().head().used_tokens == 0
    assert mixture(spark, docs, []).report().count() == 0


def test_running_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice("xy"), i, r.randrange(9)) for i in range(500)]
    got = {x.i: x.before for x in mixing.running(spark.createDataFrame(rows, "k string, i long, n long"), "k", ["i"], F.col("n"), F.expr("i div 37")).collect()}
    assert got == {i: sum(n for k2, j, n in rows if k2 == k and j < i) for k, i, _ in rows}


# toxicity


def test_disguise():
    words = lambda t: [toxicity.plain(w) for s in toxicity.sentences(t) for w in toxicity.tokens(s)]
    assert words("You $p1n3l3$$ w0rm") == ["you", "spineles", "worm"]
    assert words("what a dіsеаsе") == ["what", "a", "disease"]
    assert words("su​bhumaaaan f.o.o.l") == ["subhuman", "fol"]
    assert words("d r e c k i g e   T i e r e hier") == ["dreckige", "tiere", "hier"]


def test_learned_from_document_labels(spark):
    r = random.Random(4)
    calm = ["The index was copied to the shelf", "She sorted the old notes", "The plan follows the draft", "A quiet day for the archive"]
    bad = ["You are a moron and nobody needs you", "Those strangers are vermin, drive them out", "She was naked and moaning in bed", "You moron, stop it", "Drive those strangers out, vermin", "They are naked and moaning"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        body = [r.choice(calm) for _ in range(6)] + [r.choice(bad)] * toxic
        r.shuffle(body)
        docs.append((i, "s" if i % 2 else "S ", ". ".join(body) + "."))
        labels.append((i, int(toxic) if r.random() > 0.03 else int(not toxic)))
    docs += [(900, None, None), (901, "s", ""), (902, "s", "The index was copied to the shelf. " * 20_000), (None, "s", bad[0])]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("sentence", F.lit(1)).withColumn("abusive", F.lit("clash"))
    lab = spark.createDataFrame([*labels, *labels[:10], (None, 1), (3, None)], "doc_id long, toxic int")
    scores = toxicity.scored(d, lab)
    got = {x.doc_id: x for x in scores.collect() if x.doc_id is not None}
    hit = {k for k, x in got.items() if max(x.abusive, x.hateful, x.sexual) >= toxicity.LEAST}
    want = {i for i in range(0, 400, 8)}
    assert len(hit & want) >= 0.9 * len(want) and len(hit - want) <= 3
    rates = {x.source: x for x in toxicity.rates(scores).collect()}
    assert set(rates) == {"s", "unknown"} and rates["unknown"].abusive_rate == 0
    assert toxicity.offences(scores).count() >= len(hit)
    assert toxicity.scored(d.where("false"), lab.where("false")).count() == 0
    assert toxicity.offences(toxicity.scored(d, lab.where("false"))).columns == ["doc_id", "category"]


# queries


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    import duckdb

    from tests.test_queries import rows

    got = plans.QUERIES[name](spark, str(FOLDER)).toPandas()
    assert not name.endswith("_found") or len(got.drop_duplicates()) == len(got)
    if name in plans.ORACLES:
        con = duckdb.connect()
        for p in FOLDER.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert rows(got) == rows(con.execute(plans.ORACLES[name]).df())


def test_words():
    assert textnorm.words("<b>Ho</b>use-\nhold &amp; **Straße** _x_ ﬁne") == ["household", "straße", "x", "fine"]
    assert textnorm.words(None) == []
