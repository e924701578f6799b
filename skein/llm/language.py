"""Languages of texts and of their stretches, with a confidence, by interpolated Kneser-Ney character models.

Each language has one model: character n-grams inside words, with counts in sorted arrays of 64-bit hashes. A sentence
takes the language of the lowest cross-entropy per character and is rejected (no language) above the limit calibrated on held-out
sentences. Where the words of one sentence disagree, a Viterbi path over its words with a price for each change finds the
stretches. The confidence of a stretch is how often held-out stretches of that margin over the next language were right (a logistic fit). The models are trained on a bounded sample of labelled rows (parameter `sample`); wrong labels and mixed texts
in it are mended by relabelling its sentences before the counts are taken. Words are spelled in further ways
(without diacritics, transliterated) for training, so that such texts are known too.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import prose, textnorm

LANGUAGES = ("en", "ru", "de", "fr", "es", "pt", "uk")
#: Three-letter codes of the languages.
THREE = {"eng": "en", "rus": "ru", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ukr": "uk"}
#: Romanisation of Russian and Ukrainian letters.
ROMAN_RU = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "), strict=True))
ROMAN_UK = ROMAN_RU | {"г": "h", "ґ": "g", "и": "y", "і": "i", "ї": "yi", "є": "ye", "й": "y"}
_WORD = re.compile(r"[^\W\d_]+")
ORDER = 5
SLACK = 1.0  # nats a character a text may lie under the held-out limit, for words that were never seen
CHANGE = 14.0  # nats a change of language costs inside a sentence


def named(label: Column) -> Column:
    """The language a declared label names, however it is spelled; null for none."""
    code = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})(?:$|[-_\s])", 1))
    mapped = F.coalesce(*[F.when(code == k, v) for k, v in THREE.items()], code)
    return F.when(mapped.isin(*LANGUAGES), mapped)


def _tokens(sentence: str) -> list[str]:
    """Lower-case words; none of what has white space between fewer than half of them (encoded data), which is no language."""
    words = _WORD.findall(sentence.lower())
    return [] if len(words) > 5 and 2 * sentence.count(" ") < len(words) else words


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ß", "ss").replace("ł", "l")


def spellings(word: str, language: str) -> set[str]:
    """Other ways to write a word of a language."""
    if language in ("ru", "uk"):
        table = ROMAN_RU if language == "ru" else ROMAN_UK
        roman = "".join(table.get(c, c) for c in word)
        return {roman, roman.replace("yo", "e"), roman.replace("yy", "y"), roman.replace("kh", "h").replace("ts", "c"), word.replace("ё", "е")} - {word}
    out = {_plain(word)}
    if language == "de":
        out.add(word.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"))
    return out - {word}


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _windows(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of every predicted character: its word; for each order the hash of the n-gram and of its context; how many orders it has."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts
    keep = np.flatnonzero(place > 0)
    context = np.full(len(keep), 0xABCDEF, dtype=np.uint64)
    grams, contexts = [], []
    for k in range(ORDER):
        salt = np.uint64(k + 1)
        contexts.append(_mixed(context * _MULT + salt))
        grams.append(_mixed(_mixed(context * _MULT + salt) * _MULT + codes[keep] + np.uint64(7)))
        source = np.maximum(keep - k - 1, 0)
        context = _mixed(context * _MULT + codes[source] + np.uint64(1))
    return owner[keep], grams, contexts, np.minimum(place[keep] + 1, ORDER)


class Model:
    """Interpolated Kneser-Ney over the characters of words."""

    def __init__(self, counts: dict[str, float], alphabet: int = 256) -> None:
        words = sorted(counts)
        weight = np.array([counts[w] for w in words], dtype=np.float64)
        owner, grams, contexts, depth = _windows(words)
        keys, values, ckeys, totals, types = [], [], [], [], []
        for k in range(ORDER):
            whole = depth == k + 1  # the longest n-gram of its place: counted as it is; shorter ones by what precedes them
            within = depth >= k + 1
            g, first, inverse = np.unique(grams[k][within], return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=np.where(whole[within], weight[owner[within]], 0.0), minlength=len(g))
            if k + 1 < ORDER:
                longer = depth > k + 1
                pairs = np.unique(np.stack([grams[k][longer], grams[k + 1][longer]]), axis=1)[0]
                at = np.searchsorted(g, pairs)
                count += np.bincount(at, minlength=len(g))
            c = contexts[k][within][first]
            u, back = np.unique(c, return_inverse=True)
            keys.append(g)
            values.append(count)
            ckeys.append(u)
            totals.append(np.bincount(back, weights=count))
            types.append(np.bincount(back).astype(np.float64))
        n1, n2 = (sum(float(((v > x - 0.5) & (v < x + 0.5)).sum()) for v in values) for x in (1, 2))
        self.discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
        self.base = 1.0 / alphabet
        self.grams = self._sorted(np.concatenate(keys), np.concatenate(values))
        self.contexts = self._sorted(np.concatenate(ckeys), np.stack([np.concatenate(totals), np.concatenate(types)]))

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], np.ascontiguousarray(values[..., order]).astype(np.float32)

    def score(self, windows: tuple, n: int) -> np.ndarray:
        """Log-probability of each of n words."""
        owner, grams, contexts, depth = windows
        p = np.full(len(owner), self.base)
        for k in range(ORDER):
            at, known = _find(self.contexts[0], contexts[k])
            known &= depth >= k + 1
            at = at[known]
            total, types = self.contexts[1][0][at].astype(np.float64), self.contexts[1][1][at]
            where, there = _find(self.grams[0], grams[k][known])
            count = np.where(there, self.grams[1][where], 0.0)
            p[known] = (np.maximum(count - self.discount, 0) + np.minimum(self.discount * types, total * 0.999) * p[known]) / total
        return np.bincount(owner, weights=np.log(np.maximum(p, 1e-12)), minlength=n)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Identifier:
    """The models of all languages with their limits; scores of words are kept between texts."""

    def __init__(self, models: dict[str, Model], limits: np.ndarray, calibration: tuple[float, float] = (0.0, 1.0)) -> None:
        self.languages, self.models, self.limits, self.calibration = list(models), list(models.values()), limits, calibration
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.languages)))
        self.letters = np.zeros(1024, dtype=np.int64)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "models": self.models, "limits": self.limits, "calibration": self.calibration}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def learn(self, words: set[str]) -> None:
        """Score the words that are not known yet."""
        if len(self.known) > 2_000_000:
            self._reset()
        new = [w for w in words if w not in self.known]
        ends = np.cumsum([len(w) for w in new]) // 800_000  # letters of a part, but for a longer word
        for part in (new[a:b] for a, b in pairwise([0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(new)]) if a < b):
            windows = _windows(part)
            n, upto = len(self.known), len(self.known) + len(part)
            while upto > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            for j, m in enumerate(self.models):
                self.scores[n:upto, j] = m.score(windows, len(part))
            self.letters[n:upto] = [len(w) + 1 for w in part]
            self.known.update(zip(part, range(n, upto), strict=True))

    def confidence(self, margin: np.ndarray) -> np.ndarray:
        """Chance that the best language is right, by its log-odds margin over the next."""
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a + b * np.sqrt(np.maximum(margin, 0)), -30, 30)))

    def stretches_of(self, texts: list[list[str]], least_words: int, least_stretch: int) -> list[tuple[int, int, int, int, int, float]]:
        """(text, sentence, begin and end word, language, confidence) of every stretch that takes a language; texts are given as sentences."""
        sentences = [_tokens(s) for t in texts for s in t]
        counts = np.array([len(t) for t in texts], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(sentences)) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = np.array([len(s) for s in sentences], dtype=np.int64)
        keep = np.flatnonzero(sizes >= min(3, least_words))
        if not len(keep):
            return []
        flat = list(chain.from_iterable([sentences[i] for i in keep.tolist()]))
        self.learn(set(flat))
        ids = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes, owner, number = sizes[keep], owner[keep], number[keep]
        begins = np.cumsum(sizes) - sizes
        score = self.scores[ids]
        total = np.add.reduceat(score, begins, axis=0)
        letters = np.add.reduceat(self.letters[ids], begins)
        best = total.argmax(axis=1)
        top = total[np.arange(len(best)), best]
        total[np.arange(len(best)), best] = -np.inf
        margin = top - total.max(axis=1)
        free = np.add.reduceat(score.max(axis=1), begins)
        good = (top / letters >= self.limits[best]) & (margin > 2.0) & (sizes >= least_words) & (letters >= 14)
        torn = free - top > CHANGE
        whole = np.flatnonzero(good & ~torn)
        found = list(zip(owner[whole].tolist(), number[whole].tolist(), [0] * len(whole), sizes[whole].tolist(), best[whole].tolist(), self.confidence(margin[whole]).tolist(), strict=True))
        for i in np.flatnonzero(torn).tolist():
            b, n, place = int(begins[i]), int(sizes[i]), (int(owner[i]), int(number[i]))
            part, size = score[b : b + n], self.letters[ids[b : b + n]]
            stretches = _stretches(part)
            if len(stretches) == 1:
                if good[i]:
                    found.append((*place, 0, n, int(best[i]), float(self.confidence(margin[i]))))
                continue
            for s, e, language in stretches:
                if e - s >= least_stretch and part[s:e, language].sum() / size[s:e].sum() >= self.limits[language]:
                    gain = float(part[s:e, language].sum() - np.delete(part[s:e].sum(axis=0), language).max())
                    if gain > 4.0:
                        found.append((*place, s, e, language, float(self.confidence(np.array(gain)))))
        return found

    def languages_of(self, texts: list[list[str]], least_words: int, least_stretch: int) -> list[dict[int, list[float]]]:
        """For each text, given as sentences: language -> [words, best confidence]."""
        found: list[dict[int, list[float]]] = [{} for _ in texts]
        for text, _, begin, end, language, confidence in self.stretches_of(texts, least_words, least_stretch):
            entry = found[text].setdefault(language, [0, 0.0])
            entry[0] += end - begin
            entry[1] = max(entry[1], confidence)
        return found

    def segments_of(self, texts: list[list[str]], least_words: int, least_stretch: int) -> list[list[tuple[str, int, float, str]]]:
        """For each text its stretches in order: (language or `und`, words, confidence, text); neighbours of one language are one, its confidence the least."""
        marks: list[dict[int, list]] = [{} for _ in texts]
        for text, number, begin, end, language, confidence in self.stretches_of(texts, least_words, least_stretch):
            marks[text].setdefault(number, []).append((begin, end, self.languages[language], confidence))
        out = []
        for sentences, mark in zip(texts, marks, strict=True):
            parts: list[tuple[str, int, float, str]] = []
            for number, sentence in enumerate(sentences):
                spans = [m.span() for m in _WORD.finditer(sentence)]
                held = sorted(mark.get(number, []))
                at, pieces = 0, []
                for k, (begin, end, language, confidence) in enumerate(held):
                    last = len(spans) if k + 1 == len(held) else held[k + 1][0]  # what no language takes goes with the stretch before it
                    begin = 0 if k == 0 else begin
                    cut = len(sentence) if last == len(spans) else spans[last][0]
                    pieces.append((language, last - begin, confidence, sentence[at:cut].strip()))
                    at = cut
                for piece in pieces or [("und", len(spans), 0.0, sentence.strip())]:
                    if parts and parts[-1][0] == piece[0]:
                        before = parts.pop()
                        piece = (piece[0], before[1] + piece[1], min(before[2], piece[2]), f"{before[3]} {piece[3]}")
                    parts.append(piece)
            out.append(parts or [("und", 0, 0.0, "")])
        return out


def _stretches(score: np.ndarray) -> list[tuple[int, int, int]]:
    """The best path of languages over words."""
    n, m = score.shape
    cost, back = score[0].copy(), np.zeros((n, m), dtype=np.int64)
    own = np.arange(m)
    for i in range(1, n):
        k = int(cost.argmax())
        move = cost[k] - CHANGE > cost
        back[i] = np.where(move, k, own)
        cost = np.where(move, cost[k] - CHANGE, cost) + score[i]
    path = [int(cost.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    out, s = [], 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[s]:
            out.append((s, i, path[s]))
            s = i
    return out


def train(rows: list[tuple[str, str]], rounds: int = 4) -> Identifier:
    """Models from (text, declared language); sentences whose words speak for another language are relabelled first."""
    sentences, labels = [], []
    order = {x: i for i, x in enumerate(LANGUAGES)}
    for text, label in rows:
        for s in prose.sentences(text):
            words = _tokens(s)
            if len(words) >= 4:
                sentences.append(words)
                labels.append(order[label])
    if not sentences:
        raise ValueError("no labelled text to train on")
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for s in sentences for w in s], dtype=np.int64)
    sizes = np.array([len(s) for s in sentences])
    begins, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    label = np.array(labels)
    n, m = len(vocabulary), len(LANGUAGES)
    sure = np.ones(len(sizes), dtype=bool)
    for _ in range(rounds):
        counts = np.bincount(ids * m + label[owner], weights=sure[owner], minlength=n * m).reshape(n, m)
        log = np.log((counts + 0.05) / (counts.sum(axis=0) + 0.05 * n))
        score = np.add.reduceat(log[ids], begins, axis=0)
        label = score.argmax(axis=1)
        part = np.sort(score, axis=1)
        sure = part[:, -1] - part[:, -2] > 6.0
    held = (np.arange(len(sizes)) % 10 == 0) & sure
    use = sure & ~held
    counts = np.bincount(ids * m + label[owner], weights=use[owner], minlength=n * m).reshape(n, m)
    rate = counts / np.maximum(counts.sum(axis=0), 1)
    share = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-12)
    models: dict[str, Model] = {}
    for j, language in enumerate(LANGUAGES):
        bag: Counter[str] = Counter()
        for word, i in vocabulary.items():
            if counts[i, j] and (share[i, j] > 0.02):
                weight = 1 + math.log2(1 + counts[i, j])
                bag[word] += weight
                for other in spellings(word, language):
                    bag[other] += max(1.0, weight / 3)
        models[language] = Model(bag or {"": 1.0})
    found = Identifier(models, np.full(m, -np.inf))
    found.learn(set(vocabulary))
    at = np.array([found.known[w] for w in vocabulary])
    score, size = found.scores[at][ids], found.letters[at][ids]
    level = np.add.reduceat(score, begins, axis=0)[np.arange(len(sizes)), label] / np.add.reduceat(size, begins)
    for j in range(m):
        own = level[held & (label == j)]
        found.limits[j] = (np.quantile(own, 0.005) if len(own) >= 20 else -2.2) - SLACK
    found.calibration = _calibrated(score, begins, sizes, label, np.flatnonzero(held))
    return found


def _calibrated(score: np.ndarray, begins: np.ndarray, sizes: np.ndarray, label: np.ndarray, held: np.ndarray) -> tuple[float, float]:
    """Logistic fit of being right to the root of the margin, over beginnings of one to six words and the whole of held-out sentences."""
    margins, right = [], []
    for n in (1, 2, 3, 6, None):
        for i in held[:4000].tolist():
            total = score[begins[i] : begins[i] + min(sizes[i], n or sizes[i])].sum(axis=0)
            order = np.argsort(total)
            margins.append(total[order[-1]] - total[order[-2]])
            right.append(order[-1] == label[i])
    x, y = np.sqrt(np.maximum(np.array(margins or [0.0]), 0)), np.array(right or [True], dtype=float)
    if y.min() == y.max():
        return 0.0, 1.0
    design, w = np.stack([np.ones_like(x), x], axis=1), np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w = w + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2), design.T @ (y - p) - 0.01 * w)
    return float(w[0]), float(max(w[1], 0.0))


def training_rows(documents: DataFrame, queries: DataFrame, sample: int) -> list[tuple[str, str]]:
    """A bounded sample of labelled documents and of queries with one label: `sample` rows of each in the order of a hash of their keys."""
    parts = [
        documents.select(F.col("doc_id").cast("string").alias("key"), "text", named(F.col("lang")).alias("language")),
        queries.where(F.size("languages") == 1).select(F.col("id").alias("key"), F.col("query").alias("text"), named(F.col("languages")[0]).alias("language")),
    ]
    rows: list[tuple[str, str]] = []
    for part in parts:
        labelled = part.where("language IS NOT NULL AND length(trim(text)) > 0")
        keys = labelled.select("key").orderBy(F.xxhash64("key"), "key").limit(sample).distinct()
        rows += [(r.text, r.language) for r in labelled.join(F.broadcast(keys), "key", "left_semi").select("text", "language").collect()]  # at most `sample` keys
    return sorted(rows)


_ARROW = pa.schema([("rec_id", pa.string()), ("declared", pa.list_(pa.string())), ("lang", pa.string()), ("words", pa.int64()), ("confidence", pa.float64())])
_SCHEMA = "rec_id string, declared array<string>, lang string, words long, confidence double"


def identify(records: DataFrame, model, titled: bool = False, least_words: int = 4, least_stretch: int = 6) -> DataFrame:  # noqa: ANN001
    """A row for each record and language its text holds: words in it and the confidence of the surest sentence.

    records: rec_id, text, declared (labels as languages). Null and blank texts and texts without a sentence give no rows. No shuffle.
    model: a broadcast Identifier.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Identifier = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys, texts, labels = (c.to_pylist() for c in part.columns)
                found = known.languages_of([prose.sentences(t, titled) for t in texts], least_words, least_stretch)
                rows = [(k, d, known.languages[j], int(n), c) for k, d, f in zip(keys, labels, found, strict=True) for j, (n, c) in f.items()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return records.where("text IS NOT NULL AND rec_id IS NOT NULL").select("rec_id", "text", "declared").mapInArrow(run, _SCHEMA)


def trained(documents: DataFrame, queries: DataFrame, sample: int = 12_000):  # noqa: ANN201
    """A broadcast Identifier, or None without any labelled text."""
    rows = training_rows(documents, queries, sample)
    return documents.sparkSession.sparkContext.broadcast(train(rows)) if rows else None


def _records(documents: DataFrame, chunks: DataFrame, queries: DataFrame) -> list[tuple[str, DataFrame, bool, int, int]]:
    """(kind, rec_id with text and declared, whether a title stands in front, least words of a sentence and of a stretch)."""
    empty = F.array().cast("array<string>")
    one = F.when(named(F.col("lang")).isNull(), empty).otherwise(F.array(named(F.col("lang"))))
    several = F.coalesce(F.filter(F.transform("languages", named), lambda x: x.isNotNull()), empty)
    return [
        ("documents", documents.select(F.col("doc_id").cast("string").alias("rec_id"), "text", one.alias("declared")), False, 4, 6),
        ("chunks", chunks.select(F.col("chunk_id").alias("rec_id"), "text", one.alias("declared")), True, 4, 6),
        ("surreal_golden_queries", queries.select(F.col("id").alias("rec_id"), F.col("query").alias("text"), several.alias("declared")), False, 3, 3),
    ]


def languages(documents: DataFrame, chunks: DataFrame, queries: DataFrame, sample: int = 12_000) -> DataFrame:
    """Languages of documents, chunks and golden queries with the labels they were given: rec, rec_id, declared, lang, words, confidence."""
    model = trained(documents, queries, sample)
    if model is None:
        return documents.sparkSession.createDataFrame([], "rec string, " + _SCHEMA)
    out = None
    for rec, part, titled, words, stretch in _records(documents, chunks, queries):
        result = identify(part, model, titled, words, stretch).select(F.lit(rec).alias("rec"), "*")
        out = result if out is None else out.unionByName(result)
    return out


_SEGMENTS = "rec_id string, segment int, lang string, words int, confidence double, text string"
_SEGMENTS_ARROW = pa.schema([("rec_id", pa.string()), ("segment", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64()), ("text", pa.string())])


def segments(documents: DataFrame, chunks: DataFrame, queries: DataFrame, sample: int = 12_000) -> DataFrame:
    """The stretches of every record in order: rec, rec_id, segment, lang, words, confidence, text.

    What takes no language is `und` with confidence 0; so is a record without a sentence, a null or blank text. Headings, code, tables and the like are in no stretch. No shuffle.
    """
    model = trained(documents, queries, sample)
    if model is None:
        return documents.sparkSession.createDataFrame([], "rec string, " + _SEGMENTS)

    def cutter(titled: bool, words: int, stretch: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: Identifier = model.value
            for batch in batches:
                for i in range(0, batch.num_rows, 2000):
                    keys, texts = (c.to_pylist() for c in batch.slice(i, 2000).columns)
                    found = known.segments_of([prose.sentences(t, titled) if t else [] for t in texts], words, stretch)
                    columns = list(zip(*[(k, n, *x) for k, f in zip(keys, found, strict=True) for n, x in enumerate(f)], strict=True)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENTS_ARROW, strict=True)], schema=_SEGMENTS_ARROW)

        return run

    out = None
    for rec, part, titled, words, stretch in _records(documents, chunks, queries):
        result = part.where("rec_id IS NOT NULL").select("rec_id", "text").mapInArrow(cutter(titled, words, stretch), _SEGMENTS).select(F.lit(rec).alias("rec"), "*")
        out = result if out is None else out.unionByName(result)
    return out


def unlabelled(found: DataFrame) -> DataFrame:
    """Distinct (rec, rec_id, lang): languages a text holds and its label does not name."""
    return found.where("NOT array_contains(declared, lang)").select("rec", "rec_id", "lang").distinct()
