"""Abusive, hateful and sexual content, by multiple-instance learning from document labels.

A document is a bag of sentences; each has a probability to offend, and a document offends by noisy-or over its sentences. The
reading of all documents keeps the sentences that are not ordinary language: those where words that are rare among documents come close
together (every other sentence scores 0). Words are first freed from disguise: homoglyphs, digits and signs for letters, spaced,
dotted, broken, stretched and masked words, missing diacritics, transliteration.

The weights of words, their beginnings and pairs are learned by expectation-maximisation, with no list of bad words: the expectation
gives every kept sentence the evidence of the labels of its documents (which may be mistaken, how often is estimated), of the sentences
beside it, and of its words; the maximisation takes the log-odds of every word from these shares. Unlabelled documents take part by
their words, so that what was seen in labelled documents spreads to sentences that share words with it. Labels name no category:
it is a mixture of three over the words of offending sentences, also by expectation-maximisation, begun from some seed words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import runtime
from skein.llm import language, prose, textnorm

CATEGORIES = ("abusive", "hateful", "sexual")
#: Seed words that name the categories; they say nothing about whether a sentence offends.
SEEDS = {
    "abusive": "idiot moron fool bastard идиот дурак тупица урод trottel arschloch imbécile crétin connard imbécil idiota gilipollas babaca otário ідіот дурень",
    "hateful": "vermin parasites subhuman plague паразиты нелюди саранча ungeziefer parasiten untermenschen vermine alimañas parásitos plaga parasitas praga паразити",
    "sexual": "sex naked moaning thighs секс сексом трахаются голая стонала nackt sex ficken stöhnte schenkel sexe nue gémissait cuisses jouir sexo follar desnuda gemía muslos nua gemia гола стогнала",
}
#: Words that address somebody: without other signs, what offends is abuse.
ADDRESS = "you your dich dir dein deine toi tes tú usted você ты тебя тебе твой твоя твои тобі твій"
LEAST = 0.4  # score from which a text counts as offending
ORDINARY = 0.003  # share of documents from which a word is ordinary
PRIOR = 0.3  # of a kept sentence
SEED = 4.0  # log-weight of a seed word for its category
ADDRESSED = 1.5  # log-weight of a word of address for abuse
BESIDE = 0.2  # weight of no knowledge against that of an offending sentence beside
#: Letters of the one script that look like letters of the other.
LATIN_LIKE = dict(zip("аеорсухкмтвніѕјһԁ", "aeopcyxkmtbhisjhd", strict=True))
CYRILLIC_LIKE = dict(zip("aeopcyxkmtbhi", "аеорсухкмтвні", strict=True))
#: Signs and digits written for letters.
SIGNS = str.maketrans("013457@$!|€", "oieastasile")
_MASK = frozenset("*#%&")
_ROMAN = language.ROMAN_RU | {"ё": "e", "і": "i", "ї": "yi", "є": "ye", "ґ": "g"}

_SEPARATED = re.compile(r"(?<![^\W_])[^\W\d_](?:([._~*-])(?: \1)?[^\W\d_])(?:\1(?: \1)?[^\W\d_]){2,}")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?: {1,4}[^\W\d_]){3,}(?![^\W_])")
_ODD = re.compile(r"[@$*#%&|€]|[^\W\d_]\d|\d[^\W\d_]")
_ODDWORD = re.compile(r"[\w@$*#%&|€][\w@$*#%&!|€]*")
_WORD = re.compile(r"[^\W\d_]+")
_SPEAKER = re.compile(r"\s*(?:\[\d\d:\d\d(?::\d\d)?\]\s*)?(?:\*\*[^*\n]{1,40}\*\*:?|[^\W\d_][\w-]{0,24}:)\s")
_RUN = re.compile(r"(.)\1+")
_LATIN, _CYRILLIC = re.compile(r"[a-z]"), re.compile(r"[Ѐ-ӿ]")


def _joined(match: re.Match) -> str:
    sign = match.group(1)
    return match.group().replace(f"{sign} {sign}", "\0").replace(sign, "").replace("\0", " ")


def _closed(match: re.Match) -> str:
    return re.sub(r" {2,}", "\0", match.group()).replace(" ", "").replace("\0", " ")


def sentences(text: str) -> list[str]:
    """Sentences of a text with separated letters joined."""
    text = textnorm.mended(textnorm.visible(text))
    if _SEPARATED.search(text):
        text = _SEPARATED.sub(_joined, text)
    if _SPACED.search(text):
        text = _SPACED.sub(_closed, text)
    return prose.sentences(text, whole=True)


def tokens(sentence: str) -> list[str]:
    """Raw lower-case words; where a sentence has signs inside words, with these signs."""
    sentence = sentence.lower()
    if not _ODD.search(sentence):
        return _WORD.findall(sentence)
    return [w for w in (x.rstrip("!|") for x in _ODDWORD.findall(sentence)) if not w.isdigit() and w.strip("*#%&$@|_")]


def plain(word: str) -> str:
    """A word freed from disguise, in Latin letters, with runs of a letter as one; masked places stay as signs."""
    if not word.isalpha():
        if not any(c in _MASK for c in word):
            word = word.strip("_").translate(SIGNS)
        elif word.strip("*_").isalpha():
            word = word.strip("*_")  # emphasis
    latin, cyrillic = _LATIN.findall(word), _CYRILLIC.findall(word)
    if latin and cyrillic:
        strange_latin, strange_cyrillic = any(c not in CYRILLIC_LIKE for c in latin), any(c not in LATIN_LIKE for c in cyrillic)
        if strange_latin and not strange_cyrillic or (strange_latin == strange_cyrillic and len(latin) >= len(cyrillic)):
            word = "".join(LATIN_LIKE.get(c, c) for c in word)
        else:
            word = "".join(CYRILLIC_LIKE.get(c, c) for c in word)
    word = "".join(_ROMAN.get(c, c) for c in word)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word.replace("ß", "ss")) if not unicodedata.combining(c))
    return _RUN.sub(r"\1", word) if "*" not in word else re.sub(r"([^*])\1+", r"\1", word)


class Reader:
    """Keeps the sentences of a text that are not ordinary language."""

    def __init__(self, ordinary: frozenset) -> None:
        self.ordinary = ordinary
        self.known: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["ordinary"])

    def learn(self, raw: list[str]) -> None:
        if len(self.known) > 2_000_000:
            self.known = {}
        for w in raw:
            if w not in self.known:
                self.known[w] = plain(w)

    def words(self, sentence: str) -> list[str]:
        raw = tokens(sentence)
        self.learn(raw)
        return [p for w in raw if (p := self.known[w])]

    def unusual(self, word: str) -> bool:
        return word not in self.ordinary and 1 < len(word) <= 30  # one letter, or a run of more than 30, is no word

    def read(self, text: str) -> list[tuple[str, str]]:
        """(sentence, its plain words joined by spaces) of all sentences with a word."""
        return [(s, " ".join(words)) for s in sentences(text) if (words := self.words(s))]

    def kept(self, read: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Of what was read those with unusual words; of sentences of more than 40 words parts of 20, each from the middle of the one before.

        Kept is what has three unusual words among eight, or two that fill half of a shorter one. Runs without white space (encoded data) are no language.
        """
        out = []
        for s, joined in read:
            words = joined.split(" ")
            if len(words) < 3 or sum(map(self.unusual, [w for w in words if w not in self.ordinary])) < 2:
                continue
            speaker = _SPEAKER.match(s)
            if speaker and self.ordinary.issuperset(w := self.words(speaker.group())):  # who speaks is no part of what is said
                words = words[len(w) :]
            if len(words) < 3 or 2 * len(s.split()) < min(len(words), 40):
                continue
            strange = [self.unusual(w) for w in words]
            n = len(words)
            for a, b in [(0, n)] if n <= 40 else [(i, min(n, i + 20)) for i in range(0, n - 10, 10)]:
                sums = np.concatenate([[0], np.cumsum(strange[a:b])])
                k = min(8, b - a)
                if (sums[k:] - sums[:-k]).max() >= min(3, max(2, k // 2)):
                    out.append((s, " ".join(words[a:b])))
        return out

    def features(self, words: str) -> set[str]:
        """Unusual words, their beginnings, and pairs of neighbours with an unusual word."""
        out, before, odd = set(), "", False
        for w in words.split(" "):
            strange = self.unusual(w)
            if strange:
                out.add(w)
                if len(w) > 6:
                    out.add("^" + w[:5])
            if before and (strange or odd):
                out.add(before + " " + w)
            before, odd = w, strange
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -15, 15)))


class Scorer:
    """Weights of features for offence and for the categories."""

    def __init__(self, reader: Reader, weights: dict[str, float], kinds: dict[str, np.ndarray]) -> None:
        self.reader, self.weights, self.kinds = reader, weights, kinds
        self.begins: dict[str, list[str]] = {}
        for w in sorted((w for w, x in weights.items() if x > 0.5 and " " not in w and w[0] != "^"), key=lambda w: (-weights[w], w)):
            self.begins.setdefault(w[0], []).append(w)

    def unmasked(self, word: str) -> str:
        """The offending word that fits a word with masked places, if there is one."""
        pattern = "".join("." if c in "*#%&$@|" or c.isdigit() else re.escape(c) for c in re.sub(r"\*{2,}", "\0", word)).replace(re.escape("\0"), ".+").replace("\0", ".+")
        fits = re.compile(pattern).fullmatch
        return next((f for f in self.begins.get(word[0], ()) if fits(f)), word)

    def score(self, sentences: list[str]) -> np.ndarray:
        """Probability of each kept sentence of a document to offend, in each category."""
        p, kinds = np.zeros(len(sentences)), np.zeros((len(sentences), len(CATEGORIES)))
        for i, words in enumerate(sentences):
            if any(c in _MASK for c in words):
                words = " ".join(self.unmasked(w) if any(c in _MASK for c in w) else w for w in words.split(" "))
            features = self.reader.features(words)
            known = [x for f in features if (x := self.weights.get(f)) is not None]
            if known:
                p[i] = _sigmoid(np.array(sum(known) / max(2, len(known)) ** 0.5 + _logit(PRIOR)))
            held = [x for f in {*words.split(" "), *features} if (x := self.kinds.get(f)) is not None]
            if held:
                learned, own = np.sum(held, axis=0)
                kinds[i] = own + 2 * learned / len(held) ** 0.5
        alone = _softmax(kinds)
        return p[:, None] * _softmax(kinds + _beside(alone * p[:, None], np.zeros(len(p), dtype=np.int64), 1))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def train(bags: list[tuple[list[str], int | None]], counts: tuple[int, int], reader: Reader, rounds: int = 15) -> Scorer:
    """Weights from (kept sentences, toxic or None) of documents. counts: labelled documents with toxic 1 and 0, also those with no kept sentence."""
    types: dict[str, int] = {}
    pairs = sorted({(b, types.setdefault(s, len(types))) for b, (held, _) in enumerate(bags) for s in held})
    bag, row = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    label = np.array([-1 if y is None else y for _, y in bags], dtype=np.int64)
    held = [reader.features(s) for s in types]
    n = len(held)
    size = np.bincount(row, minlength=n).astype(float)
    documents: Counter[str] = Counter()
    for fs, d in zip(held, size.tolist(), strict=True):
        for f in fs:
            documents[f] += d
    names = sorted(f for f, d in documents.items() if d >= 2)
    place = {f: i for i, f in enumerate(names)}
    column = [sorted(place[f] for f in fs if f in place) for fs in held]
    of = np.repeat(np.arange(n), [len(c) for c in column])
    at = np.array([i for c in column for i in c], dtype=np.int64)
    root = np.maximum(np.bincount(of, minlength=n), 2) ** 0.5
    seen = label >= 0
    right, wrong, beside, alone = 0.85, 0.05, 0.2, 0.05  # label 1 of offending and other documents; another offending sentence beside an offending and another one
    z, weight = np.full(n, _logit(PRIOR)), np.zeros(len(names))
    mass = (np.minimum(size, 20.0) / np.maximum(size, 1))[row]
    for turn in range(rounds):
        inside = np.minimum(_sigmoid(z)[row], 1 - 1e-6)
        none = np.bincount(bag, weights=np.log1p(-inside), minlength=len(label))
        other = np.clip(-np.expm1(none[bag] - np.log1p(-inside)), 0, 1)
        y = label[bag]
        if_bad = np.select([y == 1, y == 0], [right, 1 - right], 1.0)
        if_not = np.select([y == 1, y == 0], [other * right + (1 - other) * wrong, other * (1 - right) + (1 - other) * (1 - wrong)], 1.0)
        evidence = np.log(if_bad / if_not)
        if turn > 3:
            evidence += np.log((other * beside + (1 - other) * (1 - beside)) / (other * alone + (1 - other) * (1 - alone)))
        share = _sigmoid(z + np.clip(np.bincount(row, weights=evidence, minlength=n), -10, 10))
        some = np.clip(-np.expm1(none), 1e-6, 1 - 1e-6)
        odds = np.select([label == 1, label == 0], [right / wrong, (1 - right) / (1 - wrong)], 1.0)
        toxic = some * odds / (some * odds + 1 - some)
        if turn > 2:
            found, both = float((toxic * (label == 1)).sum()), float((toxic * seen).sum())
            right = float(np.clip((found + 8.5) / (both + 10), 0.6, 0.97))
            wrong = float(np.clip((counts[0] - found + 0.5) / (sum(counts) - both + 10), 0.002, 0.3))
            p = share[row]
            beside = float(np.clip(((p * other).sum() + 2) / (p.sum() + 10), 0.02, 0.9))
            alone = float(np.clip((((1 - p) * other).sum() + 0.5) / ((1 - p).sum() + 10), 0.005, beside))
        # An unlabelled document counts a fifth of a labelled one, in the first rounds less.
        whole = np.bincount(row, weights=np.where(seen[bag], 1.0, 0.2 * min(1.0, turn / 5)) * mass, minlength=n)
        bad, all_ = (np.bincount(at, weights=x[of], minlength=len(names)) for x in (share * whole, whole))
        weight = np.log((bad + 2 * PRIOR) / (all_ - bad + 2 * (1 - PRIOR))) - _logit(PRIOR)
        z = np.bincount(of, weights=weight[at], minlength=n) / root + _logit(PRIOR)
    offending = np.flatnonzero(_sigmoid(z) >= 0.5)
    number = np.full(n, -1)
    number[offending] = np.arange(len(offending))
    texts = list(types)
    pairs = np.stack([bag, number[row]])[:, number[row] >= 0]
    return Scorer(reader, dict(zip(names, weight.tolist(), strict=True)), _categories([{*texts[i].split(" "), *held[i]} for i in offending.tolist()], pairs[0], pairs[1]))


def _beside(kinds: np.ndarray, bag: np.ndarray, count: int) -> np.ndarray:
    """Log-odds of the categories of a sentence from the other offending sentences of its document."""
    total = np.stack([np.bincount(bag, weights=kinds[:, j], minlength=count) for j in range(kinds.shape[1])], axis=1)
    return np.log(total[bag] - kinds + BESIDE)


def _softmax(logit: np.ndarray) -> np.ndarray:
    part = np.exp(logit - logit.max(axis=1, keepdims=True))
    return part / part.sum(axis=1, keepdims=True)


def _categories(held: list[set], bag: np.ndarray, row: np.ndarray, rounds: int = 15) -> dict[str, np.ndarray]:
    """Log-weights of features for each category, from the features of offending sentences, the seeds, and the sentences beside each other.

    bag, row: the document and the sentence of every occurrence.
    """
    k = len(CATEGORIES)
    fixed = {plain(w): ADDRESSED * np.eye(k)[0] for w in ADDRESS.split()} | {plain(w): SEED * np.eye(k)[j] for j, c in enumerate(CATEGORIES) for w in SEEDS[c].split()}
    place = {f: i for i, f in enumerate(sorted(set().union(*held, fixed)))}
    own = np.zeros((len(place), k))
    for f, x in fixed.items():
        own[place[f]] = x
    of, at = np.repeat(np.arange(len(held)), [len(fs) for fs in held]), np.array([place[f] for fs in held for f in sorted(fs)], dtype=np.int64)
    root = np.maximum(np.bincount(of, minlength=len(held)), 1)[:, None] ** 0.5

    def summed(values: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
        return np.stack([np.bincount(groups, weights=values[:, j], minlength=count) for j in range(k)], axis=1)

    seeded = summed(own[at], of, len(held))
    learned, sure = np.zeros_like(own), seeded.max(axis=1, initial=0) >= SEED
    kinds = _softmax(seeded[row]) * sure[row][:, None]
    for turn in range(rounds):
        logit = (seeded + 2 * summed(learned[at], of, len(held)) / root)[row]
        kinds = _softmax(logit + _beside(kinds, bag, int(bag.max(initial=0)) + 1))
        if turn < 2:
            kinds *= sure[row][:, None]  # the first rounds learn from the seeds
        counts = summed(summed(kinds, row, len(held))[of], at, len(place))
        share = (kinds.sum(axis=0) + 1) / (kinds.sum() + k)
        learned = np.log((counts + share) / ((counts.sum(axis=1, keepdims=True) + 1) * share))
    return {f: np.stack([learned[i], own[i]]) for f, i in place.items()}


_KEPT = "doc_id long, source string, sentences array<string>, words array<string>"
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("sentences", pa.list_(pa.string())), ("words", pa.list_(pa.string()))])
_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *[(c, pa.float64()) for c in CATEGORIES], ("sentence", pa.string())])
_SCHEMA = "doc_id long, source string, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", sentence string"


def sentences_of(documents: DataFrame) -> DataFrame:
    """doc_id, source, the sentences of every document and their plain words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(frozenset())
        for batch in batches:
            yield _pairs(batch, [reader.read(t) if t else [] for t in batch.column(2).to_pylist()])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, _KEPT)


def _pairs(batch: pa.RecordBatch, found: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.string())), pa.array([[w for _, w in f] for f in found], pa.list_(pa.string()))], schema=_KEPT_ARROW)


def ordinary_words(read: DataFrame) -> frozenset:
    """Words in a share of at least ORDINARY, and in more than twenty, of all documents that hold a word."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for held in batch.column(0).to_pylist():
                counts.update(set(" ".join(held).split(" ")))
            if len(counts) > 500_000:
                yield out()
                counts = Counter()
        yield out()

    texts = read.where("doc_id IS NOT NULL AND size(words) > 0")
    least = max(21.0, ORDINARY * texts.count())
    # At most the words of a mean document / ORDINARY rows pass.
    return frozenset(r.word for r in texts.select("words").mapInArrow(distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())


def opinions(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: the majority of a document's opinions, toxic if they are even; labels without an opinion do not count."""
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))


def kept(read: DataFrame, reader: Reader) -> DataFrame:
    """doc_id, source and the kept sentences of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pairs(batch, [reader.kept(list(zip(s, w, strict=True))) for s, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])

    return read.mapInArrow(run, _KEPT)


def scored(documents: DataFrame, labels: DataFrame, sample: int = 8_000, others: int = 40_000) -> DataFrame:
    """Scores of every document: doc_id, source, one noisy-or score a category, and its most offending sentence.

    Null and blank texts score 0; repeated rows stay. The texts of all documents are read once, without a shuffle, and stored as sentences; the ordinary words are those of
    all documents. The fit takes at most `sample` labelled documents and `others` further ones that have kept sentences (of either, those with more than 200 kept
    sentences stay out of the fit), the first in the order of a hash of the keys. Without labels the prior decides.
    """
    read = runtime.materialize(sentences_of(documents), "sentences")
    reader = Reader(ordinary_words(read))
    rows = runtime.materialize(kept(read, reader), "kept")
    known = opinions(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    odd = rows.where("size(words) BETWEEN 1 AND 200 AND doc_id IS NOT NULL").select("doc_id", "words")
    with_label = odd.join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
    without = odd.join(F.broadcast(known), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(others).withColumn("toxic", F.lit(None).cast("int"))
    bags = sorted({(r.doc_id, tuple(sorted(set(r.words))), r.toxic) for r in with_label.unionByName(without).collect()}, key=lambda r: r[:2])
    model = documents.sparkSession.sparkContext.broadcast(train([(list(w), y) for _, w, y in bags], (counts.get(1, 0), counts.get(0, 0)), reader))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = model.value
        for batch in batches:
            score, worst = np.zeros((batch.num_rows, len(CATEGORIES))), [None] * batch.num_rows
            for i, (found, words) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if words:
                    p = scorer.score(words)
                    score[i] = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum(axis=0))
                    if p.max() >= LEAST:
                        worst[i] = found[int(p.max(axis=1).argmax())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(score[:, j]) for j in range(len(CATEGORIES))], pa.array(worst, pa.string())], schema=_ARROW)

    return rows.mapInArrow(run, _SCHEMA)


def offences(scores: DataFrame, least: float = LEAST) -> DataFrame:
    """Distinct (doc_id, category) with a score of at least `least`."""
    cases = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])
    return scores.where("doc_id IS NOT NULL").select("doc_id", F.explode(cases).alias("x")).where(F.col("x.score") >= least).select("doc_id", "x.category").distinct()


def source_name(source: Column) -> Column:
    """A source however it is spelled; `unknown` for none."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[_\s]+", F.lit("-")), F.lit("")), F.lit("unknown"))


def rates(scores: DataFrame, least: float = LEAST) -> DataFrame:
    """Per source: documents, and the share of them in each category."""
    return scores.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.count("*").alias("documents"), *[F.avg((F.col(c) >= least).cast("double")).alias(f"{c}_rate") for c in CATEGORIES])
