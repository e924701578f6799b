"""Documents that hold passages of held-out test items.

The test items, a small fixed set, make a BM25 inverted index whose terms are runs of four words; its postings are cut into blocks with
their largest impact. Every document is read as overlapping passages, and each passage queries the index by block-max WAND
for all items above a threshold; every retrieved pair is verified by word alignment.

Looked for are L >= 24 consecutive words of an item with at most L/10 of them changed, added or dropped. Such a span of 48 words or more has a part of
at least 24 that is one too (of two parts one has no more edits to a word than the whole), and one of 25-29, 31-39 or 41-47 words holds one of 24, 30 or 40 words with
2, 3 or 4 edits. So these three spans are all there is to look for, and the threshold loses none of them: an edit breaks at most four terms, so the score
cannot fall below the least sum of what remains of any such span of the item.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import textnorm

SPANS = ((24, 2), (30, 3), (40, 4))  # words, and edits among them
SPAN = SPANS[0][0]
GRAM = 4  # words of a term
STEP = 26  # words from one passage to the next; passages are longer by the longest span
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])


_CURRENT = itemgetter(0)


class Index:
    """BM25 over word n-grams with blocked postings; pickles small."""

    def __init__(self, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, block: int = 16) -> None:
        texts = [(i, textnorm.words(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w) >= SPAN]
        self.ids = [i for i, _ in texts]
        self.vocabulary = {w: n for n, w in enumerate(sorted({x for _, ws in texts for x in ws}))}
        self.size = max(1, len(self.vocabulary))
        self.tokens = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for _, ws in texts]
        grams = [self.grams(t) for t in self.tokens]
        df = Counter(g for gs in grams for g in set(gs.tolist()))
        self.terms = np.array(sorted(df), dtype=np.int64)
        place = {g: n for n, g in enumerate(self.terms.tolist())}
        count, mean = len(grams), sum(map(len, grams)) / max(1, len(grams))
        idf = {g: math.log(1 + (count - n + 0.5) / (n + 0.5)) for g, n in df.items()}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.least = np.zeros(count)
        for doc, gs in enumerate(grams):
            impact = {g: idf[g] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(gs) / mean)) for g, f in Counter(gs.tolist()).items()}
            for g, x in impact.items():
                postings[place[g]].append((doc, x))
            values = np.array([impact[g] for g in gs.tolist()])
            self.least[doc] = min(self._least(values, gs, span, edits) for span, edits in SPANS)
        self.postings = [([d for d, _ in p], [x for _, x in p], [(p[min(i + block, len(p)) - 1][0], max(x for _, x in p[i : i + block])) for i in range(0, len(p), block)]) for p in postings]
        self.most = np.array([max(x for _, x in p) for p in postings]) if postings else np.zeros(0)
        self.threshold = float(self.least.min()) if count else math.inf

    def grams(self, tokens: np.ndarray) -> np.ndarray:
        """Keys of the word n-grams; -1 where a word is not in the index."""
        n = max(0, len(tokens) - GRAM + 1)
        key, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(GRAM):
            part = tokens[k : k + n]
            key = key * self.size + part  # beyond 64 bits this is a hash; verification follows
            known &= part >= 0
        return np.where(known, key & 0x7FFFFFFFFFFFFFFF, -1)

    @staticmethod
    def _least(impacts: np.ndarray, grams: np.ndarray, span: int, edits: int) -> float:
        """The least score of any `span` words of an item after `edits` edits; infinite for a shorter item."""
        least, n = math.inf, span - GRAM + 1
        for s in range(len(impacts) - n + 1):
            part = impacts[s : s + n].copy()
            first = np.zeros(n, dtype=bool)
            first[np.unique(grams[s : s + n], return_index=True)[1]] = True
            part[~first] = 0
            broken = np.sort(np.convolve(part, np.ones(GRAM)))[::-1]
            least = min(least, part.sum() - broken[:edits].sum())
        return max(least, 1e-9)

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least the threshold, by block-max WAND over the postings of the terms."""
        lists = [[self.postings[t][0][0], 0, *self.postings[t], float(self.most[t]), 0] for t in terms]
        found = []  # a list: its current item, position, items, impacts, blocks (last item, largest impact), bound, current block
        while lists:
            lists.sort(key=_CURRENT)
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[5]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            doc = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == doc:
                pivot += 1
            head, blocks, skip = lists[: pivot + 1], 0.0, math.inf
            for x in head:
                ends, k = x[4], x[6]
                while k < len(ends) and ends[k][0] < doc:
                    k += 1
                x[6] = k
                if k < len(ends):
                    blocks += ends[k][1]
                    skip = min(skip, ends[k][0])
            if blocks < threshold:  # no item up to the nearest block end, nor before the next list, can reach it
                until = max(doc + 1, min(skip + 1, lists[pivot + 1][0] if pivot + 1 < len(lists) else math.inf))
            elif head[0][0] == doc:
                score = sum(x[3][x[1]] for x in head)
                if score >= threshold:
                    found.append((doc, score))
                until = doc + 1
            else:
                until = doc
            ended = False
            for x in head:
                if x[0] < until:
                    x[1] = bisect_left(x[2], until, x[1] + 1)
                    if x[1] < len(x[2]):
                        x[0] = x[2][x[1]]
                    else:
                        x[0], ended = math.inf, True
            if ended:
                lists = [x for x in lists if x[0] != math.inf]
        return found

    def leaks(self, tokens: np.ndarray) -> dict[int, float]:
        """Positions of the items of which the document's words hold a passage, with the best score of a passage."""
        least = min(span - edits for span, edits in SPANS)
        grams = self.grams(tokens) if len(tokens) >= least and len(self.terms) else tokens[:0]
        if not len(grams):
            return {}
        at = np.minimum(np.searchsorted(self.terms, grams), len(self.terms) - 1)
        hit = self.terms[at] == grams
        if hit.sum() < min(intact(*x) for x in SPANS):
            return {}
        # A passage is worth a query only where the terms of one span reach the threshold and enough of them are known.
        bound = np.concatenate([[0.0], np.cumsum(np.where(hit, self.most[at], 0.0))])
        count = np.concatenate([[0], np.cumsum(hit)])
        starts = []
        for span, edits in SPANS:
            n = min(span + edits - GRAM + 1, len(grams))
            starts.append(np.flatnonzero((bound[n:] - bound[:-n] >= self.threshold - 1e-9) & (count[n:] - count[:-n] >= intact(span, edits))))
        found: dict[int, float] = {}
        upto = -1
        for s in np.unique(np.concatenate(starts)).tolist():
            if s < upto:
                continue
            upto = s + STEP
            passage = tokens[s : upto + sum(SPANS[-1])]
            e = s + max(0, len(passage) - GRAM + 1)
            terms = np.unique(at[s:e][hit[s:e]]).tolist()
            for doc, score in self.wand(terms, self.threshold):
                if score > found.get(doc, -1.0) and score >= self.least[doc] - 1e-9 and (doc in found or aligned(self.tokens[doc], passage)):
                    found[doc] = score
        return found


def intact(span: int, edits: int) -> int:
    """Terms that are left of a span after the edits."""
    return span - GRAM + 1 - GRAM * edits


def aligned(item: np.ndarray, passage: np.ndarray) -> bool:
    """Whether consecutive words of the item lie in the passage with no more words changed, added or dropped than SPANS allows."""
    return any(_aligned(item, passage, span, edits) for span, edits in SPANS)


def _aligned(item: np.ndarray, passage: np.ndarray, span: int, edits: int) -> bool:
    starts = np.arange(max(0, len(item) - span + 1))
    columns = np.arange(len(passage) + 1)
    cost = np.zeros((len(starts), len(columns)), dtype=np.int32)  # the passage may begin anywhere
    for j in range(span):
        if not len(starts):
            return False
        word = item[starts + j][:, None]
        step = cost + 1
        step[:, 1:] = np.minimum(step[:, 1:], cost[:, :-1] + (passage[None, :] != word))
        cost = np.minimum.accumulate(step - columns, axis=1) + columns
        alive = cost.min(axis=1) <= edits
        starts, cost = starts[alive], cost[alive]
    return bool(len(starts))


def matches(documents: DataFrame, items: DataFrame, shard: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score): the document's text holds a passage of the item; score is the BM25 score of its best passage.

    Whole texts are read once, without a shuffle of the documents. The items are indexed in shards of at most `shard` items. Null or blank texts and
    items of under 24 words give no rows; repeated documents give repeated rows.
    """
    spark = documents.sparkSession
    held = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    rows = sorted(tuple(r) for r in held.toLocalIterator())
    indexes = spark.sparkContext.broadcast([Index(rows[i : i + shard]) for i in range(0, len(rows), shard)])
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_finder(indexes), "doc_id long, item_id long, score double")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) of `matches`."""
    return matches(documents, items).select("doc_id", "item_id").distinct()


def _finder(indexes):  # noqa: ANN001, ANN202
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hits, scores = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = textnorm.words(text)
                for known in indexes.value:
                    for item, score in known.leaks(np.fromiter(map(known.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))).items():
                        docs.append(doc)
                        hits.append(known.ids[item])
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64()), pa.array(scores, pa.float64())], schema=_ARROW)

    return find
