"""Items over a size limit cut into pieces within it: balanced targets, each snapped to the strongest boundary nearby.

The size of a text is its number of UTF-8 bytes divided by 4, rounded down. The least possible number of pieces gives
equal-length targets; each cut moves to the strongest boundary near its target (heading, paragraph, list item, line, sentence, clause, word) that
keeps this piece and what is left for the others within the limit; if a limit fails, targets are set anew for one more piece. A run without white
space is cut inside only if it is longer than the limit by itself. The next piece begins at the word start that shares at least the overlap; it shares
less only where the next word would otherwise not fit. Without their shared parts the pieces give the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "chunk_id string, chunk_strategy string, text_hash long, piece_no int, n_pieces int, begin_char int, end_char int, shared_chars int, boundary string, text string"
_ARROW = pa.schema([("chunk_id", pa.string()), ("chunk_strategy", pa.string()), ("text_hash", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("begin_char", pa.int32()), ("end_char", pa.int32()), ("shared_chars", pa.int32()), ("boundary", pa.string()), ("text", pa.string())])
NAMES = ("inside_run", "word", "clause", "sentence", "line", "item", "paragraph", "heading", "end")
_SPACE = re.compile(r"\s+")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_ROW = re.compile(r"^[ \t]*\|.*$", re.M)
_HEADING, _ITEM = re.compile(r"#{1,6}\s"), re.compile(r"(?:[-*+]|\d{1,3}[.)])\s")
_SENTENCE, _CLAUSE = frozenset(".!?…。！？"), frozenset(",;:)，；：")
LONG_WORD = 64  # bytes more than the overlap that are shared to begin at a word


def _bounds(text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every boundary: the character after it, the byte after it, its strength (index in NAMES). Lines of fenced code are as weak as clauses; table rows break at lines and words only."""
    fences = [m.start() for m in _FENCE.finditer(text)] if "```" in text or "~~~" in text else []
    rows = [(m.start(), m.end()) for m in _ROW.finditer(text)] if "|" in text else []
    at, strength = [], []
    fence = row = 0
    for m in _SPACE.finditer(text):
        begin, end = m.span()
        lines = text.count("\n", begin, end)
        while fence < len(fences) and fences[fence] < end:
            fence += 1
        while row < len(rows) and rows[row][1] <= begin:
            row += 1
        if fence % 2 and not (lines and fence and begin <= fences[fence - 1] <= end):  # inside code, but for the line before the fence
            kind = 2 if lines else 1
        elif lines:
            kind = 7 if _HEADING.match(text, end) else 6 if lines > 1 else 5 if _ITEM.match(text, end) else 4
        elif row < len(rows) and rows[row][0] <= begin:
            kind = 1
        else:
            before = text[begin - 1] if begin else ""
            kind = 3 if before in _SENTENCE else 2 if before in _CLAUSE else 1
        at.append(end)
        strength.append(kind)
    chars = np.array(at, dtype=np.int64)
    return chars, offsets[chars] if len(chars) else chars, np.array(strength, dtype=np.int64)


def _offsets(text: str) -> np.ndarray:
    """Byte offset of every character, and of the end."""
    if text.isascii():
        return np.arange(len(text) + 1, dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])


def least_pieces(total: int, size: int, overlap: int) -> int:
    """The fewest pieces that can hold total bytes with the overlap between them."""
    limit, shared = 4 * size + 3, 4 * overlap
    return 1 if total <= limit else -(-(total - shared) // (limit - shared))


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, end, kind of the boundary at the end as index in NAMES) of each piece, in characters.

    An overlap that leaves no room for anything new (at least the size) is taken as half of the size.
    """
    size = max(1, size)
    overlap = max(0, overlap) if overlap < size else size // 2
    limit, shared = 4 * size + 3, 4 * overlap
    offsets = _offsets(text)
    total = int(offsets[-1])
    if total <= limit:
        return [(0, len(text), 8)]
    bounds = _bounds(text, offsets)
    n = least_pieces(total, size, overlap)
    while True:
        pieces = _attempt(len(text), offsets, bounds, n, limit, shared)
        if pieces:
            return pieces
        n += max(1, n // 64)


def _attempt(length: int, offsets: np.ndarray, bounds: tuple, n: int, limit: int, shared: int) -> list | None:
    """n pieces, or None if a limit fails."""
    chars, places, strength = bounds
    total = int(offsets[-1])
    step = (total - shared) / n
    pieces, begin, last = [], 0, 0  # last: the byte of the cut before
    for k in range(1, n):
        most = int(offsets[begin]) + limit
        least = max(last + 1, total - (n - k) * (limit - shared))
        target = min(max(shared + k * step, least), most)
        if least > most:
            return None
        a, b = np.searchsorted(places, [max(least, target - step / 4), min(most, target + step / 4) + 1])
        if a == b:
            a, b = np.searchsorted(places, [least, most + 1])
        if a < b:
            strong = a + np.flatnonzero(strength[a:b] == strength[a:b].max())
            best = int(strong[np.abs(places[strong] - target).argmin()])
            cut, kind = int(chars[best]), int(strength[best])
        elif np.searchsorted(places, most, side="right") > np.searchsorted(places, last, side="right"):
            return None  # there are boundaries, but too early for the pieces that are left
        else:
            cut, kind = int(np.searchsorted(offsets, target, side="right")) - 1, 0
            if int(offsets[cut]) <= last:
                cut = int(np.searchsorted(offsets, most, side="right")) - 1
        if cut >= length:
            break
        pieces.append((begin, cut, kind))
        begin, last = _next_begin(begin, cut, kind, offsets, chars, places, limit, shared), int(offsets[cut])
    return [*pieces, (begin, length, 8)] if total - int(offsets[begin]) <= limit else None


def _next_begin(begin: int, cut: int, kind: int, offsets: np.ndarray, chars: np.ndarray, places: np.ndarray, limit: int, shared: int) -> int:
    """Where the next piece begins: at the last word start that shares the overlap, later if the next run would not fit."""
    end = int(offsets[cut])
    want = end - shared
    following = int(np.searchsorted(chars, cut, side="right"))
    reach = int(places[following]) if following < len(places) else int(offsets[-1])
    if kind == 0 or reach - end > limit:  # inside a run that is over the limit, or before one: share exactly
        exact = int(np.searchsorted(offsets, want))
        return exact if begin < exact < cut else cut
    i = int(np.searchsorted(places, want, side="right")) - 1
    if i >= 0 and want - int(places[i]) > LONG_WORD:
        i += 1
    for j in range(max(i, 0), following):
        if chars[j] > begin and reach - int(places[j]) <= limit:
            return int(chars[j])
    return cut


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, strategy, text, size, overlap, print_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cuts = split_text(text, size, overlap)
            before = 0
            for no, (begin, end, kind) in enumerate(cuts):
                rows.append((key, strategy, print_, no, len(cuts), begin, end, max(0, before - begin), NAMES[kind], text[begin:end]))
                before = end
        columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def oversized(chunks: DataFrame) -> DataFrame:
    """Distinct (chunk_id, chunk_strategy, text, size, overlap, text_hash) whose text is over the size named in the strategy `<name>_<size>_<overlap>`."""
    size = F.regexp_extract("chunk_strategy", r"_(\d+)_(\d+)$", 1).try_cast("int")
    overlap = F.regexp_extract("chunk_strategy", r"_(\d+)_(\d+)$", 2).try_cast("int")
    rows = chunks.select("chunk_id", "chunk_strategy", "text", size.alias("size"), overlap.alias("overlap"), F.xxhash64("text").alias("text_hash"))
    return rows.where("size > 0 AND octet_length(text) div 4 > size").dropDuplicates(["chunk_id", "chunk_strategy", "text"])


def split_oversized(chunks: DataFrame) -> DataFrame:
    """Numbered pieces of every chunk whose text is over the size in its chunk_strategy.

    Repeated rows count once; several texts under one chunk_id are told apart by text_hash. Null texts and strategies that name no size are within every limit and
    give no rows. Other columns of the chunks are left aside. No shuffle but that of the repeated oversized rows.
    """
    return oversized(chunks).mapInArrow(_pieces, PIECES)


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """One row a chunk: inside_run if a run without white space had to be cut, otherwise natural."""
    inside = F.max(F.when(F.col("boundary") == "inside_run", 1).otherwise(0)) == 1
    return pieces.groupBy("chunk_id").agg(F.when(inside, "inside_run").otherwise("natural").alias("cut"))


def _texts(chunks: DataFrame) -> DataFrame:
    """Of every oversized text its pieces put together again."""
    inner = F.expr("substring(text, shared_chars + 1, end_char)")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("piece_no", inner.alias("t")))), lambda x: x.t))
    shares = F.expr("CASE WHEN piece_no > 0 THEN octet_length(substring(text, 1, shared_chars)) END")
    piece = split_oversized(chunks).withColumn("bytes", F.octet_length("text"))
    found = piece.groupBy("chunk_id", "chunk_strategy", "text_hash").agg(
        F.count("*").alias("pieces"), F.min("bytes").alias("shortest"), F.max("bytes").alias("longest"), F.min(shares).alias("least_shared"), F.md5(joined).alias("joined"))
    rows = oversized(chunks).withColumn("bytes", F.octet_length("text")).withColumn("given", F.md5("text")).drop("text")
    share = F.expr("if(overlap < size, overlap, size div 2)")
    rows = rows.withColumn("overlap", share).withColumn("least_pieces", F.expr("cast(ceil((bytes - 4 * overlap) / (4 * size + 3 - 4 * overlap)) AS long)"))
    return rows.join(found, [rows[c].eqNullSafe(found[c]) for c in ("chunk_id", "chunk_strategy", "text_hash")]).select(
        rows["chunk_id"], rows["chunk_strategy"], "size", "overlap", "bytes", "least_pieces", "pieces", "shortest", "longest", "least_shared", (F.col("given") == F.col("joined")).alias("whole"))


def audit(chunks: DataFrame) -> DataFrame:
    """Distinct (chunk_id, chunk_strategy, bytes, least_pieces, within, whole): whether all pieces are within the limit, and give the text again."""
    within = F.col("longest") <= 4 * F.col("size") + 3
    return _texts(chunks).select("chunk_id", "chunk_strategy", "bytes", "least_pieces", within.alias("within"), "whole").distinct()


def balance(chunks: DataFrame) -> DataFrame:
    """Per strategy: texts, pieces, the least number of pieces there could be, the mean of shortest to longest piece, and the share of texts whose pieces all share the overlap."""
    rows = _texts(chunks)
    return rows.groupBy("chunk_strategy").agg(F.count("*").alias("texts"), F.sum("pieces").alias("pieces"), F.sum("least_pieces").alias("least_pieces"), F.avg(F.col("shortest") / F.col("longest")).alias("evenness"), F.avg((F.col("least_shared") >= 4 * F.col("overlap")).cast("double")).alias("overlap_kept"))
