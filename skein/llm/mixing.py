"""Sources mixed to target shares of all tokens, by a low-discrepancy schedule.

Every source's documents are put in a shuffled order and cut into blocks of equal tokens. Slot i of the mixture takes the
source into whose cumulative weight the golden-ratio point frac((i + 1) * phi) falls, so that any run of slots has nearly the
target shares; the n-th slot of a source takes its n-th block, and begins again with the first after the last, at most max_repeats times.
Positions and ranks are sums over ranges and then inside a range, so that a source with a third of all rows is never one task's.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import runtime

#: The pattern of words of the byte-level vocabularies, and the golden ratio.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PHI = 0.6180339887498949
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    """The tokenizer of a vocabulary file, once a worker."""
    if path not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _ENCODERS[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def source_name(source: Column) -> Column:
    """A source however it is spelled; null for none."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[_\s]+", F.lit("-")), F.lit(""))


def counted(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source and tokens of every whole text; null texts have none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], schema=_ARROW)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").mapInArrow(count, "doc_id long, source string, tokens long")


def running(rows: DataFrame, key: str, order: list[str], size: Column, coarse: Column) -> DataFrame:
    """Adds `before`, the sum of size over the rows of the key before this one, in the order of (coarse, order)."""
    rows = rows.withColumn("_c", coarse)
    total = rows.groupBy(key, "_c").agg(F.sum(size).alias("_s"))
    offset = F.coalesce(F.sum("_s").over(Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = total.withColumn("_o", offset).drop("_s")
    inside = F.coalesce(F.sum(size).over(Window.partitionBy(key, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_i", inside).join(total, [key, "_c"]).withColumn("before", F.col("_o") + F.col("_i")).drop("_c", "_o", "_i")


class Mixture:
    """The plan of one mixture. total: tokens of the mixture; None takes the most for which every share can be met."""

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: int | None = None, block: int = 4096) -> None:
        spark = documents.sparkSession
        self.block = block
        self.counts = runtime.materialize(counted(documents, vocabulary).where("doc_id IS NOT NULL").distinct(), "tokens")
        self.bits = max(12, math.ceil(math.log2(max(1, self.counts.count()) / 50_000)) if self.counts.count() else 0)  # ranges of a source: about 50,000 rows each, if it has all
        self.targets = targets
        # At most a row a source with a target; sources without one take no part.
        wanted = targets.select(source_name(F.col("source")).alias("source"), F.nanvl("target_share", F.lit(None)).alias("share"), "max_repeats").where("source IS NOT NULL AND share > 0")
        wanted = wanted.groupBy("source").agg(F.max("share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
        held = self.counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        self.sources = sorted((r.source, r.share, max(1, r.repeats), r.tokens or 0) for r in wanted.join(held, "source", "left").collect())
        whole = sum(s for _, s, _, _ in self.sources)
        able = [(n, s / whole, r, t) for n, s, r, t in self.sources if t > 0]
        scale = sum(s for _, s, _, _ in able) or 1.0
        self.weights = {n: s / scale for n, s, _, _ in able}
        if total is None:
            total = int(min((t * r / self.weights[n] for n, _, r, t in able), default=0))
        # A source that cannot give its share of a given total gives what it may; the others share the rest.
        caps, open_, amounts, left = {n: t * r for n, _, r, t in able}, dict(self.weights), {}, float(total)
        while open_:
            unit = left / sum(open_.values())
            full = [n for n, w in open_.items() if caps[n] < w * unit - 1e-6]
            if not full:
                amounts |= {n: w * unit for n, w in open_.items()}
                break
            for n in full:
                amounts[n] = float(caps[n])
                left -= caps[n]
                del open_[n]
        self.amounts = amounts
        mixed = sum(amounts.values()) or 1.0
        self.cumulative, at = [], 0.0
        for n in sorted(amounts):
            self.cumulative.append((n, at, at + amounts[n] / mixed))
            at += amounts[n] / mixed
        self.slots = int(mixed // block) if amounts else 0
        self.spark = spark

    def _case(self, point: Column) -> Column:
        out = F.lit(self.cumulative[-1][0]) if self.cumulative else F.lit(None).cast("string")
        for name, _, end in reversed(self.cumulative[:-1]):
            out = F.when(point < end, name).otherwise(out)
        return out

    def schedule(self) -> DataFrame:
        """slot, source, rank: the source of each slot and which of its slots that is."""
        slots = self.spark.range(self.slots).withColumnRenamed("id", "slot")
        slots = slots.withColumn("source", self._case(F.expr(f"pmod((slot + 1) * {PHI!r}D, 1D)")))
        return running(slots, "source", ["slot"], F.lit(1), F.expr("slot div 16384")).withColumnRenamed("before", "rank")

    def placed(self) -> DataFrame:
        """doc_id, source, tokens, before: documents in the shuffled order of their source, with the tokens before each; those of no tokens or target are left out."""
        rows = self.counts.where("tokens > 0").join(F.broadcast(self.spark.createDataFrame([(n,) for n in self.amounts], "source string")), "source")
        rows = rows.withColumn("_h", F.xxhash64("doc_id", F.lit("mixture")))
        return running(rows, "source", ["_h", "doc_id"], F.col("tokens"), F.shiftright("_h", 64 - self.bits)).drop("_h")

    def _sizes(self) -> DataFrame:
        """source, n: the number of blocks of each source."""
        return self.counts.where("tokens > 0").groupBy("source").agg(F.ceil(F.sum("tokens") / self.block).cast("long").alias("n"))

    def uses(self) -> DataFrame:
        """doc_id, source, tokens, uses: how often each document of a source with a target is used.

        A source's slots go over its blocks again and again: full rounds use every document, the slots that are left the first blocks. A document counts with its first block.
        """
        taken = self.schedule().groupBy("source").agg(F.count("*").alias("slots"))
        limits = self.spark.createDataFrame([(n, r) for n, _, r, _ in self.sources], "source string, repeats int")
        per = F.broadcast(self._sizes().join(taken, "source", "left").join(limits, "source"))  # a row a source with a target
        extra = (F.col("block") < F.expr("coalesce(slots, 0) % n")).cast("int")
        rows = self.placed().withColumn("block", F.expr(f"before div {self.block}")).join(per, "source")
        return rows.select("doc_id", "source", "tokens", F.least(F.expr("coalesce(slots, 0) div n") + extra, F.col("repeats")).cast("int").alias("uses"))

    def stream(self) -> DataFrame:
        """slot, place, source, doc_id, begin_token, end_token: the mixture in the order of slot and place.

        A slot is a block of equal tokens (the last of a source may have fewer); a document that goes over the end of a block is continued where its source's next block is.
        """
        limits = F.broadcast(self._sizes().join(self.spark.createDataFrame([(n, r) for n, _, r, _ in self.sources], "source string, repeats int"), "source"))
        slots = self.schedule().join(limits, "source").where("rank div n < repeats").select("slot", "source", F.expr("rank % n").alias("block"))
        size = self.block
        parts = self.placed().withColumn("block", F.explode(F.expr(f"sequence(before div {size}, (before + tokens - 1) div {size})")))
        parts = parts.select("source", "doc_id", "block", F.expr(f"greatest(block * {size} - before, 0)").alias("begin_token"), F.expr(f"least((block + 1) * {size} - before, tokens)").alias("end_token"), "before")
        place = F.row_number().over(Window.partitionBy("source", "block").orderBy("before", "doc_id")) - 1  # a block has no more rows than tokens
        return slots.join(parts.withColumn("place", place).drop("before"), ["source", "block"]).select("slot", "place", "source", "doc_id", "begin_token", "end_token")

    def report(self) -> DataFrame:
        """source, target_share, reached_share, tokens, used_tokens, documents, most_uses: every target, also those without documents or without a share."""
        held = self.counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("documents"))
        used = self.uses().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
        wanted = self.targets.select(source_name(F.col("source")).alias("source"), F.nanvl("target_share", F.lit(None)).alias("share")).where("source IS NOT NULL").groupBy("source").agg(F.max("share").alias("target_share"))
        rows = wanted.join(held, "source", "left").join(used, "source", "left").na.fill(0, ["tokens", "documents", "used_tokens", "most_uses"])
        whole = F.sum("used_tokens").over(Window.partitionBy())  # a row a target
        return rows.withColumn("reached_share", F.col("used_tokens") / F.greatest(whole, F.lit(1))).select("source", "target_share", "reached_share", "tokens", "used_tokens", "documents", "most_uses")
