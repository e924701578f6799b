"""Conversations from message rows: versions settled, roles given, broken ones set apart with the reason; and from export fragments, by assembly.

Message rows have a dialog and an order inside it, so that a dialog is rebuilt by its settled rows, and its faults are sums over them.

Export fragments have neither: `assembled` puts fragments (runs of messages in order, of unknown place) together by suffix-prefix matches of their
message hashes. Matches give the overlap graph of a dialog, of which unambiguous paths are merged by pointer doubling; a dialog
whose fragments do not end as one path has a gap, and `gaps` names it broken.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import runtime
from skein.llm import mixing, textnorm

LEAST = 3  # messages two fragments must share
_VISIBLE = rf"[^\s\p{{Z}}\p{{Cc}}{textnorm.INVISIBLE}]"


def handle(name: Column) -> Column:
    """A handle without case, outer white space and a leading @; null for an empty one."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"^@[\s\p{Z}]*", ""), F.lit(""))


def settled(messages: DataFrame) -> DataFrame:
    """One row a message: that with the latest edit_date (null is earliest), of equals the one received last. Partial sums before the shuffle."""
    rows = messages.where("dialog_id IS NOT NULL AND message_id IS NOT NULL")
    fields = ["edit_date", "received_at", "sender", "sent_at", "text", "reply_to_msg_id", "topic_id", "is_deleted"]
    last = F.max(F.struct(*[F.col(f) for f in fields])).alias("m")
    return rows.groupBy("dialog_id", "message_id").agg(last).select("dialog_id", "message_id", *[f"m.{f}" for f in fields if f not in ("edit_date", "received_at")])


def with_roles(messages: DataFrame, senders: DataFrame, limit: int = 200_000) -> DataFrame:
    """Settled messages with role (null if the sender is missing or unknown) and visible."""
    roles = senders.select(handle(F.col("sender")).alias("who"), "role").where("who IS NOT NULL").groupBy("who").agg(F.min("role").alias("role"))
    if senders.count() <= limit:  # beyond it the join shuffles
        roles = F.broadcast(roles)
    rows = messages.withColumn("who", handle(F.col("sender"))).join(roles.withColumn("registered", F.lit(True)), "who", "left")
    visible = ~F.coalesce("is_deleted", F.lit(False)) & F.coalesce(F.col("text").rlike(_VISIBLE), F.lit(False))
    return rows.withColumn("visible", visible).withColumn("registered", F.coalesce("registered", F.lit(False))).drop("who")


_EDGE = "dialog_id long, frag long, n int, suffix boolean, whole boolean, print long"
_BASE = 0x9E3779B97F4A7C15


def _prints(key, messages):  # noqa: ANN001, ANN202
    """The hash of every prefix and of every suffix of a fragment of at least LEAST messages."""
    import pandas as pd

    h = messages.sort_values("pos")["hash"].to_numpy().astype(np.int64).view(np.uint64)
    n = len(h)
    base = np.full(n + 1, _BASE, dtype=np.uint64)
    back = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    base[0] = back[0] = 1
    power, undo = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
    sizes = np.arange(min(LEAST, n), n + 1)
    prefix, suffix = sums[sizes], (sums[n] - sums[n - sizes]) * undo[n - sizes]
    return pd.DataFrame({"dialog_id": key[0], "frag": key[1], "n": np.tile(sizes, 2).astype(np.int32), "suffix": np.repeat([False, True], len(sizes)), "whole": np.tile(sizes == n, 2), "print": np.concatenate([prefix, suffix]).view(np.int64)})


def assembled(fragments: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (dialog_id, frag, path, place, shared): the path a fragment belongs to, its place on it, and how many messages it shares with the one before.

    fragments: dialog_id, frag, pos, hash, a row a message; a fragment is one export, which one task holds. A fragment follows another where a suffix of the one is, message by
    message, a prefix of the other (at least LEAST messages, the longest counts). Equal fragments and those that are a prefix or suffix of another add nothing and take its
    path, place -1. Steps that follow from two others are no steps of their own; places
    with several possible successors or predecessors end a path. Paths are merged in as many rounds as the logarithm of the longest.
    """
    spark = fragments.sparkSession
    kept = fragments.where("dialog_id IS NOT NULL AND frag IS NOT NULL AND hash IS NOT NULL").select("dialog_id", "frag", F.col("pos").cast("long").alias("pos"), "hash").dropDuplicates(["dialog_id", "frag", "pos"])
    prints = runtime.materialize(kept.groupBy("dialog_id", "frag").applyInPandas(_prints, _EDGE), "prints")
    ends = prints.where("suffix").select("dialog_id", F.col("frag").alias("a"), "n", "print", F.col("whole").alias("a_whole"))
    begins = prints.where("NOT suffix").select("dialog_id", F.col("frag").alias("b"), "n", "print", F.col("whole").alias("b_whole"))
    pairs = runtime.materialize(ends.join(begins, ["dialog_id", "n", "print"]).where("a <> b"), "pairs")
    # b is held by a: all of b is the end of a; a is held by b: all of a is the begin of b. Of equal ones the first stays.
    held = pairs.where("b_whole AND (NOT a_whole OR a < b)").select("dialog_id", F.col("b").alias("frag"), F.col("a").alias("holder"))
    held = held.unionByName(pairs.where("a_whole AND NOT b_whole").select("dialog_id", F.col("a").alias("frag"), F.col("b").alias("holder")))
    held = held.groupBy("dialog_id", "frag").agg(F.min("holder").alias("holder"))
    free = prints.where("suffix AND whole").select("dialog_id", "frag").join(held, ["dialog_id", "frag"], "left_anti")
    edges = pairs.where("NOT a_whole AND NOT b_whole").groupBy("dialog_id", "a", "b").agg(F.max("n").alias("shared"))
    edges = edges.join(free.withColumnRenamed("frag", "a"), ["dialog_id", "a"]).join(free.withColumnRenamed("frag", "b"), ["dialog_id", "b"])
    # Transitive reduction: what follows from two steps through a fragment between is no step of its own.
    sizes = prints.where("suffix AND whole").select("dialog_id", F.col("frag").alias("b"), F.col("n").alias("size"))
    onward = edges.select("dialog_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("shared").alias("next"))
    through = edges.join(onward, ["dialog_id", "b"]).join(sizes, ["dialog_id", "b"]).select("dialog_id", "a", F.col("c").alias("b"), (F.col("shared") + F.col("next") - F.col("size")).cast("int").alias("shared")).distinct()
    edges = runtime.materialize(edges.join(through, ["dialog_id", "a", "b", "shared"], "left_anti"), "edges")
    edges = edges.withColumn("after", F.count("*").over(Window.partitionBy("dialog_id", "a"))).withColumn("before", F.count("*").over(Window.partitionBy("dialog_id", "b"))).where("after = 1 AND before = 1")
    back = edges.select("dialog_id", F.col("b").alias("frag"), F.col("a").alias("head"), "shared")
    now = free.join(back, ["dialog_id", "frag"], "left").select("dialog_id", "frag", F.coalesce("head", "frag").alias("head"), F.col("head").isNotNull().cast("long").alias("place"), F.coalesce("shared", F.lit(0)).alias("shared"))
    for _ in range(rounds):
        now = runtime.materialize(now, "paths")
        hop = now.select("dialog_id", F.col("frag").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        if not now.where("head <> frag").join(hop.where("further <> head"), ["dialog_id", "head"], "left_semi").take(1):
            break
        now = now.join(hop, ["dialog_id", "head"]).select("dialog_id", "frag", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), "shared")
    paths = now.select("dialog_id", "frag", F.col("head").alias("path"), "place", "shared")
    inside = held.join(paths.select("dialog_id", F.col("frag").alias("holder"), "path"), ["dialog_id", "holder"], "left").select("dialog_id", "frag", F.coalesce("path", "holder").alias("path"), F.lit(-1).cast("long").alias("place"), F.lit(0).alias("shared"))
    return paths.unionByName(inside)


def merged(fragments: DataFrame, paths: DataFrame) -> DataFrame:
    """The messages of fragments in the order of their paths, each shared one once: dialog_id, path, place, pos and the other columns of the fragments."""
    rows = fragments.join(paths.where("place >= 0"), ["dialog_id", "frag"])
    first = F.row_number().over(Window.partitionBy("dialog_id", "frag").orderBy("pos")) > F.col("shared")
    return rows.withColumn("_new", first).where("_new").drop("_new", "shared", "frag")


def gaps(paths: DataFrame) -> DataFrame:
    """(dialog_id, fault): dialogs whose fragments do not make one path."""
    return paths.where("place >= 0").groupBy("dialog_id").agg(F.count_distinct("path").alias("n")).where("n > 1").select("dialog_id", F.lit("broken").alias("fault"))


def rebuilt(messages: DataFrame, senders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled messages of all dialogs, faults of dialogs).

    Messages: dialog_id, message_id, sender, role, sent_at, text, reply_to_msg_id, visible. Faults: dialog_id, fault:
    empty, broken, no_reply as TESTDATA.md defines them. Rows without dialog_id belong to no dialog.
    """
    rows = runtime.materialize(with_roles(settled(messages), senders), "messages")
    known = rows.select("dialog_id", F.col("message_id").alias("reply_to_msg_id"))
    lost = rows.where("visible AND reply_to_msg_id IS NOT NULL").select("dialog_id", "reply_to_msg_id").distinct().join(known, ["dialog_id", "reply_to_msg_id"], "left_anti")
    users, answers = (F.when(F.col("visible") & (F.col("role") == r), F.col("message_id")) for r in ("user", "assistant"))
    state = rows.groupBy("dialog_id").agg(F.max("visible").alias("shown"), F.min(users).alias("asked"), F.max(answers).alias("answered"), F.max(F.col("visible") & ~F.col("registered")).alias("strange"))
    # Of rows without message_id it only counts that a dialog has them, of lost replies too.
    nameless = messages.where("dialog_id IS NOT NULL AND message_id IS NULL").select("dialog_id", F.lit(True).alias("marked"))
    marked = nameless.unionByName(lost.select("dialog_id", F.lit(True).alias("marked"))).distinct()
    yes = lambda c: F.coalesce(c, F.lit(False))
    dialogs = state.join(marked, "dialog_id", "full")
    found = F.array(F.when(~yes(F.col("shown")), "empty"), F.when(yes(F.col("marked")) | yes(F.col("strange")), "broken"), F.when(yes(F.col("shown")) & ~yes(F.col("asked") < F.col("answered")), "no_reply"))
    faults = dialogs.select("dialog_id", F.explode(found).alias("fault")).where("fault IS NOT NULL")
    return rows.select("dialog_id", "message_id", "sender", "role", "sent_at", "text", "reply_to_msg_id", "visible"), faults


def sound(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """The visible messages of dialogs without fault, numbered through each dialog by turn, from 1. Long dialogs are numbered by ranges of messages."""
    shown = rows.where("visible").join(faults.select("dialog_id").distinct(), "dialog_id", "left_anti")
    placed = mixing.running(shown, "dialog_id", ["message_id"], F.lit(1), F.expr("message_id div 4096"))
    return placed.withColumn("turn", F.col("before") + 1).drop("before")
