"""Queries of the operators for training text, and SQL counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import runtime
from skein.llm import conversations, language, leaks, mixing, neighbours, splitting, toxicity
from skein.runtime import table


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.usable(neighbours.all_vectors(table(spark, folder, "chunk_vectors"), table(spark, folder, "vector_components")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = neighbours.nodes_of(_vectors(spark, folder), copies=11)
    return neighbours.mutual(neighbours.similar(nodes, neighbours.graph(nodes), k=10, least=0.90))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, folder))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of searches: fused vectors whose row number is divisible by 50."""
    rows = table(spark, folder, "chunk_vectors").where("vector_rowid % 50 = 0")
    return rows.select(F.lit("fused").alias("component"), "chunk_strategy", "embedding_model", "chunk_id").distinct()


def p1_search(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.searched(_vectors(spark, folder), _asked(spark, folder))


def p1_recall(spark: SparkSession, folder: str) -> DataFrame:
    vectors, asked = runtime.materialize(_vectors(spark, folder), "vectors"), _asked(spark, folder)
    made = neighbours.linked(vectors)
    near, walked = (neighbours.recall(vectors, found, asked) for found in (neighbours.nearest(vectors, made=made), neighbours.searched(vectors, asked, made=made)))
    return near.select(F.lit("neighbours").alias("by"), "*").unionByName(walked.select(F.lit("search").alias("by"), "*"))


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(*(table(spark, folder, t) for t in ("documents", "chunks", "surreal_golden_queries")))


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.segments(*(table(spark, folder, t) for t in ("documents", "chunks", "surreal_golden_queries")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.unlabelled(p2_languages(spark, folder))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.cut_kinds(p4_pieces(spark, folder))


def p4_audit(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.audit(table(spark, folder, "chunks"))


def p4_balance(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.balance(table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuilt(table(spark, folder, "telegram_messages"), table(spark, folder, "senders"))[1]


def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.sound(*conversations.rebuilt(table(spark, folder, "telegram_messages"), table(spark, folder, "senders")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).uses()


def p7_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).stream()


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report()


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.offences(p8_scores(spark, folder))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rates(p8_scores(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_recall": p1_recall, "p1_search": p1_search, "p2_found": p2_found, "p2_languages": p2_languages, "p2_segments": p2_segments, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_audit": p4_audit, "p4_balance": p4_balance, "p5_found": p5_found, "p5_conversations": p5_conversations, "p6_found": p6_found, "p7_uses": p7_uses, "p7_stream": p7_stream, "p7_report": p7_report, "p8_found": p8_found, "p8_rates": p8_rates, "p8_scores": p8_scores}

_SEEN = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}\p{Cc}\p{Cf}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{034f}\x{2800}\x{3164}\x{ffa0}\x{fe00}-\x{fe0f}\x{180b}-\x{180e}]"
P5 = rf"""
WITH rows AS (
  SELECT dialog_id, message_id, reply_to_msg_id, text, is_deleted,
         nullif(regexp_replace(lower(regexp_replace(sender, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '^@[\s\p{{Z}}]*', ''), '') AS who,
         row_number() OVER (PARTITION BY dialog_id, message_id ORDER BY edit_date DESC NULLS LAST, received_at DESC NULLS LAST, sender DESC NULLS LAST) AS k
  FROM telegram_messages WHERE dialog_id IS NOT NULL AND message_id IS NOT NULL),
last AS (SELECT *, coalesce(NOT is_deleted, true) AND coalesce(regexp_matches(text, '{_SEEN}'), false) AS visible FROM rows WHERE k = 1),
roles AS (SELECT nullif(regexp_replace(lower(trim(sender)), '^@\s*', ''), '') AS who, min(role) AS role FROM senders GROUP BY 1),
given AS (SELECT last.*, roles.who IS NOT NULL AS registered, role FROM last LEFT JOIN roles USING (who)),
dialogs AS (SELECT dialog_id, count(*) FILTER (message_id IS NULL) AS nameless FROM telegram_messages WHERE dialog_id IS NOT NULL GROUP BY 1),
state AS (SELECT dialog_id, bool_or(visible) AS shown, bool_or(visible AND NOT registered) AS strange,
                 min(message_id) FILTER (visible AND role = 'user') AS asked, max(message_id) FILTER (visible AND role = 'assistant') AS answered FROM given GROUP BY 1),
lost AS (SELECT DISTINCT g.dialog_id FROM given g WHERE visible AND reply_to_msg_id IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM last o WHERE o.dialog_id = g.dialog_id AND o.message_id = g.reply_to_msg_id))
SELECT d.dialog_id, 'empty' AS fault FROM dialogs d LEFT JOIN state USING (dialog_id) WHERE NOT coalesce(shown, false)
UNION SELECT d.dialog_id, 'broken' FROM dialogs d LEFT JOIN state USING (dialog_id) WHERE nameless > 0 OR coalesce(strange, false) OR d.dialog_id IN (SELECT dialog_id FROM lost)
UNION SELECT dialog_id, 'no_reply' FROM state WHERE shown AND NOT coalesce(asked < answered, false)
"""

CONVERSATIONS = P5.replace("SELECT dialog_id, message_id, reply_to_msg_id, text, is_deleted,", "SELECT dialog_id, message_id, reply_to_msg_id, text, is_deleted, sender, sent_at,", 1).replace("SELECT d.dialog_id, 'empty'", ", faults AS (SELECT d.dialog_id, 'empty'", 1) + """)
SELECT dialog_id, message_id, sender, role, sent_at AT TIME ZONE 'UTC' AS sent_at, text, reply_to_msg_id, visible, row_number() OVER (PARTITION BY dialog_id ORDER BY message_id) AS turn
FROM given WHERE visible AND dialog_id NOT IN (SELECT dialog_id FROM faults)
"""

ORACLES = {"p4_found": r"""
WITH sized AS (SELECT DISTINCT chunk_id, text, TRY_CAST(regexp_extract(chunk_strategy, '_(\d+)_(\d+)$', 1) AS BIGINT) AS size FROM chunks),
over AS (SELECT *, list_max(list_transform(regexp_split_to_array(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda r: strlen(r) // 4)) AS run
         FROM sized WHERE size > 0 AND strlen(text) // 4 > size)
SELECT chunk_id, CASE WHEN max(CASE WHEN run > size THEN 1 ELSE 0 END) = 1 THEN 'inside_run' ELSE 'natural' END AS cut FROM over GROUP BY chunk_id
""", "p4_audit": r"""
WITH sized AS (SELECT DISTINCT chunk_id, chunk_strategy, text, TRY_CAST(regexp_extract(chunk_strategy, '_(\d+)_(\d+)$', 1) AS BIGINT) AS size, TRY_CAST(regexp_extract(chunk_strategy, '_(\d+)_(\d+)$', 2) AS BIGINT) AS named FROM chunks),
over AS (SELECT *, CASE WHEN named < size THEN named ELSE size // 2 END AS overlap FROM sized WHERE size > 0 AND strlen(text) // 4 > size)
SELECT DISTINCT chunk_id, chunk_strategy, strlen(text) AS bytes, CAST(ceil((strlen(text) - 4 * overlap) / (4 * size + 3 - 4 * overlap)) AS BIGINT) AS least_pieces, true AS within, true AS whole FROM over
""", "p5_found": P5, "p5_conversations": CONVERSATIONS}
