"""Query of the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein import runtime
from skein.operators import change_feed


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    store = runtime.new_path(spark, "feed")
    state = change_feed.apply_changes(spark, runtime.table(spark, folder, "delta_changes"), store)
    return change_feed.present_rows(state).select("target_table", "ref", "fingerprint")


QUERIES = {"p3_found": p3_found}

ORACLES = {"p3_found": """
WITH rows AS (
  SELECT target_table, ref, change_no, fingerprint, lower(trim(change_type)) AS kind,
         TRY_CAST(regexp_extract(source_cursor, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS seq, coalesce(changed_at, deleted_at) AS happened
  FROM delta_changes WHERE target_table IS NOT NULL AND ref IS NOT NULL),
known AS (SELECT happened, max(seq) AS s FROM rows WHERE seq IS NOT NULL AND happened IS NOT NULL GROUP BY happened),
placed AS (SELECT rows.*, coalesce(seq, s) AS n FROM rows LEFT JOIN known USING (happened)),
last AS (
  SELECT *, row_number() OVER (PARTITION BY target_table, ref ORDER BY n DESC, (kind = 'upsert') DESC, change_no DESC) AS k
  FROM placed WHERE n IS NOT NULL AND kind IN ('upsert', 'tombstone'))
SELECT target_table, ref, fingerprint FROM last WHERE k = 1 AND kind = 'upsert'
"""}
