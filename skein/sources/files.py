"""Markdown files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking

#: Directories that are never read, unless configured otherwise.
EXCLUDED = (".git", ".obsidian", ".trash", "node_modules", "__pycache__", ".venv")


def excluded_names(patterns: list[str]) -> list[str]:
    """Directory names of patterns such as **/name/** ; patterns with wildcards inside are ignored."""
    names = (p.strip("*/") for p in patterns)
    return list(dict.fromkeys(n for n in names if n and not set(n) & set("*?[/")))


def is_excluded(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def discover(spark: SparkSession, paths: list[str], exclude: list[str] | None = None) -> DataFrame:
    """path, modified, size_bytes, text of *.md under directories, files and globs: each file once, none empty, none in an excluded directory."""
    if not paths:
        raise ValueError("no path given")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(paths)
    clean = F.regexp_replace("path", r"^file:/*", "/")
    rows = files.where("length > 0").select(clean.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(~is_excluded(F.col("path"), excluded_names(list(EXCLUDED if exclude is None else exclude)))).dropDuplicates(["path"])


def file_info(files: DataFrame) -> DataFrame:
    """Adds frontmatter (map), title, kind, tags, body and both fingerprints."""
    rows = files.withColumn("frontmatter", chunking.frontmatter_map(chunking.frontmatter_block(F.col("text")))).withColumn("body", chunking.body_text(F.col("text")))
    rows = rows.withColumn("title", chunking.title(F.col("frontmatter"), F.col("body"), F.col("path")))
    rows = rows.withColumn("kind", F.coalesce(F.try_element_at("frontmatter", F.lit("kind")), F.lit("note")))
    tags = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("frontmatter", F.lit("tags")), F.lit("")), ","), lambda s: F.trim(s)), lambda t: t != "")
    rows = rows.withColumn("tags", tags)
    return rows.withColumn("content_fingerprint", T.chunk_checksum("kind", "body")).withColumn("meta_fingerprint", T.meta_checksum("title", "tags"))


def source_documents(files: DataFrame) -> DataFrame:
    """Files as documents of the filesystem namespace."""
    return files.select(F.lit("filesystem").alias("namespace"), F.col("path").alias("document_ref"), T.reference(F.lit("filesystem"), "path").alias("ref"), "title", F.lit("text/markdown").alias("media_type"), "kind", "text", "content_fingerprint", "meta_fingerprint")


def diff(current: DataFrame, known: DataFrame) -> DataFrame:
    """path, change: new, modified, touched (same content, other time), unchanged or deleted.

    current: path, modified, size_bytes, checksum; known: the same of the last run. Equal time and size need no checksum.
    """
    k = known.select("path", F.col("modified").alias("_m"), F.col("size_bytes").alias("_s"), F.col("checksum").alias("_c"), F.lit(True).alias("_k"))
    rows = current.withColumn("_n", F.lit(True)).join(k, "path", "full_outer")
    change = (F.when(F.col("_k").isNull(), "new").when(F.col("_n").isNull(), "deleted").when((F.col("modified") == F.col("_m")) & (F.col("size_bytes") == F.col("_s")), "unchanged")
              .when(F.col("checksum").eqNullSafe(F.col("_c")), "touched").otherwise("modified"))
    return rows.select("path", change.alias("change"))


def route(current: DataFrame, known: DataFrame) -> DataFrame:
    """path, route: rechunk where the content differs or is new, reembed where only title or tags do, else skip."""
    k = known.select("path", F.col("content_fingerprint").alias("_c"), F.col("meta_fingerprint").alias("_m"))
    rows = current.join(k, "path", "left")
    return rows.select("path", F.when(~F.col("content_fingerprint").eqNullSafe(F.col("_c")), "rechunk").when(~F.col("meta_fingerprint").eqNullSafe(F.col("_m")), "reembed").otherwise("skip").alias("route"))


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries from JSON lines; blank lines are skipped."""
    item = "array<struct<ref:string,contains:string>>"
    schema = f"id string, query string, category string, languages array<string>, primary_surface string, expected_engines array<string>, relevant {item}, maybe {item}, broad_query boolean, notes string"
    return spark.read.schema(schema).json(path).where("id IS NOT NULL")


def jdbc_snapshot(spark: SparkSession, url: str, tables: list[str], driver: str = "org.sqlite.JDBC") -> dict[str, DataFrame]:
    """Tables of a database through JDBC; the driver's jar must be on the class path."""
    return {t: spark.read.format("jdbc").options(url=url, dbtable=t, driver=driver).load() for t in tables}
