"""Session settings, the shared folder for intermediate tables, and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_LOCAL_FOLDER: dict[str, str] = {}
_TEMPORARY: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "skein", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; on a cluster pass the master through spark-submit."""
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("MASTER"):
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; where it is unset a temporary one on a single machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FOLDER[app])
    return _LOCAL_FOLDER[app]


def unique() -> str:
    return uuid.uuid4().hex


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table; drop_temporary deletes it."""
    path = f"{shared_folder(spark)}/{name}-{unique()}"
    _TEMPORARY.append(path)
    return path


def drop_temporary(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far; results that read them must have been taken. Returns how many."""
    n = len(_TEMPORARY)
    while _TEMPORARY:
        delete_path(spark, _TEMPORARY.pop())
    return n


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    write(df.write.mode("overwrite"), spark, path)
    return spark.read.schema(df.schema).parquet(path)


def write(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write an intermediate table; its shuffle files are deleted at once, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
