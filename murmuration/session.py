"""Sessions that the plans expect: UTC, adaptive plans, Arrow."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "murmuration", **settings: str) -> SparkSession:
    """The running session, or a new one; master and memory come from spark-submit or from settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. A temporary one is made only where that is unset and
    the session runs in one process; on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("murmuration.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="murmuration-")
        spark.conf.set("murmuration.shared.dir", found)
    return found.rstrip("/")


_written: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; drop_written() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df through the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def drop(table: DataFrame) -> None:
    """Deletes a table that written() returned, once nothing reads it any more, nor what is made of it lazily."""
    path = _paths.pop(table)
    _delete(table.sparkSession, path)
    _written.remove(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that this process has written to the shared folder, once nothing reads them; returns how many."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n
