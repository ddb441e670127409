"""Session defaults and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # building wide expressions is several times faster without call-site capture
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_local_roots: dict[str, str] = {}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults every operator here is tested under."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    A temporary folder is used only in local mode, where driver and executors share
    one machine. On a cluster an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="tremorline-")
    return _local_roots[context.applicationId]


_open_scopes: list[str] = []


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can write to."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the file system that Spark takes it for; a local one stays a plain path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(where)
    return full.toUri().getPath() if full.toUri().getScheme() == "file" else full.toString()


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, when results must have been written."""
    _open_scopes.append(f"{stage_root(spark)}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete_folder(spark, _open_scopes.pop())


def stage_folder(spark: SparkSession) -> str:
    """Where tables are staged: the open scope if there is one."""
    return _open_scopes[-1] if _open_scopes else stage_root(spark)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a staged table."""
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Shuffle files of a statement go when it ends, not when the driver collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Statements run inside leave no shuffle files."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    The table survives lost executors, cuts the lineage, keeps column pruning and
    filter pushdown for every reader, and gives the optimizer a true size, so that it
    broadcasts a staged lookup only when the lookup is below its threshold. It costs a
    write and a read of the table, and its files until the enclosing ``staging_scope``
    ends or, outside of one, until the folder is cleared. Its shuffle files go at once.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else stage_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
