"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Wide aggregations build thousands of expressions; recording a stack trace for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "quillframe", master: str | None = None, **extra) -> SparkSession:
    """A session with the settings the operators expect; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SESSION_SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of this machine, which is removed at the end.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="quillframe-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark).rstrip('/')}/{app}/{label}-{uuid.uuid4().hex}"


_TABLES: list[str] = []  # paths written by ``write_out`` and not yet removed


def scratch_tables() -> list[str]:
    return list(_TABLES)


def remove_tables(spark: SparkSession, paths) -> None:
    """Delete scratch tables that no DataFrame in use still reads."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
        if path in _TABLES:
            _TABLES.remove(path)


def write_out(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The result no longer depends on the input's lineage, so a lost executor cannot change
    row placement, and later steps prune columns of the written table.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
