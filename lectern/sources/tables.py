"""Reading the input tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of a data directory, narrowed to ``columns`` so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset (tests), a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Spark's setting that removes the files of a query's shuffles when the query ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str = "t", free: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs only the rereading of files. The folder is removed when the
    driver ends. ``free`` removes the files of the write's shuffles at once, not when the driver happens to collect
    its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(temporary(path, spark))
    finally:
        if free and before is None:
            spark.conf.unset(FREE)
        elif free:
            spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def temporary(path: str, spark: SparkSession) -> str:
    """``path``, which is removed when the driver ends."""
    if not _made:
        atexit.register(_clean, spark)
    _made.add(path)
    return path


def _clean(spark: SparkSession) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session is gone already; local folders can still be removed
        import shutil

        for path in _made:
            if path.startswith("file:"):
                shutil.rmtree("/" + path.split(":", 1)[1].lstrip("/"), ignore_errors=True)
