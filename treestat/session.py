"""Session builder and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders handed out, by application.
_MADE: dict[str, list[str]] = {}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the library counts on: UTC and adaptive execution."""
    b = SparkSession.builder.master(master).appName("treestat")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=settings | conf).getOrCreate()


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder path that driver and executors both see.

    It lies under ``spark.checkpoint.dir``. Only where that is unset and all tasks run in this process (a local
    session, tests) a local temporary folder is taken; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        base = tempfile.mkdtemp(prefix="spark-treestat-")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df, what: str):
    """Cut lineage: write ``df`` to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession, *what: str) -> int:
    """Delete the working folders that this application was given, or those of the given kinds; their number.

    DataFrames that read them are void after that.
    """
    mine, jvm = _MADE.get(spark.sparkContext.applicationId, []), spark._jvm
    gone = [p for p in mine if not what or p.rsplit("/", 1)[1].rsplit("-", 1)[0] in what]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        mine.remove(p)
    return len(gone)
