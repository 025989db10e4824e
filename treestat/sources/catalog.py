"""Catalogue storage, exports, scan metadata and the crowded-directory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treestat.schema import ENTRIES, METADATA

#: Metadata keys of a scan that exports carry.
SCAN_KEYS = ("source_url", "start_time", "end_time", "duration_secs", "total_dirs", "total_files", "total_bytes", "error_count", "status", "worker_count")


SKETCHES = T.StructType([T.StructField("rows", T.LongType()), T.StructField("sketch", T.BinaryType())])


def measures() -> list[Column]:
    """What is known of rows from one pass: their number, and a mergeable sketch of their paths (estimates within 2 %)."""
    return [F.count("*").alias("rows"), F.hll_sketch_agg("path", 14).alias("sketch")]


def sketch_path(path: str) -> str:
    """Where the sketches of the catalogue at ``path`` are kept."""
    return f"{path.rstrip('/')}.sketches"


def write_sketch(spark: SparkSession, seen: dict, path: str) -> None:
    spark.createDataFrame([(seen["rows"], bytes(seen["sketch"]))], SKETCHES).coalesce(1).write.mode("overwrite").parquet(path)


def write_catalog(e: DataFrame, path: str, partitions: int | None = None) -> int:
    """Write a fresh catalogue in path order: point and prefix filters then skip files and row groups. The number of rows.

    Rows are counted and their paths sketched as they are written; the sketch lies beside the catalogue.
    """
    cols = [F.col("path")]
    ranged = e.repartitionByRange(partitions, *cols) if partitions else e.repartitionByRange(*cols)
    seen = Observation()
    rows = ranged.sortWithinPartitions("path").observe(seen, *measures())
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#inode", "true").parquet(path)
    write_sketch(e.sparkSession, seen.get, f"{sketch_path(path)}/part=written")
    return seen.get["rows"]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """One row for each written part of the catalogue at ``path`` and each ingested batch: rows, sketch."""
    return spark.read.schema(SKETCHES).option("basePath", sketch_path(path)).parquet(sketch_path(path)).select("rows", "sketch")


def export_catalog(e: DataFrame, metadata: DataFrame, big_dirs: DataFrame, out: str) -> DataFrame:
    """Write the three tables under ``out``; one row with the numbers converted, counted while they are written."""
    spark = e.sparkSession
    entries, seen = write_catalog(e, f"{out}/entries"), Observation()
    metadata.filter(F.col("key").isin(*SCAN_KEYS)).write.mode("overwrite").parquet(f"{out}/walk_info")
    big_dirs.select("path", "file_count").observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{out}/big_directories")
    return spark.createDataFrame([(entries, seen.get["rows"])], "entries_converted long, big_dirs_converted long")


def export_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, n: int = 1000) -> None:
    df.orderBy("path").limit(n).write.mode("overwrite").json(path)


def export_paths(df: DataFrame, path: str) -> None:
    df.select("path").write.mode("overwrite").text(path)


# --- metadata ------------------------------------------------------------------------------------


def _last(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", order)


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Insert or replace by ``key``. Works for metadata (``key``) and for crowded directories (``path``)."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return _last(both, key, "_seq")


def get(metadata: DataFrame, key: str) -> DataFrame:
    """One row with ``value``; NULL where the key is missing."""
    return metadata.filter(F.col("key") == key).agg(F.max("value").alias("value"))


def start_metadata(spark: SparkSession, source_url: str, start_time: int, workers: int) -> DataFrame:
    rows = {"source_url": source_url, "start_time": start_time, "status": "running", "worker_count": workers}
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], METADATA)


def finish_metadata(totals: DataFrame, end_time: int, duration_secs: int, completed: bool) -> DataFrame:
    """Metadata rows of a finished scan from its one-row totals (dirs, files, bytes, errors)."""
    status = "completed" if completed else "interrupted"
    return totals.select(
        F.expr(
            f"stack(7, 'end_time', '{int(end_time)}', 'duration_secs', '{int(duration_secs)}', 'total_dirs', cast(dirs as string), 'total_files', cast(files as string),"
            f" 'total_bytes', cast(bytes as string), 'error_count', cast(errors as string), 'status', '{status}') as (key, value)"
        )
    )
