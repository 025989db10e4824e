"""Listing batches as streams: append, running totals, upsert log, crowded-directory alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treestat.schema import ENTRIES, RAW_LISTING
from treestat.sources.catalog import measures, sketch_path, write_catalog
from treestat.sources.listing import normalize_listing
from treestat.sources.stored import BUCKETS, Stored, store


def listing_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Raw listing files as they arrive; the files per trigger bound what is in flight."""
    return spark.readStream.schema(RAW_LISTING).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append normalised rows to the catalogue at ``out``, exactly once."""
    return normalize_listing(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_sketches(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Number and sketch of the paths of each batch, beside the catalogue at ``out``: estimates follow what is ingested.

    Reads names alone. A replayed batch replaces its own sketch, and sketches of the same paths do not add up.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        df.agg(*measures()).coalesce(1).write.mode("overwrite").parquet(f"{sketch_path(out)}/part=batch{batch_id}")

    return normalize_listing(raw).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Outcomes of directories read (dir, outcome) as they arrive."""
    return spark.readStream.schema("dir string, outcome string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def totals(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Dirs, files and bytes of the rows seen and errors of the outcomes seen, batch or stream."""
    rows = entries.select("entry_type", "size", F.lit(False).alias("error"))
    failed = outcomes.select(F.lit(None).cast("int").alias("entry_type"), F.lit(None).cast("bigint").alias("size"), (F.col("outcome") != "ok").alias("error"))
    is_dir = F.col("entry_type") == 1
    return rows.unionByName(failed).agg(
        F.count_if(is_dir).alias("dirs"),
        F.count_if(~is_dir).alias("files"),
        F.coalesce(F.sum(F.when(~is_dir, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if("error").alias("errors"),
    )


def _replaced(out: str):
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def keep_latest(result: DataFrame, out: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Write each trigger's result to its own folder of ``out``; a replayed batch rewrites the same folder."""
    return result.writeStream.outputMode(mode).foreachBatch(_replaced(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(raw: DataFrame, outcomes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Totals so far of two streams, rows and outcomes, as one query."""
    return keep_latest(totals(normalize_listing(raw), outcomes), out, checkpoint, "complete")


def latest_batch(spark: SparkSession, out: str, schema) -> DataFrame:
    """Rows of the last trigger of a ``complete`` result."""
    log = spark.read.schema(f"{schema}, batch_id bigint").option("basePath", out).parquet(out)
    last = log.agg(F.max("batch_id").alias("batch_id"))
    return log.join(F.broadcast(last), "batch_id", "left_semi").drop("batch_id")  # one row


def upsert_log(raw: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append-only log of normalised rows with their order inside the batch; work follows the batch alone."""
    rows = normalize_listing(raw, "scan_seq")
    return rows.writeStream.foreachBatch(_replaced(log)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_view(spark: SparkSession, log: str, base: DataFrame | None = None) -> DataFrame:
    """One row per path: the last written over ``base`` and the log."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRIES)
    rows = spark.read.schema(f"{names}, scan_seq bigint, batch_id bigint").option("basePath", log).parquet(log)
    if base is not None:
        rows = rows.unionByName(base.withColumns({"scan_seq": F.lit(0).cast("bigint"), "batch_id": F.lit(-1).cast("bigint")}))
    cols = [f.name for f in ENTRIES if f.name != "path"]
    best = rows.groupBy("path").agg(F.max_by(F.struct(*cols), F.struct("batch_id", "scan_seq")).alias("r"))
    return best.select(*(F.col("path") if f.name == "path" else F.col(f"r.{f.name}").alias(f.name) for f in ENTRIES))


def compact(spark: SparkSession, log: str, new_base: str, base: DataFrame | None = None) -> None:
    """Write base and log as a new base version; never in place."""
    write_catalog(upsert_view(spark, log, base), new_base)


def compact_stored(spark: SparkSession, log: str, root: str, name: str, base: DataFrame | None = None, buckets: int = BUCKETS) -> Stored:
    """``compact`` into a stored catalogue: rows in buckets by path, the companion by inode and the sketch follow the log."""
    return store(upsert_view(spark, log, base), root, name, buckets)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each batch of a task counted by path, so that a crowded directory sends few rows to its state."""
    for pdf in frames:
        yield pdf.groupby("path", sort=False).size().rename("n").reset_index()


def _crossed(threshold: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (before,) = state.get if state.exists else (0,)
        after = before + sum(int(pdf["n"].sum()) for pdf in frames)
        state.update((after,))
        if before < threshold <= after:
            yield pd.DataFrame({"path": [key[0]], "file_count": [threshold], "seen": [after]})

    return step


def big_dir_alerts(raw: DataFrame, threshold: int, out: str, checkpoint: str) -> StreamingQuery:
    """One alert for each directory, when its count of non-directories reaches ``threshold``: path, file_count (the threshold),
    seen (the count by then). State is one counter a directory and survives restarts, so no directory alerts twice."""
    rows = normalize_listing(raw).filter("entry_type <> 1").select(F.col("parent_path").alias("path"))
    counts = rows.mapInPandas(_counted, "path string, n long").groupBy("path")
    alerts = counts.applyInPandasWithState(_crossed(threshold), "path string, file_count long, seen long", "n long", "append", GroupStateTimeout.NoTimeout)
    return keep_latest(alerts, out, checkpoint, "append")


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("path string, file_count bigint, seen bigint, batch_id bigint").option("basePath", out).parquet(out)
