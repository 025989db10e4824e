"""Catalogues stored for repeated use: rows lie in buckets by path, and a companion in buckets by inode.

Two catalogues with as many buckets meet by path without a shuffle, and lookups and joins by inode read the companion, of
which one inode's rows lie in one bucket. The writer resolves each row's parent to the inode of its directory, so that
question needs no join later. Rows are counted and their paths sketched while they are written.

The tables are external: their files lie under one folder, with the numbers that a session needs to attach them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from treestat.operators.lookups import one_per_inode
from treestat.operators.tree import with_parent_id
from treestat.session import written
from treestat.sources.catalog import measures, sketch_path, write_sketch

BUCKETS = 64


@dataclass(frozen=True)
class Stored:
    """The two tables of a stored catalogue in a session."""

    spark: SparkSession
    name: str
    root: str

    @property
    def by_path(self) -> DataFrame:
        return self.spark.table(f"{self.name}_by_path")

    @property
    def by_inode(self) -> DataFrame:
        """One row per inode: the one with the greatest path."""
        return self.spark.table(f"{self.name}_by_inode")


def _write(rows: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    dealt = rows.repartition(buckets, key).sortWithinPartitions(key)  # one file for each bucket
    dealt.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def store(e: DataFrame, root: str, name: str, buckets: int = BUCKETS) -> Stored:
    """Write ``e`` (with path, inode, and any further columns) under ``root`` as tables ``name``_by_path and _by_inode.

    A table name stands for one folder: storing again under the same name replaces it.
    """
    spark, seen = e.sparkSession, Observation()
    e = written(e, "to-store") if {"parent_path", "entry_type"} <= set(e.columns) else e  # read twice for the parents
    rows = with_parent_id(e) if {"parent_path", "entry_type"} <= set(e.columns) else e
    _write(rows.observe(seen, *measures()), f"{name}_by_path", f"{root}/by_path", "path", buckets)
    _write(one_per_inode(spark.table(f"{name}_by_path")), f"{name}_by_inode", f"{root}/by_inode", "inode", buckets)
    write_sketch(spark, seen.get, f"{sketch_path(root)}/part=written")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{root}/layout")
    return Stored(spark, name, root)


def attach(spark: SparkSession, root: str, name: str) -> Stored:
    """The catalogue stored under ``root`` as tables of this session."""
    buckets = spark.read.schema("buckets int").parquet(f"{root}/layout").first()["buckets"]
    for key in ("path", "inode"):
        at = f"{root}/by_{key}"
        columns = spark.read.parquet(at).schema.toDDL()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_by_{key} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{at}'")
    return Stored(spark, name, root)


def lookup_inode(stored: Stored, inode: int) -> DataFrame:
    """The row of one inode, out of one bucket."""
    return stored.by_inode.filter(F.col("inode") == inode)
