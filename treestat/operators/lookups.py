"""Lookups, filters and predicates over ``entries``. Each keeps its filter in a form that reaches the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treestat.functions import columns as C

DAY = 86400


def scan_ordered(e: DataFrame) -> DataFrame:
    return e.orderBy("path")


def by_path(e: DataFrame, path: str) -> DataFrame:
    return e.filter(F.col("path") == path)


def one_per_inode(e: DataFrame) -> DataFrame:
    """Hard links collapse to the row with the greatest path.

    Most inodes have one row, so nothing is gained by aggregating before rows are dealt by inode: they are dealt first and
    sorted once.
    """
    best = e.repartition("inode").groupBy("inode").agg(F.max_by(F.struct(*(c for c in e.columns if c != "inode")), "path").alias("r"))
    return best.select(*(F.col("inode") if c == "inode" else F.col(f"r.{c}").alias(c) for c in e.columns))


def by_inode(e: DataFrame, inode: int) -> DataFrame:
    return one_per_inode(e.filter(F.col("inode") == inode))


def contains(keys: DataFrame, e: DataFrame, on: str) -> DataFrame:
    """The keys (one column ``on``) that the catalogue has."""
    return keys.join(e.select(on), on, "left_semi")


def with_prefix(e: DataFrame, prefix: str) -> DataFrame:
    """Raw string prefix: ``/data`` also matches ``/database``."""
    return e.filter(F.col("path").startswith(prefix)).orderBy("path")


def exclude_paths(e: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Drop rows whose path any pattern (unanchored Java regex) finds."""
    for p in patterns:
        e.sparkSession._jvm.java.util.regex.Pattern.compile(p)  # a bad pattern raises here, not in a task
        e = e.filter(~F.col("path").rlike(p))
    return e


def dirs_only(e: DataFrame) -> DataFrame:
    return e.filter("entry_type = 1")


def max_depth(e: DataFrame, limit: int) -> DataFrame:
    """Directories deeper than ``limit`` are not read, so rows down to ``limit`` + 1 are kept."""
    return e.filter(F.col("depth") <= limit + 1)


def no_atime(e: DataFrame) -> DataFrame:
    return e.withColumn("atime", F.lit(None).cast("bigint"))


def large_files(e: DataFrame, over: int = 1 << 30) -> DataFrame:
    rows = e.filter(F.col("size") > over).select("path", "size").orderBy(F.desc("size"), "path")
    return rows.select("path", F.expr("size div 1073741824").alias("size_gb"))


def recently_modified(e: DataFrame, now: int, days: int = 7, n: int = 100) -> DataFrame:
    rows = e.filter((F.col("entry_type") == 0) & (F.col("mtime") > now - DAY * days))
    out = rows.select("path", "mtime", "size").orderBy(F.desc("mtime"), "path").limit(n)
    return out.select("path", C.format_time_sql(F.col("mtime")).alias("modified"), C.mb(F.col("size")).alias("size_mb"))


def stale_files(e: DataFrame, now: int, days: int = 365, n: int = 100) -> DataFrame:
    rows = e.filter((F.col("entry_type") == 0) & F.col("atime").isNotNull() & (F.col("atime") < now - DAY * days))
    out = rows.select("path", "atime", "size").orderBy(F.desc("size"), "path").limit(n)
    return out.select("path", C.format_time_sql(F.col("atime")).alias("accessed"), C.gb(F.col("size")).alias("size_gb"))


def world_writable(e: DataFrame, n: int = 100) -> DataFrame:
    rows = e.filter((F.col("entry_type") == 0) & F.col("mode").isNotNull() & (F.col("mode").bitwiseAND(2) == 2))
    return rows.select("path", C.octal(F.col("mode")).alias("perms"), "uid").orderBy("path").limit(n)
