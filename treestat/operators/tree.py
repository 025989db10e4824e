"""Directory operators: direct statistics, crowded directories, recursive sizes, parent ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treestat.functions import columns as C

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def dir_direct_stats(e: DataFrame) -> DataFrame:
    kind = F.col("entry_type")
    return e.groupBy("parent_path").agg(
        F.count_if(kind == 0).alias("files"),
        F.count_if(kind == 1).alias("dirs"),
        F.count_if(kind == 2).alias("symlinks"),
        F.count_if(~kind.isin(0, 1, 2)).alias("others"),
        F.coalesce(F.sum(F.when(kind == 0, F.col("size"))), _zero()).alias("bytes"),
        F.count("*").alias("total"),
    )


def dir_stats(e: DataFrame) -> DataFrame:
    """Direct statistics keyed by the directory's own row; empty directories have zeros."""
    dirs = e.filter("entry_type = 1").select(F.col("inode").alias("entry_id"), "path")
    joined = dirs.join(dir_direct_stats(e), dirs["path"] == F.col("parent_path"), "left")
    return joined.select("entry_id", "path", *(F.coalesce(c, _zero()).alias(f"direct_{c}") for c in ("files", "dirs", "symlinks", "others", "bytes")))


def with_parent_id(e: DataFrame) -> DataFrame:
    """``e`` with the inode of each row's parent directory; NULL under the start directory."""
    dirs = e.filter("entry_type = 1").select(F.col("path").alias("parent_path"), F.col("inode").alias("parent_id"))
    return e.join(dirs, "parent_path", "left").select(*e.columns, "parent_id")


def parent_id(e: DataFrame) -> DataFrame:
    """path, inode, parent_id. Catalogues written by ``sources.stored`` have parent_id as a column."""
    return with_parent_id(e.select("path", "inode", "parent_path", "entry_type")).select("path", "inode", "parent_id")


def tree_size(e: DataFrame, n: int | None = 20) -> DataFrame:
    """Files and bytes below every directory. Sums per parent first, so the fan-out is directories x depth."""
    direct = e.filter("entry_type = 0").groupBy("parent_path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    spread = direct.select(F.explode(C.ancestors(F.col("parent_path"))).alias("path"), "files", "bytes")
    out = spread.groupBy("path").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return out if n is None else out.orderBy(F.desc("bytes"), "path").limit(n)


def big_dirs(e: DataFrame, threshold: int = 1_000_000) -> DataFrame:
    """Directories with at least ``threshold`` non-directories: the capped count and the exact one."""
    if threshold < 1:
        raise ValueError("threshold must be 1 or more")
    out = e.filter("entry_type <> 1").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("exact_count"))
    return out.filter(F.col("exact_count") >= threshold).select("path", F.least("exact_count", F.lit(threshold).cast("bigint")).alias("file_count"), "exact_count")


def big_dir_scan(e: DataFrame, paths: DataFrame, threshold: int) -> DataFrame:
    """For each of the given directories (column ``path``), empty ones too: capped count, whether the cap was hit,
    names of sub-directories.

    Entries are counted by directory where they are read, before anything is shuffled or joined, so a crowded directory
    sends one row from each task; of its names only those of directories are kept.
    """
    is_dir = F.col("entry_type") == 1
    found = e.groupBy(F.col("parent_path").alias("path")).agg(F.count_if(~is_dir).alias("n"), F.collect_list(F.when(is_dir, F.col("name"))).alias("names"))
    joined = paths.select("path").distinct().join(found, "path", "left")
    count = F.coalesce("n", _zero())
    return joined.select(
        "path",
        F.least(count, F.lit(threshold).cast("bigint")).alias("file_count"),
        (count >= threshold).alias("threshold_hit"),
        F.sort_array(F.coalesce("names", F.array().cast("array<string>"))).alias("subdirs"),
    )


def big_dir_check(e: DataFrame, threshold: int) -> DataFrame:
    """Counts every entry, directories too."""
    out = e.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n"))
    return out.select("path", F.when(F.col("n") >= threshold, "IsBig").otherwise("NotBig").alias("verdict"), "n")


def big_dir_summary(e: DataFrame, threshold: int) -> DataFrame:
    """Directories scanned (the start directory too), big ones found, the threshold."""
    dirs = e.agg((F.count_if(F.col("entry_type") == 1) + 1).alias("dirs_scanned"), _zero().alias("big_dirs_found"))
    found = big_dirs(e, threshold).agg(_zero().alias("dirs_scanned"), F.count("*").alias("big_dirs_found"))
    both = dirs.unionByName(found).agg(F.sum("dirs_scanned").alias("dirs_scanned"), F.sum("big_dirs_found").alias("big_dirs_found"))
    return both.withColumn("threshold", F.lit(threshold).cast("bigint"))


def walk_totals(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """Directories read, non-directories, their bytes, errors: of listing outcomes and of the rows they gave."""
    ok, is_dir = F.col("outcome") == "ok", F.col("entry_type") == 1
    a = outcomes.agg(F.count_if(ok).alias("dirs"), _zero().alias("files"), _zero().alias("bytes"), F.count_if(~ok).alias("errors"))
    b = rows.agg(_zero().alias("dirs"), F.count_if(~is_dir).alias("files"), F.coalesce(F.sum(F.when(~is_dir, F.col("size"))), _zero()).alias("bytes"), _zero().alias("errors"))
    return a.unionByName(b).agg(*(F.sum(c).alias(c) for c in ("dirs", "files", "bytes", "errors")))
