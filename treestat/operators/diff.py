"""What changed between two scans.

Every question starts from one full join of the scans on the path, written once: matched paths, paths of the current
scan alone and paths of the baseline alone are parts of it, so each scan is read and shuffled by path once. Only the
paths of the current scan alone take part in the second join, on the inode.

That join is made and written to the shared folder when a question is asked, not when its DataFrame is run (``session.clean``
removes it). A caller with several questions about the same scans makes ``paired`` once and hands it to each. Scans that are
stored as ``sources.stored`` writes them need neither: ``stored_changes`` reads them twice and shuffles no path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treestat.session import written


def paired(cur: DataFrame, base: DataFrame, lazy: bool = False) -> DataFrame:
    """Both scans side by side: path, in_cur, in_base, inode, mtime, size, and b_inode, b_mtime, b_size of the baseline.

    The result is written at once, unless ``lazy``.
    """
    new = cur.select("path", F.lit(True).alias("in_cur"), "inode", "mtime", "size")
    old = base.select("path", F.lit(True).alias("in_base"), F.col("inode").alias("b_inode"), F.col("mtime").alias("b_mtime"), F.col("size").alias("b_size"))
    return new.join(old, "path", "full") if lazy else written(new.join(old, "path", "full"), "paired")


def _matched(both: DataFrame) -> DataFrame:
    same = (F.col("inode") == F.col("b_inode")) & F.col("mtime").eqNullSafe(F.col("b_mtime")) & (F.col("size") == F.col("b_size"))
    kind = F.when(same, "Unchanged").otherwise("Modified")
    return both.filter("in_cur AND in_base").select("path", kind.alias("change"), F.lit(None).cast("string").alias("old_path"), "size")


def _moved_or_new(both: DataFrame, by_inode: DataFrame | None = None) -> DataFrame:
    if by_inode is None:
        by_inode = both.filter("in_base").groupBy(F.col("b_inode").alias("inode")).agg(F.max("path").alias("old_path"))
    rest = both.filter("in_cur AND in_base IS NULL").select("path", "inode", "size").join(by_inode, "inode", "left")
    return rest.select("path", F.when(F.col("old_path").isNull(), "New").otherwise("Renamed").alias("change"), "old_path", "size")


def _gone(both: DataFrame) -> DataFrame:
    return both.filter("in_base AND in_cur IS NULL").select("path", F.col("b_inode").alias("inode"), F.col("b_size").alias("size"))


def _gone_for_good(both: DataFrame) -> DataFrame:
    moved = _moved_or_new(both).filter("old_path IS NOT NULL").select(F.col("old_path").alias("path"))
    return _gone(both).join(moved, "path", "left_anti")


def changes(cur: DataFrame, base: DataFrame, both: DataFrame | None = None) -> DataFrame:
    """One row per current entry: path, change, old_path, size.

    A path of the baseline is Modified if inode, mtime or size differ, else Unchanged. Another path whose inode
    the baseline has is Renamed from the greatest path of that inode; the rest is New.
    """
    both = paired(cur, base) if both is None else both
    return _matched(both).unionByName(_moved_or_new(both))


def deleted_paths(cur: DataFrame, base: DataFrame) -> DataFrame:
    return base.select("path", "inode", "size").join(cur.select("path"), "path", "left_anti")


def deleted_not_renamed(cur: DataFrame, base: DataFrame, both: DataFrame | None = None) -> DataFrame:
    return _gone_for_good(paired(cur, base) if both is None else both)


def change_summary(cur: DataFrame, base: DataFrame, both: DataFrame | None = None) -> DataFrame:
    both = paired(cur, base) if both is None else both
    gone = _gone_for_good(both).select(F.lit("Deleted").alias("change"), "size")
    rows = _matched(both).unionByName(_moved_or_new(both)).select("change", "size").unionByName(gone)
    return rows.groupBy("change").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def stored_changes(cur: DataFrame, base: DataFrame, base_by_inode: DataFrame) -> DataFrame:
    """``changes`` of two catalogues stored by path with as many buckets, and the baseline's companion by inode.

    Both joins find the stored rows where they lie; only the paths that the current scan has alone are shuffled.
    """
    both = paired(cur, base, lazy=True)
    old = base_by_inode.select("inode", F.col("path").alias("old_path"))
    return _matched(both).unionByName(_moved_or_new(both, old))
