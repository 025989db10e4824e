"""Reports over ``entries``: totals, usage by group, top-N lists, duplicates, permissions.

Top-N ties are broken by the path or the group key, ascending. ``n`` = 0 gives no rows, None all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treestat.functions import columns as C

TOP = 20
#: Paths of one duplicate group in a cell.
PAGE = 100_000


def _files(e: DataFrame) -> DataFrame:
    return e.filter("entry_type = 0")


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0).cast("bigint"))


def _top(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    out = df.orderBy(*order)
    return out if n is None else out.limit(n)


# --- overviews -----------------------------------------------------------------------------------


def overview(e: DataFrame) -> DataFrame:
    is_file = F.col("entry_type") == 0
    return e.agg(
        F.count("*").alias("total_entries"),
        F.count_if(is_file).alias("total_files"),
        F.count_if(F.col("entry_type") == 1).alias("total_dirs"),
        F.count_if(F.col("entry_type") == 2).alias("total_symlinks"),
        _sum(F.when(is_file, F.col("size"))).alias("total_bytes"),
        _sum(F.when(is_file, F.col("blocks"))).alias("total_blocks"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )


def overview_gb(e: DataFrame) -> DataFrame:
    return e.agg(
        F.count("*").alias("total_entries"),
        F.count_if(F.col("entry_type") == 0).alias("files"),
        F.count_if(F.col("entry_type") == 1).alias("directories"),
        F.count_if(F.col("entry_type") == 2).alias("symlinks"),
        C.gb(F.sum("size")).alias("total_gb"),
        C.gb(F.sum("blocks") * 512).alias("allocated_gb"),
        F.max("depth").alias("max_depth"),
    )


def allocation(e: DataFrame) -> DataFrame:
    logical, on_disk = F.sum("size"), C.allocated(F.sum("blocks"))
    percent = F.round(100.0 * on_disk.cast("double") / F.nullif(logical, F.lit(0)).cast("double"), 1)
    return _files(e).agg(C.gb(logical).alias("logical_gb"), C.gb(on_disk).alias("allocated_gb"), percent.alias("percent"))


def count_entries(e: DataFrame) -> DataFrame:
    return e.agg(F.count("*").alias("entries"))


def approx_entries(sketches: DataFrame) -> DataFrame:
    """Estimated number of different paths from the sketches of written parts (``sketch``); the catalogue is not read."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("bigint")).alias("entries"))


# --- usage by group ------------------------------------------------------------------------------


def by_extension(e: DataFrame, n: int = TOP) -> DataFrame:
    groups = _files(e).groupBy(F.coalesce("extension", F.lit("")).alias("extension"))
    out = groups.agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"), F.sum("blocks").alias("total_blocks"))
    return _top(out, n, F.desc("total_bytes"), "extension")


def by_extension_gb(e: DataFrame, n: int = TOP) -> DataFrame:
    groups = _files(e).groupBy("extension").agg(F.count("*").alias("file_count"), F.sum("size").alias("total"), F.sum("blocks").alias("blocks"))
    out = _top(groups.withColumn("ext", F.coalesce("extension", F.lit("(none)"))), n, F.desc("total"), "ext")
    return out.select("ext", "file_count", C.gb(F.col("total")).alias("size_gb"), C.gb(C.allocated(F.col("blocks"))).alias("allocated_gb"))


def _by_owner(e: DataFrame, who: str, n: int) -> DataFrame:
    out = e.groupBy(F.coalesce(who, F.lit(0).cast("bigint")).alias(who)).agg(
        F.count_if(F.col("entry_type") == 0).alias("file_count"),
        F.count_if(F.col("entry_type") == 1).alias("dir_count"),
        _sum(F.when(F.col("entry_type") == 0, F.col("size"))).alias("total_bytes"),
    )
    return _top(out, n, F.desc("total_bytes"), who)


def by_uid(e: DataFrame, n: int = TOP) -> DataFrame:
    return _by_owner(e, "uid", n)


def by_gid(e: DataFrame, n: int = TOP) -> DataFrame:
    return _by_owner(e, "gid", n)


def _by_owner_gb(e: DataFrame, who: str, n: int) -> DataFrame:
    out = e.groupBy(who).agg(
        F.count_if(F.col("entry_type") == 0).alias("files"), F.count_if(F.col("entry_type") == 1).alias("dirs"), F.sum("size").alias("total")
    )
    out = _top(out, n, F.desc("total"), F.asc_nulls_first(who))
    return out.select(who, "files", "dirs", C.gb(F.col("total")).alias("size_gb"))


def by_uid_gb(e: DataFrame, n: int = TOP) -> DataFrame:
    return _by_owner_gb(e, "uid", n)


def by_gid_gb(e: DataFrame, n: int = TOP) -> DataFrame:
    return _by_owner_gb(e, "gid", n)


def by_top_dir(e: DataFrame, n: int | None = None) -> DataFrame:
    groups = _files(e).groupBy(C.top_dir(F.col("path")).alias("top_dir"))
    out = _top(groups.agg(F.count("*").alias("files"), F.sum("size").alias("total")), n, F.desc("total"), "top_dir")
    return out.select("top_dir", "files", C.gb(F.col("total")).alias("size_gb"))


def permissions(e: DataFrame, n: int = TOP) -> DataFrame:
    groups = _files(e).filter("mode IS NOT NULL").groupBy(C.octal(F.col("mode")).alias("perms"))
    out = _top(groups.agg(F.count("*").alias("files"), F.sum("size").alias("total")), n, F.desc("files"), "perms")
    return out.select("perms", "files", C.gb(F.col("total")).alias("size_gb"))


# --- directories ---------------------------------------------------------------------------------


def largest_dirs(e: DataFrame, n: int = TOP) -> DataFrame:
    """Direct children of any type; the parent comes from the path and slash-less paths are dropped."""
    groups = e.filter(F.col("path").contains("/") & (F.col("path") != "/")).groupBy(C.parent_of(F.col("path")).alias("dir_path"))
    return _top(groups.agg(F.count("*").alias("entry_count")), n, F.desc("entry_count"), "dir_path")


def largest_dirs_files(e: DataFrame, n: int = TOP) -> DataFrame:
    out = _files(e).groupBy("parent_path").agg(F.count("*").alias("file_count"), F.sum("size").alias("total"))
    return _top(out, n, F.desc("file_count"), "parent_path").select("parent_path", "file_count", C.gb(F.col("total")).alias("size_gb"))


def dir_sizes(e: DataFrame, n: int | None = None) -> DataFrame:
    out = _files(e).groupBy("parent_path").agg(F.count("*").alias("files"), F.sum("size").alias("total"))
    return _top(out, n, F.desc("total"), "parent_path").select("parent_path", "files", F.expr("total div 1073741824").alias("size_gb"))


# --- top-N lists ---------------------------------------------------------------------------------


def largest_files(e: DataFrame, n: int = TOP) -> DataFrame:
    return _top(_files(e).select("path", "size"), n, F.desc("size"), "path")


def largest_files_gb(e: DataFrame, n: int = TOP, zone: str = "UTC") -> DataFrame:
    out = _top(_files(e).select("path", "size", "mtime"), n, F.desc("size"), "path")
    return out.select("path", C.gb(F.col("size")).alias("size_gb"), C.format_time_sql(F.col("mtime"), zone).alias("modified"))


def oldest_files(e: DataFrame, n: int = TOP) -> DataFrame:
    """NULL times sort first."""
    return _top(_files(e).select("path", "mtime", "size"), n, F.asc_nulls_first("mtime"), "path")


def oldest_files_known(e: DataFrame, n: int = TOP, zone: str = "UTC") -> DataFrame:
    out = _top(_files(e).filter("mtime IS NOT NULL").select("path", "mtime", "size"), n, "mtime", "path")
    return out.select("path", C.format_time_sql(F.col("mtime"), zone).alias("modified"), C.mb(F.col("size")).alias("size_mb"))


def most_links(e: DataFrame, n: int = TOP) -> DataFrame:
    """A NULL link count is 1; there is no minimum."""
    return _top(_files(e).select("path", F.coalesce("nlink", F.lit(1)).alias("nlink"), "size"), n, F.desc("nlink"), "path")


def most_links_gt1(e: DataFrame, n: int = TOP) -> DataFrame:
    out = _top(_files(e).filter("nlink > 1").select("path", "nlink", "size"), n, F.desc("nlink"), "path")
    return out.select("path", "nlink", C.mb(F.col("size")).alias("size_mb"))


def duplicate_pages(e: DataFrame, n: int = TOP, page: int = PAGE) -> DataFrame:
    """Candidates by (name, size), ranked by size * count; only the ranked groups' paths are collected.

    The paths of a group come in pages of about ``page``, dealt by inode and sorted in themselves, so a group of any
    size is neither one task's nor one cell's. A group within ``page`` has page 0 alone.
    """
    files = _files(e).filter("size > 0")
    ranked = files.groupBy("name", "size").agg(F.count("*").alias("copies")).filter("copies > 1")
    top = _top(ranked, n, (F.col("size") * F.col("copies")).desc(), "name", "size")
    rows = files.select("name", "size", "path", "inode").join(F.broadcast(top), ["name", "size"])  # at most n rows
    number = F.pmod(F.col("inode"), F.ceil(F.col("copies") / F.lit(page))).alias("page")
    paged = rows.select("name", "size", "copies", number, "path").groupBy("name", "size", "copies", "page")
    return paged.agg(F.array_join(F.sort_array(F.collect_list("path")), "\n").alias("paths"))


def duplicates(e: DataFrame, n: int = TOP) -> DataFrame:
    """``duplicate_pages``: one row a group, but for groups of over ``PAGE`` paths, which have one row a page."""
    return duplicate_pages(e, n).drop("page")


#: Reports that ``reports`` can make in one pass: key, values of a row, whether rows are summed by key, and the order of
#: the result (position of the value and whether the least come first). Keys are text; ``uid`` and ``gid`` are ordered as numbers.
REPORTS: dict[str, tuple[str, tuple[str, ...], bool, tuple[int, bool]]] = {
    "by_extension": ("extension", ("one", "size", "blocks"), True, (1, False)),
    "largest_files": ("path", ("size",), False, (0, False)),
    "largest_dirs": ("parent", ("all",), True, (0, False)),
    "oldest_files": ("path", ("mtime", "size"), False, (0, True)),
    "most_links": ("path", ("links", "size"), False, (0, False)),
    "by_uid": ("uid", ("one", "dirs", "size"), True, (2, False)),
    "by_gid": ("gid", ("one", "dirs", "size"), True, (2, False)),
}
#: Groups that a task keeps of one report before it hands them on.
_GROUPS = 200_000


def _partial(batches: Iterator[pa.RecordBatch], names: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """Of each report: sums by key of the rows of a task, or its first ``n`` rows. All reports see a batch in turn."""
    made: dict[str, list[pa.Table]] = {name: [] for name in names}

    def reduced(name: str, t: pa.Table) -> pa.Table:
        _, values, summed, (by, least) = REPORTS[name]
        if summed:
            out = t.group_by("key").aggregate([(f"v{k}", "sum") for k in range(len(values))])
            return out.select(["key", *(f"v{k}_sum" for k in range(len(values)))]).rename_columns(["key", *(f"v{k}" for k in range(len(values)))])
        place = pc.sort_indices(t, sort_keys=[(f"v{by}", "ascending" if least else "descending"), ("key", "ascending")], null_placement="at_start")
        return t.take(place[:n])

    def flushed(name: str) -> pa.RecordBatch:
        t = reduced(name, pa.concat_tables(made[name])).combine_chunks()
        made[name] = []
        cols = {c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c] for c in t.column_names}
        return pa.RecordBatch.from_arrays([pa.array([name] * len(t), pa.string()), cols["key"], *(cols.get(f"v{k}", pa.nulls(len(t), pa.int64())) for k in range(3))], ["report", "key", "v0", "v1", "v2"])

    for b in batches:
        t = pa.Table.from_batches([b])
        is_file = pc.equal(t["entry_type"], 0)
        for name in names:
            key, values, summed, _ = REPORTS[name]
            rows = t if name in ("largest_dirs", "by_uid", "by_gid") else t.filter(is_file)
            rows = rows.filter(pc.is_valid(rows[key]))
            part = pa.table([rows[key], *(rows[v] for v in values)], ["key", *(f"v{k}" for k in range(len(values)))])
            made[name].append(reduced(name, part))
            if len(made[name]) >= 8:
                made[name] = [reduced(name, pa.concat_tables(made[name]))]
            if summed and sum(map(len, made[name])) > _GROUPS:
                yield flushed(name)
    for name in names:
        if made[name]:
            yield flushed(name)


def reports(e: DataFrame, names: Iterable[str], n: int = TOP) -> DataFrame:
    """Several reports in one pass over the catalogue: report, rank, key, v0, v1, v2.

    Values by report: by_extension files, bytes, blocks; largest_files size; largest_dirs entries; oldest_files mtime, size;
    most_links links, size; by_uid and by_gid files, directories, bytes. Order and ties are those of the report itself. A task
    keeps sums and the first rows of all reports as it reads (Spark has no aggregate of the first n rows, and seven jobs
    or a kept scan cost more); what tasks hand on is summed and ranked, with the ranking cut before rows are dealt.
    """
    names = list(names)
    if bad := [x for x in names if x not in REPORTS]:
        raise ValueError(f"no such report: {bad}")
    is_file = F.col("entry_type") == 0
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = e.select(
        "path", "entry_type", "mtime", F.col("blocks"),
        F.coalesce("extension", F.lit("")).alias("extension"),
        F.when(F.col("path").contains("/") & (F.col("path") != "/"), C.parent_of(F.col("path"))).alias("parent"),
        *(F.coalesce(x, zero).cast("string").alias(x) for x in ("uid", "gid")),
        F.when(is_file, F.col("size")).otherwise(zero).alias("size"),
        F.coalesce("nlink", one).alias("links"),
        F.when(is_file, one).otherwise(zero).alias("one"), F.when(F.col("entry_type") == 1, one).otherwise(zero).alias("dirs"), one.alias("all"),
    )
    parts = rows.mapInArrow(lambda batches: _partial(batches, names, n), "report string, key string, v0 long, v1 long, v2 long")
    value = lambda k: F.sum(f"v{k}").alias(f"v{k}")  # noqa: E731  rows of a file have one part
    whole = parts.groupBy("report", "key").agg(*map(value, range(3)))
    up = F.coalesce(*(F.when(F.col("report") == x, F.col(f"v{by}")) for x, (_, _, _, (by, least)) in REPORTS.items() if least))
    down = F.coalesce(*(F.when(F.col("report") == x, F.col(f"v{by}")) for x, (_, _, _, (by, least)) in REPORTS.items() if not least))
    number = F.when(F.col("report").isin("by_uid", "by_gid"), F.col("key").cast("bigint"))
    order = Window.partitionBy("report").orderBy(up.asc_nulls_first(), down.desc_nulls_last(), number, "key")
    ranked = whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("report", F.col("rank").cast("bigint").alias("rank"), "key", "v0", "v1", "v2")
