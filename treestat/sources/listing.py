"""From raw listing rows to entries, and the parallel listing job over a mounted tree."""

from __future__ import annotations

import os
import re
import stat as st
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treestat.functions import columns as C
from treestat.schema import ENTRIES, RAW_LISTING
from treestat.session import shared_dir


def normalize_listing(raw: DataFrame, *keep: str) -> DataFrame:
    """Drop ``.`` and ``..``; build path, type, depth, extension; zeros and NULLs where there were no attributes.

    ``keep`` names raw columns to carry along.
    """
    kind = C.type_from_code(F.col("type_code"))
    path = C.join_path(F.col("parent_path"), F.col("name"))
    out = raw.filter(~C.is_dot(F.col("name"))).select(
        "parent_path",
        "name",
        path.alias("path"),
        kind.alias("entry_type"),
        F.coalesce("size", F.lit(0)).alias("size"),
        "mtime", "atime", "ctime", "mode", "uid", "gid", "nlink",
        F.coalesce("inode", F.lit(0)).alias("inode"),
        (F.col("parent_depth") + 1).alias("depth"),
        F.coalesce(C.blocks_of(F.col("used")), F.lit(0)).alias("blocks"),
        C.extension(F.col("name"), kind).alias("extension"),
        *keep,
    )
    return out.select(*(F.col(f.name).cast(f.dataType) for f in ENTRIES), *keep)


#: Rows of a directory, then its outcome; or a directory that a task hands back (outcome ``PENDING``), with its name as bytes.
_LISTED = T.StructType([T.StructField("dir", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("raw", T.BinaryType()), *RAW_LISTING.fields])
_FRONTIER = "raw binary, path string, depth int"
#: File-type bits to protocol code.
_CODES = {st.S_IFREG: 1, st.S_IFDIR: 2, st.S_IFLNK: 5, st.S_IFBLK: 3, st.S_IFCHR: 4, st.S_IFSOCK: 6, st.S_IFIFO: 7}
CHUNK = 10_000
PENDING = "pending"
#: Entries that a task lists before it hands back what it has not read: at first, while there is one task, and later.
FIRST_BUDGET, BUDGET = 2_000, 200_000


def _list_dirs(frames: Iterator[pd.DataFrame], budget: int, max_depth: int | None, exclude: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of directories and of those below them in chunks, after each directory one outcome row: ``ok`` or the kind of error.

    A task goes down from its directories until it has listed ``budget`` entries; directories not read by then are handed back.
    """
    names = [f.name for f in _LISTED]
    patterns = [re.compile(p) for p in exclude]
    todo: list[tuple[bytes, str, int]] = []
    rows: list[tuple] = []
    listed = 0

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names).astype(object)
        rows.clear()
        return out

    def read(raw: bytes, path: str, depth: int) -> Iterator[pd.DataFrame]:
        nonlocal listed
        outcome = "ok"
        try:
            with os.scandir(raw) as it:
                for k, x in enumerate(it):
                    listed += 1
                    try:
                        s = x.stat(follow_symlinks=False)
                        stat = (_CODES.get(st.S_IFMT(s.st_mode), 0), s.st_size, s.st_blocks * 512, s.st_mode, s.st_uid, s.st_gid, s.st_nlink, int(s.st_mtime), int(s.st_atime), int(s.st_ctime))
                    except OSError:
                        stat = (None,) * 10
                    name = x.name.decode("utf-8", "replace")
                    rows.append((path, None, None, path, name, x.inode(), depth, k, *stat))
                    if stat[0] == 2 and (max_depth is None or depth < max_depth):
                        below = f"/{name}" if path == "/" else f"{path}/{name}"
                        if not any(p.search(below) for p in patterns):
                            todo.append((x.path, below, depth + 1))
                    if len(rows) >= CHUNK:
                        yield frame()
        except OSError as e:
            outcome = type(e).__name__
        rows.append((path, outcome, None, path, None, None, depth, None, *(None,) * 10))

    for pdf in frames:
        todo += [(bytes(raw), path, int(depth)) for raw, path, depth in zip(pdf["raw"], pdf["path"], pdf["depth"])]
        while todo and listed < budget:
            yield from read(*todo.pop())
        for raw, path, depth in todo:
            rows.append((path, PENDING, raw, path, None, None, depth, None, *(None,) * 10))
            if len(rows) >= CHUNK:
                yield frame()
        todo.clear()
    if rows:
        yield frame()


def _local(root: str) -> str:
    """The path of a local root; other stores are refused."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", root)
    if not scheme:
        return root
    if scheme[1] != "file":
        raise ValueError(f"{root} is not a mounted tree: list_store lists what Spark's file systems read")
    return "/" + root[len("file:") :].lstrip("/")


def list_tree(spark: SparkSession, root: str, max_depth: int | None = None, dirs_only: bool = False, exclude: list[str] | None = None, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Entries below ``root``, a tree mounted on all executors, and one outcome per directory read.

    Tasks go down their part of the tree until they have listed ``budget`` entries and hand back the rest, which is dealt
    anew; so the number of jobs follows the size of the tree and not its depth. What a job lists is written to the shared
    folder: a lost executor repeats only its part and lineage stays short. Unreadable directories are counted, not fatal.
    Symbolic links are not followed. ``exclude`` patterns (in what Java and Python share) drop rows and stop the descent. A root in another store
    is refused.
    """
    for p in exclude or []:
        re.compile(p)
    path, out, turn = _local(root), shared_dir(spark, "listing"), 0
    frontier = spark.createDataFrame([(os.fsencode(path), path, 0)], _FRONTIER)
    while True:
        most = budget if turn else min(FIRST_BUDGET, budget)
        tasks = max(1, spark.sparkContext.defaultParallelism * 4) if turn else 1
        rows = frontier.repartition(tasks).mapInPandas(lambda frames: _list_dirs(frames, most, max_depth, exclude or []), _LISTED)
        rows.write.parquet(f"{out}/turn={turn}")
        left = spark.read.schema(_LISTED).parquet(f"{out}/turn={turn}").filter(F.col("outcome") == PENDING)
        frontier = left.select("raw", F.col("dir").alias("path"), F.col("parent_depth").alias("depth"))
        turn += 1
        if frontier.isEmpty():
            break
    listed = spark.read.schema(_LISTED).option("basePath", out).parquet(*(f"{out}/turn={k}" for k in range(turn)))
    entries = normalize_listing(listed.filter("outcome IS NULL"))
    for p in exclude or []:
        entries = entries.filter(~F.col("path").rlike(p))
    if dirs_only:
        entries = entries.filter("entry_type = 1")
    return entries, listed.filter(F.col("outcome") != PENDING).select("dir", "outcome")


def list_store(spark: SparkSession, root: str) -> DataFrame:
    """Entries below ``root`` in any store that Spark reads: files as the store lists them, directories as the files' paths
    name them. Such stores give name, size and time only; the rest is as for entries without attributes, and empty directories are not seen.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    inner = F.expr(f"substring(path, {len(base) + 2})")  # below the root
    files = found.select(F.concat(F.lit(f"{base}/"), inner).alias("path"), F.lit(1).alias("type_code"), "size", "mtime", (F.size(F.split(inner, "/")) - 1).alias("parent_depth"))
    parts = F.split(inner, "/")
    steps = found.filter(F.size(parts) > 1).select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    dirs = steps.select(F.concat(F.lit(f"{base}/"), F.array_join(F.slice("p", 1, F.col("k")), "/")).alias("path"), (F.col("k") - 1).alias("parent_depth")).distinct()
    dirs = dirs.withColumns({"type_code": F.lit(2), "size": F.lit(0).cast("bigint"), "mtime": F.lit(None).cast("bigint")})
    rows = files.unionByName(dirs).withColumns({"parent_path": F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)"), "name": F.substring_index("path", "/", -1)})
    missing = {f.name: F.lit(None).cast(f.dataType) for f in RAW_LISTING if f.name not in rows.columns}
    return normalize_listing(rows.withColumns(missing))
