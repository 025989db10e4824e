"""Every query by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treestat.functions import columns as C
from treestat.operators import diff, lookups, reports, tree
from treestat.plans import fixtures as X

from treestat.session import shared_dir
from treestat.sources import catalog, listing, stored
from treestat.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = 904_608_000  # a reference time inside the data
BIG = 30  # threshold of crowded directories at these sizes
_GB, _MB = "round(CAST({} AS DOUBLE)/1024/1024/1024, 2)", "round(CAST({} AS DOUBLE)/1024/1024, 2)"
_I = lambda x: f"CAST({x} AS BIGINT)"
_STAMP = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M:%S')"
_COLS = "parent_path, name, path, entry_type, size, mtime, atime, ctime, mode, uid, gid, nlink, inode, depth, blocks, extension"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = X.oracle(sql)


def _on_entries(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda spark, d: f(X.entries(spark, d)), sql)


# --- reports -------------------------------------------------------------------------------------

_on_entries("overview", reports.overview, f"""SELECT count(*) AS total_entries, count_if(entry_type = 0) AS total_files, count_if(entry_type = 1) AS total_dirs,
  count_if(entry_type = 2) AS total_symlinks, {_I("coalesce(sum(size) FILTER (entry_type = 0), 0)")} AS total_bytes,
  {_I("coalesce(sum(blocks) FILTER (entry_type = 0), 0)")} AS total_blocks, coalesce(max(depth), 0) AS max_depth FROM ent""")
_on_entries("overview_gb", reports.overview_gb, f"""SELECT count(*) AS total_entries, count_if(entry_type = 0) AS files, count_if(entry_type = 1) AS directories,
  count_if(entry_type = 2) AS symlinks, {_GB.format("sum(size)")} AS total_gb, {_GB.format("sum(blocks) * 512")} AS allocated_gb, max(depth) AS max_depth FROM ent""")
_on_entries("allocation", reports.allocation, f"""SELECT {_GB.format("sum(size)")} AS logical_gb, {_GB.format("sum(blocks) * 512")} AS allocated_gb,
  round(100.0::DOUBLE * CAST(sum(blocks) * 512 AS DOUBLE) / CAST(nullif(sum(size), 0) AS DOUBLE), 1) AS percent FROM ent WHERE entry_type = 0""")
_on_entries("count_entries", reports.count_entries, "SELECT count(*) AS entries FROM ent")


def _approx(spark: SparkSession, d: str) -> DataFrame:
    """The estimate from the sketches of a written catalogue, held against the rows counted in writing it."""
    out = shared_dir(spark, "catalog")
    rows = catalog.write_catalog(X.entries(spark, d), out)
    estimate = reports.approx_entries(catalog.read_sketches(spark, out))
    return estimate.select(F.lit(rows).cast("long").alias("entries"), (F.abs(F.col("entries") - rows) * 20 <= rows).alias("within_5_percent"))


_add("approx_entries", _approx, "SELECT count(*) AS entries, true AS within_5_percent FROM ent")
_on_entries("by_extension", reports.by_extension, f"""SELECT coalesce(extension, '') AS extension, count(*) AS file_count, {_I("sum(size)")} AS total_bytes,
  {_I("sum(blocks)")} AS total_blocks FROM ent WHERE entry_type = 0 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20""")
_on_entries("by_extension_gb", reports.by_extension_gb, f"""SELECT coalesce(extension, '(none)') AS ext, count(*) AS file_count, {_GB.format("sum(size)")} AS size_gb,
  {_GB.format("sum(blocks) * 512")} AS allocated_gb FROM ent WHERE entry_type = 0 GROUP BY extension ORDER BY sum(size) DESC, 1 LIMIT 20""")
for _who in ("uid", "gid"):
    _on_entries(f"by_{_who}", getattr(reports, f"by_{_who}"), f"""SELECT coalesce({_who}, 0) AS {_who}, count_if(entry_type = 0) AS file_count, count_if(entry_type = 1) AS dir_count,
      {_I("coalesce(sum(size) FILTER (entry_type = 0), 0)")} AS total_bytes FROM ent GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 20""")
    _on_entries(f"by_{_who}_gb", getattr(reports, f"by_{_who}_gb"), f"""SELECT {_who}, count_if(entry_type = 0) AS files, count_if(entry_type = 1) AS dirs,
      {_GB.format("sum(size)")} AS size_gb FROM ent GROUP BY 1 ORDER BY sum(size) DESC, 1 NULLS FIRST LIMIT 20""")
_on_entries("by_top_dir", reports.by_top_dir, f"""SELECT '/' || split_part(path, '/', 2) AS top_dir, count(*) AS files, {_GB.format("sum(size)")} AS size_gb
  FROM ent WHERE entry_type = 0 GROUP BY 1 ORDER BY sum(size) DESC, 1""")
_on_entries("permissions", reports.permissions, f"""SELECT CAST((mode & 511) >> 6 AS VARCHAR) || CAST(((mode & 511) >> 3) & 7 AS VARCHAR) || CAST(mode & 7 AS VARCHAR) AS perms, count(*) AS files,
  {_GB.format("sum(size)")} AS size_gb FROM ent WHERE entry_type = 0 AND mode IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
_PARENT = "CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END"
_on_entries("largest_dirs", reports.largest_dirs, f"SELECT {_PARENT} AS dir_path, count(*) AS entry_count FROM ent GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_on_entries("largest_dirs_files", reports.largest_dirs_files, f"""SELECT parent_path, count(*) AS file_count, {_GB.format("sum(size)")} AS size_gb
  FROM ent WHERE entry_type = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
_on_entries("dir_sizes", reports.dir_sizes, f"""SELECT parent_path, count(*) AS files, {_I("sum(size) // 1073741824")} AS size_gb FROM ent WHERE entry_type = 0
  GROUP BY 1 ORDER BY sum(size) DESC, 1""")
_on_entries("largest_files", reports.largest_files, "SELECT path, size FROM ent WHERE entry_type = 0 ORDER BY size DESC, path LIMIT 20")
_on_entries("largest_files_gb", reports.largest_files_gb, f"""SELECT path, {_GB.format("size")} AS size_gb, {_STAMP.format("mtime")} AS modified
  FROM ent WHERE entry_type = 0 ORDER BY size DESC, path LIMIT 20""")
_on_entries("oldest_files", reports.oldest_files, "SELECT path, mtime, size FROM ent WHERE entry_type = 0 ORDER BY mtime NULLS FIRST, path LIMIT 20")
_on_entries("oldest_files_known", reports.oldest_files_known, f"""SELECT path, {_STAMP.format("mtime")} AS modified, {_MB.format("size")} AS size_mb
  FROM ent WHERE entry_type = 0 AND mtime IS NOT NULL ORDER BY mtime, path LIMIT 20""")
_on_entries("most_links", reports.most_links, "SELECT path, coalesce(nlink, 1) AS nlink, size FROM ent WHERE entry_type = 0 ORDER BY 2 DESC, path LIMIT 20")
_on_entries("most_links_gt1", reports.most_links_gt1, f"""SELECT path, nlink, {_MB.format("size")} AS size_mb FROM ent WHERE entry_type = 0 AND nlink > 1
  ORDER BY nlink DESC, path LIMIT 20""")
_on_entries("duplicates", reports.duplicates, """SELECT name, size, count(*) AS copies, string_agg(path, chr(10) ORDER BY path) AS paths FROM ent WHERE entry_type = 0 AND size > 0
  GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY size * count(*) DESC, name, size LIMIT 20""")


_on_entries("duplicate_pages", lambda e: reports.duplicate_pages(e, 20, 2), """SELECT name, size, copies, CAST(inode % CAST(ceil(copies / 2.0) AS BIGINT) AS BIGINT) AS page, string_agg(path, chr(10) ORDER BY path) AS paths
  FROM ent JOIN (SELECT name, size, count(*) AS copies FROM ent WHERE entry_type = 0 AND size > 0 GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY size * count(*) DESC, name, size LIMIT 20) USING (name, size)
  WHERE entry_type = 0 AND size > 0 GROUP BY 1, 2, 3, 4""")
_R = {
    "by_extension": ("coalesce(extension, '')", "count(*), sum(size), sum(blocks)", "entry_type = 0", "3 DESC, 1"),
    "largest_dirs": (_PARENT, "count(*), NULL, NULL", "true", "2 DESC, 1"),
    **{f"by_{w}": (f"coalesce({w}, 0)", "count_if(entry_type = 0), count_if(entry_type = 1), coalesce(sum(size) FILTER (entry_type = 0), 0)", "true", "4 DESC, 1") for w in ("uid", "gid")},
    "largest_files": ("path", "size, NULL, NULL", None, "size DESC, path"),
    "oldest_files": ("path", "mtime, size, NULL", None, "mtime NULLS FIRST, path"),
    "most_links": ("path", "coalesce(nlink, 1), size, NULL", None, "coalesce(nlink, 1) DESC, path"),
}


def _report_sql(name: str) -> str:
    key, values, where, order = _R[name]
    rows = f"SELECT {key} AS key, {values} FROM ent WHERE {where or 'entry_type = 0'} {'GROUP BY 1' if where else ''} ORDER BY {order} LIMIT 20"
    return f"SELECT '{name}' AS report, row_number() OVER () AS rank, CAST(key AS VARCHAR) AS key, CAST(a AS BIGINT) AS v0, CAST(b AS BIGINT) AS v1, CAST(c AS BIGINT) AS v2 FROM ({rows}) t(key, a, b, c)"


_on_entries("reports", lambda e: reports.reports(e, reports.REPORTS, 20), " UNION ALL ".join(map(_report_sql, _R)))

# --- tree ----------------------------------------------------------------------------------------

_ANCESTORS = """RECURSIVE up AS (SELECT parent_path AS path, 1 AS files, size FROM ent WHERE entry_type = 0 UNION ALL
  SELECT CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END, files, size FROM up WHERE path <> '/')"""
_on_entries("tree_size", tree.tree_size)
ORACLES["tree_size"] = f"WITH RECURSIVE ent AS ({X.ENT_SQL}), {_ANCESTORS.removeprefix('RECURSIVE ')} SELECT path, {_I('sum(files)')} AS files, {_I('sum(size)')} AS bytes FROM up GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20"
_DIRECT = f"""SELECT parent_path, count_if(entry_type = 0) AS files, count_if(entry_type = 1) AS dirs, count_if(entry_type = 2) AS symlinks,
  count_if(entry_type NOT IN (0, 1, 2)) AS others, {_I("coalesce(sum(size) FILTER (entry_type = 0), 0)")} AS bytes, count(*) AS total FROM ent GROUP BY 1"""
_on_entries("dir_direct_stats", tree.dir_direct_stats, _DIRECT)
_on_entries("dir_stats", tree.dir_stats, "SELECT d.inode AS entry_id, d.path, " + ", ".join(f"coalesce(s.{c}, 0) AS direct_{c}" for c in ("files", "dirs", "symlinks", "others", "bytes"))
            + f" FROM ent d LEFT JOIN ({_DIRECT}) s ON d.path = s.parent_path WHERE d.entry_type = 1")
_on_entries("parent_id", tree.parent_id, "SELECT c.path, c.inode, d.inode AS parent_id FROM ent c LEFT JOIN ent d ON d.entry_type = 1 AND d.path = c.parent_path")
_BIG_SQL = f"SELECT parent_path AS path, least(count(*), {BIG}) AS file_count, count(*) AS exact_count FROM ent WHERE entry_type <> 1 GROUP BY 1 HAVING count(*) >= {BIG}"
_on_entries("big_dirs", lambda e: tree.big_dirs(e, BIG), _BIG_SQL)
_on_entries("big_dir_scan", lambda e: tree.big_dir_scan(e, e.filter("entry_type = 1 AND depth <= 2"), BIG).withColumn("subdirs", F.array_join("subdirs", "\n")),
            f"""SELECT d.path, least(count_if(e.entry_type <> 1), {BIG}) AS file_count, count_if(e.entry_type <> 1) >= {BIG} AS threshold_hit,
  coalesce(string_agg(e.name, chr(10) ORDER BY e.name) FILTER (e.entry_type = 1), '') AS subdirs
  FROM (SELECT path FROM ent WHERE entry_type = 1 AND depth <= 2) d LEFT JOIN ent e ON e.parent_path = d.path GROUP BY 1""")  # fmt: skip
_on_entries("big_dir_check", lambda e: tree.big_dir_check(e, BIG), f"SELECT parent_path AS path, CASE WHEN count(*) >= {BIG} THEN 'IsBig' ELSE 'NotBig' END AS verdict, count(*) AS n FROM ent GROUP BY 1")
_on_entries("big_dir_summary", lambda e: tree.big_dir_summary(e, BIG), f"SELECT (SELECT count(*) + 1 FROM ent WHERE entry_type = 1) AS dirs_scanned, (SELECT count(*) FROM ({_BIG_SQL})) AS big_dirs_found, {_I(BIG)} AS threshold")


def _walked(e: DataFrame) -> DataFrame:
    """Totals of a walk in which every directory of the catalogue and the start directory were read."""
    start = e.agg(F.lit("/").alias("dir")).select("dir")
    outcomes = e.filter("entry_type = 1").select(F.col("path").alias("dir")).unionByName(start).withColumn("outcome", F.lit("ok"))
    return tree.walk_totals(outcomes, e)


_WALK_SQL = f"SELECT count_if(entry_type = 1) + 1 AS dirs, count_if(entry_type <> 1) AS files, {_I('coalesce(sum(size) FILTER (entry_type <> 1), 0)')} AS bytes, {_I(0)} AS errors FROM ent"
_on_entries("walk_totals", _walked, _WALK_SQL)

# --- lookups and filters -------------------------------------------------------------------------

_on_entries("scan_ordered", lookups.scan_ordered, f"SELECT {_COLS} FROM ent ORDER BY path")
_on_entries("lookup_path", lambda e: lookups.by_path(e, "/data/u1"), f"SELECT {_COLS} FROM ent WHERE path = '/data/u1'")
_LAST = f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY inode ORDER BY path DESC) AS rn FROM ent) WHERE rn = 1"
_on_entries("lookup_inode", lambda e: lookups.by_inode(e, 7), f"{_LAST} AND inode = 7")
_on_entries("by_inode", lookups.one_per_inode, _LAST)
for _key in ("path", "inode"):
    _add(f"contains_{_key}", lambda spark, d, k=_key: lookups.contains(X.baseline(spark, d).select(k), X.entries(spark, d), k),
         f"SELECT {_key} FROM base WHERE {_key} IN (SELECT {_key} FROM ent)")
_on_entries("prefix_scan", lambda e: lookups.with_prefix(e, "/data/u1"), f"SELECT {_COLS} FROM ent WHERE starts_with(path, '/data/u1') ORDER BY path")
_on_entries("exclude_paths", lambda e: lookups.exclude_paths(e, [r"/u[13]/", r"\.log$"]), f"SELECT {_COLS} FROM ent WHERE NOT regexp_matches(path, '/u[13]/') AND NOT regexp_matches(path, '\\.log$')")
_on_entries("dirs_only", lookups.dirs_only, f"SELECT {_COLS} FROM ent WHERE entry_type = 1")
_on_entries("max_depth", lambda e: lookups.max_depth(e, 2), f"SELECT {_COLS} FROM ent WHERE depth <= 3")
_on_entries("no_atime", lookups.no_atime, f"SELECT {_COLS.replace('atime', 'CAST(NULL AS BIGINT) AS atime')} FROM ent")
_on_entries("large_files", lambda e: lookups.large_files(e, 5_000_000), f"SELECT path, {_I('size // 1073741824')} AS size_gb FROM ent WHERE size > 5000000 ORDER BY size DESC, path")
_on_entries("recently_modified", lambda e: lookups.recently_modified(e, NOW, 60), f"""SELECT path, {_STAMP.format("mtime")} AS modified, {_MB.format("size")} AS size_mb FROM ent
  WHERE entry_type = 0 AND mtime > {NOW} - 86400 * 60 ORDER BY mtime DESC, path LIMIT 100""")
_on_entries("stale_files", lambda e: lookups.stale_files(e, NOW), f"""SELECT path, {_STAMP.format("atime")} AS accessed, {_GB.format("size")} AS size_gb FROM ent
  WHERE entry_type = 0 AND atime IS NOT NULL AND atime < {NOW} - 86400 * 365 ORDER BY size DESC, path LIMIT 100""")
_OCT = "CAST((mode & 511) >> 6 AS VARCHAR) || CAST(((mode & 511) >> 3) & 7 AS VARCHAR) || CAST(mode & 7 AS VARCHAR)"
_on_entries("world_writable", lookups.world_writable, f"SELECT path, {_OCT} AS perms, uid FROM ent WHERE entry_type = 0 AND mode & 2 = 2 ORDER BY path LIMIT 100")

# --- diff ----------------------------------------------------------------------------------------

_CHANGES = """SELECT e.path, CASE WHEN b.path IS NOT NULL THEN CASE WHEN e.inode = b.inode AND e.mtime IS NOT DISTINCT FROM b.mtime AND e.size = b.size THEN 'Unchanged' ELSE 'Modified' END
    WHEN i.path IS NOT NULL THEN 'Renamed' ELSE 'New' END AS change, CASE WHEN b.path IS NULL THEN i.path END AS old_path, e.size
  FROM ent e LEFT JOIN base b ON b.path = e.path LEFT JOIN (SELECT inode, max(path) AS path FROM base GROUP BY 1) i ON i.inode = e.inode"""
_GONE = "SELECT path, inode, size FROM base WHERE path NOT IN (SELECT path FROM ent)"
_NOT_MOVED = f"{_GONE} AND path NOT IN (SELECT old_path FROM ({_CHANGES}) WHERE change = 'Renamed')"
for _name, _f, _sql in (
    ("changes", diff.changes, _CHANGES),
    ("deleted_paths", diff.deleted_paths, _GONE),
    ("deleted_not_renamed", diff.deleted_not_renamed, _NOT_MOVED),
    ("change_summary", diff.change_summary, f"""SELECT change, count(*) AS entries, {_I("sum(size)")} AS bytes FROM (SELECT change, size FROM ({_CHANGES})
       UNION ALL SELECT 'Deleted', size FROM ({_NOT_MOVED})) GROUP BY 1"""),
):
    _add(_name, lambda spark, d, f=_f: f(X.entries(spark, d), X.baseline(spark, d)), _sql)

# --- scalar functions ----------------------------------------------------------------------------


_on_entries("path_functions", lambda e: e.select("path", C.join_path(F.col("parent_path"), F.col("name")).alias("joined"), C.parent_of(F.col("path")).alias("parent"), C.base_name(F.col("path")).alias("base")),
            f"SELECT path, CASE WHEN parent_path = '/' THEN '/' || name ELSE parent_path || '/' || name END AS joined, {_PARENT} AS parent, regexp_extract(path, '([^/]*)$', 1) AS base FROM ent")
_on_entries("extension", lambda e: e.select("path", C.extension(F.col("name"), F.col("entry_type")).alias("extension")), "SELECT path, extension FROM ent")
_on_entries("type_from_mode", lambda e: e.select("path", C.type_from_mode(F.col("mode")).alias("kind"), C.stored_type(F.col("depth") * 3).alias("stored")),
            """SELECT path, CAST(CASE mode & 61440 WHEN 32768 THEN 0 WHEN 16384 THEN 1 WHEN 40960 THEN 2 WHEN 24576 THEN 3 WHEN 8192 THEN 4 WHEN 4096 THEN 5 WHEN 49152 THEN 6 ELSE 255 END AS INT) AS kind,
  CAST(CASE WHEN depth * 3 BETWEEN 0 AND 6 THEN depth * 3 ELSE 255 END AS INT) AS stored FROM ent""")  # fmt: skip
_CODE = "CAST(CASE type_code WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 255 END AS INT)"
_add("type_from_code", lambda spark, d: X.raw_listing(spark, d).select("parent_path", "name", C.type_from_code(F.col("type_code")).alias("kind")), f"SELECT parent_path, name, {_CODE} AS kind FROM raw_listing")
_on_entries("format_time", lambda e: e.select("path", C.format_time(F.col("mtime")).alias("short"), C.format_time_sql(F.col("mtime")).alias("long"), F.unix_seconds(F.timestamp_seconds(-F.col("mtime"))).alias("negated")),
            f"SELECT path, CASE WHEN mtime IS NULL THEN 'unknown' ELSE strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M') END AS short, {_STAMP.format('mtime')} AS long, -mtime AS negated FROM ent")
_UNITS = ((1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB"))
_SIZE_SQL = "CASE " + " ".join(f"WHEN size >= {k} THEN CASE WHEN size % {k} = 0 THEN printf('%d {u}', size // {k}) ELSE printf('%.2f {u}', round(CAST(size AS DOUBLE) / {k}, 2)) END" for k, u in _UNITS) + " ELSE printf('%d B', size) END"
_on_entries("format_size", lambda e: e.select("path", C.format_size(F.col("size")).alias("text")), f"SELECT path, {_SIZE_SQL} AS text FROM ent")
_on_entries("format_number", lambda e: e.select("path", C.format_number(F.col("size")).alias("text")), "SELECT path, format('{:,}', size) AS text FROM ent")
_on_entries("permission_bits", lambda e: e.select("path", C.permissions(F.col("mode")).alias("bits"), *(C.owner_can(F.col("mode"), x).alias(f"owner_{x}") for x in "rwx"), C.octal(F.col("mode")).alias("octal")),
            f"SELECT path, mode & 4095 AS bits, mode & 256 <> 0 AS owner_r, mode & 128 <> 0 AS owner_w, mode & 64 <> 0 AS owner_x, {_OCT} AS octal FROM ent")
_add("scan_history", lambda spark, d: X.scans(spark, d).select("scan_id", C.format_elapsed(F.col("elapsed_secs")).alias("elapsed"), C.rate(F.col("files"), F.col("dirs"), F.col("elapsed_secs")).alias("rate")),
     """SELECT scan_id, CASE WHEN elapsed_secs < 60 THEN concat(elapsed_secs, 's') WHEN elapsed_secs < 3600 THEN concat(elapsed_secs // 60, 'm ', elapsed_secs % 60, 's')
  ELSE concat(elapsed_secs // 3600, 'h ', elapsed_secs % 3600 // 60, 'm') END AS elapsed,
  CASE WHEN elapsed_secs > 0 THEN CAST(files + dirs AS DOUBLE) / CAST(elapsed_secs AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rate FROM scans""")  # fmt: skip
_add("source_url_parts", lambda spark, d: X.scans(spark, d).select("scan_id", C.source_url_parts(F.col("source_url")).alias("u")).select("scan_id", "u.*"),
     r"""WITH p AS (SELECT scan_id, regexp_extract(CASE WHEN source_url LIKE 'nfs://%' THEN source_url ELSE regexp_replace(source_url, '^([^:/]+):/', '\1/') END, '^(?:nfs://)?([^:/]+)(?::([0-9]+))?(/\S*)$', ['server', 'port', 'path']) AS u FROM scans),
  q AS (SELECT scan_id, u.path <> '' AS valid, nullif(u.server, '') AS server, CAST(nullif(u.port, '') AS INT) AS port, rtrim(u.path, '/') AS path FROM p),
  r AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(/[^/]+)', 1) END AS share FROM q),
  s AS (SELECT *, CASE WHEN share = '/' THEN '' ELSE substr(path, length(share) + 1) END AS sub FROM r)
  SELECT scan_id, server, port, CASE WHEN valid THEN share END AS export, CASE WHEN valid THEN sub END AS subpath, CASE WHEN valid THEN concat(share, sub) END AS full_path,
    CASE WHEN valid THEN CASE WHEN sub = '' THEN '/' ELSE sub END END AS walk_start_path,
    CASE WHEN valid THEN concat('nfs://', server, CASE WHEN port IS NULL THEN '' ELSE concat(':', port) END, share, sub) END AS display, valid FROM s""")  # fmt: skip
ORACLES["source_url_parts"] = ORACLES["source_url_parts"].replace(")\nWITH p AS", "), p AS")

# --- sources, sinks, metadata --------------------------------------------------------------------

_NORMAL = f"""SELECT parent_path, name, CASE WHEN parent_path = '/' THEN '/' || name ELSE parent_path || '/' || name END AS path, {_CODE} AS entry_type, coalesce(size, 0) AS size, mtime, atime, ctime,
  mode, uid, gid, nlink, inode, CAST(parent_depth + 1 AS INT) AS depth, coalesce({_I("floor((used + 511) / 512)")}, 0) AS blocks,
  CASE WHEN type_code = 1 AND strlen(regexp_extract(name, '([^.]*)$', 1)) < 10 THEN lower(regexp_extract(name, '([^.]*)$', 1)) END AS extension FROM raw_listing WHERE name NOT IN ('.', '..')"""
_add("normalize_listing", lambda spark, d: listing.normalize_listing(X.raw_listing(spark, d)), _NORMAL)


def _list_tree(spark: SparkSession, d: str) -> DataFrame:
    """The directories of the catalogue written in partitions by owner and depth, as the listing job finds them."""
    out = shared_dir(spark, "partitions")
    X.entries(spark, d).select("path", "size", "uid", "depth").write.partitionBy("uid", "depth").parquet(out)
    entries, outcomes = listing.list_tree(spark, out, dirs_only=True, budget=50)
    if failed := outcomes.filter("outcome <> 'ok'").take(5):
        raise RuntimeError(f"directories that could not be read: {failed}")
    return entries.select(F.substring_index("parent_path", "/", -1).alias("parent"), "name", "depth").withColumn("parent", F.when(F.col("depth") > 1, F.col("parent")))


_U = "'uid=' || coalesce(CAST(uid AS VARCHAR), '__HIVE_DEFAULT_PARTITION__')"
_add("list_tree", _list_tree, f"""SELECT DISTINCT CAST(NULL AS VARCHAR) AS parent, {_U} AS name, 1 AS depth FROM ent
  UNION ALL SELECT DISTINCT {_U}, 'depth=' || depth, 2 FROM ent""")


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out = shared_dir(spark, "catalog")
    catalog.write_catalog(X.entries(spark, d), out)
    return catalog.read_catalog(spark, out)


_add("write_roundtrip", _roundtrip, f"SELECT {_COLS} FROM ent")


def _totals(e: DataFrame) -> DataFrame:
    return _walked(e)


def _export_counts(spark: SparkSession, d: str) -> DataFrame:
    e = X.entries(spark, d)
    meta = catalog.finish_metadata(_totals(e), NOW, 60, True)
    return catalog.export_catalog(e, meta, tree.big_dirs(e, BIG), shared_dir(spark, "export"))


_add("export_counts", _export_counts, f"SELECT (SELECT count(*) FROM ent) AS entries_converted, (SELECT count(*) FROM ({_BIG_SQL})) AS big_dirs_converted")


def _csv(spark: SparkSession, d: str, sep: str) -> DataFrame:
    out = shared_dir(spark, "csv")
    rows = X.entries(spark, d).filter("entry_type = 0 AND size > 1000000").select("path", "size", "mtime", "uid")
    catalog.export_csv(rows, out, sep)
    return spark.read.schema("path string, size bigint, mtime bigint, uid bigint").option("header", True).option("sep", sep).option("escape", '"').csv(out)


_CSV_SQL = "SELECT path, size, mtime, uid FROM ent WHERE entry_type = 0 AND size > 1000000"
_add("export_csv", lambda spark, d: _csv(spark, d, ","), _CSV_SQL)
_add("export_tsv", lambda spark, d: _csv(spark, d, "\t"), _CSV_SQL)


def _json(spark: SparkSession, d: str) -> DataFrame:
    out = shared_dir(spark, "json")
    catalog.export_json(X.entries(spark, d).select("path", "size", "mtime", "extension"), out, 1000)
    return spark.read.schema("path string, size bigint, mtime bigint, extension string").json(out)


_add("export_json", _json, "SELECT path, size, mtime, extension FROM ent ORDER BY path LIMIT 1000")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    out = shared_dir(spark, "paths")
    catalog.export_paths(lookups.large_files(X.entries(spark, d), 1_000_000), out)
    return spark.read.text(out).select(F.col("value").alias("path"))


_add("export_paths", _paths, "SELECT path FROM ent WHERE size > 1000000")


def _walk_info(spark: SparkSession, d: str) -> DataFrame:
    old = X.scans(spark, d).select(F.concat(F.lit("scan"), F.col("scan_id")).alias("key"), F.col("source_url").alias("value"))
    new = X.scans(spark, d).filter("scan_id % 3 = 0").select(F.concat(F.lit("scan"), F.col("scan_id") * 2).alias("key"), F.col("elapsed_secs").cast("string").alias("value"))
    return catalog.upsert(old, new)


_add("walk_info_upsert", _walk_info, """SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NULL THEN o.value ELSE n.value END AS value FROM
  (SELECT concat('scan', scan_id) AS key, source_url AS value FROM scans) o FULL JOIN
  (SELECT concat('scan', scan_id * 2) AS key, CAST(elapsed_secs AS VARCHAR) AS value FROM scans WHERE scan_id % 3 = 0) n ON o.key = n.key""")


def _scan_metadata(spark: SparkSession, d: str) -> DataFrame:
    start = catalog.start_metadata(spark, "nfs://server/export", NOW, 8)
    return catalog.upsert(start, catalog.finish_metadata(_totals(X.entries(spark, d)), NOW + 60, 60, True))


_add("scan_metadata", _scan_metadata, f"""WITH t AS ({_WALK_SQL}) SELECT 'source_url' AS key, 'nfs://server/export' AS value UNION ALL SELECT 'start_time', '{NOW}' UNION ALL SELECT 'worker_count', '8'
  UNION ALL SELECT 'end_time', '{NOW + 60}' UNION ALL SELECT 'duration_secs', '60' UNION ALL SELECT 'status', 'completed' UNION ALL SELECT 'total_dirs', CAST(dirs AS VARCHAR) FROM t
  UNION ALL SELECT 'total_files', CAST(files AS VARCHAR) FROM t UNION ALL SELECT 'total_bytes', CAST(bytes AS VARCHAR) FROM t UNION ALL SELECT 'error_count', CAST(errors AS VARCHAR) FROM t""")
ORACLES["scan_metadata"] = ORACLES["scan_metadata"].replace(")\nWITH t AS", "), t AS")


def _big_table(spark: SparkSession, d: str) -> DataFrame:
    e = X.entries(spark, d)
    first = tree.big_dirs(e.filter("entry_type = 0"), BIG).select("path", "file_count")
    return catalog.upsert(first, tree.big_dirs(e, BIG + 10).select("path", "file_count"), "path").orderBy("path")


_BIG_AT = "SELECT parent_path AS path, least(count(*), {t}) AS file_count FROM ent WHERE {w} GROUP BY 1 HAVING count(*) >= {t}"
_add("big_dirs_table", _big_table, f"""SELECT coalesce(n.path, o.path) AS path, coalesce(n.file_count, o.file_count) AS file_count FROM ({_BIG_AT.format(t=BIG, w="entry_type = 0")}) o
  FULL JOIN ({_BIG_AT.format(t=BIG + 10, w="entry_type <> 1")}) n ON o.path = n.path ORDER BY 1""")

# --- streams -------------------------------------------------------------------------------------


def _listing_files(spark: SparkSession, d: str) -> str:
    """Raw listing rows as several files, split by inode."""
    out = shared_dir(spark, "raw")
    X.raw_listing(spark, d).withColumn("part", F.col("inode") % 5).repartition(5, "part").drop("part").write.parquet(out)
    return out


def _stream(spark: SparkSession, d: str, start) -> str:
    out = shared_dir(spark, "stream")
    start(ingest.listing_stream(spark, _listing_files(spark, d), 2), out, shared_dir(spark, "checkpoint")).awaitTermination()
    return out


_add("stream_ingest", lambda spark, d: catalog.read_catalog(spark, _stream(spark, d, ingest.ingest)), _NORMAL)


def _stream_totals(spark: SparkSession, d: str) -> DataFrame:
    failed = shared_dir(spark, "outcomes")
    X.outcomes(spark, d).repartition(3, "dir").write.parquet(failed)
    out = _stream(spark, d, lambda raw, o, c: ingest.running_totals(raw, ingest.outcome_stream(spark, failed, 1), o, c))
    return ingest.latest_batch(spark, out, "dirs bigint, files bigint, bytes bigint, errors bigint")


_add("stream_totals", _stream_totals, f"""SELECT count_if(entry_type = 1) AS dirs, count_if(entry_type <> 1) AS files, {_I('sum(size) FILTER (entry_type <> 1)')} AS bytes,
  (SELECT count(*) FROM outcomes WHERE outcome <> 'ok') AS errors FROM ({_NORMAL})""")
_add("stream_upsert", lambda spark, d: ingest.upsert_view(spark, _stream(spark, d, ingest.upsert_log)), _NORMAL)


def _stream_big(spark: SparkSession, d: str) -> DataFrame:
    out = _stream(spark, d, lambda raw, o, c: ingest.big_dir_alerts(raw, BIG, o, c))
    return ingest.read_alerts(spark, out).groupBy("path").agg(F.max("file_count").alias("file_count"), F.count("*").alias("alerts"))


_add("stream_big_dirs", _stream_big, f"SELECT parent_path AS path, {_I(BIG)} AS file_count, {_I(1)} AS alerts FROM ({_NORMAL}) WHERE entry_type <> 1 GROUP BY 1 HAVING count(*) >= {BIG}")

# --- stored catalogues ---------------------------------------------------------------------------


def _stored(spark: SparkSession, df: DataFrame) -> stored.Stored:
    """``df`` stored in buckets under the shared folder."""
    out = shared_dir(spark, "stored")
    return stored.store(df, out, "t" + out.rsplit("-", 1)[1], 8)


def _stored_changes(spark: SparkSession, d: str) -> DataFrame:
    cur, base = _stored(spark, X.entries(spark, d)), _stored(spark, X.baseline(spark, d))
    return diff.stored_changes(cur.by_path, base.by_path, base.by_inode)


_add("stored_changes", _stored_changes, _CHANGES)
_add("stored_by_inode", lambda spark, d: _stored(spark, X.entries(spark, d)).by_inode.select(*_COLS.split(", ")), _LAST)
_add("stored_lookup_inode", lambda spark, d: stored.lookup_inode(_stored(spark, X.entries(spark, d)), 7).select(*_COLS.split(", ")), f"{_LAST} AND inode = 7")
_add("stored_contains_inode", lambda spark, d: lookups.contains(X.baseline(spark, d).select("inode"), _stored(spark, X.entries(spark, d)).by_inode, "inode"), "SELECT inode FROM base WHERE inode IN (SELECT inode FROM ent)")
_add("stored_parent_id", lambda spark, d: _stored(spark, X.entries(spark, d)).by_path.select("path", "inode", "parent_id"), "SELECT c.path, c.inode, d.inode AS parent_id FROM ent c LEFT JOIN ent d ON d.entry_type = 1 AND d.path = c.parent_path")
