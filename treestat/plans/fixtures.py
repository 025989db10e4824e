"""Catalogue tables derived from ``orders`` and ``supplier``: entries, an earlier scan, raw listings, scans.

Each text runs in Spark SQL and DuckDB alike but for two placeholders, so a query and its oracle start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treestat.functions import columns as C
from treestat.schema import ENTRIES

_EPOCH = {"spark": "unix_seconds(CAST(o_orderdate AS TIMESTAMP))", "duckdb": "CAST(epoch(o_orderdate) AS BIGINT)"}

_ROWS = """
WITH raw AS (
SELECT o_orderkey AS k,
  concat('/', CASE o_orderkey % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'data' WHEN 2 THEN 'scratch' ELSE 'archive' END,
         CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('/u', CAST(o_custkey % 10 AS VARCHAR(8))) END,
         CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('/d', CAST(o_orderkey % 12 AS VARCHAR(8))) END) AS parent_path,
  concat('f', CAST(o_orderkey % 5000 AS VARCHAR(8)), CASE o_orderkey % 8
         WHEN 0 THEN '.log' WHEN 1 THEN '.TXT' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' WHEN 4 THEN '.'
         WHEN 5 THEN '.verylongext' WHEN 6 THEN '.json' ELSE concat('-', CAST(o_orderkey AS VARCHAR(12)), '.log') END) AS name,
  CASE WHEN o_orderkey % 41 = 0 THEN 41471 WHEN o_orderkey % 97 = 0 THEN 49645
       WHEN o_orderkey % 6 = 0 THEN 33206 WHEN o_orderkey % 6 = 1 THEN 33261 ELSE 33188 END AS mode,
  CASE WHEN o_orderkey % 29 = 0 THEN 0 WHEN o_orderkey % 8 = 0 THEN (o_orderkey % 5000) * 1000 ELSE CAST(floor(o_totalprice) AS BIGINT) * (1 + o_orderkey % 37) END AS size,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE <epoch> END AS mtime,
  CASE WHEN o_orderkey % 113 = 0 THEN NULL ELSE 1000 + o_custkey % 25 END AS uid,
  CASE WHEN o_orderkey % 127 = 0 THEN NULL ELSE 100 + o_custkey % 5 END AS gid,
  CASE WHEN o_orderkey % 7 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS inode,
  CASE WHEN o_orderkey % 131 = 0 THEN NULL WHEN o_orderkey % 7 < 2 THEN 2 ELSE 1 END AS nlink
FROM <orders>
),
one AS (SELECT *, row_number() OVER (PARTITION BY concat(parent_path, '/', name) ORDER BY k) AS rn FROM raw),
files AS (
  SELECT parent_path, name, concat(parent_path, '/', name) AS path,
    CASE mode WHEN 41471 THEN 2 WHEN 49645 THEN 6 ELSE 0 END AS entry_type,
    size, mtime, mtime + 86400 * (k % 400) AS atime, mtime AS ctime, CAST(mode AS BIGINT) AS mode, uid, gid, CAST(nlink AS BIGINT) AS nlink, inode,
    CAST(length(parent_path) - length(replace(parent_path, '/', '')) + 1 AS INT) AS depth,
    CASE WHEN k % 10 = 0 THEN CAST(floor(CAST(size AS DOUBLE) / 1024) AS BIGINT) ELSE CAST(ceil(CAST(size AS DOUBLE) / 512) AS BIGINT) END AS blocks
  FROM one WHERE rn = 1),
dirpaths AS (
  SELECT parent_path AS path FROM files
  UNION SELECT regexp_extract(parent_path, '^(/[^/]+)', 1) FROM files
  UNION SELECT regexp_extract(parent_path, '^(/[^/]+/u[0-9]+)', 1) FROM files WHERE parent_path LIKE '/%/u%/%'),
dirs AS (
  SELECT CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent_path,
    regexp_extract(path, '([^/]+)$', 1) AS name, path, 1 AS entry_type,
    CAST(4096 AS BIGINT) AS size, CAST(1700000000 AS BIGINT) AS mtime, CAST(1700000000 AS BIGINT) AS atime,
    CAST(1700000000 AS BIGINT) AS ctime, CAST(16877 AS BIGINT) AS mode, CAST(1000 AS BIGINT) AS uid, CAST(100 AS BIGINT) AS gid, CAST(2 AS BIGINT) AS nlink,
    1000000000 + row_number() OVER (ORDER BY path) AS inode,
    CAST(length(path) - length(replace(path, '/', '')) AS INT) AS depth, CAST(8 AS BIGINT) AS blocks
  FROM dirpaths)
"""

_BASE = """
SELECT CASE WHEN inode % 13 = 0 THEN concat(parent_path, '/old_', name) ELSE path END AS path,
  CASE WHEN inode % 23 = 0 THEN inode + 50000000 ELSE inode END AS inode,
  CASE WHEN inode % 17 = 0 THEN mtime - 3600 ELSE mtime END AS mtime,
  CASE WHEN inode % 19 = 0 THEN size + 1 ELSE size END AS size
FROM <ent> WHERE inode % 11 <> 0
UNION ALL
SELECT concat('/gone/', CAST(inode AS VARCHAR(12)), name), inode + 90000000, mtime, size FROM <ent> WHERE inode % 31 = 0 AND entry_type = 0
"""

_STAT = ("mode", "uid", "gid", "nlink", "mtime", "atime", "ctime")
_GONE = lambda x, name: f"CASE WHEN inode % 101 = 0 THEN NULL ELSE {x} END AS {name}"
_RAW = f"""
SELECT parent_path, name, inode, depth - 1 AS parent_depth, inode AS scan_seq,
  {_GONE("CASE entry_type WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 6 THEN 6 END", "type_code")},
  {_GONE("size", "size")}, {_GONE("blocks * 512 - inode % 2", "used")},
  {", ".join(_GONE(x, x) for x in _STAT)}
FROM <ent>
UNION ALL
SELECT path, '.', inode, depth, inode, 2, size, blocks * 512, {", ".join(_STAT)} FROM <ent> WHERE entry_type = 1
UNION ALL
SELECT path, '..', inode, depth, inode, 2, size, blocks * 512, {", ".join(_STAT)} FROM <ent> WHERE entry_type = 1
"""

_SCANS = """
SELECT s_suppkey AS scan_id,
  CASE s_suppkey % 6
    WHEN 0 THEN concat('nfs://server', CAST(s_suppkey AS VARCHAR(8)), '/export')
    WHEN 1 THEN concat('nfs://server/export/data/sub', CAST(s_suppkey AS VARCHAR(8)))
    WHEN 2 THEN 'nfs://server:2049/export'
    WHEN 3 THEN '192.168.1.100:/data'
    WHEN 4 THEN 'nfs://server/' ELSE 'invalid' END AS source_url,
  s_suppkey * 17 AS files, s_suppkey * 3 AS dirs, (s_suppkey * 331) % 9000 AS elapsed_secs
FROM <supplier>
"""


def _sql(text: str, engine: str, **tables: str) -> str:
    text = text.replace("<epoch>", _EPOCH[engine])
    for name, value in tables.items():
        text = text.replace(f"<{name}>", value)
    return text


#: Catalogues that are read where they were stored instead of being derived, by application and folder of tables.
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def use_stored(spark: SparkSession, sf_dir: str, **catalogues: DataFrame) -> None:
    """From now on the queries of this application over ``sf_dir`` read these catalogues (``entries``, ``baseline``)."""
    for what, df in catalogues.items():
        _STORED[spark.sparkContext.applicationId, sf_dir, what] = df


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current catalogue."""
    if (stored := _STORED.get((spark.sparkContext.applicationId, sf_dir, "entries"))) is not None:
        return stored.select(*ENTRIES.names)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = spark.sql(_sql(_ROWS, "spark", orders="{orders}") + "SELECT * FROM files UNION ALL SELECT * FROM dirs", orders=orders)
    rows = rows.withColumn("extension", C.extension(F.col("name"), F.col("entry_type")))
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in ENTRIES))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier scan: path, inode, mtime, size."""
    if (stored := _STORED.get((spark.sparkContext.applicationId, sf_dir, "baseline"))) is not None:
        return stored
    return spark.sql(_sql(_BASE, "spark", ent="{ent}"), ent=entries(spark, sf_dir))


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows before normalisation, with the ``.`` and ``..`` rows."""
    return spark.sql(_sql(_RAW, "spark", ent="{ent}"), ent=entries(spark, sf_dir))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of many scans."""
    return spark.sql(_sql(_SCANS, "spark", supplier="{supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


#: Outcomes of reading the directories of the catalogue and the start directory; some could not be read.
_OUTCOMES = """
SELECT path AS dir, CASE WHEN inode % 7 = 3 THEN 'PermissionError' WHEN inode % 11 = 5 THEN 'FileNotFoundError' ELSE 'ok' END AS outcome
FROM <ent> WHERE entry_type = 1 UNION ALL SELECT DISTINCT '/', 'ok' FROM <ent>
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome per directory read."""
    return spark.sql(_sql(_OUTCOMES, "spark", ent="{ent}"), ent=entries(spark, sf_dir))


ENT_SQL = (
    _sql(_ROWS, "duckdb", orders="orders")
    + """SELECT e.*, CASE WHEN entry_type = 0 AND strlen(regexp_extract(name, '([^.]*)$', 1)) < 10
    THEN lower(regexp_extract(name, '([^.]*)$', 1)) END AS extension FROM (SELECT * FROM files UNION ALL SELECT * FROM dirs) e"""
)
BASE_SQL = _sql(_BASE, "duckdb", ent="ent")
RAW_SQL = _sql(_RAW, "duckdb", ent="ent")
SCANS_SQL = _sql(_SCANS, "duckdb", supplier="supplier")
OUTCOMES_SQL = _sql(_OUTCOMES, "duckdb", ent="ent")


def oracle(select: str) -> str:
    """A DuckDB query over ``ent``, ``base``, ``raw_listing``, ``outcomes`` and ``scans``."""
    return f"WITH ent AS ({ENT_SQL}), base AS ({BASE_SQL}), raw_listing AS ({RAW_SQL}), outcomes AS ({OUTCOMES_SQL}), scans AS ({SCANS_SQL})\n{select}"
