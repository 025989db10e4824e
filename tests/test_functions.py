"""Column functions at their edges, and replays of literal cases."""



import pytest
from pyspark.sql import functions as F

from treestat.functions import columns as C
from treestat.operators import diff, lookups, reports, tree
from treestat.schema import ENTRIES


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x, kind="string"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(
    "name, kind, want",
    [("a.TXT", 0, "txt"), ("Makefile", 0, "makefile"), (".bashrc", 0, "bashrc"), ("x.", 0, ""), ("x.verylongext", 0, None), ("a.txt", 1, None), ("x.éééé", 0, "éééé"), ("x.ééééé", 0, None), ("a.tar.gz", 0, "gz")],
)
def test_extension(spark, name, kind, want):
    assert value(spark, C.extension(lit(name), lit(kind, "int"))) == want


@pytest.mark.parametrize("path, want", [("/", None), ("/a", "/"), ("/a/b", "/a"), ("/a/b c/d", "/a/b c"), ("plain", "/"), ("/é/\nx", "/é")])
def test_parent(spark, path, want):
    assert value(spark, C.parent_of(lit(path))) == want


def test_paths(spark):
    assert value(spark, C.join_path(lit("/"), lit("f"))) == "/f" and value(spark, C.join_path(lit("/a"), lit("f"))) == "/a/f"
    assert value(spark, C.ancestors(lit("/a/b"))) == ["/", "/a", "/a/b"] and value(spark, C.ancestors(lit("/"))) == ["/"]
    assert value(spark, C.top_dir(lit("/a/b/c"))) == "/a" and value(spark, C.base_name(lit("/a/b"))) == "b"


def test_types_and_permissions(spark):
    modes = {0o100644: 0, 0o040755: 1, 0o120777: 2, 0o060000: 3, 0o020000: 4, 0o010000: 5, 0o140000: 6, 0: 255}
    assert {m: value(spark, C.type_from_mode(lit(m, "bigint"))) for m in modes} == modes
    codes = {1: 0, 2: 1, 5: 2, 3: 3, 4: 4, 6: 6, 7: 5, 9: 255, None: 255}
    assert {c: value(spark, C.type_from_code(lit(c, "int"))) for c in codes} == codes
    assert value(spark, C.permissions(lit(0o100755, "bigint"))) == 0o755 and value(spark, C.octal(lit(0o100640, "bigint"))) == "640"
    assert all(value(spark, C.owner_can(lit(0o100755, "bigint"), x)) for x in "rwx")


@pytest.mark.parametrize("size, want", [(0, "0 B"), (512, "512 B"), (1024, "1 KiB"), (1536, "1.50 KiB"), (5508250000, "5.13 GiB"), (1 << 40, "1 TiB")])
def test_format_size(spark, size, want):
    assert value(spark, C.format_size(lit(size, "bigint"))) == want


def test_presentation(spark):
    assert [value(spark, C.format_number(lit(n, "bigint"))) for n in (0, 999, 1000, 1234567, 1234567890)] == ["0", "999", "1,000", "1,234,567", "1,234,567,890"]
    assert [value(spark, C.format_elapsed(lit(n, "bigint"))) for n in (59, 61, 3661)] == ["59s", "1m 1s", "1h 1m"]
    assert value(spark, C.rate(lit(1000, "bigint"), lit(100, "bigint"), lit(10, "bigint"))) == 110 and value(spark, C.rate(lit(1, "int"), lit(1, "int"), lit(0, "int"))) == 0
    assert value(spark, C.format_time(lit(None, "bigint"))) == "unknown" and value(spark, C.format_time(lit(10**15, "bigint"))) == str(10**15)
    assert value(spark, C.format_time(lit(0, "bigint"))) == "1970-01-01 00:00" and value(spark, C.format_time(lit(0, "bigint"), "Asia/Tokyo")) == "1970-01-01 09:00"
    assert value(spark, F.timestamp_seconds(lit(-1, "bigint"))) is not None and value(spark, C.blocks_of(lit(513, "bigint"))) == 2


@pytest.mark.parametrize(
    "url, want",
    [
        ("nfs://server/export", ("server", None, "/export", "", "/export", "/", "nfs://server/export", True)),
        ("nfs://server/export/data/x", ("server", None, "/export", "/data/x", "/export/data/x", "/data/x", "nfs://server/export/data/x", True)),
        ("nfs://server:2049/export", ("server", 2049, "/export", "", "/export", "/", "nfs://server:2049/export", True)),
        ("192.168.1.100:/data", ("192.168.1.100", None, "/data", "", "/data", "/", "nfs://192.168.1.100/data", True)),
        ("nfs://server/", ("server", None, "/", "", "/", "/", "nfs://server/", True)),
        ("invalid", (None,) * 7 + (False,)),
        ("://server/export", (None,) * 7 + (False,)),
        ("nfs://server", (None,) * 7 + (False,)),
    ],
)
def test_source_url(spark, url, want):
    assert tuple(value(spark, C.source_url_parts(lit(url)))) == want


def test_explicit_export(spark):
    got = value(spark, C.source_url_parts(lit("nfs://s/a/b/c"), lit("a/b")))
    assert (got["export"], got["subpath"], got["full_path"]) == ("/a/b", "/c", "/a/b/c")


BASE = [("/file1.txt", 100, 1000, 1024), ("/file2.txt", 200, 2000, 2048)]
KEYS = "path string, inode long, mtime long, size long"


@pytest.mark.parametrize(
    "row, change, old",
    [
        (("/file1.txt", 100, 1000, 1024), "Unchanged", None),
        (("/file1.txt", 100, 2000, 1024), "Modified", None),
        (("/file1.txt", 100, 1000, 2048), "Modified", None),
        (("/file1.txt", 999, 1000, 1024), "Modified", None),
        (("/new_file.txt", 300, 3000, 512), "New", None),
        (("/renamed_file.txt", 100, 1000, 1024), "Renamed", "/file1.txt"),
    ],
)
def test_change(spark, row, change, old):
    got = diff.changes(spark.createDataFrame([row], KEYS), spark.createDataFrame(BASE, KEYS)).first()
    assert (got["change"], got["old_path"]) == (change, old)


@pytest.fixture(scope="module")
def entries(spark):
    from treestat.plans.fixtures import entries

    return entries(spark, "/root/testdata/sf0.001").cache()


def test_invariants(spark, entries):
    o = reports.overview(entries).first()
    root = tree.tree_size(entries, None).filter("path = '/'").first()
    assert (root["files"], root["bytes"]) == (o["total_files"], o["total_bytes"])
    assert tree.dir_direct_stats(entries).agg(F.sum("total")).first()[0] == o["total_entries"] == entries.count()
    assert reports.largest_files(entries, 0).count() == 0 and reports.largest_files(entries, 10**6).count() == o["total_files"]


def test_empty_catalogue(spark):
    none = spark.createDataFrame([], ENTRIES)
    assert tuple(reports.overview(none).first()) == (0,) * 7
    assert all(getattr(reports, f)(none, 20).count() == 0 for f in reports.REPORTS)
    assert reports.reports(none, reports.REPORTS).collect() == []


def test_bad_arguments(spark, entries):
    with pytest.raises(ValueError):
        tree.big_dirs(entries, 0)
    with pytest.raises(Exception, match="(?i)pattern|unclosed"):
        lookups.exclude_paths(entries, ["("])
    paths = spark.createDataFrame([("/data/.snapshot/hourly.0",), ("/data/myfile.txt",)], "path string")
    assert [r["path"] for r in lookups.exclude_paths(paths, [r"\.snapshot"]).collect()] == ["/data/myfile.txt"]


def test_plans(spark, entries):
    """Filters reach the scan; no report plans a Cartesian product or Python."""
    from treestat.session import shared_dir
    from treestat.sources.catalog import read_catalog, write_catalog

    out = shared_dir(spark, "plans")
    write_catalog(entries, out)
    e = read_catalog(spark, out)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(path,/data/u1)" in plan(lookups.by_path(e, "/data/u1"))
    assert "StringStartsWith(path,/data)" in plan(lookups.with_prefix(e, "/data"))
    p = plan(reports.by_extension(e))
    assert "EqualTo(entry_type,0)" in p and "atime" not in p and "TakeOrderedAndProject" in p
    for df in (reports.duplicates(e), tree.tree_size(e), diff.change_summary(e, e.select("path", "inode", "mtime", "size")), tree.big_dir_summary(e, 5)):
        assert "Cartesian" not in plan(df) and "Python" not in plan(df) and "NestedLoop" not in plan(df)



def files(spark, *rows):
    """Catalogue rows from (path, entry_type, size, blocks, nlink)."""
    made = spark.createDataFrame(rows, "path string, entry_type int, size long, blocks long, nlink long")
    made = made.withColumns({"parent_path": C.parent_of(F.col("path")), "name": C.base_name(F.col("path"))})
    made = made.withColumn("extension", C.extension(F.col("name"), F.col("entry_type")))
    return made.select(*((F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRIES))


def test_large_files_come_by_size(spark):
    e = files(spark, ("/a", 0, 1_500_000_000, 1, 1), ("/b", 0, 1_900_000_000, 1, 1), ("/c", 0, 5, 1, 1), ("/d", 0, 1_900_000_000, 1, 1))
    assert [tuple(r) for r in lookups.large_files(e).collect()] == [("/b", 1), ("/d", 1), ("/a", 1)]


def test_groups_without_limit(spark):
    e = files(spark, *((f"/top{k}/f", 0, 10 * k, 1, 1) for k in range(60)))
    assert [r["top_dir"] for r in reports.by_top_dir(e).collect()] == [f"/top{k}" for k in range(59, -1, -1)]
    assert [r["parent_path"] for r in reports.dir_sizes(e).collect()] == [f"/top{k}" for k in range(59, -1, -1)]


def test_units(spark):
    e = files(spark, ("/a.x", 0, 3 << 20, 1 << 22, 5), ("/b.x", 0, 1 << 20, 1 << 21, 1))
    assert tuple(reports.most_links_gt1(e).first()) == ("/a.x", 5, 3.0)
    assert tuple(reports.by_extension_gb(e).first()) == ("x", 2, 0.0, 3.0)
    assert value(spark, C.blocks_of(lit((1 << 60) + 1, "bigint"))) == (1 << 51) + 1


def test_scan_of_empty_directories(spark):
    e = files(spark, ("/a", 1, 0, 0, 1), ("/b", 1, 0, 0, 1), ("/a/s", 1, 0, 0, 1), ("/a/f", 0, 1, 1, 1))
    got = {tuple(map(str, r)) for r in tree.big_dir_scan(e, e.filter("entry_type = 1"), 1).collect()}
    assert got == {("/a", "1", "True", "['s']"), ("/b", "0", "False", "[]"), ("/a/s", "0", "False", "[]")}


VALUES = {
    "by_extension": ("extension", "file_count", "total_bytes", "total_blocks"), "largest_files": ("path", "size"), "largest_dirs": ("dir_path", "entry_count"),
    "oldest_files": ("path", "mtime", "size"), "most_links": ("path", "nlink", "size"), "by_uid": ("uid", "file_count", "dir_count", "total_bytes"), "by_gid": ("gid", "file_count", "dir_count", "total_bytes"),
}


@pytest.mark.parametrize("groups, n", [(200_000, 7), (3, 1), (200_000, 0)])
def test_reports_are_their_members(spark, entries, monkeypatch, groups, n):
    monkeypatch.setattr(reports, "_GROUPS", groups)
    rows = reports.reports(entries, reports.REPORTS, n).collect()
    for name, cols in VALUES.items():
        want = [(str(r[cols[0]]), *(r[c] for c in cols[1:])) for r in getattr(reports, name)(entries, n).collect()]
        got = sorted((r for r in rows if r["report"] == name), key=lambda r: r["rank"])
        assert [(r["key"], r["v0"], r["v1"], r["v2"])[: len(cols)] for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_reports_read_once(spark, entries):
    from treestat.session import shared_dir

    out = shared_dir(spark, "once")
    entries.write.parquet(out)
    plan = reports.reports(spark.read.parquet(out), reports.REPORTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "InMemoryTableScan" not in plan and "WindowGroupLimit" in plan
    with pytest.raises(ValueError, match="no such report"):
        reports.reports(entries, ["by_moon"])


def test_crowded_directory_is_counted_before_the_join(spark):
    """Two aggregates below the join, and a directory of a million entries does not meet in one task."""
    out = spark.range(0, 1_000_000, 1, 8).select(F.lit("/crowd").alias("parent_path"), F.when(F.col("id") % 250_000 == 0, 1).otherwise(0).alias("entry_type"), F.concat(F.lit("n"), "id").alias("name"))
    asked = spark.createDataFrame([("/crowd",), ("/empty",)], "path string")
    df = tree.big_dir_scan(out, asked, 1000)
    tree_ = df._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(k for k, x in enumerate(tree_) if "Join" in x)
    below = [x for x in tree_[join + 1 :] if "HashAggregate" in x and "count_if" in x.lower() or "ObjectHashAggregate" in x]
    assert len(below) >= 2 and any("partial_" in x for x in below)
    got = {r["path"]: (r["file_count"], r["threshold_hit"], r["subdirs"]) for r in df.collect()}
    assert got == {"/crowd": (1000, True, ["n0", "n250000", "n500000", "n750000"]), "/empty": (0, False, [])}


def test_duplicate_pages(spark, monkeypatch):
    e = files(spark, *((f"/d{k}/same", 0, 9, 1, 1) for k in range(50)), ("/x/two", 0, 3, 1, 1), ("/y/two", 0, 3, 1, 1), ("/z/one", 0, 100, 1, 1)).withColumn("inode", F.xxhash64("path"))
    rows = reports.duplicate_pages(e, 20, 10).collect()
    pages = [r for r in rows if r["name"] == "same"]
    assert len(pages) == 5 and all(r["copies"] == 50 for r in pages)
    assert sorted(p for r in pages for p in r["paths"].split("\n")) == sorted(f"/d{k}/same" for k in range(50))
    assert all(r["paths"].split("\n") == sorted(r["paths"].split("\n")) for r in pages)
    assert [(r["page"], r["paths"]) for r in rows if r["name"] == "two"] == [(0, "/x/two\n/y/two")]


def test_inode_view_sorts_once(spark, entries):
    plan = lookups.one_per_inode(entries.select("inode", "path", "size"))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert plan.count("Exchange hashpartitioning(inode") == 1 and above.count("Sort [") <= 1


def test_shared_folder_on_a_cluster(spark):
    from treestat import session as S

    class Away:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("X", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(Away, "x")
    df = S.written(spark.range(5), "cleaned")
    assert df.count() == 5 and S.clean(spark, "cleaned") == 1 and S.clean(spark, "cleaned") == 0
    with pytest.raises(Exception, match="(?i)exist"):
        df.count()


def test_change_summary_scans_each_side_once(spark, entries):
    from treestat.session import shared_dir

    cur, old = shared_dir(spark, "cur"), shared_dir(spark, "old")
    entries.write.parquet(cur)
    entries.select("path", "inode", "mtime", "size").filter("inode % 3 <> 0").write.parquet(old)
    got = diff.change_summary(spark.read.parquet(cur), spark.read.parquet(old))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert cur not in plan and old not in plan
    n = {r["change"]: r["entries"] for r in got.collect()}
    kinds = diff.changes(spark.read.parquet(cur), spark.read.parquet(old)).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in kinds} == {k: v for k, v in n.items() if k != "Deleted"} and n["Unchanged"]
