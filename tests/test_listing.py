"""The listing job against os.walk, and streams against their batch twins."""

import os

import pytest
from pyspark.sql import functions as F

from treestat.operators import reports, tree
from treestat.plans import fixtures
from treestat.session import shared_dir
from treestat.sources import catalog, listing
from treestat.streaming import ingest


def test_list_tree(spark, tmp_path):
    root = tmp_path / "root"
    (root / "a/b/c").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / ".hidden").mkdir()
    for k in range(25):
        (root / f"a/f{k}.TXT").write_text("x" * k)
    (root / "a/b/c/é\nfile").write_text("y")
    os.symlink(root / "a", root / "link")
    entries, outcomes = listing.list_tree(spark, str(root))
    want = {}
    for d, dirs, files in os.walk(root):
        for n in dirs + files:
            want[os.path.join(d, n)] = os.lstat(os.path.join(d, n))
    got = {r["path"]: r for r in entries.collect()}
    assert set(got) == set(want)
    assert all(got[p]["size"] == s.st_size and got[p]["inode"] == s.st_ino and got[p]["mode"] == s.st_mode for p, s in want.items())
    assert got[str(root / "link")]["entry_type"] == 2 and got[str(root / "a")]["depth"] == 1 and got[str(root / "a/f3.TXT")]["extension"] == "txt"
    assert {r["outcome"] for r in outcomes.collect()} == {"ok"}
    t = tree.walk_totals(outcomes, entries).first()
    assert (t["dirs"], t["files"], t["errors"]) == (6, 27, 0)
    shallow, _ = listing.list_tree(spark, str(root), max_depth=1, exclude=[r"/a$"])
    assert {r["path"] for r in shallow.collect()} == {str(root / x) for x in ("empty", ".hidden", "link")}
    dirs, _ = listing.list_tree(spark, str(root), dirs_only=True)
    assert dirs.count() == 5


def jobs(spark, f):
    """What ``f`` returns, and the number of jobs it ran."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{id(f)}"
    spark.sparkContext.setJobGroup(group, group)
    out = f()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_narrow_tree_takes_few_jobs(spark, tmp_path):
    deep = tmp_path / "root"
    for _ in range(300):
        deep = deep / "d"
    deep.mkdir(parents=True)
    (deep / "leaf").write_text("x")
    (entries, outcomes), n = jobs(spark, lambda: listing.list_tree(spark, str(tmp_path / "root")))
    assert entries.count() == 301 and outcomes.count() == 301 and n <= 6


@pytest.mark.parametrize("budget", [1, 7, 1000])
def test_work_is_handed_back(spark, tmp_path, budget):
    for k in range(6):
        for i in range(4):
            (tmp_path / f"a{k}/b{i}").mkdir(parents=True)
            (tmp_path / f"a{k}/b{i}/file").write_text("x")
    os.makedirs(os.fsencode(tmp_path) + b"/odd\xff/in")
    entries, outcomes = listing.list_tree(spark, f"file://{tmp_path}", budget=budget)
    assert entries.count() == 6 + 24 + 24 + 2 and entries.select("path").distinct().count() == 56
    assert outcomes.filter("outcome = 'ok'").count() == outcomes.count() == 1 + 6 + 24 + 2
    some, _ = listing.list_tree(spark, str(tmp_path), max_depth=1, exclude=["/a[0-2]$"], budget=budget)
    assert {r["depth"] for r in some.collect()} == {1, 2} and some.count() == 3 + 1 + 12 + 1


def test_store_is_listed_by_spark(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.TXT").write_text("hello")
    (tmp_path / "top").write_text("y")
    got = {r["path"]: r for r in listing.list_store(spark, f"file://{tmp_path}").collect()}
    base = f"file:{tmp_path}"
    assert set(got) == {f"{base}/a", f"{base}/a/b", f"{base}/a/b/x.TXT", f"{base}/top"}
    x = got[f"{base}/a/b/x.TXT"]
    assert (x["size"], x["entry_type"], x["depth"], x["extension"], x["parent_path"], x["mode"]) == (5, 0, 3, "txt", f"{base}/a/b", None) and x["mtime"]
    assert (got[f"{base}/a"]["entry_type"], got[f"{base}/a"]["depth"], got[f"{base}/a"]["parent_path"]) == (1, 1, base)
    with pytest.raises(ValueError, match="list_store"):
        listing.list_tree(spark, "hdfs://name/data")


def test_vanished_directory(spark, tmp_path):
    (tmp_path / "here").mkdir()
    gone = spark.createDataFrame([(str(p).encode(), str(p), 0) for p in (tmp_path, tmp_path / "gone")], listing._FRONTIER)
    rows = gone.mapInPandas(lambda f: listing._list_dirs(f, 100, 0, []), listing._LISTED)
    outcomes = rows.filter("outcome IS NOT NULL").select("dir", "outcome")
    t = tree.walk_totals(outcomes, listing.normalize_listing(rows.filter("outcome IS NULL"))).first()
    assert (t["dirs"], t["errors"]) == (1, 1)


def test_upsert_takes_the_last_row(spark):
    raw = fixtures.raw_listing(spark, "/root/testdata/sf0.001")
    first, log, check = shared_dir(spark, "raw"), shared_dir(spark, "log"), shared_dir(spark, "check")
    raw.write.parquet(first)
    ingest.upsert_log(ingest.listing_stream(spark, first), log, check).awaitTermination()
    again = raw.filter("inode % 2 = 0").withColumn("size", F.col("size") + 7)
    again.unionByName(again.withColumns({"size": F.lit(1).cast("bigint"), "scan_seq": F.lit(-1).cast("bigint")})).write.mode("append").parquet(first)
    ingest.upsert_log(ingest.listing_stream(spark, first), log, check).awaitTermination()
    view = ingest.upsert_view(spark, log)
    old = {r["path"]: r for r in listing.normalize_listing(raw).collect()}
    new = {r["path"]: r for r in view.collect()}
    assert set(old) == set(new)
    changed = [p for p in old if old[p]["inode"] % 2 == 0 and old[p]["mode"] is not None]
    assert changed and all(new[p]["size"] == old[p]["size"] + 7 for p in changed)
    base = shared_dir(spark, "base")
    ingest.compact(spark, log, base)
    assert catalog.read_catalog(spark, base).count() == len(old)
    merged = ingest.upsert_view(spark, log, catalog.read_catalog(spark, base))
    assert {r["path"]: r["size"] for r in merged.collect()} == {p: r["size"] for p, r in new.items()}


def test_metadata(spark):
    m = catalog.start_metadata(spark, "nfs://server/export", 5, 8)
    m = catalog.upsert(m, spark.createDataFrame([("status", "completed"), ("extra", "1")], m.schema))
    assert catalog.get(m, "status").first()["value"] == "completed" and catalog.get(m, "none").first()["value"] is None
    assert m.count() == 5


def test_alerts_come_once_over_restarts(spark):
    raw = fixtures.raw_listing(spark, "/root/testdata/sf0.001").filter("name NOT IN ('.', '..')")
    files, out, check = (shared_dir(spark, x) for x in ("raw", "alerts", "check"))
    seen = set()
    for part in range(4):
        raw.filter(F.col("inode") % 4 == part).write.mode("append").parquet(files)
        ingest.big_dir_alerts(ingest.listing_stream(spark, files), 20, out, check).awaitTermination()
        alerts = [r["path"] for r in ingest.read_alerts(spark, out).collect()]
        assert len(alerts) == len(set(alerts)) and seen <= set(alerts)
        seen = set(alerts)
    want = {r["path"] for r in tree.big_dirs(listing.normalize_listing(raw), 20).collect()}
    assert seen == want and want


def test_errors_are_counted_as_they_come(spark):
    raw, failed, out, check = (shared_dir(spark, x) for x in ("raw", "outcomes", "totals", "check"))
    fixtures.raw_listing(spark, "/root/testdata/sf0.001").write.parquet(raw)
    schema = "dirs bigint, files bigint, bytes bigint, errors bigint"
    for k, n in enumerate((3, 2)):
        spark.createDataFrame([(f"/x{k}{i}", "PermissionError") for i in range(n)] + [("/ok", "ok")], "dir string, outcome string").coalesce(1).write.mode("append").parquet(failed)
        ingest.running_totals(ingest.listing_stream(spark, raw), ingest.outcome_stream(spark, failed), out, check).awaitTermination()
        got = ingest.latest_batch(spark, out, schema).first()
        assert got["errors"] == (3, 5)[k] and got["files"] > 0
    batch = ingest.totals(listing.normalize_listing(spark.read.schema(listing.RAW_LISTING).parquet(raw)), spark.read.parquet(failed)).first()
    assert tuple(batch) == tuple(got)


def test_estimate_follows_ingest_without_reading(spark):
    e = fixtures.entries(spark, "/root/testdata/sf0.01")
    out = shared_dir(spark, "catalog")
    n = catalog.write_catalog(e, out)
    assert n == e.count()
    raw, check = shared_dir(spark, "raw"), shared_dir(spark, "check")
    new = fixtures.raw_listing(spark, "/root/testdata/sf0.01").withColumn("parent_path", F.concat(F.lit("/second"), "parent_path"))
    for part in range(2):  # the second half comes twice: paths count once
        new.filter((F.col("inode") % 2 == part) | (F.col("inode") % 4 == 0)).write.mode("append").parquet(raw)
        ingest.ingest_sketches(ingest.listing_stream(spark, raw, 3), out, check).awaitTermination()
    estimate = reports.approx_entries(catalog.read_sketches(spark, out))
    plan = estimate._jdf.queryExecution().executedPlan().toString()
    assert "path" not in plan.split("ReadSchema", 1)[1] and out + "/" not in plan
    exact = n + listing.normalize_listing(new).select("path").distinct().count()
    assert abs(estimate.first()["entries"] - exact) <= 0.05 * exact
    assert reports.approx_entries(catalog.read_sketches(spark, out).limit(0)).first()["entries"] == 0


def test_export_counts_without_reading_again(spark, monkeypatch):
    e = fixtures.entries(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(catalog, "read_catalog", None)
    meta = catalog.start_metadata(spark, "nfs://server/export", 5, 8)
    row = catalog.export_catalog(e, meta, tree.big_dirs(e, 20), shared_dir(spark, "export")).first()
    assert (row["entries_converted"], row["big_dirs_converted"]) == (e.count(), tree.big_dirs(e, 20).count())
