"""Stored catalogues: plans that leave the stored rows where they are, and the same results."""

import pytest
from pyspark.sql import functions as F

from treestat.operators import diff, lookups, reports, tree
from treestat.plans import fixtures
from treestat.session import shared_dir
from treestat.sources import catalog, stored
from treestat.streaming import ingest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def both(spark):
    cur = stored.store(fixtures.entries(spark, SF), shared_dir(spark, "cur"), "test_cur", 8)
    base = stored.store(fixtures.baseline(spark, SF), shared_dir(spark, "base"), "test_base", 8)
    return cur, base


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that plans show the buckets
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("Final Plan") : text.index("Initial Plan")] if "Final Plan" in text else text


def test_changes_shuffle_no_path(both):
    cur, base = both
    df = diff.stored_changes(cur.by_path, base.by_path, base.by_inode)
    text = plan(df)
    assert "hashpartitioning(path" not in text and text.count("SortMergeJoin") == 3
    assert text.count("Exchange hashpartitioning(inode") == 1  # the current scan's own paths
    want = diff.changes(cur.by_path, base.by_path)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_deleted_paths_shuffle_nothing(both):
    cur, base = both
    df = diff.deleted_paths(cur.by_path, base.by_path)
    assert "Exchange" not in plan(df) and df.count() > 0


def test_keys_go_to_the_companion(spark, both):
    cur, base = both
    keys = fixtures.baseline(spark, SF).select("inode").repartition(5)
    df = lookups.contains(keys, cur.by_inode, "inode")
    text = plan(df)
    scan = next(k for k, x in enumerate(text.splitlines()) if "test_cur_by_inode" in x)
    assert not any("Exchange" in x for x in text.splitlines()[max(0, scan - 3) : scan])
    assert df.count() == lookups.contains(keys, fixtures.entries(spark, SF), "inode").count()
    assert "Exchange" not in plan(cur.by_inode)
    assert plan(stored.lookup_inode(cur, 7)).count("SelectedBucketsCount: 1 out of 8") == 1
    want = lookups.one_per_inode(fixtures.entries(spark, SF)).select("inode", "path")
    assert cur.by_inode.select("inode", "path").exceptAll(want).isEmpty() and cur.by_inode.count() == want.count()


def test_parent_is_resolved_by_the_writer(spark, both):
    cur, _ = both
    df = cur.by_path.select("path", "inode", "parent_id")
    assert "Join" not in plan(df) and "Exchange" not in plan(df)
    assert df.exceptAll(tree.parent_id(fixtures.entries(spark, SF))).isEmpty()


def test_direct_statistics_shuffle_sums_only(both):
    text = plan(tree.dir_stats(both[0].by_path))
    assert "hashpartitioning(path" not in text  # directories stay; sums by parent come to them


def test_attach(spark, both):
    again = stored.attach(spark, both[0].root, "test_again")
    assert again.by_path.exceptAll(both[0].by_path).isEmpty() and again.by_path.count() == both[0].by_path.count()
    df = diff.deleted_paths(again.by_path, both[1].by_path)
    assert "Exchange" not in plan(df)
    assert plan(again.by_inode.filter(F.col("inode") == 7)).count("SelectedBucketsCount: 1 out of 8") == 1


def test_companion_follows_the_log(spark):
    raw = fixtures.raw_listing(spark, "/root/testdata/sf0.001")
    files, log, check = (shared_dir(spark, x) for x in ("raw", "log", "check"))
    raw.write.parquet(files)
    ingest.upsert_log(ingest.listing_stream(spark, files), log, check).awaitTermination()
    first = ingest.compact_stored(spark, log, shared_dir(spark, "first"), "test_first", buckets=4)
    raw.limit(0).write.mode("append").parquet(files)
    moved = raw.filter("name NOT IN ('.', '..') AND inode % 5 = 0").withColumns({"name": F.concat(F.lit("zz-"), "name"), "scan_seq": F.col("scan_seq") + 1})
    moved.write.mode("append").parquet(files)
    ingest.upsert_log(ingest.listing_stream(spark, files), log, check).awaitTermination()
    second = ingest.compact_stored(spark, log, shared_dir(spark, "second"), "test_second", first.by_path.drop("parent_id"), 4)
    want = lookups.one_per_inode(second.by_path)
    assert second.by_inode.exceptAll(want).isEmpty() and second.by_inode.count() == want.count()
    assert second.by_path.count() == first.by_path.count() + moved.count()
    renamed = second.by_inode.filter("inode % 5 = 0 AND entry_type = 0 AND name LIKE 'zz-%'").count()
    assert renamed > 0
    estimate = reports.approx_entries(catalog.read_sketches(spark, second.root)).first()["entries"]
    assert abs(estimate - second.by_path.count()) <= 0.05 * estimate
