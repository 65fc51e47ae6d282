"""Snapshots behind pointers, the legacy export, and pages of any depth."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terravane.operators import paging
from terravane.sources import sinks

AT = "2024-06-01 00:00:00"


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_readers_follow_the_pointer(spark, tmp_path):
    folder = str(tmp_path / "s")
    first = sinks.write_snapshot(frame(spark, 1, 2), folder)
    assert ids(sinks.read_snapshot(spark, folder)) == [1, 2]
    second = sinks.write_snapshot(frame(spark, 3), folder)
    assert ids(sinks.read_snapshot(spark, folder)) == [3] and ids(sinks.read_snapshot(spark, folder, first)) == [1, 2]
    # A version that is there already is pointed to, not written again.
    held = sorted(p.name for p in (tmp_path / "s/data").iterdir())
    assert sinks.write_snapshot(frame(spark, 2, 1).repartition(3), folder) == first
    assert ids(sinks.read_snapshot(spark, folder)) == [1, 2] and sorted(p.name for p in (tmp_path / "s/data").iterdir()) == held
    assert sinks.prune(spark, folder, []) and ids(sinks.read_snapshot(spark, folder)) == [1, 2]
    with pytest.raises(ValueError, match=second):
        sinks.read_snapshot(spark, folder, second)


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    folder = str(tmp_path / "s")
    sinks.write_snapshot(frame(spark, 1), folder)
    # The content can be hashed, but the write of it fails.
    failing = frame(spark, 7).withColumn("name", F.when(F.rand() < 2, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_snapshot(failing, folder)
    bad = sinks._point
    try:
        sinks._point = lambda *a: (_ for _ in ()).throw(OSError("no pointer"))
        with pytest.raises(OSError):
            sinks.write_snapshot(frame(spark, 8), folder)
    finally:
        sinks._point = bad
    assert ids(sinks.read_snapshot(spark, folder)) == [1]
    assert len(sinks.prune(spark, folder, [])) == 1 and ids(sinks.read_snapshot(spark, folder)) == [1]


def test_empty_tables_and_unknown_folders(spark, tmp_path):
    version = sinks.write_snapshot(frame(spark, 1).where("false"), str(tmp_path / "s"))
    assert sinks.read_snapshot(spark, str(tmp_path / "s"), version).schema == frame(spark, 1).schema
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, str(tmp_path / "none"))


def test_legacy_export_asks_for_a_live_attestation_of_the_websites_domain(spark):
    day = lambda d: dt.datetime(2024, *d)
    venues = spark.createDataFrame([(v, v.upper(), "m" if v != "f" else "n", "retired" if v == "g" else "active") for v in "abcdefg"], "venue_id string, display_name string, municipality string, lifecycle string")
    facts = [(v, "resource", f"https://x.it/{v}{i}", "menu", "accepted", "active") for v in "abcdefg" for i in (1, 0)]
    facts += [(v, "website", f"https://www.{v}.it/home", None, "accepted", "active") for v in "abcdefg"]
    facts += [("a", "website", "https://a-first.it/", None, "accepted", "active"), ("a", "website", "https://www.a.it/better", None, "rejected", "active"), ("a", "resource", "https://x.it/old", "menu", "accepted", "stale")]
    attested = [
        ("a", "a.it", "verified", "active", day((1, 1)), day((12, 1))), ("a", "a.it", "verified", "active", day((1, 1)), day((11, 1))), ("b", "b.it", "verified", "active", day((1, 1)), day((6, 1))),
        ("c", "other.it", "verified", "active", day((1, 1)), day((12, 1))), ("d", "d.it", "verified", "active", day((6, 2)), day((12, 1))), ("e", "e.it", "rejected", "active", day((1, 1)), day((12, 1))),
        ("f", "f.it", "verified", "active", day((6, 1)), day((12, 1))), ("g", "g.it", "verified", "active", day((1, 1)), day((12, 1))),
    ]
    facts = spark.createDataFrame(facts, "venue_id string, kind string, url string, role string, decision string, lifecycle string")
    attested = spark.createDataFrame(attested, "venue_id string, domain string, decision string, lifecycle string, reviewed_at timestamp, expires_at timestamp")
    at = F.lit(AT).cast("timestamp")
    got = {r["canonical_venue_id"]: (r["name"], r["website"], [x["url"] for x in r["resources"]]) for r in sinks.legacy_export(venues, facts, attested, at).collect()}
    shown = {v: f"https://www.{v}.it/home" if v in "af" else None for v in "abcdef"}
    assert got == {v: (v.upper(), w, [f"https://x.it/{v}0", f"https://x.it/{v}1"] if w else []) for v, w in shown.items()}
    assert {r["canonical_venue_id"] for r in sinks.legacy_export(venues, facts, attested, at, "n").collect()} == {"f"}


def test_deep_pages_read_one_range(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 100).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("v")).repartition(7)
    order = paging.ordering("v", True, ["k", "id"])
    index = paging.pages(rows, order, rows_a_range=500)
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    assert index.total == 5000 and len(index.before) == 11
    got = {r["rn"]: r["id"] for r in index.ranked().collect()}
    assert [got[i + 1] for i in range(5000)] == want
    for offset, size in ((0, 50), (2480, 50), (4990, 50), (6000, 10), (777, 500)):
        found = sorted(index.page(offset, size).collect(), key=lambda r: r["rn"])
        assert [(r["rn"], r["id"]) for r in found] == [(i + 1, want[i]) for i in range(offset, min(5000, offset + min(size, 200)))]
    plan = index.page(3010, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert paging.pages(rows.where("false"), order).page(0, 10).collect() == []
