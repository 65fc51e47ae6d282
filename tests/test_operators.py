"""Operators on small tables made by hand."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from terravane.functions import filters, geo, stats, text, url
from terravane.operators import changes, entity, evidence, facets, history, paging, queue, sampling, spatial, web
from terravane.sources import places, sinks
from terravane.streaming import jobs


def values(spark, columns, data, schema):
    return spark.createDataFrame(data, schema).select(columns)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("k, n, lower", [(96, 96, 0.9615244121), (22, 22, 0.8513451254), (2, 3, 0.2076596008)])
def test_wilson(spark, k, n, lower):
    assert one(spark, stats.wilson(F.lit(k), F.lit(n)))["lower"] == pytest.approx(lower, abs=1e-9)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))) is None


def test_text(spark):
    cases = [
        (text.normalize(F.lit(" Caffè Ⅳ ﬁ ")), "caffe iv fi"),
        (text.words_only(F.lit("L'Osteria — Perù 2°"), "NFD"), "l osteria peru 2"),
        (text.venue_name(F.lit("da mario srl")), "da mario"),
        (text.core_name(F.lit("ristorante pizzeria da mario")), "da mario"),
        (text.core_name(F.lit("pizzeria bar")), "bar"),
        (text.phone_key(F.lit("+39 0422 123456")), "0422123456"),
        (text.phone_key(F.lit("3912345")), "3912345"),
        (text.title_case(F.lit("da MARIO al ponte")), "Da MARIO Al Ponte"),
        (text.quote_text(F.lit("“A”​–b")), '"a"-b'),
        (text.csv_line([F.lit('a"b'), F.lit(None).cast("string"), F.lit("c,d")]), '"a""b",,"c,d"'),
        (text.slug(F.lit("Perché no? Sì!")), "perche-no-si"),
    ]
    for column, want in cases:
        assert one(spark, column) == want
    assert one(spark, text.phones_match(F.lit("0422123456"), F.lit("422123456")))
    assert not one(spark, text.phones_match(F.lit("1234567"), F.lit("234567")))


def test_urls(spark):
    cases = [
        (url.registrable_domain(F.lit("https://www.shop.example.co.uk/x")), "example.co.uk"),
        (url.registrable_domain(F.lit("http://10.0.0.1:80/")), "10.0.0.1"),
        (url.registrable_domain(F.lit("mailto:x@y.z")), None),
        (url.candidate_url(F.lit("HTTPS://Ex.com?b=2&utm_source=x&a=1#f")), "https://ex.com/?a=1&b=2"),
        (url.canonical_url(F.lit("http://www.ex.com/a/?ref=1"), True), "https://ex.com/a"),
        (url.with_scheme(F.lit("ex.com/menu")), "http://ex.com/menu"),
        (url.resolve(F.lit("../menu.pdf"), F.lit("https://ex.com/a/b")), "https://ex.com/menu.pdf"),
        (url.website_kind(F.lit("https://m.facebook.com/x"), [], []), "social"),
    ]
    for column, want in cases:
        assert one(spark, column) == want


def test_points_on_edges_and_in_holes(spark):
    square, hole, beside = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)], [(4, 0), (8, 0), (8, 4), (4, 4)]
    with_hole, two = [[square, hole]], [[square], [beside]]
    cases = [(3, 3, with_hole, "inside"), (1.5, 1.5, with_hole, "outside"), (1, 1.5, with_hole, "boundary"), (4, 2, with_hole, "boundary"), (4, 2, two, "inside"), (9, 9, with_hole, "outside"), (None, 1, two, None)]
    rows = [(None if x is None else float(x), float(y), [[[{"x": float(a), "y": float(b)} for a, b in ring] for ring in p] for p in shape], want) for x, y, shape, want in cases]
    frame = spark.createDataFrame(rows, f"x double, y double, rings {geo.RINGS}, want string")
    assert all(r.got == r.want for r in frame.withColumn("got", geo.place_in(F.col("x"), F.col("y"), F.col("rings"))).collect())


def test_facets_ignore_their_own_filter(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "status string, kind string")
    found = facets.self_excluding_facets(rows, {"status": F.col("status").isin("a"), "kind": F.col("kind").isin("x")})
    assert {(r.facet, r.code): r.total for r in found.collect()} == {("status", "a"): 1, ("status", "b"): 1, ("status", None): 1, ("kind", "x"): 1, ("kind", "y"): 1}


@pytest.mark.parametrize("descending", [False, True])
def test_pages_hold_every_row_once(spark, descending):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(83)], "id long, k long")
    order = paging.ordering("k", descending, ["id"])
    ids = [r["id"] for at in range(0, 100, 20) for r in paging.page(rows, order, at, 20).orderBy("rn").collect()]
    assert sorted(ids) == list(range(83))
    assert ids[-1] % 5 == 0
    seen, cursor = [], None
    while True:
        got = paging.keyset_page(rows, ["k", "id"], cursor, 20, descending).orderBy("rn").collect()
        seen += [r["id"] for r in got]
        if not got or not got[-1]["has_next"]:
            break
        cursor = [got[-1]["k"], got[-1]["id"]]
    assert sorted(seen) == list(range(83)) and len(seen) == 83
    assert paging.decode_cursor(paging.encode_cursor([1, "ü"])) == [1, "ü"]
    assert paging.decode_cursor("!") is None


def test_diff_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, ""), (4, "d")], "id long, v string")
    assert {r.id: r.change for r in changes.diff(old, new, ["id"], ["v"]).collect()} == {1: "delete", 2: "update", 3: "update", 4: "insert"}
    assert changes.same_rows(old, old).isEmpty() and changes.same_rows(old, new).count() == 6


def test_greedy_groups_follow_the_best_score(spark):
    keys = spark.createDataFrame([(i, "t") for i in (1, 2, 3, 4)], "id long, town string")
    pairs = spark.createDataFrame([("t", 1, 3, 70, True), ("t", 2, 3, 90, True), ("t", 1, 2, 50, False), ("t", 3, 4, 80, True)], "town string, left long, right long, score int, merge boolean")
    assert {r.id: r.group for r in entity.greedy_groups(keys, pairs).collect()} == {1: 1, 2: 2, 3: 2, 4: 2}


def test_blocking_loses_no_pair(spark):
    base = dict(aliases=None, phone=None, website=None, address=None, street=None, house_number=None, postcode=None, place_id=None, locality=None, lat=45.0, lon=12.0, town="t")
    names = ["Da Mario", "Trattoria Da Mario", "Mario", "Bar Sport srl", "Sport", "Sportivo Bar", "Il Po", "Po"]
    rows = spark.createDataFrame([Row(id=i, name=n, **base) for i, n in enumerate(names)], "id long, name string, aliases array<string>, phone string, website string, address string, street string, house_number string, postcode string, place_id string, locality string, lat double, lon double, town string")
    keys = entity.prepared(rows)
    got = {(r.left, r.right) for r in entity.candidate_pairs(keys).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (6, 7)}
    scored = {(r.left, r.right): r for r in entity.scored_pairs(entity.candidate_pairs(keys), keys).collect()}
    assert scored[0, 1].evidence == ["name_alias", "distance_30"] and scored[0, 1].score == 70 and scored[0, 1].merge


def test_spatial_assignment(spark):
    square = [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]]]
    regions = spark.createDataFrame([("a", square), ("b", [[[{"x": p["x"] + 0.5, "y": p["y"]} for p in square[0][0]]]])], f"code string, rings {geo.RINGS}")
    points = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.7, 0.7), (3, 5.0, 5.0), (4, 1.4, 0.4), (5, 0.0, 0.3), (6, None, 0.1)], "id long, lon double, lat double")
    got = {r.id: (r.code, r.status) for r in spatial.assign(points, regions, "id", "code", "lon", "lat").collect()}
    assert got == {1: ("a", "assigned"), 2: (None, "ambiguous"), 3: (None, "outside"), 4: ("b", "assigned"), 5: (None, "ambiguous"), 6: (None, "outside")}


def test_queue(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [(1, "running", 1, 3, False, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)), (2, "running", 3, 3, False, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)), (3, "running", 1, 3, True, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)), (4, "running", 1, 3, False, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3))]
    frame = spark.createDataFrame(rows, "job_id long, status string, attempt_count int, max_attempts int, cancel_requested boolean, next_attempt_at timestamp, lease_expires_at timestamp")
    got = {r.job_id: r.status for r in queue.recovered(frame, now, 60, 3600).collect()}
    assert got == {1: "retry", 2: "dead_letter", 3: "cancelled", 4: "running"}
    requests = spark.createDataFrame([("b", 1, "day", 6), ("b", 2, "day", 6), ("b", 3, "day", 3), ("b", 3, "run", 1)], "budget string, request_id long, scope string, n long")
    limits = spark.createDataFrame([("b", "day", 10), ("b", "run", 5)], "budget string, scope string, most long")
    assert {r.request_id: r.granted for r in queue.reserve(requests, limits).collect()} == {1: True, 2: False, 3: True}
    steps = spark.createDataFrame([("v", 1, "contacted", False), ("v", 2, "new", True), ("v", 3, "demo", True), ("w", 1, "won", False), ("w", 2, "demo", True)], "venue string, id long, stage string, auto boolean")
    assert {r.venue: r.stage for r in queue.stage_after(steps, "venue", ["id"], "stage", "auto").collect()} == {"v": "demo", "w": "won"}


def test_attestations(spark):
    at = F.lit("2024-06-01").cast("timestamp")
    schema = "status string, lifecycle string, method string, website_url string, reviewed_at timestamp, expires_at timestamp, evidence_urls array<string>, reviewer string, venue_id string, expected_venue_id string"
    good = ("verified", "active", "official_registry", "https://a.b/", dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1), ["https://a.b/x"], None, "v", "v")
    rows = [good, (*good[:5], dt.datetime(2024, 6, 1), *good[6:]), (*good[:2], "manual_first_party_review", *good[3:]), (*good[:8], "u", "v"), ("rejected", *good[1:])]
    got = [r.f for r in spark.createDataFrame(rows, schema).select(evidence.attestation_fault(at).alias("f")).collect()]
    assert got == [None, "ownership_attestation_expired", "ownership_reviewer_missing", "ownership_venue_mismatch", "ownership_not_verified"]


def test_review_overlay(spark):
    base = spark.createDataFrame([("a", "verified", "x"), ("b", "verified", "x"), ("c", "unchecked", None), ("d", "unchecked", None)], "venue_id string, status string, domain string")
    decisions = spark.createDataFrame([("a", 1, "reject", "y"), ("b", 1, "reject", "x"), ("c", 1, "reject", "z"), ("c", 2, "approve", "z"), ("d", 1, "reject", "q")], "venue_id string, id long, decision string, domain string")
    got = {r.venue_id: r.status for r in evidence.review_overlay(base, decisions, ["id"]).collect()}
    assert got == {"a": "verified", "b": "rejected", "c": "verified", "d": "rejected"}


def test_sampling(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    a = [r.k for r in sampling.hash_sample(rows, "k", 20, "s").collect()]
    assert a == [r.k for r in sampling.hash_sample(rows.repartition(7), "k", 20, "s").collect()]
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "s string, n long")
    assert {r.s: r.quota for r in sampling.largest_remainder(counts, "s", "n", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    towns = spark.createDataFrame([("t", f"v{i}", f"{i:03d}", "bar" if i < 3 else "pub", "known" if i % 2 else "missing") for i in range(6)], "town string, venue_id string, order_hash string, type string, website string")
    got = [(r.website, r.type, r.venue_id) for r in sampling.balanced_types(towns, ["t"]).orderBy("n").collect()]
    assert got == [("known", "bar", "v1"), ("missing", "pub", "v4")]


def test_history(spark):
    rows = spark.createDataFrame([("p", i, ok) for i, ok in enumerate([False, False, True, False])], "p string, id long, ok boolean")
    streaks = [r.streak for r in history.runs(rows, ["p"], ["id"], F.col("ok")).orderBy("id").collect()]
    assert streaks == [1, 2, 0, 1]
    assert [r.failures for r in queue.circuits(rows, "p", ["id"], ~F.col("ok"), 2).collect()] == [1]


def test_search_scores(spark):
    schema = "name string, place string, haystack string, domain_text string, same_domain boolean, is_pdf boolean, has_food boolean, has_menu boolean, fallback boolean"
    rows = [("da mario", "treviso", "da mario ristorante treviso", "damario", False, False, True, False, False), ("da mario", "treviso", "pizza roma", "pizza", False, False, True, True, True)]
    got = [(r.outcome, r.score) for r in web.search_score(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("accepted", 34 + 28 + 16 + 18 + 8), ("rejected", 8 + 10 - 8)]


PLACES = """{"type":"Feature","geometry":{"type":"Point","coordinates":[12.0,45.0]},"properties":{"id":"a","confidence":0.95,"names":{"primary":"Bar Uno"},"categories":{"primary":"bar"},"websites":["uno.example.com"]}}
{"type":"Feature","geometry":{"type":"Point","coordinates":[12.0,45.0]},"properties":{"id":"b","confidence":0.5,"names":{"primary":"Due"},"categories":{"primary":"bar"}}}

{"type":"Feature","geometry":{"type":"Point","coordinates":[50.0,45.0]},"properties":{"id":"c","names":{"primary":"Tre"},"categories":{"primary":"bar"}}}
{"type":"Feature","geometry":{"type":"Point","coordinates":[12.0,45.0]},"properties":{"id":"d","names":{"primary":"Quattro"},"categories":{"primary":"bank","alternate":["bar"]}}}
"""


def test_import(spark, tmp_path):
    (tmp_path / "p.geojsonl").write_text(PLACES)
    mapped = places.admitted(places.geojson_sequence(spark, str(tmp_path / "p.geojsonl")), {"bar": "bar"}, (6.0, 36.0, 19.0, 48.0))
    assert {r.place_id: r.reason for r in mapped.collect()} == {"a": None, "b": "low_confidence", "c": "outside_region_bbox", "d": "non_food_category"}
    assert mapped.where("reason IS NULL").first().website == "http://uno.example.com"
    (tmp_path / "b.geojson").write_text('{"features":[{"type":"Feature","properties":{"istat_code":"1","municipality":"M"},"geometry":{"type":"Polygon","coordinates":[[[11,44],[13,44],[13,46],[11,46],[11,44]]]}}]}')
    towns = places.boundaries(spark, str(tmp_path / "b.geojson"))
    assert places.assigned(mapped, towns).first().istat_code == "1"
    (tmp_path / "bad.geojsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="malformed"):
        places.geojson_sequence(spark, str(tmp_path / "bad.geojsonl")).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, name string")
    v = sinks.write_snapshot(rows, str(tmp_path / "s"))
    assert v == sinks.write_snapshot(rows.repartition(3), str(tmp_path / "s"))
    assert sinks.read_snapshot(spark, str(tmp_path / "s"), v).count() == 2
    sinks.write_csv(rows.coalesce(1), ["id", "name"], str(tmp_path / "c"))
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "c").rglob("part-*.txt")))
    assert body == '﻿id,name\r\n1,"a,b"\r\n2,\r\n'.encode()


def test_streams(spark, tmp_path):
    events = [(1, i, f"k{i % 3}", dt.datetime(2024, 1, 1, 0, i)) for i in range(6)]
    spark.createDataFrame(events, "provider long, event_id long, key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("provider long, event_id long, key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = jobs.deduplicated(stream, "key", "ts", "1 hour").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 3


def test_due_and_reasons(spark):
    today = F.lit("2024-01-10").cast("date")
    days = ["2024-01-09", "2024-01-10", "2024-01-17", "2024-01-18", None]
    rows = spark.createDataFrame([(d,) for d in days], "d string").withColumn("d", F.col("d").cast("date"))
    assert [r.b for r in rows.select(filters.due_bucket(F.col("d"), today).alias("b")).collect()] == ["overdue", "today", "week", "later", "none"]
    assert [r.b for r in rows.select(filters.due("week", F.col("d"), today, F.lit(True)).alias("b")).collect()] == [True, True, True, False, False]


def test_circuit_stream_keeps_state_across_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "provider long, event_id long, failed boolean"
    for n, rows in enumerate(([(1, 1, True), (2, 2, True), (1, 3, True)], [(1, 4, True), (2, 5, False)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = []
    q = jobs.circuits(stream, 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, i: out.extend(b.collect())).start()
    q.awaitTermination(180)
    last = {r.provider: (r.failures, r.open) for r in out}
    assert last == {1: (3, True), 2: (0, False)}
