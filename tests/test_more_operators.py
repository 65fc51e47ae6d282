"""Operators that no query goes through, on tables made by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from terravane.functions import filters, geo, html, stats, text
from terravane.operators import changes, entity, evaluation, evidence, facets, matching, sampling, spatial, web
from terravane.sources import places, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def feature(i, **properties):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [12.0, 45.0]}, "properties": {"id": i, "names": {"primary": "N"}, **properties}}


def test_extract_shapes(spark, tmp_path):
    shapes = {"a.json": {"type": "FeatureCollection", "features": [feature("1"), feature("2")]}, "b.json": [feature("1"), feature("2")], "c.json": {"places": [feature("1"), feature("2")]}}
    for name, value in shapes.items():
        (tmp_path / name).write_text(json.dumps(value))
        assert [r.id for r in places.extract(spark, str(tmp_path / name)).select("properties.id").orderBy("id").collect()] == ["1", "2"]
    assert places.documents_matching(spark, str(tmp_path), "c*.json").count() == 1


def test_address_evidence(spark):
    schema = "a struct<freeform: string, locality: string, postcode: string, country: string, country_code: string>"
    rows = [(("x", "Óderzo", "31046", "IT", None),), (("x", "Milano", "20100", "IT", None),), (("x", "Oderzo", "99999", None, "fr"),), ((None,) * 5,)]
    found = places.local_evidence(F.col("a"), "oderzo", ["31046"], "IT")
    got = spark.createDataFrame(rows, schema).select(found["evidence"].alias("e"), found["contradiction"].alias("c")).collect()
    assert [(r.e, r.c) for r in got] == [(["locality", "postcode", "country"], False), (["country"], True), (["locality"], True), ([], False)]


def test_map_elements_and_towns(spark):
    rows = [("node", 1, {"name": "Bar Uno", "amenity": "bar"}, 12.0, 45.0, None), ("way", 2, {"name": "X", "amenity": "bar"}, None, None, (12.0, 45.0)), ("way", 3, {"name": "Pub Tre", "amenity": "pub"}, None, None, (12.0, 45.0)), ("node", 4, {"name": "Bank", "amenity": "bank"}, 1.0, 1.0, None), ("node", 5, {"name": "Bar", "amenity": "bar"}, None, None, None)]
    frame = spark.createDataFrame(rows, "type string, id long, tags map<string, string>, lon double, lat double, center struct<lon: double, lat: double>")
    assert [r.osm_id for r in places.elements(frame, ["bar", "pub"]).orderBy("osm_id").collect()] == ["node/1", "way/3"]
    towns = spark.createDataFrame([("q", 0, "node", 1, [1.0] * 4), ("q", 1, "relation", 2, [1.0] * 3), ("q", 2, "relation", 3, [1.0] * 4), ("p", 0, "way", 4, [1.0] * 4)], "q string, position int, osm_type string, osm_id long, boundingbox array<double>")
    assert {r.q: r.osm_id for r in places.best_town(towns, ["q"]).collect()} == {"q": 3, "p": 4}


def test_source_manifest(spark):
    assert places.run_manifest(spark, "s", lambda s: s.range(3))[1] == {"source": "s", "status": "succeeded", "records": 3, "error": None}
    assert places.run_manifest(spark, "s", lambda s: s.range(0))[1]["status"] == "degraded"
    assert places.run_manifest(spark, "s", lambda s: s.table("nowhere"))[1]["status"] == "failed"
    assert places.run_manifest(spark, "s", None, enabled=False)[1]["status"] == "disabled"


def test_merged_regions_and_boxes(spark):
    ring = lambda x: [[[{"x": x, "y": 0.0}, {"x": x + 1, "y": 0.0}, {"x": x, "y": 1.0}]]]
    regions = spark.createDataFrame([("a", ring(0.0)), ("b", ring(5.0)), ("c", ring(9.0))], f"code string, rings {geo.RINGS}")
    done = spatial.merged_regions(regions, spark.createDataFrame([("ab", ["b", "a"])], "successor string, predecessors array<string>"), "code")
    assert {r.code: [p[0][0].x for p in r.rings] for r in done.collect()} == {"c": [9.0], "ab": [5.0, 0.0]}
    assert tuple(spatial.whole_box(regions).first()) == (0.0, 0.0, 10.0, 1.0)
    assert spatial.indexed(regions.where("code = 'a'"), size=0.5).count() == 9


def test_exports(spark):
    scan = spark.createDataFrame([([("v", [("t", "s")])],)], "rows array<struct<id: string, found: array<struct<title: string, snippet: string>>>>")
    assert "snippet" not in sinks.without_snippets(scan, "rows", "found").schema.simpleString()


def test_times(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, filters.valid_at(t("2024-01-01"), t("2024-01-01"), t("2024-01-02"))) and not one(spark, filters.valid_at(t("2024-01-02"), t("2024-01-01"), t("2024-01-02")))
    assert one(spark, filters.due_for_check(t("2024-01-02"), t("2024-01-02"), F.lit(None).cast("timestamp"))) and not one(spark, filters.due_for_check(t("2024-01-01"), t("2024-01-02"), F.lit(None).cast("timestamp")))
    now = F.lit(1_700_000_000_000).cast("long")
    headers = ("30", "1700000060", "Tue, 14 Nov 2023 22:14:20 GMT", "1", "Tue, 14 Nov 2023 22:00:00 GMT", "junk")
    assert [one(spark, stats.reset_delay_ms(F.lit(h), now)) for h in headers] == [30_000, 60_000, 60_000, 1_000, 0, None]
    rows = spark.createDataFrame([("review", dt.datetime(2024, 1, 1)), ("final", dt.datetime(2024, 1, 1))], "status string, at timestamp")
    assert [r.retry_after for r in evidence.with_retry(rows, "at", "status").collect()] == [dt.datetime(2024, 1, 8), None]


def test_words(spark):
    assert one(spark, text.has_term(F.lit("la carta dei vini"), ["carta dei"])) and not one(spark, text.has_term(F.lit("cartadei"), ["carta"]))
    assert one(spark, text.at_word_start(F.lit("al ponte (nuovo)"), "nuovo")) and not one(spark, text.at_word_start(F.lit("pontenuovo"), "nuovo"))
    assert one(spark, text.excerpt(F.lit("One bar. Two shops. Three BAR here! Four."), ["bar"], 40)) == "One bar. Three BAR here!"
    assert one(spark, html.italian_address(F.lit("Vieni in Via Roma, 12 31046 Oderzo"))) == "Via Roma, 12 31046"
    assert [one(spark, html.role(F.lit(w))) for w in ("ordina ora menu", "carta dei vini", "pizze", "chi siamo")] == ["order", "drinks", "specialty", None]
    assert one(spark, html.role(F.lit("x"), F.lit(True))) == "menu"


def test_joins(spark):
    events = spark.createDataFrame([(2, 10, "created"), (1, 11, "created"), (3, 10, "replaced")], "event_id long, attestation_id long, event string")
    attested = spark.createDataFrame([(10, "v", "a.b"), (11, "v", "c.d")], "attestation_id long, venue_id string, publisher_domain string")
    assert [r.event_id for r in matching.attestation_history(events, attested).collect()] == [1, 2, 3] and matching.attestation_history(events, attested, "a.b").count() == 2
    jobs = spark.createDataFrame([("v", 1, "queued", 1), ("v", 2, "running", 1), ("w", 3, "queued", 1)], "venue_id string, job_id long, status string, priority int")
    venues = spark.createDataFrame([("v", "x"), ("w", "y")], "venue_id string, place string")
    assert [r.job_id for r in matching.queued_candidates(jobs, venues, ["x"]).collect()] == [1]
    counts = spark.createDataFrame([("a", 2)], "state string, n long")
    assert {r.state: r.n for r in facets.zero_filled(counts, spark.createDataFrame([("a",), ("b",)], "state string"), ["state"]).collect()} == {"a": 2, "b": 0}
    rows = spark.createDataFrame([(None, ""), ("", None)], "a string, b string").select(changes.row_hash(["a", "b"]).alias("h"))
    assert rows.distinct().count() == 2


def test_models(spark):
    """Two scores of one slug, a name that another model's slug is, filters, and prices of free and routed models."""
    model = "id string, name string, context_length long, input_modalities array<string>, supported_parameters array<string>, prompt double, completion double, reasoning double"
    can = ["structured_outputs"]
    models = [
        ("x/Alpha-1:free", "Whatever", 64_000, ["text"], can, 0.0, 0.0, None), ("y/unknown", "Beta  Two!", 32_000, None, can, 1e-6, 2e-6, 3e-6), ("z/gamma", "Gamma", 99_000, ["text"], can, 1e-7, 1e-7, None),
        ("z/short", "Short", 16_000, ["text"], can, 0.0, 0.0, None), ("z/images", "Images", 64_000, ["image"], can, 0.0, 0.0, None), ("z/auto", "Auto", 64_000, ["text"], can, -1.0, -1.0, None), ("z/loose", "Loose", 64_000, ["text"], [], 0.0, 0.0, None), ("z/dear", "Dear", 64_000, ["text"], can, 1e-3, 1e-3, None),
    ]
    scores = [(1, "alpha-1", "A", 10.0), (2, "beta-two", "Other", 50.0), (3, "alpha-1", "B", 70.0), (4, "elsewhere", "Alpha 1", 60.0)]
    got = evaluation.model_shortlist(spark.createDataFrame(models, model), spark.createDataFrame(scores, "position int, slug string, name string, score double")).collect()
    assert [(r.id, r.score, r.slug, r.free) for r in got] == [("x/Alpha-1:free", 60.0, "elsewhere", True), ("y/unknown", 50.0, "beta-two", False), ("z/gamma", None, None, False), ("z/dear", None, None, False)]
    assert (got[1].usd_per_1000_triage, got[1].usd_per_1000_verifier, got[1].usd_per_million_output) == (5.4, 9.0, 3.0)


RESOURCE_CASES = [
    ("https://a.test/", "<a href='/menu'>Il menu</a>", [("https://a.test/menu", "menu", "high", ["same_official_domain", "menu_anchor"])]),
    ("https://a.test/", '<a href="https://other.com/menu">menu</a>', []),
    ("https://www.a.test/", '<a href="http://a.test/x?b=1&amp;c=2">Dolci</a><a href="#menu">menu</a><a href="mailto:menu@a.test">menu</a>', [("http://a.test/x?b=1&c=2", "menu", "high", ["same_official_domain", "menu_anchor"])]),
    ("https://pizza-smile.order.dish.co/", '<a href="/menus/dolci">Dolci</a>', [("https://pizza-smile.order.dish.co/menus/dolci", "order", "high", ["same_official_domain", "order_anchor"])]),
    ("https://a.test/", '<a href="/Listino.pdf"><img src="button-123.jpg" alt="Consulta prezzi"></a>', [("https://a.test/Listino.pdf", "menu", "high", ["same_official_domain", "pdf_url"])]),
    ("https://a.test/", '<a href="https://orders.example.test/al-bivio">Ordina online</a>', [("https://orders.example.test/al-bivio", "order", "high", ["linked_from_official_site", "order_anchor"])]),
    ("https://a.test/", '<a href="https://booking.example.test/table/1">Prenota il tuo tavolo</a>', [("https://booking.example.test/table/1", "booking", "medium", ["linked_from_official_site", "specialty_anchor"])]),
    ("https://a.test/", '<a href="/privacy-menu">Privacy del menu</a><a href="/camere">Ordina camere</a><a href="/">menu</a><a href="/chi">Chi siamo</a>', []),
    ("https://a.test/", '<a href="/pesce/">Pesce</a><a href="/pesce#x">Menu</a>', [("https://a.test/pesce/", "specialty", "medium", ["same_official_domain", "specialty_anchor"])]),
    ("https://a.test/", '<img src="/logo-menu.png"><img src="/m1.jpg" alt="Menu"><p>la nostra pizza, il menu</p><img src="/m2.jpg"><img src="/menu.jpg">', [("https://a.test/m1.jpg", "menu_image", "medium", ["same_official_domain", "menu_image_metadata"]), ("https://a.test/m2.jpg", "menu_image", "low", ["same_official_domain", "menu_image_context"])]),
    ("https://a.test/", None, []),
    (None, '<a href="/menu">menu</a>', []),
]


def test_resources_of_pages(spark):
    """Each case has a host of its own, so that all are one table."""
    own = lambda text, i: text and text.replace("a.test", f"a{i}.test")
    pages = [(own(page, i), own(html, i)) for i, (page, html, _) in enumerate(RESOURCE_CASES)]
    rows = web.resources(spark.createDataFrame(pages, "url string, html string")).orderBy("page", "is_image", "position").collect()
    for i, (page, html, want) in enumerate(RESOURCE_CASES):
        assert [(r.target, r.role, r.confidence, r.evidence) for r in rows if r.page == own(page, i)] == [(own(t, i), *rest) for t, *rest in want], html
    assert web.resources(spark.createDataFrame([], "url string, html string")).collect() == []


def test_entities(spark):
    pairs = spark.createDataFrame([(1, 2, True, 40, ["name_exact"]), (1, 3, True, 40, ["name_exact"])], "left long, right long, review boolean, score int, evidence array<string>")
    groups = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id long, group long")
    assert sorted((r.group, r.right) for r in entity.review_links(pairs, groups).collect()) == [(1, 2), (2, 2)]
    venues = spark.createDataFrame([("i1", "c1", "s1"), ("i2", "c2", "s2"), ("i3", "c3", "s3"), ("i4", "c4", "s4")], "identifier string, candidate_id string, source_record_id string")
    got = entity.stable_ids(venues, spark.createDataFrame([("i1", "A")], "identifier string, venue_id string"), spark.createDataFrame([("c2",)], "venue_id string"), spark.createDataFrame([("s1", "Z"), ("s3", "C")], "source_record_id string, venue_id string"))
    assert {r.identifier: r.venue_id for r in got.collect()} == {"i1": "A", "i2": "c2", "i3": "C", "i4": "c4"}


def test_assessments_and_scores(spark):
    rows = spark.createDataFrame([("v", "u", 1, 1), ("v", "u", 2, 2), ("v", "u", 2, 3), ("v", "w", 1, 4)], "venue_id string, candidate_url string, checked_at int, assessment_id long")
    assert sorted(r.assessment_id for r in evidence.latest_assessments(rows).collect()) == [3, 4]
    assert one(spark, web.site_total(F.lit(120), F.lit(50), F.lit(-5))) == 53
    assert one(spark, web.additive(F.array(F.lit("a"), F.lit("b"), F.lit("x")), {"a": 10, "b": -3})) == 7
    assert one(spark, web.site_outcome(F.lit(80), F.lit(60), F.array().cast("array<string>"))) == "accepted" and one(spark, web.site_outcome(F.lit(80), F.lit(60), F.array(F.lit("c")))) == "rejected"
    variants = spark.createDataFrame([("p", "http://www.a.b/m/?utm_source=1", "low", ["x", "y"]), ("p", "https://a.b/m", "high", ["x"]), ("p", "https://a.b/n", "low", ["x"])], "page string, target string, confidence string, evidence array<string>")
    assert sorted(r.target for r in web.preferred_variants(variants, ["page"]).collect()) == ["https://a.b/m", "https://a.b/n"]
    ranked = spark.createDataFrame([("a", "booking", "high", 1), ("b", "menu", "low", 1), ("c", "menu", "low", 2)], "target string, role string, confidence string, score int").orderBy(*web.resource_order())
    assert [r.target for r in ranked.collect()] == ["c", "b", "a"]
    assert sampling.audit_sample(spark.range(100).withColumnRenamed("id", "k"), "k", "s").count() == 20
