"""JSON of any depth: nodes, identifiers, and what pages say of themselves."""

import json

import pytest
from pyspark.sql import functions as F

from terravane.operators import harvest
from terravane.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def walked(value, found):
    if isinstance(value, list):
        for v in value:
            walked(v, found)
    elif isinstance(value, dict):
        for k, v in value.items():
            if k in harvest.KEYS and isinstance(v, str) and v.startswith("venue:"):
                found.add(v)
            walked(v, found)
    return found


def test_identifiers_at_any_depth(spark):
    deep = {"venue_id": "venue:bottom"}
    for i in range(16):
        deep = {"k": [deep, i]} if i % 2 else {"venue_id": {"venue_id": "no", "x": deep}}
    values = [
        {"venue_id": "venue:\"quo\\ted\" è \n"}, [{"canonical_venue_id": "venue:a"}, [[{"duplicate_of_venue_id": "venue:b"}]]],
        {"venue_id": 7, "canonical_venue_id": None, "other": "venue:c", "duplicate_of_venue_id": ["venue:d"]}, deep, "venue:e", [], {}, 3, None,
        {"text": '{"venue_id":"venue:inside a text"}'}, {"canonical_venue_id": "venue:a"},
    ]
    rows = [(json.dumps(v),) for v in values] + [('{"venue_id": "venue:slash\\/u\\u0041"}',), ("{broken",), ("",), (None,)]
    got = [r["venue_id"] for r in harvest.venue_ids(spark.createDataFrame(rows, "doc string"), "doc").collect()]
    want = set()
    for v in values:
        walked(v, want)
    assert sorted(got) == sorted(want | {"venue:slash/uA"})


def test_nodes_are_visited_parents_first(spark):
    rows = spark.createDataFrame([(1, '{"a":[1,{"b":2}],"c":"x"}'), (2, None), (3, "5")], "id int, text string")
    found = harvest.nodes(rows.select("id", F.try_parse_json("text").alias("v")), "v").select("id", "path", "name", F.to_json("v").alias("v"))
    got = sorted((r["id"], list(r["path"]), r["name"], r["v"]) for r in found.collect())
    assert got == sorted([(1, [], None, '{"a":[1,{"b":2}],"c":"x"}'), (1, [0], "a", '[1,{"b":2}]'), (1, [0, 0], None, "1"), (1, [0, 1], None, '{"b":2}'), (1, [0, 1, 0], "b", "2"), (1, [1], "c", '"x"'), (3, [], None, "5")])
    assert harvest.nodes(rows.where("false").select("id", F.parse_json("text").alias("v")), "v").collect() == []


def page(*blocks, quote='"'):
    return "<html>" + "".join(f"<script type={quote}application/ld+json{quote}>{b}</script>" for b in blocks) + "</html>"


CASES = [
    (page('{"@type":"Restaurant","name":"da mario","telephone":" 0422 1 ","address":"Via Roma 1"}'), ("Da Mario", "0422 1", "Via Roma 1", True)),
    (page('{"@type":"Restaurant","name":"l\'isola"}', quote="'"), ("L'Isola", None, None, True)),
    (page('{"@type":{"odd":1},"name":"xyz","telephone":5}'), (None, "5", None, False)),
    (page('{"@type":["WebSite","Thing"],"name":"the site"}', '{"@graph":[{"@type":"Organization","name":"the firm"},{"@type":["X","BarOrPub"],"name":"the bar at"}]}'), ("The Bar At", None, None, True)),
    (page('{"@type":"Restaurant","name":"first one"}', '{"@type":"Restaurant","name":"second one","telephone":"9"}'), ("First One", "9", None, True)),
    (page('{"@type":"Restaurant","name":"Pizzeria"}', '{"@type":"LocalBusiness","name":"real name"}'), ("Real Name", None, None, True)),
    (page("{broken", '{&quot;@type&quot;:&quot;Restaurant&quot;,&quot;name&quot;:&quot;caffè &amp; co&quot;}'), ("Caffè & Co", None, None, True)),
    (page('{"address":{"streetAddress":" Via  Po 3 ","postalCode":31046,"addressLocality":"Oderzo","addressRegion":"TV","addressCountry":{"name":"Italy"}}}'), (None, None, "Via Po 3, 31046, Oderzo, TV", False)),
    (page('{"address":{}}', '{"x":{"address":"Via Due 2"}}'), (None, None, "Via Due 2", False)),
    ("<html>no block</html>", None),
    ("", None),
    (None, None),
]


def test_page_facts_in_json_ld(spark):
    rows = spark.createDataFrame([(i % len(CASES), html, 5, "kept") for i, (html, _) in enumerate(CASES * 2)], "page_id int, html string, json_ld int, name string")
    got = harvest.json_ld(rows).collect()
    assert len(got) == 2 * len(CASES) and all(r["name"] == "kept" for r in got)
    for r in got:
        said, want = r["json_ld"], CASES[r["page_id"]][1]
        assert (said and (said["name"], said["telephone"], said["address"], said["venue_schema"])) == want, r["html"]
    of = {r["page_id"]: r["json_ld"]["components"].asDict() for r in got if r["json_ld"] and r["json_ld"]["components"]}
    assert of[7] == {"street": "Via Po 3", "postal_code": "31046", "locality": "Oderzo", "province": "TV", "country": "Italy", "source_text": None}
    assert of[0]["source_text"] == "Via Roma 1"
    assert harvest.json_ld(rows.where("false")).collect() == []


@pytest.mark.parametrize("name", ["harvested_ids", "structured_pages"])
def test_queries_have_no_python_workers(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
