"""Pairs that meet in blocks against all pairs, and the tables that they are joined from."""

import random

import pytest

from terravane.operators import entity
from terravane.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"
RECORD = "id long, town string, name string, aliases array<string>, phone string, website string, address string, street string, house_number string, postcode string, place_id string, locality string, lat double, lon double"


def rows(seed):
    rng = random.Random(seed)
    some = lambda *values: rng.choice([*values, None])
    names = ["Da Mario", "Trattoria Da Mario", "Mario", "Bar Sport srl", "Sport", "Sportivo Bar", "Il Po", "Po", ""]
    return [
        (i, some("s", "t", "t"), some(*names), some([rng.choice(names)], rng.sample(names, 2), []), some("111111", "222222"), some("a.example", "b.example"), some("Via Roma 1", "Via Po 2"),
         some("Via Roma", "Via Po"), some("1", "2"), some("31000", "31001"), some("p1"), some("Roma", "Asti"), 45.0 + rng.randrange(3) / 1000, 12.0 + rng.randrange(3) / 100)
        for i in rng.sample(range(1000), 70)
    ]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_pairs_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(entity, "CHUNK", chunk)
    keys = entity.prepared(spark.createDataFrame(rows(chunk), RECORD)).localCheckpoint()
    ids = keys.select("id", "town")
    every = ids.toDF("left", "t").join(ids.toDF("right", "t"), "t").where("left < right").select("left", "right")
    wanted = {(r["left"], r["right"]): r for r in entity.scored_pairs(every, keys).collect()}
    can = {p for p, r in wanted.items() if {"name_exact", "name_alias"} & set(r["evidence"]) or "phone_exact" in r["evidence"] and {"website_exact", "address_exact"} & set(r["evidence"])}
    got = entity.evidence_pairs(keys).collect()
    assert sorted((r["left"], r["right"]) for r in got) == sorted(can) and can
    assert all(r == wanted[r["left"], r["right"]] for r in got)
    merges = entity.evidence_pairs(keys, mergeable=True).collect()
    assert sorted((r["left"], r["right"], r["score"]) for r in merges) == sorted((r["left"], r["right"], r["score"]) for p, r in wanted.items() if p in can and r["merge"])
    assert merges


@pytest.mark.parametrize("query", ["pair_evidence_score", "entity_groups"])
def test_keys_are_not_broadcast(spark, query):
    """Written keys are small on disk only. The sizes of large classes are the one table that is broadcast."""
    plan = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= (1 if query == "pair_evidence_score" else 0)
