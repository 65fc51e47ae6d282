"""The powered holdout against a plain pass over whole regions."""

import hashlib

import pytest

from terravane.operators import sampling
from terravane.plans.catalog import QUERIES
from terravane.plans.place_queries import strata

SF = "/root/testdata/sf0.001"


def plain(rows, seed, slots):
    out = []
    for region in sorted({r["region"] for r in rows}):
        chosen = []
        for slot in range(slots):
            want = sampling.powered_target(slot)

            def score(r):
                missed = sum(p for k, p in sampling.PENALTY.items() if r[k] != want[k])
                return missed + 8 * sum(c["type"] == r["type"] for c in chosen) + 5 * sum(c["town"] == r["town"] for c in chosen)

            left = [r for r in rows if r["region"] == region and r["website"] == want["website"] and r not in chosen]
            chosen.append(min(left, key=lambda r: (score(r), hashlib.sha256(f"{seed}:{region}:{slot}:{r['venue_id']}".encode()).hexdigest(), r["venue_id"])))
        out += [(region, r["venue_id"], slot, "locked_holdout") for slot, r in enumerate(chosen)]
    return out


def test_the_query_equals_the_plain_pass(spark):
    rows = [r.asDict() for r in strata(spark, SF).drop("order_hash").collect()]
    got = [(r["region"], r["venue_id"], r["slot"], r["part"]) for r in QUERIES["powered_selection"](spark, SF).collect()]
    assert sorted(got) == sorted(plain(rows, "powered", 25))


def test_a_region_without_enough_venues_fails(spark):
    rows = strata(spark, SF).where("region = 'ASIA'").limit(8)
    with pytest.raises(Exception, match="lacks venues"):
        sampling.powered_holdout(rows, "x").collect()
    assert sampling.powered_holdout(rows.where("false"), "x").collect() == []
