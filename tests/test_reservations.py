"""Reservations against budgets, next to a plain fold."""

import random

import pytest

from terravane.operators import queue

REQUESTS, LIMITS = "budget string, request_id long, scope string, n long", "budget string, scope string, most long"


def fold(requests, limits):
    most, by_request = {}, {}
    for b, s, m in limits:
        most[b, s] = min(m, most.get((b, s), m))
    for b, r, s, n in requests:
        mine = by_request.setdefault((b or "", r, b), {})
        mine[s] = max(n, mine.get(s, n))
    used, out = {}, []
    for (_, r, b), scopes in sorted(by_request.items(), key=lambda x: x[0][:2]):
        full = [s for s, n in sorted(scopes.items()) if (b, s) in most and used.get((b, s), 0) + n > most[b, s]]
        if not full:
            for s, n in scopes.items():
                used[b, s] = used.get((b, s), 0) + n
        out.append((b, r, not full, full[0] if full else None))
    return sorted(out, key=str)


def check(spark, requests, limits, **conf):
    got = queue.reserve(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(limits, LIMITS)).collect()
    assert sorted(((r["budget"], r["request_id"], r["granted"], r["exhausted"]) for r in got), key=str) == fold(requests, limits)


def test_requests_without_limits_are_granted(spark):
    check(spark, [("b", 1, "free", 9), ("b", 2, "free", 9), ("b", 2, "day", 5), ("c", 1, "day", 5)], [("b", "day", 4)])


def test_a_scope_named_twice_counts_once(spark):
    check(spark, [("b", 1, "day", 3), ("b", 1, "day", 3), ("b", 2, "day", 2), ("b", 2, "day", 1)], [("b", "day", 5), ("b", "day", 7)])


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_many_budgets_and_a_hot_one_equal_the_fold(spark, batch):
    """Amounts are carried on from batch to batch, and forgotten where a budget ends."""
    rng = random.Random(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        requests = [(rng.choice(["hot", "hot", *"abcdef"]), i, s, rng.randrange(1, 5)) for i in range(400) for s in rng.sample(["day", "run", "site", "free"], rng.randrange(1, 4))]
        check(spark, requests, [(b, s, rng.randrange(5, 200)) for b in ["hot", *"abcde"] for s in ("day", "run", "site")])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nulls_and_empty_tables(spark):
    check(spark, [], [("b", "day", 4)])
    check(spark, [("b", 1, "day", 3), (None, 2, "day", 3)], [])
