"""Two sets of keys against each other: counts by case, and tasks that follow the rows."""

import random
import re

from pyspark.sql import functions as F

from terravane.operators import evaluation


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "ROWS_A_TASK", 100)
    a = spark.range(3000).select(F.col("id").alias("case_id"), (F.col("id") % 7).alias("url"))
    b = spark.range(1000, 4000).select(F.col("id").alias("case_id"), (F.col("id") % 7).alias("url"))
    sizes = [r["count"] for r in evaluation._sides(a, b, ["case_id", "url"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 60 and sum(sizes) == 4000 and max(sizes) <= 150


def made(rng, n, columns):
    """Rows with repeats and nulls."""
    return [tuple(rng.choice([None, *range(6)]) for _ in range(columns)) for _ in range(n)]


def counted(a, b, by):
    """Found, only in the first and only in the second by ``by``; a key with a null is never found."""
    out = {}
    for k in set(a) | set(b):
        n = out.setdefault(by(k), [0, 0, 0])
        both = k in a and k in b and None not in k
        n[0] += both
        n[1] += k in a and not both
        n[2] += k in b and not both
    return out


def test_fixture_scores_with_repeats_and_nulls(spark):
    rng = random.Random(3)
    a, b = made(rng, 150, 3), made(rng, 150, 3)
    frame = lambda rows: spark.createDataFrame(rows, "case_id int, url int, role int")
    rows = evaluation.fixture_scores(frame(a), frame(b), ["url", "role"]).collect()
    assert {r["case_id"]: [r["found"], r["missed"], r["extra"]] for r in rows} == counted(a, b, lambda k: k[0])
    assert len(rows) == 7 and all(r["exact"] == (r["missed"] == r["extra"] == 0) for r in rows)
    assert evaluation.fixture_scores(frame([]), frame([]), ["url", "role"]).collect() == []


def test_match_counts_with_repeats_and_nulls(spark):
    rng = random.Random(4)
    a, b = made(rng, 200, 3), made(rng, 200, 3)
    frame = lambda rows: spark.createDataFrame(rows, "k int, s int, role int")
    rows = evaluation.match_counts(frame(a), frame(b), ["k", "s", "role"], ["role"]).collect()
    assert {r["role"]: [r["tp"], r["fp"], r["fn"]] for r in rows} == counted(a, b, lambda k: k[2])
    assert len(rows) == 7 and next(r for r in rows if r["role"] is None)["precision"] == 0


def test_match_counts_of_many_rows_take_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "ROWS_A_TASK", 100)
    dealt, sides = [], evaluation._sides
    monkeypatch.setattr(evaluation, "_sides", lambda *args: dealt.append(sides(*args)) or dealt[-1])
    a, b = (spark.range(at, at + 2000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("role")) for at in (0, 500))
    found = {r["role"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.match_counts(a, b, ["k", "role"], ["role"]).collect()}
    assert found == {0: (500, 167, 167), 1: (500, 167, 166), 2: (500, 166, 167)}
    assert dealt[0].select(F.spark_partition_id()).distinct().count() == 40


def dealing(frame):
    """What the rows are dealt by, from the plan: the columns and the number of tasks."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*), (\d+)\), REPARTITION_BY_NUM", plan), plan.count("Exchange hashpartitioning")


def test_rows_are_dealt_once_by_their_keys_alone(spark):
    a, b = (spark.range(at, at + 200).select(F.col("id").alias("case_id"), (F.col("id") % 3).alias("url")) for at in (0, 50))
    dealt, n = dealing(evaluation._sides(a, b, ["case_id", "url"]))
    assert n == len(dealt) == 1 and "__apart" not in dealt[0][0] and dealt[0][1] == "4"


def test_more_rows_first_take_more_tasks_then_larger_ones():
    """At 360 times sf0.1 fixture_scores deals 305,926,200 rows, match_metrics 334,755,360; above 200 tasks the writers hold their rows."""
    assert [evaluation._tasks(n, 12) for n in (0, 5_098_770, 50_987_700, 305_926_200, 334_755_360)] == [12, 12, 98, 200, 200]
    assert evaluation._tasks(334_755_360, 400) == 400 and evaluation._tasks(0, 0) == 1
    assert all(n <= evaluation._tasks(n, 12) * 4 * evaluation.ROWS_A_TASK for n in (10**9, 10**11))
