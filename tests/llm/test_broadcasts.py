"""What grows with the documents is never broadcast, as Spark sizes it by small files, or by the rows that others were made from."""

import random

from pyspark.sql import functions as F

from terravane.llm import common, components, decontam, simhash_neardup

SF = "/root/testdata/sf0.01"


def planned(monkeypatch, *modules):
    """The physical plans of the tables that these modules write from now on, without the tables that were hinted to be small."""
    plans, cut = [], common.cut

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for module in modules:
        monkeypatch.setattr(module, "cut", noted)
    return plans


def test_keys_of_fingerprints_are_not_broadcast(spark):
    prints = spark.createDataFrame([(random.Random(i).getrandbits(60),) for i in range(50)], "fp long")
    plan = simhash_neardup.hamming_links(common.cut(prints))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_op1_broadcasts_hot_keys_only(spark, monkeypatch):
    plans = planned(monkeypatch, simhash_neardup, components)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = simhash_neardup.simhash_components(docs)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    # Two joins hold hot keys, at most ``HOT_KEYS``.
    assert len(plans) > 5 and sum(p.count("BroadcastExchange") for p in plans) == 2
    assert last.agg(F.count("*")).first()[0] == docs.count()


def test_near_duplicates_broadcast_hot_keys_only(spark, monkeypatch):
    plans = planned(monkeypatch, simhash_neardup, components)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = simhash_neardup.keep_first(docs)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    # Hot keys are held in one join of fingerprints, one of labels and one of nodes.
    assert len(plans) > 15 and sum(p.count("BroadcastExchange") for p in plans) <= 3
    assert 0 < kept.count() < docs.count()


def test_salted_prefixes_are_not_broadcast(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plans = planned(monkeypatch, decontam)
    found = decontam.contamination(docs, items)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and not any("BroadcastExchange" in p for p in plans)
    assert found.where("n_hit > 0").count() > 0
