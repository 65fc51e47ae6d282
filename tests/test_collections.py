"""Feature collections written a nation each, where tasks are not merged."""

from terravane.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_each_collection_is_one_file_at_any_number_of_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "1b")
    try:
        rows = QUERIES["places_in_collections"](spark, SF).select("place_id").collect()
    finally:
        spark.conf.set(name, before)
    want = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("'p' || c_custkey AS place_id").collect()
    assert sorted(r["place_id"] for r in rows) == sorted(r["place_id"] for r in want)
