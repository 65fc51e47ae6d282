"""Captured searches, directories and benchmark manifests."""

import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.url import host
from ..operators.history import first_sights


def search_results(captured: DataFrame) -> DataFrame:
    """One row a result of captured searches ``(query_position, query, provider, results)`` in order (SRC-11)."""
    each = captured.select("query_position", "query", "provider", F.posexplode("results").alias("rank", "r"))
    return each.select("query_position", "query", "provider", "rank", F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.col("r.snippet").alias("snippet"))


def discovered(results: DataFrame, verdict: Column, most_queries: int = 4) -> tuple[DataFrame, DataFrame]:
    """Results of the first queries that are admitted, each address once; and accepted and new ones by query (SRC-09, AGG-14)."""
    tried = results.where(F.col("query_position") < most_queries).withColumn("verdict", verdict)
    good = tried.where("verdict = 'admitted'")
    first = W.partitionBy("url").orderBy("query_position", "rank")
    once = good.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return once, first_sights(good, "query_position", "url")


def directory_entries(results: DataFrame, domain: str) -> DataFrame:
    """Entries of one directory, once for each path, with a name from the title (SRC-10)."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    rows = results.where((host(F.col("url")) == domain) & (path != "/")).withColumn("path", path)
    name = F.trim(F.regexp_replace(F.regexp_replace("title", r"\s*[|–-]\s*[^|–-]*$", ""), r"\s+", " "))
    first = W.partitionBy("path").orderBy("query_position", "rank")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("path", "url", name.alias("name")).where(F.length("name") >= 2)


def manifest(spark: SparkSession, path: str) -> dict:
    """A benchmark manifest with what it extends filled in, and its scans and truth sets read (SRC-16).

    Manifests are small and read by the driver; overrides win by municipality id.
    """

    def read(at: str) -> dict:
        return json.loads(spark.read.option("wholetext", "true").text(at).first()["value"])

    found, folder = read(path), posixpath.dirname(path)
    base = manifest(spark, posixpath.join(folder, found["extends"])) if found.get("extends") else {"municipalities": []}
    merged = {m["id"]: m for m in base["municipalities"]}
    for m in found.get("municipalities", []):
        merged[m["id"]] = {**merged.get(m["id"], {}), **m}
    for key, scan in (found.get("scan_overrides") or {}).items():
        if key in merged:
            merged[key]["scan"] = scan
    for m in merged.values():
        if isinstance(m.get("scan"), str):
            m["scan"] = read(posixpath.join(folder, m["scan"]))
        if isinstance(m.get("truth_set"), str):
            m["cases"] = read(posixpath.join(folder, m["truth_set"]))["cases"]
    return {**base, **{k: v for k, v in found.items() if k not in ("extends", "scan_overrides")}, "municipalities": list(merged.values())}


def cases(spark: SparkSession, found: dict) -> DataFrame:
    rows = [(m["id"], c["id"], c["selector"].get("name"), c["selector"].get("osm_id"), bool(c["expected"].get("venue")), c["expected"].get("official_websites") or []) for m in found["municipalities"] for c in m.get("cases", [])]
    return spark.createDataFrame(rows, "municipality string, case_id string, name string, osm_id string, is_venue boolean, websites array<string>")
