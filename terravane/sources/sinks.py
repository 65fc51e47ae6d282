"""Snapshots, exports and backups."""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import csv_line
from ..functions.url import registrable_domain
from ..operators.evaluation import bag_fingerprint


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, content: dict) -> None:
    """Put a small file in place of another in one step: written aside, then renamed over it."""
    aside, files = _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options
    over = spark.sparkContext._gateway.new_array(options.Rename, 1)
    over[0] = options.Rename.OVERWRITE
    target, _ = _file(spark, path)
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(aside), files.makeQualified(target), over)


def _pointed(spark: SparkSession, path: str) -> dict | None:
    at, files = _file(spark, path)
    return json.loads(spark.read.option("wholetext", "true").text(path).first()["value"]) if files.exists(at) else None


def write_snapshot(rows: DataFrame, folder: str) -> str:
    """Publish ``rows`` under the hash of their content; the version (SNK-01, SNK-03).

    The table is written to a folder of its own, then a file that names the version is put in place in one step, and
    with another the version becomes the current one. Readers follow these pointers, so they see a whole version or
    the one before, and a write that fails leaves both as they were. Equal content is one version and is not
    written again. Old versions stay until ``prune``.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    version = bag_fingerprint(rows, sorted(rows.columns)).first()["fingerprint"][:16]
    known = _pointed(spark, f"{folder}/versions/{version}.json")
    if known is None:
        data = f"data/{version}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{folder}/{data}")
        known = {"version": version, "data": data, "schema": rows.schema.jsonValue()}
        _point(spark, f"{folder}/versions/{version}.json", known)
    if (_pointed(spark, f"{folder}/current.json") or {}).get("version") != version:
        _point(spark, f"{folder}/current.json", known)
    return version


def read_snapshot(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """A version that was published, the current one by default."""
    folder = folder.rstrip("/")
    known = _pointed(spark, f"{folder}/current.json" if version is None else f"{folder}/versions/{version}.json")
    if known is None:
        raise ValueError(f"no version {version or ''} in {folder}")
    return spark.read.schema(StructType.fromJson(known["schema"])).parquet(f"{folder}/{known['data']}")


def prune(spark: SparkSession, folder: str, keep: list[str]) -> list[str]:
    """Delete all versions but the current one and those to ``keep``, and what failed writes have left; the names deleted."""
    folder = folder.rstrip("/")
    current = _pointed(spark, f"{folder}/current.json") or {}
    kept = {*keep, current.get("version")}
    gone = []
    for part in ("versions", "data"):
        at, files = _file(spark, f"{folder}/{part}")
        for status in files.listStatus(at) if files.exists(at) else ():
            name = status.getPath().getName()
            if part == "versions" and name.split(".")[0] not in kept or part == "data" and not any((_pointed(spark, f"{folder}/versions/{v}.json") or {}).get("data") == f"data/{name}" for v in kept if v):
                files.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)


def write_csv(rows: DataFrame, columns: list[str], folder: str) -> None:
    """Lines quoted only where needed, ended by CR LF, under a header with a byte-order mark in each file (SNK-02).

    Files are written where the rows are; the header goes to a file of its own that sorts first.
    """
    spark = rows.sparkSession
    header = spark.createDataFrame([("﻿" + ",".join(columns),)], "line string").coalesce(1)
    header.write.option("lineSep", "\r\n").mode("overwrite").text(f"{folder}/0-header")
    rows.select(csv_line([F.col(c) for c in columns]).alias("line")).write.option("lineSep", "\r\n").mode("overwrite").text(f"{folder}/1-rows")


def write_backup(tables: dict[str, DataFrame], folder: str, day: str) -> None:
    """All tables under a day's folder (SNK-05)."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/day={day}/{name}")


def without_snippets(scan: DataFrame, column: str, nested: str) -> DataFrame:
    """A nested array without the snippet field of its structs (SNK-06)."""
    return scan.withColumn(column, F.transform(F.col(column), lambda x: x.withField(nested, F.transform(x[nested], lambda y: y.dropFields("snippet")))))


def legacy_export(venues: DataFrame, facts: DataFrame, attestations: DataFrame, at: Column, municipality: str = "") -> DataFrame:
    """``name, canonical_venue_id, website, resources`` of active venues, of one municipality or of all (SNK-07).

    The website is the first accepted website fact, by address, for whose registrable domain the venue has a verified
    attestation that was reviewed by ``at`` and has not expired then. Resources are the accepted ones, by address, and
    none without a website. Venues: venue_id, display_name, municipality, lifecycle. Facts: venue_id, kind, url, role,
    decision, lifecycle. Attestations: venue_id, domain, decision, lifecycle, reviewed_at, expires_at.
    """
    live = attestations.where("decision = 'verified' AND lifecycle = 'active'").where((F.col("reviewed_at") <= at) & (F.col("expires_at") > at)).select("venue_id", "domain").distinct()
    accepted = facts.where("decision = 'accepted' AND lifecycle = 'active'")
    sites = accepted.where("kind = 'website'").select("venue_id", "url", registrable_domain(F.col("url")).alias("domain"))
    website = sites.join(live, ["venue_id", "domain"]).groupBy("venue_id").agg(F.min("url").alias("website"))
    resources = accepted.where("kind = 'resource'").groupBy("venue_id").agg(F.array_sort(F.collect_list(F.struct("url", "role"))).alias("resources"))
    chosen = venues.where((F.col("lifecycle") == "active") & ((F.lit(municipality) == "") | (F.col("municipality") == municipality)))
    none = F.array().cast("array<struct<url: string, role: string>>")
    out = chosen.join(website, "venue_id", "left").join(resources, "venue_id", "left")
    shown = F.when(F.col("website").isNotNull(), F.coalesce("resources", none)).otherwise(none)
    return out.select(F.col("display_name").alias("name"), F.col("venue_id").alias("canonical_venue_id"), "website", shown.alias("resources"))
