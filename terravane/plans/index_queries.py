"""Queries through the lead index: orders as leads of customers' nations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import LeadIndex
from .common import LEADS_SQL, leads, placed_customers


def index(spark: SparkSession, sf_dir: str) -> LeadIndex:
    rows = leads(spark, sf_dir).join(placed_customers(spark, sf_dir).select("c_custkey", "lon", "lat"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("status") == "F", "verified").when(F.col("status") == "O", "unchecked").otherwise("no_website")
    return LeadIndex(
        rows.select(
            F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("venue_id"), F.concat(F.lit("Café "), F.col("c_name")).alias("name"), status.alias("status"), F.col("segment").alias("category"), "region", F.substring("nation", 1, 3).alias("province"),
            F.col("nation").alias("municipality"), F.when(F.col("o_orderkey") % 4 == 0, "demo").alias("stage"), "lon", "lat", F.when(F.col("o_orderkey") % 3 == 0, F.lit("https://a.example/?q=\"1\",2")).alias("website"), F.when(F.col("o_orderkey") % 2 == 0, "1").alias("phone"), F.lit(None).cast("date").alias("next_on"),
        )
    )


INDEX_SQL = f"""{LEADS_SQL},
x AS (SELECT 'v' || o_orderkey AS venue_id, 'Café ' || c_name AS name, CASE status WHEN 'F' THEN 'verified' WHEN 'O' THEN 'unchecked' ELSE 'no_website' END AS status, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 4 ELSE 6 END AS status_ord, segment AS category, region,
  substr(nation, 1, 3) AS province, nation AS municipality, CASE WHEN o_orderkey % 4 = 0 THEN 'demo' END AS stage, 6.0::DOUBLE + (o_custkey * 7919 % 13000) / 1000.0::DOUBLE AS lon, 36.0::DOUBLE + (o_custkey * 104729 % 11000) / 1000.0::DOUBLE AS lat,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://a.example/?q="1",2' END AS website, CASE WHEN o_orderkey % 2 = 0 THEN '1' END AS phone,
  trim(regexp_replace(lower(strip_accents('Café ' || c_name)), '[^a-z0-9]+', ' ', 'g')) AS name_fold FROM leads)"""


def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of those with a phone whose name or town has the words, worst status first (SRT-01, SRT-02)."""
    found = index(spark, sf_dir).table(descending=True, offset=25, size=25, query="CAFÉ cust", has_phone=True, status=["verified", "no_website"])
    return found.select("venue_id", "name", "status", "rn", "total")


TABLE_SQL = f"""WITH {INDEX_SQL},
r AS (SELECT venue_id, name, status, row_number() OVER (ORDER BY status_ord DESC, name_fold, venue_id) AS rn, count(*) OVER () AS total FROM x WHERE phone IS NOT NULL AND status <> 'unchecked')
SELECT * FROM r WHERE rn > 25 AND rn <= 50"""


def index_towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest towns with their boxes, and that there are more (AGG-22, SRT-08)."""
    return index(spark, sf_dir).towns(10).select("municipality", "province", "n", F.round("west", 6).alias("west"), F.round("north", 6).alias("north"), "rn", "truncated")


INDEX_TOWNS_SQL = f"""WITH {INDEX_SQL},
t AS (SELECT municipality, province, count(*) AS n, round(min(lon), 6) AS west, round(max(lat), 6) AS north FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, municipality, province) AS rn, count(*) OVER () > 10 AS truncated FROM t)
SELECT * FROM r WHERE rn <= 10"""


def index_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A town by its name, in any case (SRT-09)."""
    return index(spark, sf_dir).locate("naTION 7", "NAT").select("municipality", "province", "n", F.round("south", 6).alias("south"), F.round("east", 6).alias("east"))


LOCATE_SQL = f"WITH {INDEX_SQL} SELECT municipality, province, count(*) AS n, round(min(lat), 6) AS south, round(max(lon), 6) AS east FROM x WHERE municipality = 'NATION_7' GROUP BY 1, 2"


def index_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection as lines of CSV (SNK-02, SNK-08)."""
    return index(spark, sf_dir).export(region=["EUROPE", "ASIA"], stage=["demo"]).select(F.regexp_replace("line", r",[0-9.]+,[0-9.]+,", ",").alias("line"))


EXPORT_SQL = f"""WITH {INDEX_SQL}
SELECT concat_ws(',', venue_id, name, status, category, region, province, municipality, CASE WHEN website IS NULL THEN '' ELSE '"' || replace(website, '"', repeat('"', 2)) || '"' END, coalesce(phone, '')) AS line FROM x WHERE region IN ('EUROPE', 'ASIA') AND stage = 'demo'"""

QUERIES = {"index_table": (index_table, TABLE_SQL), "index_towns": (index_towns, INDEX_TOWNS_SQL), "index_locate": (index_locate, LOCATE_SQL), "index_export": (index_export, EXPORT_SQL)}
