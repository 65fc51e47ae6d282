"""Nodes, identifiers and page facts out of JSON of any depth."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import decode_entities
from ..tables import cut

# The keys that hold venue identifiers; kinds of things that JSON-LD describes, with their priority; names that say nothing.
KEYS = ["venue_id", "canonical_venue_id", "duplicate_of_venue_id"]
KINDS = [("restaurant|foodestablishment|cafe|bar|pub", 3), ("localbusiness|organization", 2), ("website", 1)]
GENERIC = "^(ristorante|pizzeria|trattoria|osteria|bar|home|homepage)$"


def nodes(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with a row for every node of the variant ``value``: its ``path`` and ``name`` besides the other columns.

    The path lists the positions on the way from the root, whose own path is empty; paths sort as a walk visits the
    nodes, parents first. Members of an object stand in the order of their names, as variants keep them. ``name`` is
    that of a member, null for others. Values that are null have no nodes. A level of the trees is a table and the
    next is exploded from it, so neither depth nor width of a document is bound.
    """
    level = rows.where(F.col(value).isNotNull()).withColumn("path", F.array().cast("array<int>")).withColumn("name", F.lit(None).cast("string"))
    found = None
    while True:
        level = cut(level)
        if level.isEmpty():
            return level if found is None else found
        found = level if found is None else found.unionByName(level)
        children = rows.sparkSession.tvf.variant_explode(F.col(value).outer()).select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__value"))
        others = [c for c in level.columns if c not in (value, "path", "name")]
        level = level.lateralJoin(children).select(*others, F.concat("path", F.array("__pos")).alias("path"), F.col("__key").alias("name"), F.col("__value").alias(value))


def venue_ids(documents: DataFrame, column: str) -> DataFrame:
    """The distinct ``venue:`` identifiers under the known keys, at any depth (SET-05). Text that is no JSON has none."""
    found = nodes(documents.select(F.try_parse_json(column).alias("json")), "json").where(F.col("name").isin(KEYS))
    return found.select(F.try_variant_get("json", "$", "string").alias("venue_id")).where(F.startswith("venue_id", F.lit("venue:"))).distinct()


def _text(json: Column, path: str) -> Column:
    return F.try_variant_get(json, path, "string")


def _squeezed(json: Column, path: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_text(json, path), r"\s+", " ")), F.lit(""))


def _is_object(json: Column, path: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(json, path, "variant")), F.lit("OBJECT")), F.lit(False))


def venue_name_of(text: Column) -> Column:
    """A name of three to 49 signs that says more than the kind of place, each word with a capital."""
    name = F.trim(text)
    words = F.regexp_extract_all(name, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    capital = F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)), "")
    return F.when(F.length(name).between(3, 49) & ~F.lower(name).rlike(GENERIC), F.trim(capital))


def json_ld(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``json_ld``: what the JSON-LD blocks of a page say of a venue (HTM-04); null without a block that parses.

    Fields: ``name``, of the node of the kind with the highest priority, the first of these; ``venue_schema``, whether
    a node is a restaurant or the like; ``telephone`` and ``address``, each of the first node that has one, and the
    parts of this address. Blocks stand in either quotes and may hold entities; those that are no JSON are passed
    over. Nodes are visited in the order of ``nodes``.
    """
    keyed = pages.withColumn("__page", F.md5(html))
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    listed = keyed.where(F.col(html).rlike(r"(?i)application/ld\+json")).select("__page", blocks.alias("blocks")).dropDuplicates(["__page"]).select("__page", F.posexplode("blocks").alias("block", "text"))
    every = nodes(listed.select("__page", "block", F.try_parse_json(decode_entities(F.col("text"))).alias("json")), "json")
    json, at = F.col("json"), F.struct("block", "path")
    kind = F.lower(F.coalesce(F.array_join(F.try_variant_get(json, "$['@type']", "array<string>"), ","), F.when(~_is_object(json, "$['@type']"), _text(json, "$['@type']"))))
    priority = F.lit(0)
    for pattern, rank in reversed(KINDS):
        priority = F.when(kind.rlike(pattern), rank).otherwise(priority)
    structured = _is_object(json, "$.address")
    part = {"street": "streetAddress", "postal_code": "postalCode", "locality": "addressLocality", "province": "addressRegion"}
    parts = {k: _squeezed(json, f"$.address.{v}") for k, v in part.items()}
    country = F.when(_is_object(json, "$.address.addressCountry"), _squeezed(json, "$.address.addressCountry.name")).otherwise(_squeezed(json, "$.address.addressCountry"))
    text = F.nullif(F.trim(_text(json, "$.address")), F.lit(""))
    components = F.struct(*[F.when(structured, c).alias(k) for k, c in {**parts, "country": country}.items()], F.when(~structured, text).alias("source_text"))
    address = F.when(structured, F.nullif(F.concat_ws(", ", *parts.values()), F.lit(""))).otherwise(text)
    seen = every.where(_is_object(json, "$")).select(
        "__page", at.alias("at"), priority.alias("priority"), F.when(priority > 0, venue_name_of(_text(json, "$.name"))).alias("name"),
        F.nullif(F.trim(_text(json, "$.telephone")), F.lit("")).alias("telephone"), address.alias("address"), components.alias("components"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c if c != "components" else "address").isNotNull(), F.col("at"))).alias(c)
    best = F.min_by("name", F.when(F.col("name").isNotNull(), F.struct((-F.col("priority")).alias("p"), "at"))).alias("name")
    facts = seen.groupBy("__page").agg(best, first("telephone"), first("address"), first("components"), F.max(F.col("priority") == 3).alias("venue_schema"))
    said = facts.select("__page", F.struct("name", "telephone", "address", "components", "venue_schema").alias("json_ld"))
    return keyed.drop("json_ld").join(said, "__page", "left").drop("__page")
