"""JSON, arrays and maps."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON as a variant, null where it is malformed (JSN-02)."""
    return F.try_parse_json(text)


def text_at(text: Column, path: str) -> Column:
    """A JSON value only if it is a string (JSN-01)."""
    v = F.try_variant_get(F.try_parse_json(text), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(text), path, "string"))


def stable_json(columns: list[str]) -> Column:
    """The columns in the order of their names, nulls kept, for hashing (JSN-03)."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def unnested(keys: Column, values: Column) -> Column:
    """Parallel arrays as one array of pairs, to be exploded (JSN-04, ARR-01)."""
    return F.arrays_zip(keys.alias("key"), values.alias("value"))


def compacted(entries: Column) -> Column:
    """A map without null and empty values (MAP-01)."""
    return F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))


def merged_lists(a: Column, b: Column) -> Column:
    """Two maps of arrays, the arrays of a key united, first ones first (MAP-01)."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda k, x, y: F.array_distinct(F.concat(F.coalesce(x, none), F.coalesce(y, none))))


def united(arrays: Column) -> Column:
    """The distinct values of collected arrays, sorted (SET-06, AGG-18)."""
    return F.array_sort(F.array_distinct(F.flatten(arrays)))


def has_all(found: Column, wanted: list[str]) -> Column:
    """Every wanted value in an array; any, if needed, is ``arrays_overlap`` (ARR-02)."""
    return F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(found, w))


def later(at: Column, days: Column | int) -> Column:
    """A time some days later (DT-02)."""
    return at + F.make_dt_interval(F.lit(days) if isinstance(days, int) else days)


def name_from_title(title: Column, town: str) -> Column:
    """The venue's name in a page title: what stands before a separator, without the town and words of lists (STR-16)."""
    head = F.trim(F.regexp_replace(F.split(title, r"\s+[|–—-]\s+|:\s+")[0], r"\s+", " "))
    bare = F.trim(F.regexp_replace(head, rf"(?i)[,(]?\s*\b(?:a|ad|in|di)?\s*\b{town}\b\)?\s*$", ""))
    listed = bare.rlike(r"(?i)^(?:i |le |the )?(?:\d+ )?(?:migliori|best|top)\b")
    return F.when(~listed & F.length(bare).between(3, 55), bare)
