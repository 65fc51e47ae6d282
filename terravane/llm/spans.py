"""Spans of regular-expression matches, by DataFrame functions alone.

Offsets are code points, end exclusive. Matches are leftmost and do not overlap. A text is split at the matches;
the lengths of the pieces and of the matches give the offsets.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kind is the place of the span's kind in the operator's list of kinds.
SPAN = "struct<start: int, kind: int, end: int, value: string>"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def match_spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches of ``pattern`` in a text that has no null, in order.

    Offsets are running sums. An array that grows in a fold is copied at each step, so the matches are folded in
    blocks of the root of their number: first the lengths of the blocks, then each block from its start.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), m.alias("match")))

    def lengths(block):
        return F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + p["size"])

    def step(acc, pair):
        begin = acc["at"] + pair["gap"]
        end = begin + pair["size"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.when(pair["match"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"))

    def spans(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), no_spans().alias("found")), step, lambda acc: acc["found"])

    def starts(blocks):
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(blocks, first, lambda acc, b: F.struct((acc["at"] + lengths(b)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])

    def in_blocks(every):
        width = F.ceil(F.sqrt(F.size(every))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / width).cast("int")), lambda i: F.slice(every, i * width + 1, width))
        return bound(blocks, lambda held: F.flatten(F.zip_with(held, starts(held), spans)))

    return bound(pairs, in_blocks)


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


#: A text with more spans than this is taken apart into its signs, as finding a place in a text costs its distance.
MANY = 64


def masked(text: Column, spans: Column, kinds: list[str]) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in kinds])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def replaced(part):
        """``part`` gives so many signs from a place on."""

        def step(acc, s):
            between = part(acc["at"], F.greatest(s["start"] - acc["at"], F.lit(0)))
            fresh = F.concat(acc["parts"], F.array(between, F.element_at(names, s["kind"] + 1)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"]).alias("parts"))

        return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), part(acc["at"], F.length(text))))

    few = replaced(lambda at, n: F.substring(text, at + 1, n))
    many = bound(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda signs: replaced(lambda at, n: F.array_join(F.slice(signs, at + 1, n), "")))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= MANY, few).otherwise(many)
