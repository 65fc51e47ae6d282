"""Predicates and precedence rules as column expressions."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column | None]) -> Column:
    """The conjunction of the conditions that are given (FLT-02, FLT-17)."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def chosen(column: Column, codes: Iterable[str] | None, every: Iterable[str]) -> Column | None:
    """Membership in the known codes; no filter if none or all are chosen (FLT-01)."""
    known = [c for c in codes or [] if c in set(every)]
    return None if not known or set(known) == set(every) else column.isin(known)


def inside(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all four sides (FLT-04)."""
    west, south, east, north = box
    return x.between(west, east) & y.between(south, north)


def due(kind: str, when: Column, today: Column, staged: Column) -> Column:
    """none, overdue, today, week or any (FLT-03)."""
    rules = {
        "none": staged & when.isNull(),
        "overdue": when < today,
        "today": when <= today,
        "week": when <= F.date_add(today, 7),
        "any": when.isNotNull(),
    }
    return F.coalesce(rules[kind], F.lit(False))


def due_bucket(when: Column, today: Column) -> Column:
    """The narrowest due class a date falls in."""
    return F.when(when.isNull(), "none").when(when < today, "overdue").when(when == today, "today").when(when <= F.date_add(today, 7), "week").otherwise("later")


def first_true(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first rule that holds (FLT-06, FLT-08)."""
    out = F.lit(default).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order (FLT-12, FLT-13, FLT-22)."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def valid_at(at: Column, start: Column, end: Column) -> Column:
    """From the start on, before the end (FLT-15)."""
    return (start <= at) & (at < end)


def due_for_check(at: Column, valid_until: Column, retry_after: Column) -> Column:
    """FLT-16."""
    return F.coalesce(at >= valid_until, F.lit(False)) | F.coalesce(at >= retry_after, F.lit(False))


def expired(age_seconds: Column, kind: Column, policy: dict[str, int]) -> Column:
    """Whether a file of a class has reached its age; other classes never do (FLT-19)."""
    limits = F.create_map(*[F.lit(x) for k, v in policy.items() for x in (k, v)])
    return F.coalesce(age_seconds >= F.try_element_at(limits, kind), F.lit(False))


def category(column: Column, table: dict[str, str], default: str = "other") -> Column:
    """A dictionary of few entries as an expression (FLT-07)."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), column), F.lit(default))
