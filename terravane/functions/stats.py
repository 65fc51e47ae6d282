"""Ratios, intervals, ranks, backoff and dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5th percentile of the normal distribution.
Z = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z) -> Column:
    """Lower and upper bound of Wilson's interval; null for no trials (MTH-03)."""
    n, k = total.cast("double"), successes.cast("double")
    p, z2 = k / F.nullif(n, F.lit(0.0)), z * z
    centre = p + z2 / (2 * n)
    margin = F.lit(z) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    return F.when(n > 0, F.struct(((centre - margin) / (1 + z2 / n)).alias("lower"), ((centre + margin) / (1 + z2 / n)).alias("upper")))


def ratio(part: Column, whole: Column, places: int | None = 4, empty: float | None = None) -> Column:
    """part / whole; ``empty`` for a zero whole (MTH-04)."""
    r = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.round(r, places) if places is not None else r, F.lit(empty).cast("double"))


def round_half_up(x: Column, places: int = 0) -> Column:
    """Halves towards positive infinity."""
    return F.floor(x * 10**places + 0.5) / 10**places


def size_stratum(n: Column) -> Column:
    """MTH-06."""
    return F.when(n < 25, "small").when(n < 150, "medium").otherwise("large")


def backoff_seconds(attempt: Column, base: int, longest: int) -> Column:
    """min(longest, base 2^(attempt - 1)) (MTH-05)."""
    return F.least(F.lit(longest), (base * F.pow(F.lit(2.0), attempt - 1))).cast("long")


def nearest_rank(value: str, fraction: float) -> Column:
    """The value at place ceil(n fraction) (AGG-17)."""
    return F.expr(f"percentile_disc({fraction}D) WITHIN GROUP (ORDER BY {value})")


def day_number(day: Column) -> Column:
    """Days since 1970 began; null for none (DT-01)."""
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def rome_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Europe/Rome"))


def freshness(text: Column, year: int, seasonal: Column) -> Column:
    """review for a future year or last year, stale for two years ago or last season, current, undated (DT-03)."""
    newest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    return (
        F.when(newest > year, "review")
        .when((newest < year) & (seasonal | (F.lit(year) - newest >= 2)), "stale")
        .when(newest < year, "review")
        .when(newest == year, "current")
        .otherwise("undated")
    )


def reset_delay_ms(header: Column, now_ms: Column) -> Column:
    """A rate limit's reset as milliseconds from now: delta seconds, an epoch above 1e9, or an HTTP date (DT-04)."""
    n = header.try_cast("double")
    day = F.regexp_extract(header, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT", 1)
    at = F.try_to_timestamp(F.concat(day, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss xx"))
    ms = F.when(n > 1e9, n * 1000 - now_ms).when(n.isNotNull(), n * 1000).otherwise(F.unix_millis(at) - now_ms)
    return F.when(ms < 0, 0).otherwise(ms.cast("long"))
