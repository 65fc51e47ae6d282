"""Secret scans: known forms by pattern, others by a battery of randomness tests.

Long tokens are candidates. The alphabet of each is inferred (hexadecimal, base 32, letters and digits, base 64, also
in its form for URLs). Four tests ask whether its signs are drawn evenly and independently: chi-squared of the whole
alphabet and of its five parts, a runs test about its middle, and the correlation of neighbours. The tests depend on
each other and are rough for short tokens, so the null distribution of their combined statistic is drawn: tokens of
random signs, by alphabet and length, from a hash. Tokens that look as random as those are reported. By classes of
length over the whole corpus, p values above one half, which random tokens have as often as others, tell how many
candidates are random; the limit rises where more than ``RATE`` of the reported are certain to be ordinary ones.
All by DataFrame functions.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sha_hex
from .spans import SPAN, bound, count_kind, listed, match_spans, no_spans

KINDS = ["assign", "access", "hex", "random"]
BASE = 3
RATE = 0.05
#: A class of length is eight signs wide, the last one is open; random tokens drawn for each and each alphabet.
FIRST_CLASS, LAST_CLASS, DRAWS = 2, 16, 400
#: Quantiles of the drawn statistics, so p values are told apart by half a percent; the limit is at least at this bin.
BINS, LEAST_BIN, SURE = 200, 10, 1.645

# Forms of secrets, and the alphabets of encodings.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGNED = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{16,}+={0,2}"
ALPHABETS = [
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
PARTS = 5


def even_chi2(x: Column, degrees: int) -> Column:
    """The upper tail of chi-squared for an even number of degrees."""

    def tail(half: Column) -> Column:
        term = total = F.lit(1.0)
        for i in range(1, degrees // 2):
            term = term * half / i
            total = total + term
        return F.least(F.exp(-half) * total, F.lit(1.0))

    return bound(x / 2, tail)


def two_sided(z: Column) -> Column:
    """The two tails of the normal distribution beyond |z|, by the rational approximation 7.1.26 of Abramowitz and Stegun."""

    def tails(x: Column, t: Column) -> Column:
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.greatest(F.least(poly * F.exp(-x * x), F.lit(1.0)), F.lit(1e-30))

    return bound(F.abs(z) / F.sqrt(F.lit(2.0)), lambda x: bound(1 / (1 + 0.3275911 * x), lambda t: tails(x, t)))


def encoding(token: Column) -> Column:
    out = F.lit(len(ALPHABETS) - 1)
    for k in reversed(range(len(ALPHABETS) - 1)):
        out = F.when(token.rlike(ALPHABETS[k][1]), k).otherwise(out)
    return out


def signs(token: Column) -> Column:
    """A token as places of its signs in its inferred alphabet: struct of code, size of the alphabet, places."""
    plain = F.rtrim(F.translate(token, "-_", "+/"), F.lit("="))
    code = encoding(plain)
    letters = F.element_at(F.array(*[F.lit(a) for _, _, a in ALPHABETS]), code + 1)
    sized = F.when(code == 0, F.lower(plain)).otherwise(plain)
    places = F.filter(F.transform(F.split(sized, ""), lambda c: F.when(c == "", -1).otherwise(F.instr(letters, c) - 1)), lambda v: v >= 0)
    return F.struct(code.alias("code"), F.length(letters).alias("size"), places.alias("places"))


def statistic(places: Column, signs_of: Column) -> Column:
    """Fisher's sum over the four tests of places in an alphabet of ``signs_of`` signs; the larger, the less random."""
    return bound(F.struct(places.alias("v"), signs_of.cast("double").alias("size"), F.size(places).cast("double").alias("n")), _statistic)


def _statistic(t: Column) -> Column:
    v, size, n = t["v"], t["size"], t["n"]

    def whole_tail(z: Column) -> Column:
        return bound(two_sided(z) / 2, lambda p: F.greatest(F.when(z > 0, p).otherwise(1 - p), F.lit(1e-30)))

    counts = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda x: F.size(F.filter(v, lambda y: y == x)).cast("double"))
    third = 2 / (9 * (size - 1))
    whole = (F.cbrt((F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * size / n - n) / (size - 1)) - (1 - third)) / F.sqrt(third)

    def chi2(seen: Column) -> Column:
        parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
        widths = F.transform(parts, lambda k: F.ceil(size * (k + 1) / PARTS) - F.ceil(size * k / PARTS))
        return F.aggregate(F.zip_with(seen, widths, lambda o, w: F.pow(o - n * w / size, 2) / (n * w / size)), F.lit(0.0), lambda s, x: s + x)

    seen = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.size(F.filter(v, lambda x: F.floor(x * PARTS / size) == k)).cast("double"))
    neighbours = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def runs(half: Column) -> Column:
        upper, turns = half["upper"], half["turns"]
        mean = 2 * upper * (n - upper) / n + 1
        return bound(mean, lambda m: bound((m - 1) * (m - 2) / (n - 1), lambda spread: F.when(spread > 0, (turns - m) / F.sqrt(spread)).otherwise(F.lit(6.0))))

    half = F.struct(F.size(F.filter(v, lambda x: x * 2 >= size)).cast("double").alias("upper"), (F.size(F.filter(neighbours, lambda p: (p["a"] * 2 >= size) != (p["b"] * 2 >= size))) + 1).alias("turns"))

    def serial(mean: Column) -> Column:
        variance = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        product = F.aggregate(neighbours, F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))
        return bound(variance, lambda x: F.when(x > 0, product / x * F.sqrt(n)).otherwise(F.lit(6.0)))

    tails = [
        bound(whole, whole_tail),
        F.greatest(even_chi2(bound(seen, chi2), PARTS - 1), F.lit(1e-30)),
        two_sided(bound(half, runs)),
        two_sided(bound(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n, serial)),
    ]
    return F.round(F.aggregate(F.array(*tails), F.lit(0.0), lambda s, p: s - 2 * F.log(p)), 6)


def length_class(n: Column) -> Column:
    return F.least(F.greatest(F.floor(n / 8), F.lit(FIRST_CLASS)), F.lit(LAST_CLASS)).cast("int")


def class_key(code: Column, n: Column) -> Column:
    return (code * 100 + length_class(n)).cast("int")


def null_quantiles(spark: SparkSession) -> DataFrame:
    """Quantiles of the statistic over random tokens, ascending, by alphabet and class of length: key, quantiles."""
    kinds, classes = len(ALPHABETS), LAST_CLASS - FIRST_CLASS + 1
    rows = spark.range(kinds * classes * DRAWS).select("id", F.pmod("id", F.lit(kinds)).cast("int").alias("code"), (F.pmod(F.floor(F.col("id") / kinds), F.lit(classes)) + FIRST_CLASS).alias("class"))
    n = (F.col("class") * 8 + F.pmod(F.xxhash64("id", F.lit("length")), F.lit(8))).cast("int")
    size = F.element_at(F.array(*[F.lit(len(a)) for _, _, a in ALPHABETS]), F.col("code") + 1)
    drawn = F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64(F.col("id"), i), size).cast("int"))
    tested = rows.select(class_key(F.col("code"), n).alias("key"), statistic(drawn, size).alias("stat"))
    return tested.groupBy("key").agg(F.percentile("stat", F.array(*[F.lit(i / BINS) for i in range(1, BINS)])).alias("quantiles"))


def base_spans(text: Column) -> Column:
    assign = F.filter(match_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGNED, 1)) >= 12)
    found = [
        F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), assign).otherwise(no_spans()),
        F.when(F.contains(text, F.lit("AKIA")), match_spans(text, ACCESS, 1)).otherwise(no_spans()),
        F.when(text.rlike(HEX), match_spans(text, HEX, 2)).otherwise(no_spans()),
    ]
    return F.array_sort(F.concat(*found)).cast(f"array<{SPAN}>")


def candidates(text: Column, base: Column) -> Column:
    """Long tokens of more than one sign that no base span touches."""
    tokens = F.filter(match_spans(text, TOKEN, BASE), lambda s: ~s["value"].rlike(r"^(.)\1*=*$"))
    free = F.filter(tokens, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(text.rlike("[A-Za-z0-9+/_-]{16}"), free).otherwise(no_spans())


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row a document: id and ``secrets``, an array of structs of start, kind, end and value, by start and kind.

    Null and empty texts have none. Repeated rows stay, null ids too; other columns are ignored; an empty table
    gives no rows. The limits are found over all documents; only a table of length classes and bins is kept of it.
    """
    quantiles = null_quantiles(docs.sparkSession).agg(F.map_from_entries(F.collect_list(F.struct("key", "quantiles")))).scalar()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("base", base_spans(text)).withColumn("more", candidates(text, F.col("base")))
    rows = rows.select("id", "base", F.transform("more", lambda s: F.struct(s.alias("span"), signs(s["value"]).alias("signs"))).alias("more"), quantiles.alias("null"))

    def binned(t: Column) -> Column:
        n = F.size(t["signs"]["places"])
        known = F.element_at("null", class_key(t["signs"]["code"], n))
        passed = bound(statistic(t["signs"]["places"], t["signs"]["size"]), lambda seen: F.size(F.filter(known, lambda q: q >= seen)))
        return F.struct(t["span"].alias("span"), length_class(n).alias("class"), passed.alias("bin"))

    rows = cut(rows.select("id", "base", F.when(F.size("more") > 0, F.transform("more", binned)).otherwise(F.array()).alias("more")))
    limits = reporting_limits(rows.select(F.explode("more").alias("m")).select("m.class", "m.bin"), rate)
    limit = limits.agg(F.map_from_entries(F.collect_list(F.struct("class", "limit"))).alias("limits")).scalar()
    rows = rows.withColumn("limits", limit)
    random = F.transform(F.filter("more", lambda m: m["bin"] >= F.element_at("limits", m["class"])), lambda m: m["span"])
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", random)).alias("secrets"))


def reporting_limits(values: DataFrame, rate: float) -> DataFrame:
    """``values(class, bin)`` to the smallest bin of each class from which tokens are reported.

    Of m random tokens, half have bins in the upper half and m * (BINS - t) / BINS have bins of t or more. What is
    seen beyond those is ordinary. The limit is the least t from ``LEAST_BIN`` at which the ordinary ones are not
    surely, by one normal tail of 5 %, more than ``rate`` of the reported.
    """
    steps = F.explode(F.sequence(F.lit(LEAST_BIN), F.lit(BINS // 2))).alias("t")
    counts = values.groupBy("class", "bin").agg(F.count("*").alias("n"))
    tried = counts.select("class", "bin", "n", steps).groupBy("class", "t").agg(
        F.sum(F.when(F.col("bin") >= F.col("t"), F.col("n")).otherwise(0)).alias("reported"), F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).alias("upper")
    )
    ordinary = F.col("reported") - 2 * F.col("upper") * (BINS - F.col("t")) / BINS
    fine = ordinary - SURE * F.sqrt("reported") <= rate * F.col("reported")
    return tried.where(fine | (F.col("t") == BINS // 2)).groupBy("class").agg(F.min("t").alias("limit"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by base kind, a digest of the base spans, and all spans.

    Null and empty texts have no spans: counts of zero, the digest of the empty string, an empty list. Repeated rows
    and null ids stay; an empty table gives no rows; columns other than the two named are not read.
    """
    found = find_secrets(docs, id_col, text_col).withColumn("base", F.filter("secrets", lambda s: s["kind"] < BASE))
    return found.select(
        id_col,
        *[count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        sha_hex(listed(F.col("base"), KINDS)).alias("base_sha256"),
        listed(F.col("secrets"), KINDS).alias("spans"),
    )
