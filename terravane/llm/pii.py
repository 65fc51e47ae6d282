"""Personal data: patterns propose spans, checksums confirm them, and context words adjust their scores.

E-mail and IP addresses, card numbers (Luhn), phone numbers, bank account numbers (IBAN, mod 97) and phone numbers
without a country's prefix, by DataFrame functions alone; every row is worked on where it lies. A span is reported
if its score reaches ``LEAST``: the first five kinds do by themselves, a number that only looks like a local phone
number needs a context word near by. The patterns are written so that the engine neither backtracks nor recurses
over long runs: a match may start at a run's first character or where the last match ended.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha_hex
from .spans import SPAN, bound, count_kind, listed, masked, match_spans, no_spans

KINDS = ["email", "ip", "card", "phone", "iban", "local"]
BASE = 4
NEAR = 40

# Patterns, number ranges and letters of the formats searched for.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The length of an account number by the country it starts with.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
LOCAL = r"(?<![A-Za-z0-9+.,/-])\(?0[0-9]{1,5}\)?(?:[\x20/.-]{1,2}[0-9]{2,8}){1,5}(?![A-Za-z0-9])"
CONTEXT = {
    "email": r"e-?mail|contact|write to|mailto",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|credit|debit|payment|pay",
    "phone": r"phone|call|tel|mobile|fax|contact",
    "iban": r"iban|bank|account|transfer",
    "local": r"phone|\bcall|\btel\b|\btel[.:]|mobile|\bfax|telefon|t\u00e9l\u00e9phone|handy|m\u00f3vil",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "local": 0.45}
BOOST, LEAST = 0.1, 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    signs = F.split(F.reverse(number), "")
    plain, doubled = F.lit("0123456789"), F.lit("0246813579")

    def value(sign, i):
        at = sign.cast("int") + 1
        return F.when(sign == "", 0).otherwise(F.substring(F.when(i % 2 == 1, doubled).otherwise(plain), at, F.lit(1)).cast("int"))

    return F.aggregate(F.transform(signs, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four signs moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc, sign):
        code = F.ascii(sign)
        return F.when(sign == "", acc).when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _found(text: Column, kind: str, pattern: str, gate: Column, check) -> Column:
    spans = match_spans(text, pattern, KINDS.index(kind))
    spans = F.filter(spans, lambda s: check(s["value"])) if check else spans
    return F.when(gate, spans).otherwise(no_spans())


def proposed(text: Column) -> Column:
    """All spans of a text that has no null that pass their checks, by start and kind."""
    digit = text.rlike("[0-9]")

    def sized(value, low, high):
        return F.length(digits(value)).between(low, high)

    found = [
        _found(text, "email", EMAIL, F.contains(text, F.lit("@")), None),
        _found(text, "ip", IP, digit & text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(IP_PARTS)),
        _found(text, "card", CARD, digit, lambda v: sized(v, 14, 19) & luhn(F.when(sized(v, 14, 19), digits(v)).otherwise(""))),
        _found(text, "phone", PHONE, F.contains(text, F.lit("+")), lambda v: sized(v, 10, 15)),
        _found(text, "iban", IBAN, digit & text.rlike("[A-Z]{2}[0-9]{2}"), mod97),
    ]
    local = _found(text, "local", LOCAL, text.rlike(r"(?i)" + CONTEXT["local"]) & text.rlike("0[0-9]"), lambda v: sized(v, 7, 13))

    def together(both: Column) -> Column:
        free = F.filter(both["local"], lambda s: ~F.exists(both["sure"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.array_sort(F.concat(both["sure"], free)).cast(f"array<{SPAN}>")

    return bound(F.struct(F.concat(*found).alias("sure"), local.alias("local")), together)


def scored(text: Column, spans: Column) -> Column:
    """Each span's score: that of its kind, more where a context word stands within ``NEAR`` characters."""
    base, words = F.create_map(*[F.lit(x) for k, v in SCORES.items() for x in (KINDS.index(k), v)]), [CONTEXT[k] for k in KINDS]

    def score(s):
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        around = F.lower(F.concat_ws(" ", F.substring(text, begin + 1, s["start"] - begin), F.substring(text, s["end"] + 1, F.lit(NEAR))))
        near = F.lit(False)
        for k, pattern in enumerate(words):
            near = near | ((s["kind"] == k) & around.rlike(pattern))
        return F.round(F.element_at(base, s["kind"]) + F.when(near, BOOST).otherwise(0.0), 2)

    return F.transform(spans, score)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``, an array of structs of start, kind, end and value; null and empty texts have none.

    Spans whose score is below ``LEAST`` are left out. Columns of that name are replaced; no other column is read,
    so repeated rows and clashing names do no harm.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def kept(spans: Column) -> Column:
        both = F.zip_with(spans, scored(text, spans), lambda s, score: F.struct(s.alias("span"), score.alias("score")))
        strong = F.transform(F.filter(both, lambda x: x["score"] >= LEAST), lambda x: x["span"])
        return F.when(F.exists(spans, lambda s: s["kind"] == KINDS.index("local")), strong).otherwise(spans)

    return docs.withColumn(out, bound(proposed(text), kept))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind; ``n_chars``, if there, follows. Null texts stay null."""
    names = docs.columns
    done = find_pii(docs, text_col, "__pii").withColumn(text_col, masked(F.col(text_col), F.col("__pii"), KINDS))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*names)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by base kind, a digest of the base spans, all spans and their scores.

    Null and empty texts have no spans: counts of zero, the digest of the empty string, empty lists. Repeated rows
    and null ids stay; an empty table gives no rows; columns other than the two named are not read.
    """
    found = find_pii(docs.select(F.col(id_col), F.col(text_col)), text_col, "pii")
    found = found.withColumn("base", F.filter("pii", lambda s: s["kind"] < BASE))
    return found.select(
        id_col,
        *[count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        sha_hex(listed(F.col("base"), KINDS)).alias("base_sha256"),
        listed(F.col("pii"), KINDS).alias("spans"),
        F.array_join(scored(F.coalesce(F.col(text_col), F.lit("")), F.col("pii")).cast("array<string>"), ",").alias("scores"),
    )
