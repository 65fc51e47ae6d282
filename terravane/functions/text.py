"""Text normalisation: folding, names, phone numbers, tokens."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Latin letters with marks and the letters they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN_ = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
# Word lists that names are compared without.
LEGAL_SUFFIXES = ["s r l", "s n c", "s a s", "s p a", "srl", "snc", "sas", "spa", "societa cooperativa", "cooperativa"]
GENERIC_WORDS = [
    "al", "alla", "alle", "all", "il", "lo", "la", "i", "gli", "le", "ristorante", "restaurant", "trattoria", "pizzeria", "osteria",
    "locanda", "bar", "pub", "cafe", "caffe", "birreria", "enoteca", "agriturismo",
]


def fold_latin(text: Column) -> Column:
    """Lower case without the marks of Latin letters, inside the JVM."""
    return F.translate(F.lower(text), MARKED, PLAIN_)


def _stripper(form: str):
    @F.arrow_udf(StringType())
    def strip(texts: pa.Array) -> pa.Array:
        def fold(t):
            return None if t is None else "".join(c for c in unicodedata.normalize(form, t.strip()) if not 0x300 <= ord(c) <= 0x36F).lower()

        return pa.array([fold(t) for t in texts.to_pylist()], pa.string())

    return strip


def normalize(text: Column, form: str = "NFKD") -> Column:
    """Trim, decompose (NFKD or NFD), drop combining marks, lower (STR-01)."""
    return _stripper(form)(text)


def words_only(text: Column, form: str | None = None) -> Column:
    """Fold to ``[a-z0-9 ]`` (STR-02): with ``form`` by Unicode decomposition, without by the table of Latin letters."""
    folded = fold_latin(text) if form is None else normalize(text, form)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def venue_name(folded: Column) -> Column:
    """A folded name without one legal suffix (STR-03)."""
    return F.trim(F.regexp_replace(folded, rf" (?:{'|'.join(LEGAL_SUFFIXES)})$", ""))


def core_name(folded: Column) -> Column:
    """Leading generic words go while another word remains (STR-04)."""
    return F.regexp_replace(folded, rf"^(?:(?:{'|'.join(GENERIC_WORDS)}) )+(?=[a-z0-9])", "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phone_key(text: Column) -> Column:
    """Digits, without the country's 39 where more than ten remain; null if none (STR-05)."""
    d = digits(text)
    return F.nullif(F.when((F.length(d) > 10) & d.startswith("39"), F.substring(d, F.lit(3), F.length(d))).otherwise(d), F.lit(""))


def national_digits(text: Column) -> Column:
    """Digits without 00 or +39 in front, whatever their number (STR-05, the second rule)."""
    return F.regexp_replace(digits(F.regexp_replace(text, r"^\s*(?:\+|00)39", "")), "^$", "")


def phones_match(a: Column, b: Column) -> Column:
    """Equal, or one the end of the other with eight digits or more (STR-06)."""
    long = F.least(F.length(a), F.length(b)) >= 8
    return F.coalesce((a == b) | long & (a.endswith(b) | b.endswith(a)), F.lit(False))


def street_number(address: Column) -> Column:
    """Street and house number of a folded address as a struct; nulls where there is none (STR-07)."""
    pattern = r"^((?:via|viale|piazza|corso|strada|vicolo|largo|borgo|contrada)\b.*?) ?(?:n |num |nr )?([0-9]+[a-z]?)\b"
    return F.struct(F.nullif(F.trim(F.regexp_extract(address, pattern, 1)), F.lit("")).alias("street"), F.nullif(F.regexp_extract(address, pattern, 2), F.lit("")).alias("number"))


def slug(text: Column, longest: int = 64) -> Column:
    """STR-08."""
    return F.regexp_replace(F.substring(F.regexp_replace(words_only(text), " ", "-"), 1, longest), "-+$", "")


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(8))


def meaningful(folded: Column, shortest: int = 3) -> Column:
    """Tokens of three letters or more that aren't generic (STR-09)."""
    return F.filter(F.split(folded, " "), lambda t: (F.length(t) >= shortest) & ~t.isin(GENERIC_WORDS))


def token_ratio(tokens: Column, folded: Column) -> Column:
    """The part of the tokens that stand in a text as whole words; zero without tokens."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    found = F.size(F.filter(tokens, lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" ")))))
    return F.when(F.size(tokens) > 0, found / F.size(tokens)).otherwise(0.0)


def has_term(folded: Column, terms: list[str]) -> Column:
    """Whole-term containment in padded text (STR-10)."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(padded, F.lit(f" {t} "))
    return out


def at_word_start(folded: Column, prefix: str) -> Column:
    """A prefix at the start of any word (STR-11)."""
    return F.regexp_like(folded, F.concat(F.lit("(?:^|[^\\p{L}\\p{N}])"), F.lit(_quoted(prefix))))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def quote_text(text: Column) -> Column:
    """NFKC, no zero-width signs, plain quotes and dashes, single spaces, lower (STR-13)."""

    @F.arrow_udf(StringType())
    def nfkc(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    plain = F.translate(nfkc(text), "‘’‚‛“”„‟–—―−​‌‍﻿", "''''\"\"\"\"----")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def budgeted(text: Column, head: int = 8000, tail: int = 4000) -> Column:
    """The head and the tail of a text that is too long (STR-14)."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" […] "), F.right(text, F.lit(tail))))


def title_case(text: Column) -> Column:
    """First letters upper, the rest as it is (STR-15)."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def csv_cell(text: Column) -> Column:
    """Quoted only where a quote, separator or line break asks for it; null is empty (SNK-02)."""
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(c.cast("string")) for c in columns])


def local_aliases(name: Column, town: Column) -> Column:
    """A folded name, and without the town at its end, without a generic first or last word, and with other spellings (STR-12)."""
    bare = F.when(name.endswith(F.concat(F.lit(" "), town)), F.trim(F.left(name, F.length(name) - F.length(town)))).otherwise(name)
    generic = "|".join(GENERIC_WORDS)
    spelled = F.regexp_replace(F.regexp_replace(bare, r"\bquattro\b", "4"), r"\bivs\b", "ius")
    return F.array_distinct(F.array(name, bare, core_name(bare), F.regexp_replace(bare, rf" (?:{generic})$", ""), spelled))


def excerpt(text: Column, terms: list[str], limit: int = 1500) -> Column:
    """Sentences that hold one of the terms, in order, while they fit in the limit (STR-17)."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(s), t)))
    return F.aggregate(sentences, F.lit(""), lambda a, s: F.when(F.length(a) + F.length(s) + 1 <= limit, F.ltrim(F.concat(a, F.lit(" "), s))).otherwise(a))
