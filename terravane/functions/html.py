"""Facts from HTML by regular expressions inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_term

# The entities that are decoded, and role terms in order of precedence.
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
ROLE_TERMS = {
    "order": ["ordina", "ordina online", "order", "asporto", "delivery", "takeaway"],
    "booking": ["prenota", "prenotazione", "prenotazioni", "booking", "reserve", "reservation"],
    "drinks": ["carta dei vini", "vini", "wine list", "drink list", "cocktail", "birre"],
    "menu": ["menu", "la carta", "carta", "listino", "piatti"],
    "specialty": ["specialita", "specialty", "pizza", "pizze", "dolci"],
}


def decode_entities(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Without scripts, styles, noscript parts and tags (HTM-01)."""
    bare = html
    for tag in ("script", "style", "noscript"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return strip_tags(bare)


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column) -> Column:
    """The href values of anchors, in order."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>", " ")
    return F.regexp_extract_all(bare, F.lit(r"""(?i)<a\b[^>]*?href="([^"]*)\""""), F.lit(1))


def page_facts(html: Column) -> Column:
    """Title, canonical address, JSON-LD types, telephone and sitemap links, text (HTM-02)."""
    anchors = links(html)
    return F.struct(
        title(html).alias("title"),
        F.nullif(F.regexp_extract(html, r"""(?i)<link\b[^>]*rel="canonical"[^>]*href="([^"]*)\"""", 1), F.lit("")).alias("canonical"),
        F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1))), 1, 10).alias("types"),
        F.array_distinct(F.filter(anchors, lambda a: a.startswith("tel:"))).alias("phones"),
        F.array_distinct(F.filter(anchors, lambda a: a.rlike("(?i)sitemap"))).alias("sitemaps"),
        F.left(visible_text(html), F.lit(30_000)).alias("text"),
    )


def role(folded: Column, pdf: Column | None = None, terms: dict[str, list[str]] = ROLE_TERMS) -> Column:
    """The first role one of whose terms stands in a folded text; a PDF is a menu (HTM-09)."""
    out = F.when(F.lit(False), "")
    for name, words in terms.items():
        out = out.when(has_term(folded, words), name)
    return out.otherwise(F.when(pdf, "menu") if pdf is not None else F.lit(None).cast("string"))


def italian_address(text: Column) -> Column:
    """A street with a number and a postcode (HTM-05)."""
    return F.nullif(F.regexp_extract(text, r"(?i)\b((?:via|viale|piazza|corso|strada|vicolo|largo)\s+[^,\n]{2,60}?,?\s*\d{1,4}[a-z]?\s*,?\s*\d{5})\b", 1), F.lit(""))
