"""Pages and search results: resources, scores, validation, ranking, queries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html as H
from ..functions.filters import first_true, reasons
from ..functions.text import has_term, meaningful, token_ratio, words_only
from ..functions.url import canonical_url, host, registrable_domain, resolve, website_kind

# Ranks of roles and of levels of confidence.
ROLE_RANK = {"menu": 7, "drinks": 6, "order": 5, "booking": 4, "specialty": 3, "menu_image": 2, "venue_page": 1, "secondary": 0}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}


def _rank(column: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), column), F.lit(0))


# What links and images of a venue's site are about, and signs that one is about something else.
RESOURCE_TERMS = {
    "menu": ["menu", "listino", "food", "antipasti", "primi", "secondi", "dolci", "alla carta", "carta del ristorante", "carta dei piatti"],
    "drinks": ["drink", "vino", "vini", "wine", "bevande", "birre", "cocktail", "bar list"],
    "order": ["ordina", "ordine", "ordering", "asporto", "consegna", "domicilio", "delivery", "takeaway", "take away"],
    "booking": ["prenota", "prenotazione", "booking", "reservation", "riserva tavolo"],
    "specialty": ["carne", "pesce", "brace", "griglia", "specialita", "degustazione", "cantina"],
    "food": ["ristorante", "pizzeria", "trattoria", "osteria", "cucina", "ristorazione", "pizza", "sushi", "paninoteca", "birreria", "enoteca", "gastronomia"],
    "lodging": ["room", "rooms", "camera", "camere", "suite", "bedroom", "alloggio"],
    "boilerplate": [
        "privacy", "cookie", "login", "sign in", "signin", "account", "terms", "condizioni", "imprint", "sitemap", "withdrawal", "recesso", "email protection", "wp admin", "wp login", "feed", "weather", "webcam", "helpcenter",
    ],
    "image_junk": ["logo", "icon", "favicon", "sprite", "avatar", "flag", "placeholder", "cookie", "tracking", "pixel", "loading", "spinner", "badge"],
}
ORDERING_HOSTS = r"^(?:orders?|delivery)\.|\.(?:orders?|delivery)\.|(?:^|\.)(?:dish\.co|ipratico\.com)$"
MAX_IMAGES, IMAGE_CONTEXT = 2, 180
LINK = r"""(?is)<a\b([^>]*?)href\s*=\s*["']([^"']+)["']([^>]*)>(.*?)</a>"""
IMAGE = r"""(?i)<img\b([^>]*?)src\s*=\s*["']([^"']+)["']([^>]*)>"""


def resources(pages: DataFrame, url: str = "url", html: str = "html", terms: dict[str, list[str]] = RESOURCE_TERMS, blocked: tuple[str, ...] = (), directories: tuple[str, ...] = ()) -> DataFrame:
    """What a venue's page links to or shows of its menu, drinks, orders, bookings and specialties (HTM-03).

    ``page, position, target, type, role, confidence, label, evidence, is_image``: links first, then images, in the
    order of the page, an address once a page. Links stand in either quotes. They have to be on the page's own domain;
    only pages for orders and bookings may be elsewhere, not at ``blocked`` or ``directories``. What speaks of
    privacy, accounts and the like is passed over, and orders that are for rooms. An image counts if its own text
    names a menu, or if the text around it does and speaks of food; no more than two of a page do. ``terms`` replace
    those of the same kinds. Pages without an address or text have no rows.
    """
    terms = {**RESOURCE_TERMS, **terms}
    base = pages.select(F.col(url).alias("page"), F.col(html).alias("html"))
    about = lambda text, kind: has_term(text, terms[kind])
    same = F.coalesce(host(F.col("target")) == host(F.col("page")), F.lit(False))
    http = F.col("target").rlike("^https?://")

    tags = base.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(0))).alias("position", "tag"))
    part = lambda n, pattern=LINK: F.regexp_extract("tag", pattern, n)
    links = tags.select("page", "position", H.decode_entities(part(2)).alias("href"), part(4).alias("inner")).where(~F.col("href").rlike("(?i)^(#|javascript:|mailto:|tel:)"))
    links = links.withColumn("target", resolve(F.col("href"), F.col("page"))).where(http & ~F.coalesce(canonical_url(F.col("target")) == canonical_url(F.col("page")), F.lit(False)))
    shown = F.array_join(F.regexp_extract_all("inner", F.lit(r"""(?i)\b(?:alt|title)\s*=\s*["']([^"']+)["']"""), F.lit(1)), " ")
    links = links.withColumn("label", F.trim(H.decode_entities(H.strip_tags(F.col("inner"))))).withColumn("text", words_only(F.concat_ws(" ", "target", "label", shown))).withColumn("same", same)
    ordering = F.coalesce(host(F.col("target")).rlike(ORDERING_HOSTS), F.lit(False))
    links = links.withColumns({k: about(F.col("text"), k) for k in ("menu", "drinks", "booking", "specialty")}).withColumn("order", ordering | about(F.col("text"), "order"))
    links = links.withColumn("pdf", F.col("target").rlike(r"(?i)\.pdf(?:$|[?#])")).withColumn("picture", F.col("target").rlike(r"(?i)\.(?:png|jpe?g|gif|webp|avif)(?:$|[?#])"))
    c = F.col
    elsewhere = (c("order") | c("booking")) & (website_kind(c("target"), list(blocked), list(directories)) == "official")
    wanted = (c("same") | elsewhere) & (c("pdf") | c("menu") | c("drinks") | c("order") | c("booking") | c("specialty"))
    wanted = wanted & ~about(c("text"), "boilerplate") & ~(c("order") & about(c("text"), "lodging") & ~c("menu") & ~c("specialty"))
    role = F.when(c("picture"), "menu_image").when(c("order"), "order").when(c("booking"), "booking").when(c("drinks"), "drinks").when(c("menu") | c("pdf"), "menu").otherwise("specialty")
    anchor = F.when(c("pdf"), "pdf_url").when(c("order"), "order_anchor").when(c("drinks"), "drinks_anchor").when(c("menu"), "menu_anchor").otherwise("specialty_anchor")
    linked = links.where(wanted).select(
        "page", "position", "target", F.when(c("pdf"), "pdf").when(c("picture"), "image").otherwise("webpage").alias("type"), role.alias("role"),
        F.when(c("picture"), "low").when(c("pdf") | c("menu") | c("order"), "high").otherwise("medium").alias("confidence"), "label",
        F.array(F.when(c("same"), "same_official_domain").otherwise("linked_from_official_site"), anchor).alias("evidence"), F.lit(False).alias("is_image"),
    )

    found = base.select("page", "html", F.split("html", IMAGE, -1).alias("between"), F.regexp_extract_all("html", F.lit(IMAGE), F.lit(0)).alias("tags"))
    length = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    each = found.select("*", F.posexplode("tags").alias("position", "tag")).withColumn("at", length(F.slice("between", 1, F.col("position") + 1)) + length(F.slice("tags", F.lit(1), F.col("position"))))
    first, last = F.greatest(c("at") - IMAGE_CONTEXT, F.lit(0)), c("at") + F.length("tag") + IMAGE_CONTEXT
    images = each.select("page", "position", H.decode_entities(part(2, IMAGE)).alias("src"), F.concat_ws(" ", part(1, IMAGE), part(3, IMAGE)).alias("attributes"), words_only(H.strip_tags(F.substring("html", first + 1, last - first))).alias("around"))
    images = images.where(~F.startswith("src", F.lit("data:"))).withColumn("target", resolve(F.col("src"), F.col("page"))).where(http & same)
    said = lambda name: F.regexp_extract("attributes", rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    images = images.withColumn("alt", said("alt")).withColumn("title", said("title")).withColumn("text", words_only(F.concat_ws(" ", "target", "alt", "title")))
    both = F.concat_ws(" ", "text", "around")
    strong, weak = about(c("text"), "menu"), about(c("around"), "menu") & (about(both, "food") | about(both, "specialty"))
    images = images.where(~about(c("text"), "image_junk") & (strong | weak)).withColumn("strong", strong)
    images = images.withColumn("__n", F.row_number().over(W.partitionBy("page").orderBy("position"))).where(c("__n") <= MAX_IMAGES)
    pictured = images.select(
        "page", "position", "target", F.lit("image").alias("type"), F.lit("menu_image").alias("role"), F.when(c("strong"), "medium").otherwise("low").alias("confidence"),
        F.when(c("alt") != "", c("alt")).otherwise(c("title")).alias("label"), F.array(F.lit("same_official_domain"), F.when(c("strong"), "menu_image_metadata").otherwise("menu_image_context")).alias("evidence"), F.lit(True).alias("is_image"),
    )
    every = linked.unionByName(pictured).withColumn("label", F.left("label", F.lit(100)))
    once = W.partitionBy("page", canonical_url(F.col("target"))).orderBy("is_image", "position")
    return every.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")


def search_score(candidates: DataFrame) -> DataFrame:
    """Additive score of search results (HTM-06).

    Columns: name, place (folded texts), haystack (folded title, snippet and address), domain_text, same_domain,
    is_pdf, has_food, has_menu, fallback.
    """
    c = F.col
    tokens = meaningful(c("name"))
    ratio = token_ratio(tokens, c("haystack"))
    exact = (F.length("name") >= 4) & F.contains("haystack", "name")
    place = F.contains("haystack", "place") & (c("place") != "")
    branded = F.exists(tokens, lambda t: F.contains(F.col("domain_text"), t))
    parts = [
        ("official_domain", c("same_domain"), 55), ("exact_name", exact, 34), ("location", place, 16), ("branded_domain", branded, 18),
        ("restaurant_context", c("has_food"), 8), ("menu_context", c("has_menu"), 10), ("pdf", c("is_pdf"), 6),
    ]
    score = F.round(ratio * 28).cast("int")
    for _, rule, points in parts:
        score = score + F.when(F.coalesce(rule, F.lit(False)), points).otherwise(0)
    score = score - F.when(F.size(tokens) == 0, 30).otherwise(0) - F.when(c("fallback") & ~c("same_domain"), 8).otherwise(0)
    out = candidates.withColumns({"ratio": ratio, "score": score, "reasons": reasons([(n, r) for n, r, _ in parts])})
    identity = exact | (F.col("ratio") >= 0.5) | branded | c("same_domain")
    context = place | c("has_food") | c("has_menu") | c("is_pdf")
    accepted = identity & F.when(c("same_domain"), F.col("score") >= 45).otherwise(context & (F.col("score") >= 52))
    outcome = F.when(accepted, "accepted").when(F.col("score") >= 40, "review").otherwise("rejected")
    confidence = F.when(F.col("score") >= 82, "high").when(F.col("score") >= 62, "medium").otherwise("low")
    return out.withColumns({"outcome": outcome, "confidence": confidence})


def site_total(identity: Column, geography: Column, officialness: Column) -> Column:
    """The weighted total of three scores, each held to 0 to 100 (HTM-07)."""
    held = lambda x: F.greatest(F.least(x, F.lit(100)), F.lit(0))
    return F.round(0.4 * held(identity) + 0.25 * held(geography) + 0.35 * held(officialness)).cast("int")


def additive(evidence: Column, points: dict[str, int]) -> Column:
    """The sum of the points of an array of reasons, unknown ones nothing (HTM-07)."""
    table = F.create_map(*[F.lit(x) for k, v in points.items() for x in (k, v)])
    return F.aggregate(evidence, F.lit(0), lambda a, e: a + F.coalesce(F.try_element_at(table, e), F.lit(0)))


def site_outcome(total: Column, identity: Column, contradictions: Column, accept: int = 70, review: int = 45) -> Column:
    return F.when(F.size(contradictions) > 0, "rejected").when((total >= accept) & (identity >= 50), "accepted").when(total >= review, "review").otherwise("rejected")


def validated_resource(rows: DataFrame) -> DataFrame:
    """accepted, review or rejected with the reason (HTM-08). Columns: ok, status, role, expected_role, freshness, same_site, other_branch."""
    c = F.col
    reason = first_true([
        ("fetch_failed", ~F.coalesce(c("ok"), F.lit(False)) | (c("status") >= 400)), ("other_branch", F.coalesce(c("other_branch"), F.lit(False))), ("stale", c("freshness") == "stale"),
        ("no_role_evidence", c("role").isNull()), ("role_differs", c("role") != c("expected_role")), ("dated", c("freshness") == "review"), ("off_site", ~F.coalesce(c("same_site"), F.lit(False))),
    ])
    decision = F.when(reason.isNull(), "accepted").when(reason.isin("role_differs", "dated", "off_site"), "review").otherwise("rejected")
    return rows.withColumns({"reason": reason, "decision": decision})


def resource_order() -> list[Column]:
    """By role, confidence, score, address (SRT-11)."""
    return [_rank(F.col("role"), ROLE_RANK).desc(), _rank(F.col("confidence"), CONFIDENCE_RANK).desc(), F.coalesce("score", F.lit(0)).desc(), F.col("target").asc()]


def diverse_top(rows: DataFrame, keys: list[str], limit: int, most_images: int = 2) -> DataFrame:
    """The best of each role first, then the rest, with no more than some images (SRT-10)."""
    order = resource_order()
    images = F.col("role") == "menu_image"
    of_role = F.row_number().over(W.partitionBy(*keys, "role").orderBy(*order))
    kept = rows.withColumn("__r", of_role).where(~images | (F.col("__r") <= most_images))
    place = F.row_number().over(W.partitionBy(*keys).orderBy((F.col("__r") > 1).cast("int"), *order))
    return kept.withColumn("place", place.cast("long")).where(F.col("place") <= limit).drop("__r")


def preferred_variants(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One resource for each canonical address: the higher confidence, then more evidence, then the address (HTM-10).

    Confidence goes before evidence, so the choice doesn't depend on the order of rows.
    """
    w = W.partitionBy(*keys, canonical_url(F.col("target"), True)).orderBy(_rank(F.col("confidence"), CONFIDENCE_RANK).desc(), F.size("evidence").desc(), "target")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resolved_sites(attempts: DataFrame, key: str, budget: int) -> DataFrame:
    """The first accepted attempt within the budget, in order of origin and position, and how many were made (HTM-11)."""
    origin = F.when(F.col("origin") == "attested", 0).when(F.col("origin") == "source", 1).otherwise(2)
    n = F.row_number().over(W.partitionBy(key).orderBy(origin, "position"))
    tried = attempts.withColumn("n", n).where(F.col("n") <= budget)
    hit = F.min(F.when(F.col("outcome") == "accepted", F.col("n")))
    out = tried.groupBy(key).agg(hit.alias("hit"), F.max("n").alias("made"), F.min_by(F.when(F.col("outcome") == "accepted", F.col("url")), F.when(F.col("outcome") == "accepted", F.col("n"))).alias("website"))
    return out.select(key, "website", F.coalesce("hit", "made").cast("long").alias("attempts"), F.when(F.col("hit").isNotNull(), "resolved").otherwise("unresolved").alias("status"))


def site_queries(venues: DataFrame) -> DataFrame:
    """Search queries of a venue, in order, once each (HTM-12)."""
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    made = F.array(F.concat_ws(" ", quoted, "town"), F.concat_ws(" ", quoted, "town", "province"), F.when(F.col("postcode").isNotNull(), F.concat_ws(" ", quoted, "postcode")), F.when(F.col("phone").isNotNull(), F.concat_ws(" ", quoted, "phone")))
    return venues.select("venue_id", F.posexplode(F.array_distinct(F.array_compact(made))).alias("n", "query"))


def search_outcome(http_status: Column, transport_ok: Column, parse_ok: Column, n_results: Column) -> Column:
    """HTM-13."""
    return (
        F.when(http_status.isin(402, 429), "quota").when(~F.coalesce(transport_ok, F.lit(False)) | (http_status >= 500), "transient").when(http_status >= 400, "rejected")
        .when(~F.coalesce(parse_ok, F.lit(False)), "unparsable").when(n_results == 0, "empty").otherwise("results")
    )


def quoted_in(quotes: Column, text: Column) -> Column:
    """Whether every quote of eight characters or more stands in a text, and there is one (HTM-14); both folded alike."""
    long = F.filter(quotes, lambda q: F.length(q) >= 8)
    return (F.size(long) > 0) & F.forall(long, lambda q: F.contains(text, q))


def page_kind(title: Column, url: Column, lists: str, near: str, boilerplate: str) -> Column:
    """Reasons why a found page is no venue's own (FLT-12)."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return reasons([("list_page", t.rlike(lists)), ("near_me_page", t.rlike(near)), ("boilerplate", t.rlike(boilerplate)), ("search_page", url.rlike(r"[?&](?:q|query|s)="))])


def admission(evidence: Column, contradictions: Column, identity: list[str], place: list[str]) -> Column:
    """rejected on a contradiction; admitted with evidence of both identity and place (FLT-13)."""
    has = lambda kinds: F.arrays_overlap(evidence, F.array(*[F.lit(k) for k in kinds]))
    return F.when(F.size(contradictions) > 0, "contradicted").when(~has(identity), "no_identity").when(~has(place), "no_place").otherwise("admitted")


def not_garbage(name: Column, domain: Column, structured: Column, phrases: str, domains: list[str]) -> Column:
    """Names of 3 to 55 characters that aren't phrases or addresses; listed domains go unless the source is structured (FLT-11)."""
    n = F.lower(F.trim(name))
    address = n.rlike(r"^(?:via|viale|piazza|corso|strada)\s.*\d")
    return F.length(n).between(3, 55) & ~n.rlike(phrases) & ~address & (structured | ~F.coalesce(domain.isin(domains), F.lit(False)))


def first_party_failures(c: dict[str, Column], evidence: Column, contradictions: list[str]) -> Column:
    """The checks an automatic publication fails; none if eligible (FLT-22)."""
    has = lambda *kinds: F.arrays_overlap(evidence, F.array(*[F.lit(k) for k in kinds]))
    return reasons([
        ("not_strongly_correlated", ~c["assessment_state"].eqNullSafe("strongly_correlated")), ("crawl_not_succeeded", ~c["crawl_outcome"].eqNullSafe("succeeded")),
        ("unsupported_publisher", ~(c["candidate_kind"].eqNullSafe("official") & c["final_kind"].eqNullSafe("official"))), ("venue_name_not_compatible", ~has("page_exact_name", "page_name_tokens")),
        ("publisher_domain_not_venue_branded", ~has("branded_domain")), ("municipality_not_compatible", ~has("page_municipality_match")),
        ("high_specificity_identity_missing", ~has("page_phone_match", "page_address_match")), ("contradiction_present", has(*contradictions)),
    ])


def sites_by_domain(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.groupBy(registrable_domain(F.col(url)).alias("domain")).agg(F.count("*").alias("n_pages"), F.min(url).alias("first_url"))
