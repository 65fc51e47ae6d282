"""The evidence store as tables: facts with a time to live, outcomes, retirement, attestations, reviews."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.filters import due_for_check, first_true, valid_at

# Days that kinds of facts are valid, and days until outcomes are tried again.
TTL_DAYS = {"website": 30, "resource": 14}
RETRY_DAYS = {"review": 7, "transient": 1, "rejected": 7, "not_found": 30}


def with_ttl(checks: DataFrame, keys: list[str], checked_at: str, kind: Column, days: dict[str, int] = TTL_DAYS, other: int = 14) -> DataFrame:
    """First and last sight of each fact and until when it is valid (EVD-02)."""
    ttl = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in days.items() for x in (k, v)]), kind), F.lit(other))
    seen = checks.withColumn("__ttl", ttl).groupBy(*keys).agg(F.min(checked_at).alias("first_seen"), F.max(checked_at).alias("last_seen"), F.max_by("__ttl", checked_at).alias("__ttl"))
    return seen.withColumn("valid_until", F.col("last_seen") + F.make_dt_interval(F.col("__ttl"))).drop("__ttl")


def with_retry(decisions: DataFrame, at: str, status: str, days: dict[str, int] = RETRY_DAYS) -> DataFrame:
    """Decisions that aren't final, with the time to try again (EVD-03)."""
    delay = F.create_map(*[F.lit(x) for k, v in days.items() for x in (k, v)])
    return decisions.withColumn("retry_after", F.col(at) + F.make_dt_interval(F.try_element_at(delay, F.col(status))))


def current_facts(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state of facts after a log of outcomes: accepted, transient, contradicted (EVD-04).

    A transient failure moves only ``retry_after``; a contradiction with evidence retires the fact until it is
    accepted again. Last values of each kind of outcome are enough, so it is one aggregation.
    """
    at = F.struct(*order)
    last = lambda kind, value: F.max_by(F.when(F.col("outcome") == kind, F.col(value)), F.when(F.col("outcome") == kind, at))
    out = events.groupBy(*keys).agg(
        F.min(F.when(F.col("outcome") == "accepted", F.col("at"))).alias("first_seen"),
        last("accepted", "at").alias("last_accepted"),
        F.max(F.when(F.col("outcome") == "accepted", at)).alias("__ok"),
        F.max(F.when((F.col("outcome") == "contradicted") & F.col("has_evidence"), at)).alias("__no"),
        last("transient", "retry_after").alias("__retry"),
        F.max(F.when(F.col("outcome") == "transient", at)).alias("__soft"),
        F.max_by("outcome", at).alias("last_outcome"),
    )
    retired = F.col("__no").isNotNull() & (F.col("__ok").isNull() | (F.col("__no") > F.col("__ok")))
    retry = F.when(F.col("__ok").isNull() | (F.col("__soft") > F.col("__ok")), F.col("__retry"))
    return out.select(*keys, "first_seen", "last_accepted", retry.alias("retry_after"), F.when(retired, "retired").otherwise("active").alias("lifecycle"), "last_outcome")


def cascade(facts: DataFrame, sources: DataFrame, key: str, source: str) -> DataFrame:
    """Facts that depend on a retired source are retired too (EVD-04, EVD-06)."""
    gone = sources.where("lifecycle = 'retired'").select("venue_id", F.col(key).alias(source)).distinct().withColumn("__gone", F.lit(True))
    return facts.join(gone, ["venue_id", source], "left").withColumn("lifecycle", F.when(F.col("__gone"), "retired").otherwise(F.col("lifecycle"))).drop("__gone")


def closed(facts: DataFrame, closures: DataFrame) -> DataFrame:
    """All facts of closed venues retired (EVD-06)."""
    gone = closures.select("venue_id").distinct().withColumn("__closed", F.lit(True))
    return facts.join(gone, "venue_id", "left").withColumn("lifecycle", F.when(F.col("__closed"), "retired").otherwise(F.col("lifecycle"))).drop("__closed")


def reusable(facts: DataFrame, attestations: DataFrame, at: Column) -> DataFrame:
    """Active accepted facts of venues, those with a live attestation of the same domain, and whether a check is due (EVD-07, JN-04)."""
    live = attestations.where((F.col("lifecycle") == "active") & (F.col("decision") == "verified") & valid_at(at, F.col("reviewed_at"), F.col("expires_at")))
    owned = live.select("venue_id", F.col("publisher_domain").alias("domain"), F.lit(True).alias("attested")).distinct()
    f = facts.where("lifecycle = 'active' AND decision = 'accepted'").join(owned, ["venue_id", "domain"], "left")
    return f.withColumns({"attested": F.coalesce("attested", F.lit(False)), "due": due_for_check(at, F.col("valid_until"), F.col("retry_after"))})


def attestation_events(snapshots: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """created and replaced events; equal snapshots in a row make none (EVD-08, WIN-06)."""
    w = W.partitionBy(*keys).orderBy(*order)
    state = F.struct(*columns)
    seen = snapshots.withColumn("__n", F.row_number().over(w)).withColumn("__same", F.lag(state).over(w).eqNullSafe(state))
    kept = seen.where((F.col("__n") == 1) | ~F.col("__same"))
    return kept.withColumn("event", F.when(F.col("__n") == 1, "created").otherwise("replaced")).drop("__n", "__same")


# The methods by which ownership can be attested.
METHODS = ["manual_first_party_review", "official_registry", "verified_platform_claim", "verified_reciprocal_link", "automated_llm_ownership_review"]


def attestation_fault(at: Column) -> Column:
    """The first thing wrong with an attestation, null if it is valid (EVD-09)."""
    c = F.col
    return first_true([
        ("ownership_not_verified", ~c("status").eqNullSafe("verified")),
        ("ownership_attestation_inactive", F.coalesce(c("lifecycle") != "active", F.lit(False))),
        ("unsupported_ownership_method", ~F.coalesce(c("method").isin(METHODS), F.lit(False))),
        ("invalid_attested_website", ~F.coalesce(c("website_url").rlike(r"^(?i:https?)://[^/]+"), F.lit(False))),
        ("invalid_ownership_timestamp", c("reviewed_at").isNull()),
        ("ownership_attestation_expired", F.coalesce(c("expires_at") <= at, F.lit(False))),
        ("ownership_evidence_missing", F.coalesce(F.size("evidence_urls"), F.lit(0)) <= 0),
        ("ownership_reviewer_missing", (c("method") == "manual_first_party_review") & F.coalesce(F.trim("reviewer") == "", F.lit(True))),
        ("ownership_venue_mismatch", F.coalesce(c("venue_id") != c("expected_venue_id"), F.lit(False))),
    ])


def revoked(attestations: DataFrame, revocations: DataFrame, keys: list[str]) -> DataFrame:
    """EVD-10."""
    r = revocations.groupBy(*keys).agg(F.max("revoked_at").alias("__at"))
    j = attestations.join(r, keys, "left")
    return j.withColumn("lifecycle", F.when(F.col("__at") >= F.col("reviewed_at"), "revoked").otherwise(F.col("lifecycle"))).drop("__at")


def next_for_review(candidates: DataFrame, decided: DataFrame, verified: DataFrame, cursor: tuple[str, str] | None) -> DataFrame:
    """The next undecided (venue, domain) after a cursor, with how many are left (EVD-11)."""
    rest = candidates.join(decided.select("venue_id", "domain").distinct(), ["venue_id", "domain"], "left_anti").join(verified.select("venue_id").distinct(), "venue_id", "left_anti")
    if cursor:
        v, d = cursor
        rest = rest.where((F.col("venue_id") > v) | ((F.col("venue_id") == v) & (F.col("domain") > d)))
    remaining = rest.agg(F.count("*")).scalar()
    return rest.orderBy("venue_id", "domain").limit(1).withColumn("remaining", remaining)


def publishable(batch: DataFrame, manual: DataFrame, existing: DataFrame, reviewer: str) -> DataFrame:
    """A batch's decisions by the frozen reviewer, without venues decided by hand and pairs already there (EVD-12)."""
    rows = batch.where(F.col("reviewer") == reviewer).join(manual.select("venue_id").distinct(), "venue_id", "left_anti")
    return rows.join(existing.select("venue_id", "domain").distinct(), ["venue_id", "domain"], "left_anti")


def latest_assessments(assessments: DataFrame) -> DataFrame:
    """The latest of each venue and address (EVD-13)."""
    w = W.partitionBy("venue_id", "candidate_url").orderBy(F.desc("checked_at"), F.desc("assessment_id"))
    return assessments.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def review_overlay(base: DataFrame, decisions: DataFrame, order: list[str]) -> DataFrame:
    """Statuses after pending decisions: an approval verifies its domain; a rejection counts unless another domain is verified (EVD-14).

    Base: venue_id, status, domain. The last approval, and the last rejection of its domain after it, decide.
    """
    at = F.struct(*order)
    yes = decisions.where("decision = 'approve'").groupBy("venue_id").agg(F.max_by("domain", at).alias("ok_domain"), F.max(at).alias("ok_at"))
    j = base.join(yes, "venue_id", "left").withColumn("held", F.coalesce("ok_domain", F.when(F.col("status") == "verified", F.col("domain"))))
    no = decisions.where("decision = 'reject'").select("venue_id", F.col("domain").alias("no_domain"), at.alias("no_at"))
    r = j.join(no, "venue_id", "left").withColumn("__late", F.col("ok_at").isNull() | (F.col("no_at") > F.col("ok_at")))
    hits = F.col("no_domain").isNotNull() & F.col("__late")
    summed = r.groupBy("venue_id", "status", "held").agg(F.bool_or(hits & F.col("no_domain").eqNullSafe(F.col("held"))).alias("lost"), F.bool_or(hits).alias("any_no"))
    status = F.when(F.col("held").isNotNull() & ~F.coalesce("lost", F.lit(False)), "verified").when(F.coalesce("any_no", F.lit(False)), "rejected").otherwise(F.col("status"))
    return summed.select("venue_id", status.alias("status"))


def replayed(decisions: DataFrame, venues: DataFrame) -> DataFrame:
    """Pending decisions, oldest first, with what is wrong with each in place of an exception (EVD-15)."""
    known = venues.select("venue_id", F.lit(True).alias("__known")).distinct()
    j = decisions.join(known, "venue_id", "left")
    fault = first_true([("unknown_venue", F.col("__known").isNull()), ("unknown_decision", ~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False))), ("missing_website", (F.col("decision") == "approve") & F.col("domain").isNull())])
    return j.withColumn("error", fault).drop("__known").orderBy("created_at", "decision_id")


def first_documents(entries: DataFrame) -> DataFrame:
    """Each venue's entry in the first document that has it (EVD-16)."""
    w = W.partitionBy("venue_id").orderBy("document", "position")
    return entries.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
