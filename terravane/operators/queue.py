"""The job queue as data: enqueueing, eligibility, leases, budgets, circuits, stages."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import backoff_seconds


def enqueue(queue: DataFrame, jobs: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """New jobs whose key isn't there (QUE-01)."""
    fresh = jobs.dropDuplicates([key]).join(queue.select(key), key, "left_anti")
    return queue.unionByName(fresh, allowMissingColumns=True)


def recovered(jobs: DataFrame, at: Column, base: int, longest: int) -> DataFrame:
    """Expired leases: cancelled if asked, dead after the last attempt, else to be tried again (QUE-03)."""
    lapsed = (F.col("status") == "running") & (F.col("lease_expires_at") <= at)
    status = F.when(F.col("cancel_requested"), "cancelled").when(F.col("attempt_count") >= F.col("max_attempts"), "dead_letter").otherwise("retry")
    again = at + F.make_dt_interval(secs=backoff_seconds(F.col("attempt_count"), base, longest))
    return jobs.withColumns({
        "status": F.when(lapsed, status).otherwise(F.col("status")),
        "next_attempt_at": F.when(lapsed, again).otherwise(F.col("next_attempt_at")),
        "lease_expires_at": F.when(~lapsed, F.col("lease_expires_at")),
    })


def claimable(jobs: DataFrame, running: DataFrame, at: Column, limits: dict[str, int], window: int = 100, count: int = 1) -> DataFrame:
    """The first jobs in order, of the top of the queue, whose provider and domain have room (QUE-02, SRT-12).

    Mutual exclusion of workers isn't a query's to give; one driver claims for all.
    """
    ready = jobs.where(F.col("status").isin("queued", "retry") & ~F.col("cancel_requested") & (F.col("next_attempt_at") <= at))
    top = ready.orderBy(F.desc("priority"), "next_attempt_at", "job_id").limit(window)
    by_provider = running.groupBy("provider").agg(F.count("*").alias("n_provider"))
    by_domain = running.groupBy("domain").agg(F.count("*").alias("n_domain"))
    free = top.join(by_provider, "provider", "left").join(by_domain, "domain", "left").fillna(0, ["n_provider", "n_domain"])
    free = free.where((F.col("n_provider") < limits["provider"]) & (F.col("n_domain") < limits["domain"]))
    return free.orderBy(F.desc("priority"), "next_attempt_at", "job_id").limit(count)


def after_outcome(jobs: DataFrame, outcomes: DataFrame, base: int, longest: int) -> DataFrame:
    """complete, fail with backoff or dead letter, cancel, retry, heartbeat applied to running jobs (QUE-04)."""
    j = jobs.join(outcomes.select("job_id", "outcome", F.col("at").alias("__at"), "lease"), "job_id", "left")
    o, last = F.col("outcome"), F.col("attempt_count") >= F.col("max_attempts")
    status = F.when(o == "complete", "completed").when((o == "fail") & last, "dead_letter").when(o == "fail", "retry").when(o == "cancel", "cancelled").when(o == "retry", "queued").otherwise(F.col("status"))
    again = F.when(o == "fail", F.col("__at") + F.make_dt_interval(secs=backoff_seconds(F.col("attempt_count"), base, longest))).when(o == "retry", F.col("__at")).otherwise(F.col("next_attempt_at"))
    lease = F.when(o == "heartbeat", F.col("lease")).when(o.isNull(), F.col("lease_expires_at"))
    return j.withColumns({"next_attempt_at": again, "lease_expires_at": lease, "status": status}).drop("outcome", "__at", "lease")


def reserve(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """``budget, request_id, granted, exhausted``: requests in order, granted if all their scopes have room (QUE-05, QUE-10).

    Requests: request_id, budget, scope, n. A scope without a limit always has room, one that a request names twice
    counts once, with the larger number. ``exhausted`` is the first scope, by name, that stood against a request; then
    nothing of it is used. Limits: budget, scope, most; of several for one scope the lowest holds.

    Later smaller requests can fit where an earlier one did not, so those of a budget are gone through in order:
    Spark sorts them, on disk if need be, and a task streams over them, holding only the amounts used so far.
    """
    most = limits.groupBy("budget", "scope").agg(F.min("most").cast("long").alias("most"))
    wanted = requests.groupBy("budget", "request_id", "scope").agg(F.max("n").cast("long").alias("n")).join(most, ["budget", "scope"], "left")
    rows = wanted.groupBy("budget", "request_id").agg(F.array_sort(F.collect_list(F.when(F.col("most").isNotNull(), F.struct("scope", "n", "most")))).alias("scopes"))
    kinds = dict(requests.dtypes)
    sorted_rows = rows.repartition("budget").sortWithinPartitions("budget", "request_id")
    return sorted_rows.mapInArrow(_granted, f"budget {kinds['budget']}, request_id {kinds['request_id']}, granted boolean, exhausted {kinds['scope']}")


def _granted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    budget, used = None, {}
    for batch in batches:
        against = []
        for name, scopes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if name != budget:
                budget, used = name, {}
            full = next((s["scope"] for s in scopes if used.get(s["scope"], 0) + s["n"] > s["most"]), None)
            refused = any(used.get(s["scope"], 0) + s["n"] > s["most"] for s in scopes)
            if not refused:
                for s in scopes:
                    used[s["scope"]] = used.get(s["scope"], 0) + s["n"]
            against.append((not refused, full))
        kind = batch.schema.field(2).type.value_type.field("scope").type
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g for g, _ in against], pa.bool_()), pa.array([f for _, f in against], kind)], ["budget", "request_id", "granted", "exhausted"])


def running_budget(requests: DataFrame, keys: list[str], order: list[str], n: str, most: int) -> DataFrame:
    """The prefix of requests that fits the budget (QUE-05, where the first refusal ends it)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return requests.withColumn("used", F.sum(n).over(w)).withColumn("granted", F.col("used") <= most)


def circuits(outcomes: DataFrame, provider: str, order: list[str], failed: Column, threshold: int) -> DataFrame:
    """The failures in a row at the end of each provider's log; open from the threshold on (QUE-07, WIN-04)."""
    at = F.struct(*order)
    last_ok = outcomes.groupBy(provider).agg(F.max(F.when(~failed, at)).alias("__ok"))
    j = outcomes.join(last_ok, provider)
    streak = F.count_if(failed & (F.col("__ok").isNull() | (at > F.col("__ok"))))
    return j.groupBy(provider).agg(streak.alias("failures")).withColumn("open", F.col("failures") >= threshold)


def quota_signal(status: Column, message: Column, remaining: Column) -> Column:
    """exhausted, rate_limited or none from a response (QUE-08)."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when((status == 402) | text.rlike("quota (?:exceeded|exhausted)|insufficient (?:credit|funds)|monthly limit"), "exhausted")
        .when((status == 429) & (F.coalesce(remaining, F.lit(1)) <= 0) & text.rlike("month|quota"), "exhausted")
        .when((status == 429) | text.rlike("rate.?limit|too many requests"), "rate_limited")
        .otherwise("none")
    )


def paused_for_quota(jobs: DataFrame, signals: DataFrame) -> DataFrame:
    """Running jobs of an exhausted provider go back to the queue with their attempt refunded (QUE-06)."""
    s = signals.where("signal <> 'none'").groupBy("provider").agg(F.max("resume_at").alias("__resume"))
    j = jobs.join(s, "provider", "left")
    hit = F.col("__resume").isNotNull() & (F.col("status") == "running")
    return j.withColumns({
        "attempt_count": F.when(hit, F.greatest(F.col("attempt_count") - 1, F.lit(0))).otherwise(F.col("attempt_count")),
        "next_attempt_at": F.when(hit, F.col("__resume")).otherwise(F.col("next_attempt_at")),
        "status": F.when(hit, "queued").otherwise(F.col("status")),
    }).drop("__resume")


def queue_status(jobs: DataFrame, at: Column) -> DataFrame:
    """Counts over the queue (AGG-07)."""
    s = F.col("status")
    waiting = s.isin("queued", "retry")
    return jobs.agg(
        F.count("*").alias("total"), F.count_if(s == "running").alias("active"), F.count_if(waiting & (F.col("next_attempt_at") <= at)).alias("ready"),
        F.count_if(s == "dead_letter").alias("dead_letters"), F.count_if(F.col("cancel_requested")).alias("cancel_requested"),
    )


def paced(requests: DataFrame, key: str, order: str, arrival: str, interval_ms: int) -> DataFrame:
    """Launch times at least an interval apart (WIN-10, QUE-09).

    launch(i) = i interval + max over j <= i of (arrival(j) - j interval), so a running maximum gives it.
    """
    w = W.partitionBy(key).orderBy(order)
    n = F.row_number().over(w) - 1
    shifted = requests.withColumn("__n", n).withColumn("__s", F.col(arrival) - F.col("__n") * interval_ms)
    best = F.max("__s").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return shifted.withColumn("launch_ms", best + F.col("__n") * interval_ms).drop("__n", "__s")


# The stages in their order, and those that no automatic step leaves.
STAGES = ["new", "contacted", "demo", "signed_up", "won", "lost", "do_not_contact"]
FINAL = ["won", "lost", "do_not_contact"]


def automatic_stage(current: Column, proposed: Column) -> Column:
    """An automatic step only moves forward and never out of a final stage (QUE-11)."""
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in STAGES]), c)
    now = F.coalesce(current, F.lit("new"))
    return F.when(~now.isin(FINAL) & (place(proposed) > place(now)), proposed).otherwise(now)


def stage_after(events: DataFrame, key: str, order: list[str], stage: str, automatic: str) -> DataFrame:
    """The stage of each key after its log of steps by hand and automatic ones (QUE-11).

    The last step by hand sets the stage; automatic steps after it can only move it on, so the furthest one counts,
    unless the stage is final.
    """
    at = F.struct(*order)
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col(stage))
    by_hand = ~F.col(automatic)
    last = events.groupBy(key).agg(F.max(F.when(by_hand, at)).alias("__at"), F.max_by(F.when(by_hand, F.col(stage)), F.when(by_hand, at)).alias("__set"))
    later = events.where(automatic).join(last, key).where(F.col("__at").isNull() | (at > F.col("__at")))
    # The first automatic step into a final stage ends the log.
    final_at = later.groupBy(key).agg(F.min(F.when(F.col(stage).isin(FINAL), at)).alias("__end"))
    open_steps = later.join(final_at, key).where(F.col("__end").isNull() | (at <= F.col("__end")))
    furthest = open_steps.groupBy(key).agg(F.max_by(stage, place).alias("__auto"))
    j = last.join(furthest, key, "left")
    return j.select(key, F.when(F.col("__auto").isNotNull(), automatic_stage(F.col("__set"), F.col("__auto"))).otherwise(F.coalesce("__set", F.lit("new"))).alias("stage"))
