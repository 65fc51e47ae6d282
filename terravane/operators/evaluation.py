"""Predictions against truth: counts, rates, intervals, gates, validations."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import ratio, wilson


def confusion(rows: DataFrame, predicted: Column, actual: Column, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision and recall by key (EVL-01, EVL-02)."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = rows.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


#: Rows to a task that takes two sets together, on average. Above so many tasks those that write the rows hold them in memory
#: until they are written; where it keeps to that number, a task takes up to four times as many rows.
ROWS_A_TASK, FEW_TASKS = 1 << 19, 200


def _tasks(rows: int, least: int) -> int:
    return max(1, least, min(FEW_TASKS, -(-rows // ROWS_A_TASK)), -(-rows // (4 * ROWS_A_TASK)))


def _sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``keys`` of two tables, and whether each is in the one (``__a``) and in the other (``__b``).

    One aggregation in place of two and a join. The tasks follow the rows, which are counted first, so none holds more as
    the tables grow. A key with a null in it matches none of the other table: it stands once for each side.
    """
    side = lambda d, first: d.select(*keys, F.lit(first).alias("__first"))
    rows = side(a, True).unionByName(side(b, False))
    n = _tasks(rows.count(), int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    apart = F.when(reduce(or_, [F.col(k).isNull() for k in keys]), F.col("__first"))
    dealt = rows.repartition(n, *keys).withColumn("__apart", apart)
    return dealt.groupBy(*keys, "__apart").agg(F.bool_or("__first").alias("__a"), F.bool_or(~F.col("__first")).alias("__b")).drop("__apart")


def match_counts(predicted: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp and fn of two sets of keys, by some of them (EVL-01, AGG-16)."""
    both = _sides(predicted, truth, keys)
    hit, false, missed = (F.count_if(c) for c in (F.col("__a") & F.col("__b"), ~F.col("__b"), ~F.col("__a")))
    counts = both.groupBy(*by).agg(hit.alias("tp"), false.alias("fp"), missed.alias("fn"))
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def publication(rows: DataFrame, published: Column, correct: Column, keys: list[str], least: float = 0.95, needed: int = 1) -> DataFrame:
    """Published and correct with Wilson's interval. ``powered``: at or above ``least`` on enough cases (EVL-03); ``passed``: that, and none of them false (EVL-04)."""
    counts = rows.groupBy(*keys).agg(F.count_if(published).alias("published"), F.count_if(published & correct).alias("correct"))
    found = counts.withColumn("w", wilson(F.col("correct"), F.col("published")))
    powered = (F.col("published") >= needed) & (F.coalesce(F.col("w.lower"), F.lit(0.0)) >= least)
    passed = powered & (F.col("correct") == F.col("published"))
    return found.select(*keys, "published", "correct", F.col("w.lower").alias("lower"), F.col("w.upper").alias("upper"), powered.alias("powered"), passed.alias("passed"))


def intervals(rows: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """Successes, total and interval by key (EVL-10)."""
    counts = rows.groupBy(*keys).agg(F.count_if(success).alias("successes"), F.count("*").alias("total"))
    w = wilson(F.col("successes"), F.col("total"))
    return counts.select(*keys, "successes", "total", F.round(w["lower"], 6).alias("lower"), F.round(w["upper"], 6).alias("upper"))


def gates(measures: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row of measures to a table of gates, each passed or not, and whether all are (EVL-05). A null fails."""
    table = F.array(*[F.struct(F.lit(name).alias("gate"), F.coalesce(rule, F.lit(False)).alias("passed")) for name, rule in rules])
    one = measures.select(table.alias("g"))
    return one.select(F.explode("g").alias("g"), F.forall("g", lambda x: x["passed"]).alias("go")).select("g.gate", "g.passed", "go")


def fingerprint(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """SHA-256 over the sorted hashes of each key's rows, whatever their order (EVL-11, SNK-01)."""
    each = rows.select(*keys, F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    return each.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))


def bag_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A fingerprint of any number of rows by sums of their hashes: nothing is gathered, order doesn't matter."""
    h = F.sha2(F.to_json(F.struct(*columns)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    return rows.agg(F.count("*").alias("n"), *parts).select("n", F.sha2(F.concat_ws("|", "n", *[f"s{i}" for i in range(4)]), 256).alias("fingerprint"))


def sole_prediction(rows: DataFrame, keys: list[str], domain: str, score: str, url: str) -> DataFrame:
    """The best row of keys whose rows have exactly one distinct domain, ties by address (EVL-09)."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), F.col(url))
    ranked = rows.withColumn("__n", F.row_number().over(w)).withColumn("__lo", F.min(domain).over(W.partitionBy(*keys))).withColumn("__hi", F.max(domain).over(W.partitionBy(*keys)))
    return ranked.where((F.col("__n") == 1) & (F.col("__lo") == F.col("__hi"))).drop("__n", "__lo", "__hi")


def violations(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """A row for each rule a row breaks (EVL-07, EVL-12, EVD-09); none if valid."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))
    return rows.select(F.col(key), F.explode(broken).alias("violation"))


def group_resolution(labels: DataFrame, group: str, present: str, record: str) -> DataFrame:
    """Groups of two present labels or more: resolved if all are on one record (AGG-19)."""
    g = labels.where(F.col(present)).groupBy(group).agg(F.count("*").alias("n_labels"), F.countDistinct(record).alias("n_records"))
    return g.where("n_labels >= 2").withColumn("resolved", F.col("n_records") == 1)


def reviewer_audit(decisions: DataFrame, truth: DataFrame, key: str, accepted: Column, right: Column) -> DataFrame:
    """false_rejection, missed_accept, accepted_wrong or right for each labelled row (EVL-08)."""
    joined = truth.join(decisions, key, "left")
    kind = (
        F.when(F.coalesce(accepted, F.lit(False)) & ~right, "accepted_wrong")
        .when(accepted.isNull() & right, "missed_accept")
        .when(~accepted & right, "false_rejection")
        .otherwise("right")
    )
    return joined.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def policy_replay(decisions: DataFrame, labels: DataFrame, key: str, retain: Column, label: Column) -> DataFrame:
    """What a policy keeps or rejects against the labels (EVL-14)."""
    return decisions.join(labels, key).groupBy(F.when(retain, "retain").otherwise("reject").alias("policy"), label.alias("label")).agg(F.count("*").alias("n"))


#: The tokens of a call in each stage, as (input, output).
CALL_TOKENS = {"triage": (4_500, 300), "verifier": (4_500, 1_500)}


def model_slug(name: Column) -> Column:
    """Letters and digits in lower case with single hyphens between, without the mark of a free variant."""
    parts = F.regexp_replace(F.regexp_replace(F.lower(name), ":free$", ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(parts, "^-|-$", "")


def model_shortlist(models: DataFrame, scores: DataFrame, least_context: int = 32_000) -> DataFrame:
    """Models that can be used, with costs and benchmark scores, the best first, then the cheapest (EVL-13, JN-22, SRT-13).

    Models: id, name, context_length, input_modalities, supported_parameters, prompt, completion, reasoning (prices a
    token). Those that cannot answer in a given structure, take no text (none stated is text), have a shorter context
    than ``least_context`` or no fixed price are left out. Scores: position, slug, name, score; of several under one
    slug the last holds, whether the slug is of a name or an id. A model is looked up by the last part of its id, then
    by its name, and is one row.
    """
    keyed = scores.select("position", F.posexplode(F.array(model_slug(F.col("slug")), model_slug(F.col("name")))).alias("n", "key"), F.col("slug").alias("score_slug"), "score").where(F.col("key").isNotNull())
    last = keyed.groupBy("key").agg(F.max_by(F.struct("score", "score_slug"), F.struct("position", "n")).alias("s"))
    has = lambda c, value: F.array_contains(c, value)
    priced = (F.coalesce("prompt", F.lit(0.0)) >= 0) & (F.coalesce("completion", F.lit(0.0)) >= 0) & F.col("prompt").isNotNull() & F.col("completion").isNotNull()
    text = has(F.coalesce("input_modalities", F.array(F.lit("text"))), "text")
    usable = models.where(F.coalesce(has(F.col("supported_parameters"), "structured_outputs"), F.lit(False)) & text & (F.col("context_length") >= least_context) & priced)
    m = usable.withColumn("id_key", model_slug(F.element_at(F.split("id", "/"), -1))).withColumn("name_key", model_slug(F.col("name")))
    by_id, by_name = last.select(F.col("key").alias("id_key"), F.col("s").alias("by_id")), last.select(F.col("key").alias("name_key"), F.col("s").alias("by_name"))
    found = m.join(by_id, "id_key", "left").join(by_name, "name_key", "left").withColumn("found", F.coalesce("by_id", "by_name"))
    output = F.greatest("completion", F.coalesce("reasoning", F.lit(0.0)))
    cost = {stage: F.round(1000 * (i * F.col("prompt") + o * output), 4) for stage, (i, o) in CALL_TOKENS.items()}
    rows = found.select(
        "id", "name", ((F.col("prompt") == 0) & (output == 0)).alias("free"), "context_length", F.round(F.col("prompt") * 1e6, 4).alias("usd_per_million_input"), F.round(output * 1e6, 4).alias("usd_per_million_output"),
        *[c.alias(f"usd_per_1000_{stage}") for stage, c in cost.items()], F.col("found.score").alias("score"), F.col("found.score_slug").alias("slug"),
    )
    return rows.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "usd_per_1000_verifier", "id")


def fixture_scores(cases: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against found pairs ``(case_id, value)`` by case, and which cases are exact (EVL-06)."""
    j = _sides(cases, results, ["case_id", *keys])
    hit = F.count_if(F.col("__a") & F.col("__b"))
    counts = j.groupBy("case_id").agg(hit.alias("found"), F.count_if(~F.col("__b")).alias("missed"), F.count_if(~F.col("__a")).alias("extra"))
    return counts.withColumn("exact", (F.col("missed") == 0) & (F.col("extra") == 0))


def run_faults(config: DataFrame) -> DataFrame:
    """What forbids a run: unpinned inputs, a warm run before its cold one has passed, a budget of nothing (QUE-12)."""
    warm = F.col("mode") == "warm"
    rules = [("unpinned_input", F.col("input_sha256").rlike("^[0-9a-f]{64}$")), ("cold_run_not_passed", ~warm | F.coalesce("cold_passed", F.lit(False))), ("no_budget", F.col("max_requests") > 0), ("unknown_mode", F.col("mode").isin("cold", "warm"))]
    return violations(config, "run_id", rules)
