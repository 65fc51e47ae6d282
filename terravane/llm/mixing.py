"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent between 0 (all equal) and 1 (as they are). The exponent
is bisected: the largest one whose weights reach the target entropy, or a larger one where small sources would
otherwise repeat more often than the limit. The weights are then realised: every source is read in passes, each a
pseudo-random permutation of its documents, until its budget is spent, and dealt into blocks so that each block
holds the sources in their weights. All by DataFrame functions; the texts are not touched after counting words.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut

ENTROPY, REPEATS, BLOCKS, SEED, STEPS = 0.9, 4.0, 64, "mix", 40
#: Leading hexadecimal digits of the order's hash: a source is summed in so many slices.
SLICE_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _entropy(logs: Column, alpha: Column) -> Column:
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(alpha * x))
    dot = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x * F.exp(alpha * x))
    return F.log(total) - alpha * dot / total


def _bisect(keeps) -> Column:
    """The largest exponent from 0 to 1 for which ``keeps`` holds, which it must do from 0 upwards."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s, _):
        middle = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(keeps(middle), middle).otherwise(s["lo"]).alias("lo"), F.when(keeps(middle), s["hi"]).otherwise(middle).alias("hi"))

    return F.when(keeps(F.lit(1.0)), F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["lo"]))


def source_weights(tokens: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """``tokens(source, n_tokens)`` to one row a source: tokens, alpha, weight and budget.

    ``entropy`` is the target as a part of the largest possible one. Without ``budget`` the mixture is just large
    enough to hold every document once. The exponent is rounded to six places, weights to twelve. Sources without
    tokens have no part in the target: their weight and budget are zero. Null is a source like any other; no rows
    give no rows. The sources are a dimension: their totals meet in one row for the bisection.
    """
    totals = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    sums = totals.where("tokens > 0")
    row = sums.agg(F.array_sort(F.collect_list(F.struct("tokens", "source"))).alias("s")).where(F.size("s") > 0)
    row = row.withColumn("most", F.array_max("s.tokens").cast("double"))
    row = row.withColumn("logs", F.transform("s", lambda x: F.log(x["tokens"] / F.col("most"))))
    logs = F.col("logs")

    def norm(a: Column) -> Column:
        return F.aggregate(logs, F.lit(0.0), lambda t, x: t + F.exp(a * x))

    def passes(a: Column) -> Column:
        """The passes over the source that repeats most, against those over the one that repeats least if the budget is open."""
        spread = F.exp((a - 1) * F.array_min(logs))
        return spread if budget is None else F.lit(float(budget)) / F.col("most") * spread / norm(a)

    target = F.lit(entropy) * F.log(F.size(logs).cast("double"))
    row = row.withColumn("by_entropy", _bisect(lambda a: _entropy(logs, a) >= target))
    row = row.withColumn("over", F.when(passes(F.lit(0.0)) > repeats, _bisect(lambda a: passes(a) > repeats)).otherwise(0.0))
    row = row.withColumn("alpha", F.round(F.greatest("by_entropy", "over"), 6)).withColumn("norm", norm(F.col("alpha")))
    weighted = F.transform("s", lambda x: F.struct(x["source"].alias("source"), x["tokens"].alias("tokens"), F.round(F.exp(F.col("alpha") * F.log(x["tokens"] / F.col("most"))) / F.col("norm"), 12).alias("weight")))
    row = row.withColumn("w", weighted)
    whole = F.lit(budget) if budget is not None else F.ceil(F.array_max(F.transform("w", lambda x: F.round(x["tokens"] / x["weight"], 3))))
    row = row.withColumn("whole", whole.cast("double"))
    spent = F.floor(F.round(F.col("x.weight") * F.col("whole"), 3)).cast("long")
    spent = F.greatest(spent, F.col("x.tokens")) if budget is None else spent
    worded = row.select(F.explode("w").alias("x"), "alpha", "whole").select("x.source", "x.tokens", "alpha", "x.weight", spent.alias("budget"))
    wordless = totals.where("tokens = 0").select("source", "tokens", F.lit(None).cast("double").alias("alpha"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    return worded.unionByName(wordless)


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, blocks: int = BLOCKS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each placing of a document: id, source, n_tokens, weight, pass, block, place.

    ``place`` is where the document starts in its source's stream of tokens; ``block`` says in which of ``blocks``
    equal parts of that stream. Ordered by block, the rows hold every prefix of blocks in the target weights. A
    document is placed in a pass if it starts within the source's budget; without ``budget`` each is placed at
    least once. Null sources are a source of their own. Documents without words, null texts too, are placed where
    they fall, at no cost; those of a source that has no words at all are placed once, in the first block. Repeated
    rows are placed each; an empty table gives no rows. Columns named in ``carry`` follow; others are not read.
    """
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("n_tokens"), F.struct(F.lit(0).alias("none"), *carry).alias("carried"))
    counted = cut(counted)  # words are counted once; the rows have no texts
    weights = source_weights(counted.select("source", "n_tokens"), entropy, repeats, budget)
    joined = counted.join(weights.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    last = F.when(F.col("tokens") > 0, F.greatest(F.ceil(F.col("budget") / F.col("tokens")) - 1, F.lit(0))).otherwise(0).cast("int")
    turns = joined.select("*", F.explode(F.sequence(F.lit(0), last)).alias("pass"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    turns = turns.withColumn("order", order).withColumn("slice", F.substring("order", 1, SLICE_DIGITS))
    keys = ["source", "pass", "slice"]
    inside = W.partitionBy(*keys).orderBy("order", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = turns.withColumn("before", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    slices = turns.groupBy(*keys).agg(F.sum("n_tokens").alias("n"))
    ahead = W.partitionBy("source", "pass").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = slices.select(F.col("source").alias("of"), F.col("pass").alias("p"), F.col("slice").alias("s"), (F.sum("n").over(ahead) - F.col("n")).alias("offset"))
    match = F.col("source").eqNullSafe(F.col("of")) & (F.col("pass") == F.col("p")) & (F.col("slice") == F.col("s"))
    placed = summed.join(offsets, match).withColumn("place", F.col("pass") * F.col("tokens") + F.col("offset") + F.col("before"))
    block = F.when(F.col("budget") > 0, F.least(F.floor(F.col("place") * blocks / F.col("budget")), F.lit(blocks - 1))).otherwise(0).cast("long")
    within = F.col("place") < F.col("budget")
    if budget is None:
        within = within | (F.col("pass") == 0)  # texts without words at the end of a pass start where the budget ends
    return placed.where(within).select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "weight", F.col("pass").cast("long").alias("pass"), block.alias("block"), "place", *[F.col(f"carried.{c}") for c in carry])


PLACED = ["n_tokens", "weight", "pass", "block", "place"]


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The placed documents with their columns, texts too: those of ``docs``, then n_tokens, weight, pass, block, place.

    Columns of ``docs`` with one of these five names are replaced. Nulls, ties, texts without words and empty tables
    are treated as in ``mix``; rows that repeat an id are documents of their own, and are placed as often as they
    occur, each with its own columns. Two that differ in columns of maps alone count as the same.
    """
    kept = [c for c in docs.columns if c not in PLACED]
    docs = docs.select(*kept)
    key, tag = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(*[F.coalesce(F.xxhash64(c), F.lit(0)) + F.col(c).isNull().cast("int") for c, kind in docs.dtypes if "map<" not in kind])
    placed = mix(docs.withColumn("__tag", tag), carry=("__tag",), **options).withColumn("__key", key).drop("doc_id", "source")
    whole = docs.withColumn("__key", key).withColumn("__tag", tag).dropDuplicates(["__key", "__tag"])
    return whole.join(placed, ["__key", "__tag"]).select(*kept, *PLACED)
