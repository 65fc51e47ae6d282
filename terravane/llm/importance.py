"""Importance resampling towards a target distribution.

Features are runs of one to three words, hashed into buckets. How much more frequent a bucket is in the target than in
the corpus is its gain; a document's weight is the sum of the gains of its features. Gumbel noise that only depends on
the id turns the largest scores into a draw without replacement.

Eligible documents are sorted in every partition of the scored table: these are the runs. Their rows that may be drawn
are dealt out by ranges of the order; a task merges the pieces of all runs in its range by a tournament tree. Ranges
that lie behind the draw count are not merged, and the merge of the last one stops at the count.
"""

import hashlib
import math
import string
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, raw

BUCKETS = 10_000
LONGEST = 3
SEED = 42
LEAST_WORDS = 20
#: Per cent of the eligible documents that are drawn.
SHARE = 5
#: Rows that one task merges, about.
RANGE_ROWS = 1 << 17

#: A-Z to lower case, all other ASCII signs but letters and digits to blanks.
WORD_BYTES = bytes(b if b > 127 or chr(b) in string.digits + string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256))


def buckets(text: bytes | None) -> tuple[np.ndarray, int]:
    """The bucket of each feature of a text, and the number of its words. A run's crc32 goes on from the run one word shorter."""
    words = (text or b"").translate(WORD_BYTES).split()
    spaced = [b" " + w for w in words]
    runs = list(map(crc32, words))
    every = list(runs)
    for length in range(1, LONGEST):
        runs = list(map(crc32, spaced[length:], runs))
        every += runs
    return np.array(every, np.int64) % BUCKETS, len(words)


def _histogram(batches: Iterator[pa.RecordBatch]):
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in raw(batch.column(0)):
            counts += np.bincount(buckets(text)[0], minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["bucket", "n"])


def histogram(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The number of features in each bucket over all texts. A task sends one row a bucket."""
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(_histogram, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's logarithmic gain in thousandths, rounded down, counts being smoothed by one."""
    whole = (float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log((t + 1) * whole[0] / ((s + 1) * whole[1]))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise in thousandths, rounded down, from a hash of the seed and the id. A null id counts as an empty one."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each document; the gains are one array of 80 kB."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = sent.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                found, n_words = buckets(text)
                weight = int(gain[found].sum())
                out.append((doc_id, n_words, len(found), weight, weight + noise(doc_id)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 5, ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCORED)


def _order() -> list[Column]:
    """Highest scores first, then smaller ids, ids of null last, then the place in the scored table."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]


class Tournament:
    """A tree of losers over sorted runs: each step replaces the winner by its run's next entry and replays one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.size = runs, max(len(runs), 1)
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        one, other = self.heads[a], self.heads[b]
        return other is None or (one is not None and one <= other)

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.size) // 2
            while node:
                if not self._first(at, self.losers[node]):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def _merge(rows: pa.Table) -> pa.Table:
    """The rows of a range, each run's already in order, ranked from its first rank on; no more than are to be drawn."""
    first, wanted = rows.column("first")[0].as_py(), rows.column("wanted")[0].as_py()
    run, seq = (rows.column(c).to_numpy() for c in ("run", "seq"))
    by_run = np.lexsort((seq, run))
    score, place = (rows.column(c).to_numpy()[by_run] for c in ("score", "place"))
    key = rows.column("doc_id").combine_chunks()
    null = key.is_null().to_numpy(zero_copy_only=False)[by_run]
    key = key.fill_null(0).to_numpy()[by_run]
    edges = [*np.flatnonzero(np.diff(run[by_run], prepend=-1)).tolist(), len(run)]
    entries = lambda a, b: zip((-score[a:b]).tolist(), null[a:b].tolist(), key[a:b].tolist(), place[a:b].tolist(), by_run[a:b].tolist())
    taken = []
    for entry in Tournament([iter(entries(a, b)) for a, b in zip(edges, edges[1:])]):
        if len(taken) == wanted:
            break
        taken.append(entry[-1])
    out = rows.take(pa.array(taken, pa.int64())).select(["place", "doc_id", "n_words", "n_features", "weight", "score"])
    return out.append_column("rank", pa.array(range(first, first + len(taken)), pa.int64()))


def draw(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the drawn documents in the order of their scores, null for the others.

    Of the N documents with at least ``least_words`` words, floor(share * N / 100) are drawn; equal scores go to the
    smaller id. Rows that repeat a document are documents of their own. An empty table gives an empty table.
    """
    held = cut(scored.withColumn("place", F.monotonically_increasing_id()))
    undrawn = held.withColumn("rank", F.lit(None).cast("long")).drop("place")
    able = held.where(F.col("n_words") >= least_words)
    n = able.count()
    wanted = share * n // 100
    if not wanted:
        return undrawn
    # A score below which no drawn document lies: an approximate quantile, lowered until enough rows reach it.
    part = wanted / n
    while True:
        part = min(1.0, 1.1 * part + 0.001)
        floor = able.agg(F.percentile_approx("score", 1 - part, 10_000).alias("p")).first()["p"] if part < 1 else None
        leading = able if floor is None else able.where(F.col("score") >= floor)
        if floor is None or leading.count() >= wanted:
            break
    runs = leading.withColumn("run", F.spark_partition_id()).sortWithinPartitions(*_order()).withColumn("seq", F.monotonically_increasing_id())
    ranges = cut(runs.repartitionByRange(max(1, -(-wanted // RANGE_ROWS)), *_order()).withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    sizes = sizes.where(F.col("before") < wanted).select("range", (F.col("before") + 1).alias("first"), (F.lit(wanted) - F.col("before")).alias("wanted"))
    ranked = cut(ranges.join(F.broadcast(sizes), "range").groupBy("range").applyInArrow(_merge, f"place long, {SCORED}, rank long"))
    last = ranked.where(F.col("rank") == wanted).first()
    after = (F.col("score") < last["score"]) | (
        (F.col("score") == last["score"])
        & (_place_of_id(last["doc_id"]) | (F.col("doc_id").eqNullSafe(F.lit(last["doc_id"])) & (F.col("place") > last["place"])))
    )
    rest = held.where((F.col("n_words") < least_words) | after).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("place")


def _place_of_id(last: int | None) -> Column:
    """True for ids that come after ``last``: larger ones and null; after null comes nothing."""
    return F.lit(False) if last is None else F.coalesce(F.col("doc_id") > last, F.lit(True))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document of ``docs``.

    Null texts have no words; they are never drawn. Other columns are not looked at. Texts are read twice, once for
    the histogram of the corpus and once for the weights; only five numbers a document are shuffled, and of those only
    rows near enough to the top to be drawn.
    """
    return draw(score(docs, gains(histogram(docs, text_col), histogram(target, target_col)), id_col, text_col))
