"""Ranked lexical search over shards of dual-sorted wavelet trees.

A shard holds some thousand documents, numbered by ascending id. The posting lists of all its terms stand one behind
the other, each by falling impact: that is one order. A wavelet tree over the document numbers of this sequence gives
the other: every step down halves the documents, keeps the order by impact among those left, and ends at one document.
A list is a range of positions at the root; at any node, what a list holds of the node's documents is a range again,
whose first posting has the list's highest impact there. The sum of these first impacts, weighted, bounds the score of
all documents below, and at a leaf it is the score. The search follows the nodes with the highest bounds first, some
at a time, and ends when no bound beats the last of the k best.
"""

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .common import cut
from .importance import WORD_BYTES

K = 10
#: A shard is closed when it holds so many documents or words.
SHARD_DOCS = 1 << 13
SHARD_WORDS = 1 << 21
#: Terms of queries that are sent to the workers at once.
BLOCK_TERMS = 1 << 18
#: Nodes expanded in one step.
STEP = 32
#: Of so many shards one is searched first, for scores that the others have to beat.
FIRST = 16
#: Stands for the id null, which comes after all others.
LAST = (1 << 63) - 1

INDEX = "doc_ids array<long>, terms array<string>, ends array<int>, impacts array<int>, bits binary, n_worded long"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one after the other, and how many each text has; null has none."""
    plain = pa.array([(t or b"").translate(WORD_BYTES) for t in texts.cast(pa.binary()).to_pylist()], pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(plain)
    owner = pc.list_parent_indices(lists).to_numpy()
    flat = pc.list_flatten(lists)
    real = pc.not_equal(flat, "")
    return flat.filter(real), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


@F.arrow_udf(LongType())
def n_terms(texts: pa.Array) -> pa.Array:
    """The number of terms of a text, repeats included."""
    return pa.array([len((t or b"").translate(WORD_BYTES).split()) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


@F.arrow_udf(ArrayType(StringType()))
def terms_of(texts: pa.Array) -> pa.Array:
    return pa.array([(t or b"").translate(WORD_BYTES).decode().split(" ") for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.string()))


def _shard(ids: np.ndarray, lengths: np.ndarray, words: pa.Array, n_docs: int, n_words: int) -> list:
    """A row of the index from the documents of one shard and their words."""
    order = np.argsort(ids, kind="stable")
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(number, lengths), return_counts=True)
    term, doc = np.divmod(key, max(len(ids), 1))
    long = 25 + 75 * lengths[order].astype(np.int64) * n_docs // max(n_words, 1)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * long[doc])
    by_impact = np.lexsort((doc, -impact, term))
    doc, impact = doc[by_impact], impact[by_impact]
    levels = _levels(len(ids))
    bits = []
    for level in range(levels):
        bits.append(np.packbits((doc >> (levels - 1 - level)) & 1))
        doc = doc[_by_prefix(doc >> (levels - 1 - level), level + 1)]
    ends = np.bincount(term, minlength=len(vocabulary)).cumsum()
    return [ids[order], vocabulary.cast(pa.string()), ends.astype(np.int32), impact.astype(np.int32), b"".join(b.tobytes() for b in bits), int((lengths > 0).sum())]


def _levels(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def _by_prefix(prefix: np.ndarray, bits: int) -> np.ndarray:
    """The stable order by the leading bits of document numbers."""
    return np.argsort(prefix.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a shard, written to the shared folder: ids, terms, list ends, impacts and the bits of the wavelet tree.

    Every document is in one shard, that of the task that reads it; no posting is shuffled. The lengths of documents
    are counted first, as impacts depend on their mean. ``n_worded`` are the documents with a term. Null texts have no
    terms. Ids are cast to long; rows that repeat an id are documents of their own; the id null comes after all others.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = rows.select(n_terms("text").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()

    def run(batches: Iterator[pa.RecordBatch]):
        held, size, n = [], 0, 0
        for batch in batches:
            at = 0
            while at < len(batch):
                step = batch.slice(at, 512)
                at += 512
                words, lengths = _words(step.column(1))
                held.append((step.column(0).to_numpy(), lengths, words))
                size, n = size + len(words), n + len(step)
                if size >= SHARD_WORDS or n >= SHARD_DOCS:
                    yield _row(held)
                    held, size, n = [], 0, 0
        if held:
            yield _row(held)

    def _row(held) -> pa.RecordBatch:
        ids, lengths, words = zip(*held)
        row = _shard(np.concatenate(ids), np.concatenate(lengths), pa.chunked_array(words, pa.large_string()).combine_chunks(), counted["docs"], counted["words"])
        types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([_single(v, t) for v, t in zip(row, types)], ["doc_ids", "terms", "ends", "impacts", "bits", "n_worded"])

    return cut(rows.mapInArrow(run, INDEX))


def _single(value, kind: pa.DataType) -> pa.Array:
    """An array that holds one value."""
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    values = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Tree:
    """A shard in memory: for every level the number of zeros before each position, and the impacts in its order."""

    def __init__(self, doc_ids: np.ndarray, terms: pa.Array, ends: np.ndarray, impacts: np.ndarray, bits: bytes):
        n, self.levels = len(impacts), _levels(len(doc_ids))
        self.doc_ids, self.terms, self.width = doc_ids, terms, n + 1
        self.starts, self.ends = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)
        packed = np.frombuffer(bits, np.uint8).reshape(self.levels, -1) if n else np.zeros((self.levels, 0), np.uint8)
        self.zeros = np.zeros((self.levels, n + 1), np.int32)
        self.impacts = np.zeros((self.levels + 1, n + 1), np.int32)
        self.impacts[0, :n] = impacts
        prefix = np.zeros(n, np.int64)
        for level in range(self.levels):
            bit = np.unpackbits(packed[level], count=n)
            np.cumsum(bit == 0, out=self.zeros[level, 1:])
            prefix = prefix * 2 + bit
            order = _by_prefix(prefix, level + 1)
            prefix = prefix[order]
            self.impacts[level + 1, :n] = self.impacts[level, :n][order]
        #: The postings of documents before a number: where a node starts on every level.
        self.before = np.concatenate([[0], np.bincount(prefix, minlength=1 << self.levels).cumsum()])
        self.zeros, self.impacts = self.zeros.ravel(), self.impacts.ravel()

    def first_ids(self, level: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The smallest id below each node; a node without documents has none worth a look."""
        return self.doc_ids[np.minimum(prefix << (self.levels - level), len(self.doc_ids) - 1)]

    def search(self, term: np.ndarray, weight: np.ndarray, best: list[tuple[int, int]], k: int, least: int) -> None:
        """Put what this shard has among the ``k`` best (negative score, id) into ``best``, sorted; ``least`` is a score known to be reached."""
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = self.starts[term][None], self.ends[term][None]
        bound = (self.impacts[lo] * weight).sum(1)
        while len(bound):
            score, doc = (-best[-1][0], best[-1][1]) if len(best) == k else (0, LAST)
            if least > score:
                score, doc = least, LAST
            keep = (bound > score) | ((bound == score) & (score > 0) & (self.first_ids(level, prefix) <= doc))
            level, prefix, lo, hi, bound = (x[keep] for x in (level, prefix, lo, hi, bound))
            if not len(bound):
                return
            leading = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
            left = np.ones(len(bound), bool)
            left[leading] = False
            found = self._children(level[leading], prefix[leading], lo[leading], hi[leading], weight)
            leaf = found[0] == self.levels
            hit = leaf & (found[4] > 0)
            for s, d in zip(found[4][hit].tolist(), found[1][hit].tolist()):
                entry = (-s, int(self.doc_ids[d]))
                if len(best) < k or entry < best[-1]:
                    bisect.insort(best, entry)
                    del best[k:]
            level, prefix, lo, hi, bound = (np.concatenate([x[left], y[~leaf]]) for x, y in zip((level, prefix, lo, hi, bound), found))

    def _children(self, level, prefix, lo, hi, weight):
        """Both halves of each node: their level, documents, ranges and bounds."""
        row = (level * self.width)[:, None]
        shift = self.levels - level
        start, end = self.before[prefix << shift][:, None], self.before[(prefix + 1) << shift][:, None]
        base = self.zeros[row + start]
        zeros = self.zeros[row + end] - base
        at, to = self.zeros[row + lo] - base, self.zeros[row + hi] - base
        low = np.concatenate([start + at, lo + zeros - at])
        high = np.concatenate([start + to, hi + zeros - to])
        below = np.concatenate([level, level]) + 1
        impact = self.impacts[(below * self.width)[:, None] + low]
        bound = (np.where(low < high, impact, 0) * weight).sum(1)
        return below, np.concatenate([prefix * 2, prefix * 2 + 1]), low, high, bound


def _search(sent, k: int):
    """Shards to the ``k`` best documents of each query of a block over all shards of the task."""

    def run(batches: Iterator[pa.RecordBatch]):
        queries = sent.value
        asked = pa.array(sorted({t for q in queries for t in q["terms"]}), pa.string())
        place = {t: i for i, t in enumerate(asked.to_pylist())}
        wanted = [(np.array([place[t] for t in q["terms"]]), np.array(q["weights"], np.int64), q["least"]) for q in queries]
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            for i in range(len(batch)):
                doc_ids, terms, ends, impacts = (batch.column(c)[i].values for c in range(4))
                if not len(terms):
                    continue
                tree = Tree(doc_ids.to_numpy(), terms, ends.to_numpy(), impacts.to_numpy(), batch.column(4)[i].as_py())
                held = pc.index_in(asked, terms).fill_null(-1).to_numpy()
                for (term, weight, least), found in zip(wanted, best):
                    here = held[term]
                    if (here >= 0).any():
                        tree.search(here[here >= 0], weight[here >= 0], found, k, least)
        out = [(q["key"], d, -s) for q, found in zip(queries, best) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 3, ["key", "doc_id", "score"])

    return run


def search(shards: DataFrame, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: of every query the ``k`` documents with the highest scores above zero, exactly.

    Equal scores go to smaller ids. Queries without terms, or without a document that holds one, have no rows; rows
    that repeat a query's id and text count once. Queries are sent to the shards in blocks of at most about
    ``BLOCK_TERMS`` terms, so their number is not bounded. A task returns ``k`` rows for each query of a block. One
    shard of sixteen, by a hash, is searched before all of them, for scores that are certain to be reached; that
    decides how much of a tree is looked at, not what is found.
    """
    spark = shards.sparkSession
    items = cut(queries.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct().withColumn("key", F.monotonically_increasing_id()))
    asked = items.select("key", F.explode(terms_of("text")).alias("term")).where("term <> ''").groupBy("key", "term").agg(F.count("*").alias("n"))
    n_docs = shards.agg(F.sum("n_worded").alias("n")).first()["n"] or 0
    length = lambda i: F.col("ends")[i] - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
    listed = shards.select(F.explode(F.transform("terms", lambda t, i: F.struct(t.alias("term"), length(i).alias("n")))).alias("list")).select("list.*")
    counts = listed.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(counts, "term").select("key", F.struct("term", (weight * F.col("n")).alias("weight")).alias("t")).where("t.weight > 0")
    n_blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    weighed = cut(weighed.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("t")).select("key", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.pmod(F.hash("key"), F.lit(n_blocks)).alias("block")))
    found = []
    for block in range(n_blocks):
        rows = [r.asDict() | {"least": 0} for r in weighed.where(F.col("block") == block).collect()]
        if rows:
            some = shards.where(F.pmod(F.xxhash64(F.get("doc_ids", F.lit(0)), F.size("terms")), F.lit(FIRST)) == 0)
            reached = {r["key"]: r["least"] for r in _best(_run(some, rows, k), k).where(F.col("rank") == k).select("key", F.col("score").alias("least")).collect()}
            found.append(_run(shards, [r | {"least": reached.get(r["key"], 0)} for r in rows], k))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    every = functools.reduce(DataFrame.unionByName, found)
    doc_id = F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id")
    return _best(every, k).join(items.select("key", "item_id"), "key").select("item_id", "rank", doc_id, "score")


def _run(shards: DataFrame, rows: list[dict], k: int) -> DataFrame:
    sent = shards.sparkSession.sparkContext.broadcast(rows)
    return shards.select("doc_ids", "terms", "ends", "impacts", "bits").mapInArrow(_search(sent, k), "key long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
