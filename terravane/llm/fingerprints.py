"""Document fingerprints by SimHash, and a search for all fingerprints within a Hamming radius.

The terms are pairs of neighbouring words, weighted by their length; the hash of each votes with its weight on 64
signed bits. For the search the bits are cut into two blocks more than the radius. Two fingerprints within the
radius agree on at least two blocks, so a table for every pair of blocks, keyed by their bits, holds all of them.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS = 3
BUCKETS_A_PARTITION = 4
BLOCK = 1 << 14
LOWEST = -(1 << 63)


def fingerprint(text: str) -> int:
    """64 signed votes of weighted term hashes; zero for texts without words. Equal texts have equal fingerprints."""
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    sizes = np.array([min(len(w), 24) for w in words], np.float32)
    if len(words) > 1:
        hashes = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        sizes = sizes[:-1] + sizes[1:]
    votes = np.zeros(64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += sizes[at : at + BLOCK] @ bits.astype(np.float32)
    return int(np.packbits(votes * 2 > sizes.sum(dtype=np.float64)).view(">i8")[0])


def likeness(a: int, b: int) -> float:
    return 1 - ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() / 64


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


ROW = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fp", pa.int64()), ("edited_fp", pa.int64()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(batches):
    """Rows sorted by bucket: its documents in order, then the one that follows its last."""
    last = None
    for batch in batches:
        out = []
        for bucket, after, key, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if last and last[0] != bucket:
                last = None
            if after and not last:
                continue
            fp = fingerprint(text)
            if last:
                _, before, old, old_fp = last
                new = edited(old, text)
                new_fp = fingerprint(new)
                out.append((None if before == LOWEST else before, len(old), new, old_fp, new_fp, likeness(old_fp, new_fp), likeness(old_fp, fp)))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), ROW)], schema=ROW)
                    out = []
            last = None if after else (bucket, key, text, fp)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), ROW)], schema=ROW)


def _bucket(spark: SparkSession, bounds: list[int]):
    """The number of bounds below a key, as a function of a column; the bounds are sent once, outside the plan."""
    sent = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.arrow_udf("int")
    def bucket(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sent.value, keys.to_numpy(zero_copy_only=False)).astype(np.int32))

    return bucket


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text and that text's fingerprint, and likenesses (0 to 1).

    The edited text is the text with its last quarter replaced by the first code points of the next document by
    id; after the last comes the first. Null texts are empty; null ids come first; rows with the same id are
    ordered by text. The texts are shuffled once, into ranges of ids whose bounds are quantiles; the first document
    of each range is copied to the end of the range before, so no range needs another.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_A_PARTITION
    bounds = sorted(set(rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"] or []))
    bucket = _bucket(spark, bounds)("key")
    starts = rows.select(bucket.alias("bucket"), "key").groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    if not starts:
        return spark.createDataFrame([], "id long, n_chars long, edited string, fp long, edited_fp long, near_edited double, near_next double")
    firsts = [(r["key"], starts[i - 1]["bucket"]) for i, r in enumerate(starts)]
    following = rows.join(F.broadcast(spark.createDataFrame(firsts, "key long, bucket int")), "key").select("bucket", F.lit(1).alias("after"), "key", "text")
    every = rows.select(bucket.alias("bucket"), F.lit(0).alias("after"), "key", "text").unionByName(following)
    dealt = every.repartition("bucket").sortWithinPartitions("bucket", "after", "key", "text")
    return dealt.mapInArrow(_pairs, "id long, n_chars long, edited string, fp long, edited_fp long, near_edited double, near_next double")


def _keys(fp: Column, radius: int) -> Column:
    """One key for every pair of blocks: the pair's number and the bits of both blocks."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    parts = [F.shiftrightunsigned(F.shiftleft(fp, 64 - b), 64 - b + a) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.struct(F.lit(k).alias("table"), parts[i].alias("x"), parts[j].alias("y")) for k, (i, j) in enumerate(combinations(range(n), 2))])


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``queries(fp)`` and ``prints(fp)``, distinct longs, to all pairs ``(query, fp)`` at ``radius`` bits or fewer."""
    asked = queries.select(F.col("fp").alias("query"), F.explode(_keys(F.col("fp"), radius)).alias("key"))
    held = prints.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key"))
    return held.join(asked, "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("query"))) <= radius).select("query", "fp").distinct()
