"""Benchmark decontamination by a prefix-filtered set join.

The items are cut into windows of words, and a window into shingles of three words. A window stands in a document
only if each of its shingles does, so one of them must match: the rarest, by its count over all documents. These
are the prefix tokens. Where a document holds one, the words around it are joined with the windows that have it;
length and position bounds drop windows that would pass the document's ends, and the others are compared word by word.
The documents are read twice, whatever the number of items, and only the words around prefix tokens are shuffled. A
bitmap of bounded size keeps most other tokens out of the shuffle; where it fills up, more rows are joined, and none
is lost.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import cut, raw, sha_hex
from .substring import chunks, hashed_words, run_hashes

#: ASCII letters and digits and all that isn't ASCII make words; the rest turns into spaces.
KEEP = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Bits of the bitmap to a token, and at most.
BITS_A_TOKEN, LEAST_BITS, MOST_BITS = 16, 16, 27
SALTS = 8


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    return run_hashes(words, size) ^ np.uint64(size)


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The different windows of the items: their text, size in words, and the sorted ids of the items that have it."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(ITEM_WORD), F.lit(0))
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where("item IS NOT NULL AND size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cuts = rows.select("item", F.explode(F.transform(starts, lambda p: F.slice("w", p, window))).alias("w"))
    return cuts.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("size")).agg(F.sort_array(F.collect_set("item")).alias("items"))


@F.arrow_udf(ArrayType(LongType()))
def _window_shingles(windows: pa.Array) -> pa.Array:
    """The hashes of a window's shingles, in order; of all its words if there are fewer."""
    out = []
    for text in raw(windows):
        words, _ = hashed_words([text])
        out.append(shingle_hashes(words, min(SHINGLE, len(words))).view(np.int64).tolist())
    return pa.array(out, pa.list_(pa.int64()))


def bitmap(tokens: DataFrame) -> tuple[int, np.ndarray]:
    """``tokens(hash)`` as a bitmap over the leading bits of the hash. Its size is bounded, whatever the tokens."""
    n = tokens.count()
    bits = min(max((BITS_A_TOKEN * n).bit_length(), LEAST_BITS), MOST_BITS)
    cell = F.shiftrightunsigned("hash", 64 - bits)
    words = tokens.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - bits}) & 63 AS INT))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["at"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return bits, out


def _held(hashes: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    cells = hashes >> np.uint64(64 - bits)
    return (words[(cells >> np.uint64(6)).astype(np.int64)] >> (cells & np.uint64(63))) & np.uint64(1) == 1


def _places(texts: list[bytes], sizes: list[int], known: tuple[int, np.ndarray]):
    """For each shingle size: the texts and places of shingles that the bitmap holds, and their hashes; then the words of each text."""
    words, owner = hashed_words(texts)
    first = np.searchsorted(owner, np.arange(len(texts)))
    found = []
    for size in sizes:
        hashes = shingle_hashes(words, size)
        inside = owner[: len(hashes)] == owner[size - 1 : size - 1 + len(hashes)]
        at = np.flatnonzero(inside & _held(hashes, *known))
        found.append((owner[at], at - first[owner[at]], hashes[at]))
    return found, np.bincount(owner, minlength=len(texts))


def _counter(sent):
    def count(batches):
        sizes, known = sent.value
        for batch in batches:
            for _, texts in chunks([(t or b"").translate(KEEP) for t in raw(batch.column(0))]):
                found, _ = _places(texts, sizes, known)
                hashes, n = np.unique(np.concatenate([np.empty(0, np.uint64), *[h for _, _, h in found]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return count


PLACE = "array<struct<hash: bigint, at: int, lead: int, near: array<string>>>"
PLACE_ARROW = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("near", pa.list_(pa.string()))]))


def _searcher(sent, window: int):
    """Rows of key, tag, text to key, tag, n_words and the prefix tokens that stand in the text, with the words around."""

    def search(batches):
        sizes, known = sent.value
        for batch in batches:
            every = raw(batch.column(2))
            for begin, texts in chunks([(t or b"").translate(KEEP) for t in every]):
                found, n_words = _places(texts, sizes, known)
                places: list[list] = [[] for _ in texts]
                for owners, at, hashes in found:
                    for text, p, h in zip(owners.tolist(), at.tolist(), hashes.view(np.int64).tolist()):
                        places[text].append((p, h))
                out = []
                for text, held in zip(texts, places):
                    words = text.decode().split(" ") if held else []
                    words = [w for w in words if w]
                    out.append([{"hash": h, "at": p, "lead": min(p, window - 1), "near": words[max(0, p - window + 1) : p + window]} for p, h in held])
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), batch.column(1).slice(begin, n), pa.array(n_words.astype(np.int64)), pa.array(out, PLACE_ARROW)], names=["key", "tag", "n_words", "places"])

    return search


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document: id, n_words, n_hit (words inside item windows), ranges of those (start, end), items found.

    Null and empty texts have no words and no finds; items without words or with a null id have no windows; items
    with the same id count once. Repeated rows stay, null ids too. An empty table of items gives no finds, one of
    documents no rows. Columns other than those named are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    windows = cut(windows_of(items, item_id, item_text, window).withColumn("shingles", _window_shingles(F.col("window"))))
    shingles = windows.select("window", F.posexplode("shingles").alias("offset", "hash"))
    sizes = [r["k"] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()]
    known = bitmap(shingles.select("hash").distinct())
    counts = rows.select("text").mapInArrow(_counter(spark.sparkContext.broadcast((sizes, known))), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rarest = shingles.join(counts.hint("merge"), "hash", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("hash"), F.col("offset"))).alias("token"))
    prefixes = cut(windows.join(rarest.hint("merge"), "window").select("token.hash", "token.offset", "window", "size", "items"))
    known = bitmap(prefixes.select("hash").distinct())
    searched = cut(rows.mapInArrow(_searcher(spark.sparkContext.broadcast((sizes, known)), window), f"key {dict(rows.dtypes)['key']}, tag long, n_words long, places {PLACE}"))
    # A token that a third of all documents hold is dealt over several tasks.
    salt = F.pmod(F.col("tag"), F.lit(SALTS)).cast("int")
    asked = searched.select("key", "tag", salt.alias("salt"), F.inline("places"))
    salted = prefixes.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    start = F.col("lead") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.size("near"))
    same = F.array_join(F.slice("near", F.greatest(start, F.lit(0)) + 1, F.col("size")), " ") == F.col("window")
    begin = F.col("at") - F.col("offset")
    # Spark sizes the salted prefixes as if each were one row, so it could broadcast them; the salt is for a shuffle.
    hits = asked.join(salted.hint("merge"), ["hash", "salt"]).where(fits & same).select("key", "tag", F.struct(begin.alias("start"), (begin + F.col("size")).alias("end")).alias("range"), "items")
    found = hits.groupBy(F.col("key").alias("of"), F.col("tag").alias("t")).agg(F.sort_array(F.collect_set("range")).alias("ranges"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = searched.select("key", "tag", "n_words").join(found.hint("merge"), F.col("key").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("t")), "left")
    ranges = F.coalesce("ranges", F.array().cast("array<struct<start: int, end: int>>"))
    return joined.select(F.col("key").alias(id_col), "tag", "n_words", covered(ranges).alias("n_hit"), ranges.alias("ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(ranges: Column) -> Column:
    """How many places sorted ranges cover."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, r):
        return F.struct(F.greatest(acc["end"], r["end"]).alias("end"), (acc["n"] + F.greatest(r["end"] - F.greatest(acc["end"], r["start"]), F.lit(0))).alias("n"))

    return F.aggregate(ranges, none, step, lambda acc: acc["n"])


def items_digest(items: Column) -> Column:
    return sha_hex(F.array_join(items, ","))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no item window occurs, their columns as they were.

    Nulls, repeats and empty tables are treated as in ``contamination``; rows with a null or repeated id are told
    apart by their texts.
    """
    found = contamination(docs, items, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("__id"), F.col("tag").alias("__tag")).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__tag")), "left_anti")
