"""Exact substring deduplication with a count-min prefilter.

Every window of 20 words has an anchor, the least hash among its runs of eight words, at the leftmost place. Equal
windows have equal anchors, and a run of text has an anchor about every seven words. A first pass counts anchors in
count-min sketches, one a partition, which are merged; the counts are at least the true ones, and as no count over
one matters, a bit a cell is kept of the result. One row of the sketch counts different texts, so that whole copies
of a document, which are found by a hash of the text, don't fill it. A second pass looks at windows whose anchor is
estimated to occur again: only these are grouped exactly, by a 95-bit hash of their words, so no repeated window is
lost. Where one batch holds a window more than once, one row carries all of them. If the sketch is too small for the
corpus, more windows are grouped, never fewer.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, join_hot, raw

WINDOW, RUN = 20, 8
#: Sketches have at most 2**30 cells a row; merged they have four cells or more to an anchor, if these suffice.
MOST_BITS, LEAST_BITS, SLICE_BITS, SKETCH_ROWS = 30, 16, 18, 2
CHUNK_BYTES = 2_000_000
LOWEST = -(1 << 63)
#: Bytes of text to an anchor, somewhat less than usual.
BYTES_AN_ANCHOR = 32

_NONSPACE = np.ones(256, bool)
_NONSPACE[[9, 10, 11, 12, 13, 32]] = False
_FACTOR, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]).cumprod(dtype=np.uint64)[:n]


def chunks(texts: list):
    """Runs of texts of about ``CHUNK_BYTES``: their first place and the texts."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, in order, and which text it is of."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    solid = _NONSPACE[data]
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = np.searchsorted(np.cumsum([0, *[len(t) + 1 for t in texts]]), starts, "right") - 1
    heads = starts if starts[0] == 0 else np.append(0, starts)
    places = np.arange(len(data)) - np.repeat(heads, np.diff(np.append(heads, len(data))))
    values = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, int(places.max()) + 1)[places], np.uint64(0))
    return _mix(np.add.reduceat(values, starts)), owner


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring words, of whichever texts."""
    n = max(len(words) - size + 1, 0)
    runs = np.zeros(n, np.uint64)
    for j, power in enumerate(_powers(_STEP, size)):
        runs += words[j : j + n] * power
    return _mix(runs)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its text's place, its first word's place in the text, its anchor, and the anchor's place among all words."""
    words, owner = hashed_words(texts)
    if len(words) < WINDOW:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty
    least = run_hashes(words, RUN)
    where = np.arange(len(least))
    span, wanted = 1, WINDOW - RUN + 1
    while span < wanted:
        step = min(span, wanted - span)
        a, b = least[:-step], least[step:]
        right = b < a
        least, where = np.where(right, b, a), np.where(right, where[step:], where[:-step])
        span += step
    valid = np.flatnonzero(owner[: len(least)] == owner[WINDOW - 1 : WINDOW - 1 + len(least)])
    first_word = np.searchsorted(owner, np.arange(len(texts)))
    return owner[valid], valid - first_word[owner[valid]], least[valid], where[valid]


def _cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mix(values, 0x51ED270B + row * 0x2545F491) >> np.uint64(64 - bits)).astype(np.int64)


def _short(tags: np.ndarray) -> bytes:
    """48 bits of each tag: texts that share them and a cell are taken for copies, a chance of 2 ** -48 a pair."""
    return tags.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(tags: bytes) -> np.ndarray:
    out = np.zeros((len(tags) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(tags, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


SKETCH = "row int, slice int, cells binary, tags binary, again binary"


def _sketch(batches):
    """The cells of a partition's anchors at full width, by slice: row 0 with the text that holds them, and whether
    another text, or the same one at another place, holds them too; row 1 whether they occur again at all."""
    cells, tags, again = [[], []], [], []
    for batch in batches:
        known = batch.column(0).to_numpy(zero_copy_only=False)
        for first, texts in chunks([t or b"" for t in raw(batch.column(1))]):
            owner, _, values, places = anchors(texts)
            if len(values):
                new = np.concatenate([[True], places[1:] != places[:-1]])
                owner, values = owner[new], values[new]
                order = np.lexsort((values, owner))
                owner, values = owner[order], values[order]
                same = np.concatenate([[False], (owner[1:] == owner[:-1]) & (values[1:] == values[:-1])])
                tags.append(known[first + owner])
                again.append(same)
                for row in range(SKETCH_ROWS):
                    cells[row].append(_cells(values, row, MOST_BITS).astype(np.uint32))
    if not tags:
        return
    every, marks = np.concatenate(tags), np.concatenate(again)
    for row in range(SKETCH_ROWS):
        all_cells = np.concatenate(cells[row])
        order = np.lexsort((every, all_cells))
        c, t, m = all_cells[order], every[order], marks[order]
        head = np.concatenate([[True], c[1:] != c[:-1]])
        if row == 0:
            m = m | np.concatenate([[False], ~head[1:] & (t[1:] != t[:-1])])
        else:
            m = ~head
        at = np.flatnonzero(head)
        c, t, m = c[at], t[at], np.logical_or.reduceat(m, at)
        slices = c >> np.uint32(SLICE_BITS)
        cuts = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1], [True]]))
        out = [(row, int(slices[a]), c[a:b].tobytes(), _short(t[a:b]) if row == 0 else b"", np.packbits(m[a:b]).tobytes()) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["row", "slice", "cells", "tags", "again"])


def _merger(bits: int):
    """Merge the partitions' cells slice by slice, at ``bits`` bits a cell, into a bit for each cell seen again."""
    drop = MOST_BITS - bits
    size = (1 << SLICE_BITS) >> drop

    def merge(batches):
        seen: dict[tuple[int, int], np.ndarray] = {}
        held: dict[int, np.ndarray] = {}
        twice: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, part, cells, tags, again in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                at = ((np.frombuffer(cells, np.uint32) & np.uint32((1 << SLICE_BITS) - 1)) >> np.uint32(drop)).astype(np.int64)
                again = np.unpackbits(np.frombuffer(again, np.uint8), count=len(at)).astype(bool)
                once, more = seen.setdefault((row, part), np.zeros(size, bool)), twice.setdefault((row, part), np.zeros(size, bool))
                beside = np.concatenate([[False], at[1:] == at[:-1]])
                before = once[at]
                if row == 0:
                    tags, mine = _long(tags), held.setdefault(part, np.zeros(size, np.int64))
                    beside &= np.concatenate([[False], tags[1:] != tags[:-1]])
                    before &= mine[at] != tags
                    mine[at] = tags
                more[at[again | beside | before]] = True
                once[at] = True
        if twice:
            out = [(row, part, np.packbits(found).tobytes()) for (row, part), found in twice.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["row", "slice", "twice"])

    return merge


def repeated_cells(rows: DataFrame) -> tuple[int, list[np.ndarray]]:
    """The merged sketch of the anchors of ``rows(tag, text)``: the bits of a cell, and a bit for each cell of each row, set where the count may exceed one."""
    octets = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max((4 * octets // BYTES_AN_ANCHOR).bit_length(), LEAST_BITS), MOST_BITS)
    merged = rows.select("tag", "text").mapInArrow(_sketch, SKETCH).repartition("row", "slice").mapInArrow(_merger(bits), "row int, slice int, twice binary").collect()
    maps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(SKETCH_ROWS)]
    for r in merged:
        base = ((r["slice"] << SLICE_BITS) >> (MOST_BITS - bits)) // 8
        found = np.frombuffer(r["twice"], np.uint8)
        maps[r["row"]][base : base + len(found)] = found
    return bits, maps


WINDOWS = "h1 long, h2 int, key long, tag int, start int, others array<struct<key: long, tag: int, start: int>>"
#: The bits of a text's hash that tell rows with the same id apart.
ROW_TAG = 0x7FFFFFFF
#: The bits of the 128-bit hash that are kept.
SHORT = np.array([-1, 0x7FFFFFFF])
_OTHER = pa.struct([("key", pa.int64()), ("tag", pa.int32()), ("start", pa.int32())])


def _windows(sent):
    """The windows that may repeat, by the hash of their words: one row for each of a batch, the others of the batch within."""

    def rows(batches):
        bits, maps = sent.value
        for batch in batches:
            keys, tags = batch.column(0).to_numpy(zero_copy_only=False), (batch.column(1).to_numpy(zero_copy_only=False) & ROW_TAG).astype(np.int32)
            texts = [t or b"" for t in raw(batch.column(2))]
            for first, part in chunks(texts):
                owner, start, values, _ = anchors(part)
                keep = np.ones(len(values), bool)
                for row, bitmap in enumerate(maps):
                    cells = _cells(values, row, bits)
                    keep &= (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                owner, start = owner[keep], start[keep]
                if not len(owner):
                    continue
                hashes = np.empty((len(owner), 2), np.int64)
                at, digest = 0, xxhash.xxh3_128_digest
                for doc, n in zip(*np.unique(owner, return_counts=True)):
                    words = part[doc].split()
                    line = b" ".join(words)
                    sizes = np.fromiter(map(len, words), np.int64, count=len(words))
                    ends = np.cumsum(sizes + 1) - 1
                    s = start[at : at + n]
                    joined = b"".join([digest(line[a:b]) for a, b in zip((ends - sizes)[s].tolist(), ends[s + WINDOW - 1].tolist())])
                    hashes[at : at + n] = np.frombuffer(joined, np.int64).reshape(-1, 2) & SHORT
                    at += n
                yield from _grouped(hashes, keys[first + owner], tags[first + owner], start)

    return rows


def _grouped(hashes, keys, tags, start):
    order = np.lexsort((start, tags, keys, hashes[:, 1], hashes[:, 0]))
    h, keys, tags, start = hashes[order], keys[order], tags[order], start[order].astype(np.int32)
    head = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])
    # Rows equal to the first one in key, tag and start are the same place of a repeated row.
    at = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    other = ~head & ~((keys == keys[at][group]) & (tags == tags[at][group]) & (start == start[at][group]))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group[other], minlength=len(at)))]).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(keys[other]), pa.array(tags[other]), pa.array(start[other])], fields=list(_OTHER)))
    yield pa.RecordBatch.from_arrays([pa.array(h[at, 0]), pa.array(h[at, 1].astype(np.int32)), pa.array(keys[at]), pa.array(tags[at]), pa.array(start[at]), others], names=["h1", "h2", "key", "tag", "start", "others"])


def repeats(rows: DataFrame) -> DataFrame:
    """``rows(key, tag, text)`` to the windows that start earlier elsewhere: key, tag, start. Whole copies of a text may lack theirs."""
    sent = rows.sparkSession.sparkContext.broadcast(repeated_cells(rows))
    windows = rows.mapInArrow(_windows(sent), WINDOWS)
    ranked = windows.withColumn("rank", F.rank().over(W.partitionBy("h1", "h2").orderBy("key", "tag", "start")))
    own = F.when(F.col("rank") > 1, F.array(F.struct("key", "tag", "start"))).otherwise(F.array().cast("array<struct<key: long, tag: int, start: int>>"))
    return ranked.select(F.explode(F.concat(own, "others")).alias("w")).select("w.key", "w.tag", "w.start")


def _row_tag():
    return F.col("tag").bitwiseAND(F.lit(ROW_TAG)).cast("int").alias("tag")


def copies(rows: DataFrame) -> DataFrame:
    """The key and tag of rows whose whole text also stands under a smaller key."""
    narrow = rows.select("key", "tag", F.octet_length("text").alias("size"))
    first = narrow.groupBy("tag", "size").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    first = cut(first.where("first < last").drop("last"))
    return join_hot(narrow, first, ["tag", "size"]).where("key > first").select("key", _row_tag())


KEPT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept(batches):
    """Rows sorted by key and tag: texts (start -2), a mark that they are copies (-1), starts of repeated windows."""
    texts, starts, copied, at, out = [], [], False, None, []

    def done():
        for text in texts:
            words = text.split()
            if copied and len(words) >= WINDOW:
                kept = []
            elif starts:
                edge = np.zeros(len(words) + 1, np.int64)
                first = np.concatenate(starts)
                np.add.at(edge, first, 1)
                np.subtract.at(edge, first + WINDOW, 1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = [w for w, c in zip(words, covered.tolist()) if not c]
            else:
                kept = words
            out.append((None if at[0] == LOWEST else at[0], len(words), len(words) - len(kept), b" ".join(kept).decode()))

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), KEPT)], schema=KEPT)

    for batch in batches:
        keys, tags, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        body = batch.column(3)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1]), [True]]))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            now = (int(keys[a]), int(tags[a]))
            if now != at:
                if at is not None:
                    done()
                    if len(out) >= 500:
                        yield batch_of()
                        out = []
                texts, starts, copied, at = [], [], False, now
            n, marks = int((start[a:b] == -2).sum()), int((start[a:b] == -1).sum())
            copied = copied or marks > 0
            texts += raw(body.slice(a, n))
            if b - a > n + marks:
                starts.append(start[a + n + marks : b].astype(np.int64))
    if at is not None:
        done()
        yield batch_of()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_removed, and ``kept``, the kept words joined by one space.

    A word goes if a window of 20 words covers it whose words also start earlier: in a document with a smaller id, or
    earlier in the same one. Windows are judged on the input. Null texts have no words; null ids come before all
    others; rows with one id and different texts are ordered by a hash of the text; repeated rows are one place, so
    they keep the same words. Texts are shuffled once, together with the starts of repeated windows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"), F.xxhash64(text).alias("tag"), text.alias("text"))
    starts = repeats(rows).unionByName(copies(rows).withColumn("start", F.lit(-1))).withColumn("text", F.lit(None).cast("string"))
    both = rows.select("key", _row_tag(), F.lit(-2).alias("start"), "text").unionByName(starts)
    dealt = both.repartition("key").sortWithinPartitions("key", "tag", "start")
    return dealt.mapInArrow(_kept, "key long, n_words long, n_removed long, kept string").withColumnRenamed("key", id_col)
