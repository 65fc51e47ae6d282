"""SimHash near-deduplication by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments of 21, 21 and 22 bits. If two fingerprints differ in at most
four bits, the pigeonhole principle leaves two cases. Either some segment is equal: an exact key a segment finds it.
Or every segment differs, and then two segments differ in exactly one bit each: one side of the join has the pair of
its nearest Golay codewords as key, the other side all pairs of codewords within distance four, and the parities of
the two segments, which must be opposite, narrow the keys further. Joined candidates are verified by bit count.
Only distinct fingerprints are linked, so exact copies cost one row, whatever their number.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import golay
from .common import cut, drop, join_hot, raw
from .components import connected_components

SEED = 42
CUTS = ((0, 21), (21, 21), (42, 22))
MOST_BITS = 4
BLOCK = 1 << 15
#: One text in so many is counted, and so many of the most frequent shingles are known, for the order of keys.
SAMPLE, COMMON = 16, 1 << 17
#: Bits of a set's parity sketch to a shingle, at least; hubs of a key in the first round, and their growth by round.
SKETCH_BITS, MORE_HUBS = 4, 8
#: Products of a similarity and a count are whole numbers if they are so near to one.
EPSILON = 1e-9
LOWEST = -(1 << 63)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of all the words if there are fewer."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; a signed 64-bit number."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


@lru_cache
def _fingerprint_udf(words: int):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([majority(shingle_hashes(t, words)) for t in raw(texts)], pa.int64())

    return fingerprint


def simhash(text: Column, words: int = 4) -> Column:
    """The fingerprint of a text as a signed 64-bit number; zero for texts without words and nulls."""
    return _fingerprint_udf(words)(text)


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    bits = prints.view(np.uint64)
    return [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in CUTS]


PAIRS = ((0, 1), (0, 2), (1, 2))


def index_keys(prints: np.ndarray) -> np.ndarray:
    """Six keys a fingerprint: a row each, a column a kind."""
    parts = _segments(prints)
    near, odd = [golay.nearest(p) for p in parts], [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    keys = [(k << 40) | p for k, p in enumerate(parts)]
    keys += [((3 + k) << 40) | (odd[a] << 25) | (odd[b] << 24) | (near[a] << 12) | near[b] for k, (a, b) in enumerate(PAIRS)]
    return np.stack(keys, axis=1)


def probe_keys(prints: np.ndarray) -> np.ndarray:
    """All keys under which a fingerprint within four bits can stand; -1 fills up."""
    parts = _segments(prints)
    near, odd = [golay.nearby(p) for p in parts], [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    keys = [((k << 40) | p)[:, None] for k, p in enumerate(parts)]
    for k, (a, b) in enumerate(PAIRS):
        x, y = near[a][:, :, None], near[b][:, None, :]
        head = (((3 + k) << 40) | ((1 - odd[a]) << 25) | ((1 - odd[b]) << 24))[:, None, None]
        keys.append(np.where((x < 0) | (y < 0), -1, head | (x << 12) | y).reshape(len(prints), -1))
    return np.concatenate(keys, axis=1)


def _keyed(prints: DataFrame, keys_of, name: str) -> DataFrame:
    def rows(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), BLOCK):
                part = every[at : at + BLOCK]
                keys = keys_of(part)
                kept = keys >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[kept]), pa.array(np.repeat(part, kept.sum(axis=1)))], names=["key", name]
                )

    return prints.mapInArrow(rows, f"key long, {name} long")


def hamming_links(prints: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """``prints(fp)`` of distinct longs to all pairs ``(a, b)``, a < b, that differ in ``bits`` (0 to 4) bits or fewer."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"the keys find up to {MOST_BITS} differing bits")
    index, probe = _keyed(prints, index_keys, "a"), _keyed(prints, probe_keys, "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    # Spark sizes the keys by the fingerprints they are made from, a hundredth of them, and would broadcast them.
    return index.join(probe.hint("merge"), "key").where(close).select("a", "b").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = MOST_BITS) -> DataFrame:
    """One row a document: its id, ``fp`` (long) and ``component_id``, the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id keep a row; the
    component's id is null only if all its ids are. Repeated rows stay. Other columns are ignored.
    """
    prints = cut(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), words).alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    links = hamming_links(classes.select("fp"), bits)
    labels = connected_components(links)
    labelled = classes.join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = cut(labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    of_print = cut(join_hot(labelled.select("fp", "label", F.col("copies").alias("n")), smallest, ["label"]).select("fp", "component_id", "n"))
    return join_hot(prints, of_print, ["fp"]).select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


# Near copies by similarity. Fingerprints and their Golay keys come first: all classes of texts whose fingerprints are
# within four bits are compared, unless they are of one group by then. Four bits hold only the closest copies, so classes
# are compared further, by keys that lose no pair, and the shingle sets decide both. All shingles have one order, those that are
# frequent in a sample last. Two sets of n shingles or more that are similar by t share at least t * n of them, so
# they share one of the first n - ceil(t * n) + 1 of each: these are the keys. The sample changes only the order, so
# how many rows a key has, and never what is found. A pair needs to be compared only under its first common shingle in
# that order. Of the shingles before it the sets share none, so its places in both bound what they can share: a copy
# whose own shingles fill the places ahead of the text it was made from meets none of the other copies. A set also has
# a sketch: the parities of how many of its shingles fall on each bit. Two sketches differ in no more bits than the
# sets do in shingles, so they bound what two sets can share from above, and no link is lost by them.
# Joins of all these tables merge: Spark sizes keys, hubs and pairs by small files or by the rows they are made from, and
# would broadcast them at some sizes of the corpus.


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes; ``common`` are the frequent ones in ascending order, with their counts."""
    n = len(hashes)
    if not n:
        return hashes
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, weight))[: n - int(np.ceil(similarity * n - EPSILON)) + 1]]


def parities(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of shingle hashes as 64-bit words, a power of two of them."""
    bits = 64
    while bits < SKETCH_BITS * len(hashes):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def most_shared(bits_a: Column, n_a: Column, bits_b: Column, n_b: Column) -> Column:
    """No fewer than the shingles that two sets share, by their sketches and sizes; the longer sketch is folded once."""

    def folded(x: Column, other: Column) -> Column:
        half = F.shiftright(F.size(x), 1)
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    a, b = folded(bits_a, bits_b), folded(bits_b, bits_a)
    differ = F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), F.floor((n_a + n_b - differ) / 2)).otherwise(F.least(n_a, n_b))


def node_of(text: bytes | None) -> int:
    """A signed 64-bit number that texts with the same words share."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split() if text else [])) - (1 << 63)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts of a sample of ``docs(id, text)`` hold, ascending, and how many hold them."""

    def shingles(batches):
        for batch in batches:
            texts = raw(batch.column(1))
            for at in range(0, len(texts), 64):
                every = np.concatenate([np.unique(shingle_hashes(t, words)) for t in texts[at : at + 64]])
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], names=["hash"])

    sampled = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = sampled.mapInArrow(shingles, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes = found["hash"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy().astype(np.int64)[order]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def _with_sets(docs: DataFrame, words: int, **chosen) -> DataFrame:
    """``id``, ``node``, ``n``, ``fp`` and what each of ``chosen`` takes of the set of shingle hashes, for ``docs(id, text)``."""

    def describe(batches):
        for batch in batches:
            texts = raw(batch.column(1))
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                every = [shingle_hashes(t, words) for t in part]
                sets = [np.unique(x) for x in every]
                nodes, sizes = pa.array([node_of(t) for t in part], pa.int64()), pa.array([len(x) for x in sets], pa.int32())
                prints = pa.array([majority(x) for x in every], pa.int64())
                lists = [_lists([take(x) for x in sets]) for take in chosen.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), nodes, sizes, prints, *lists], names=["id", "node", "n", "fp", *chosen])

    return docs.mapInArrow(describe, ", ".join(["id long, node long, n int, fp long", *[f"{name} array<long>" for name in chosen]]))


def nearest_prints(classes: DataFrame, bits: int = MOST_BITS, links: DataFrame | None = None) -> DataFrame:
    """``classes(node, fp)`` to pairs of nodes ``(a, b)``, a < b, whose fingerprints differ in ``bits`` bits or fewer.

    Each fingerprint is paired with the least one that the Golay keys find for it, by their least nodes, and each other node
    of a fingerprint with its least: no node has more than one such pair, however many near copies there are. The other
    pairs are those of ``close_links``. ``links`` are those of ``hamming_links``, if they are known.
    """
    prints = cut(classes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    near = (hamming_links(prints.select("fp"), bits) if links is None else links).groupBy("b").agg(F.min("a").alias("a"))
    of = prints.select("fp", "least")
    across = near.join(of.toDF("a", "x").hint("merge"), "a").join(of.toDF("b", "y").hint("merge"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = join_hot(classes.select("node", "fp"), prints, ["fp"]).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return across.unionByName(within)


def close_links(nodes: DataFrame, links: DataFrame, nearest: DataFrame, similarity: float, alike) -> DataFrame:
    """The links ``(a, b)`` among ``nodes(node, n, fp)`` whose fingerprints are equal or one of ``links(a, b)``; see ``_links`` for ``alike``.

    The pairs ``nearest`` come first, as they bring most near copies into one group. Then all others are compared, but those that are of one
    group by then: their components are those of comparing all pairs.
    """
    first = cut(alike(nearest))
    labels = connected_components(first).hint("merge")
    of = cut(nodes.select("node", "n", "fp").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    groups = of.groupBy("fp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    side = lambda x: groups.toDF(x, f"low_{x}", f"high_{x}").hint("merge")
    apart = F.least("low_a", "low_b") < F.greatest("high_a", "high_b")
    across = links.join(side("a"), "a").join(side("b"), "b").where(apart).select("a", "b")
    within = groups.where("low < high").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    keys = across.unionByName(within).select(F.xxhash64("a", "b").alias("key"), F.explode(F.array_distinct(F.array("a", "b"))).alias("fp"))
    rest = cut(keys.join(of.hint("merge"), "fp").select("key", "node", "n", F.lit(0).alias("pos"), "label"))
    return first.select("a", "b").unionByName(_links(rest, similarity, alike))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id``, and ``first``, the smallest id of its group, over documents that are equal or as similar as asked.

    Texts with the same words are one class. Classes whose shingle sets have a Jaccard similarity of ``similarity``
    or more are linked, and groups are the connected components. Candidates are, first, all classes whose SimHash
    fingerprints are within four bits by the Golay keys, see ``close_links``; then, as similar texts may differ in more
    bits, the classes that share a key, see ``_links``; both unless links have brought them into one group. They are compared
    first by their sketches, which can only link too much; then, among the classes linked so, by their whole sets,
    which are made again from the texts. Null texts count as empty; texts
    without words are a group. Ids are longs; a null id stands before all others.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.col(text_col).alias("text"))
    common, counts = common_shingles(texts, words)
    rows = cut(_with_sets(texts, words, keys=lambda hashes: prefix(hashes, similarity, common, counts), bits=parities))
    members = cut(rows.select("id", "node"))
    classes = cut(rows.groupBy("node").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bits").alias("bits"), F.max("keys").alias("keys"), F.count("*").alias("copies")))
    drop(rows)
    links = cut(hamming_links(classes.select("fp").distinct()))
    nearest = cut(nearest_prints(classes, links=links))
    exploded = classes.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    of_key = W.partitionBy("key")
    crowded = exploded.select("*", F.count("*").over(of_key).alias("nodes"), F.min("n").over(of_key).alias("least_n")).where("nodes > 1")
    # A node that is too late in the key for the smallest set of the key is so for all of them.
    shared = cut(crowded.where(_enough(F.col("n"), F.col("pos"), F.col("least_n"), similarity)).select("key", "node", "n", "pos"))
    sketches = cut(classes.select("node", "first", "n", "fp", "bits", "copies"))
    drop(classes)
    known = cut(sketches.join(shared.select("node").distinct().hint("merge"), "node"))
    # Two sets that are similar share a key, so a pair without a row in ``known`` is none.
    near_able = cut(_able(nearest, known, similarity))
    # Of two sets that are similar, each is linked by the sketches, be it to a third; so all pairs of close prints that can be links are among those asked.
    able = near_able.unionByName(_links(shared, similarity, lambda pairs: _able(pairs, known, similarity)))
    touched = able.select(F.col("a").alias("node")).unionByName(able.select(F.col("b").alias("node"))).distinct()
    asked = cut(touched.join(known.hint("merge"), "node"))
    # An id may have several texts: those of other classes are dropped again.
    read = texts.join(asked.select(F.col("first").alias("id"), F.col("node").alias("asked")).hint("merge"), "id").select(F.col("asked").alias("id"), "text")
    sets = cut(_with_sets(read, words, hashes=lambda hashes: hashes).where("id = node").select("node", "n", "hashes").dropDuplicates(["node"]))
    within = cut(shared.join(asked.select("node").hint("merge"), "node"))
    drop(shared)
    as_held = lambda pairs: _alike(_able(pairs, asked, similarity), sets, similarity)
    labels = _groups(within, similarity, as_held, close_links(asked, links, near_able, similarity, as_held))
    grouped = sketches.select("node", "first", "copies").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = cut(grouped.groupBy("label").agg(F.min("first").alias("group_first"), F.count("*").alias("n")))
    of_node = cut(join_hot(grouped.select("node", "label", F.col("copies").alias("n")), first, ["label"]).select("node", "group_first", "n"))
    return join_hot(members, of_node, ["node"]).select("id", F.col("group_first").alias("first"))


def _enough(n: Column, pos: Column, other_n: Column, similarity: float) -> Column:
    """Whether a set of ``n`` shingles has enough from place ``pos`` on to be similar to one of ``other_n``."""
    return (n - pos) * (1 + similarity) >= similarity * (n + other_n) - EPSILON


def _links(shared: DataFrame, similarity: float, alike) -> DataFrame:
    """``shared(key, node, n, pos)`` to links ``(a, b)``; ``alike`` keeps those pairs ``(a, b)``, with all columns, that are links.

    A column ``label`` may tell which nodes are of one group already.

    Their components are those of comparing every two nodes of each key whose sizes, and places ``pos`` of the key in
    them, allow the similarity if the key is the first shingle that they share. In a round some nodes of a key, its hubs,
    are compared with all its nodes of other groups and leave the key: one in the first round, up to ``MORE_HUBS``
    times as many in each further one. A key is done when its nodes are of one group, and the loop ends when all keys
    are: two nodes of a key are then of one group, or were compared. Groups are followed by labels, each node's least
    known one, so some that are one already may still count as two and be compared once more. Hubs are the least
    nodes, which are hashes, so keys of the same nodes have the same hubs and their pairs fall together; they are
    found by aggregation, so a key with many nodes needs no task of its own.
    """
    left, hubs, found = shared if "label" in shared.columns else shared.withColumn("label", F.col("node")), 1, []
    while True:
        hub, low, high = F.min(F.struct("node", "n", "pos", "label")), F.min("label").alias("low"), F.max("label").alias("high")
        if hubs == 1:
            keys = left.groupBy("key").agg(F.array(hub).alias("hubs"), low, high)
        else:
            slots = left.groupBy("key", F.pmod("node", F.lit(hubs)).alias("slot")).agg(hub.alias("hub"), low, high)
            keys = slots.groupBy("key").agg(F.collect_list("hub").alias("hubs"), F.min("low").alias("low"), F.max("high").alias("high"))
        now = cut(left.join(keys.where("low < high").select("key", "hubs").hint("merge"), "key"))
        if hubs > 1:
            drop(left)
        if now.isEmpty():
            links = shared.sparkSession.createDataFrame([], "a long, b long")
            for part in found:
                links = links.unionByName(part)
            return links
        one = now.select("node", "n", "pos", "label", F.explode("hubs").alias("hub"))
        fit = [_enough(F.col(f"{x}n"), F.col(f"{x}pos"), F.col(f"{y}n"), similarity) for x, y in (("", "hub."), ("hub.", ""))]
        one = one.where((F.col("label") != F.col("hub.label")) & fit[0] & fit[1])
        ends = F.struct("node", "label"), F.struct("hub.node", "hub.label")
        pairs = one.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("u"), F.col("y.label").alias("v")).distinct()
        linked = cut(alike(pairs))
        rest = now.where(~F.array_contains("hubs.node", F.col("node"))).select("key", "node", "n", "pos", "label")
        if not linked.isEmpty():
            found.append(linked.select("a", "b"))
            less = linked.groupBy(F.greatest("u", "v").alias("u")).agg(F.min(F.least("u", "v")).alias("v"))
            least = less.join(less.toDF("v", "w").hint("merge"), "v", "left").select(F.col("u").alias("label"), F.coalesce("w", "v").alias("least"))
            rest = rest.join(least.hint("merge"), "label", "left").select("key", "node", "n", "pos", F.coalesce("least", "label").alias("label"))
        left = cut(rest)
        drop(now)
        hubs *= MORE_HUBS


def _groups(shared: DataFrame, similarity: float, alike, known: DataFrame | None = None) -> DataFrame:
    """``shared(key, node, n, pos)`` to ``(node, label)`` of all its nodes: the components of its links and the ``known`` ones."""
    links = _links(shared, similarity, alike)
    labels = connected_components(cut(links if known is None else links.unionByName(known)))
    return shared.select("node").distinct().join(labels.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _able(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs that are as similar as asked as far as their sketches tell."""
    known = sketches.select("node", "n", "bits")
    both = pairs.join(known.toDF("a", "n_a", "bits_a").hint("merge"), "a").join(known.toDF("b", "n_b", "bits_b").hint("merge"), "b")
    most = most_shared(F.col("bits_a"), F.col("n_a"), F.col("bits_b"), F.col("n_b"))
    return both.where(most * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - EPSILON).select(*pairs.columns)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    pairs = cut(pairs)
    whole = pairs.join(sets.toDF("a", "n_a", "set_a").hint("merge"), "a").join(sets.toDF("b", "n_b", "set_b").hint("merge"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return whole.where(both >= similarity * (F.col("n_a") + F.col("n_b") - both) - EPSILON).select(*pairs.columns)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without all but the first of each near-duplicate group, columns as they were.

    Rows that repeat an id and its text count once; other rows with the same id stay or go together.
    """
    groups = cut(near_duplicate_groups(docs, id_col, text_col, words, similarity))
    gone = groups.where("id > first").select(F.col("id").alias("__id")).distinct()
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    # How many go follows from the corpus, so they are never broadcast: one shuffle of the texts at any size.
    kept = docs.join(gone.hint("shuffle_hash"), key == F.col("__id"), "left_anti")
    if groups.groupBy("id").count().where("count > 1").isEmpty():
        return kept
    once = W.partitionBy(key, F.xxhash64(text_col)).orderBy(F.lit(1))
    return kept.withColumn("__turn", F.row_number().over(once)).where("__turn = 1").drop("__turn")
