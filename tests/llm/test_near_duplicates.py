"""Near-duplicate groups against comparing all pairs."""

import random

from pyspark.sql import functions as F

from terravane.llm import simhash_neardup
from terravane.llm.common import cut, join_hot


def joined(nodes, links):
    """Groups of two or more, as sets."""
    of = {n: {n} for n in nodes}
    for a, b in links:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for n in of[b]:
                of[n] = of[a]
    return {frozenset(g) for g in of.values()}


def test_crowded_key_is_compared_whole(spark):
    family, pairs = list(range(300)), [(1000 + 2 * k, 1001 + 2 * k) for k in range(40)]
    links = {(a, a + 1) for a in family[:-1]} | {(0, a) for a in family[1:]} | set(pairs)
    nodes = family + [n for p in pairs for n in p]
    shared = spark.createDataFrame([(7, n, 1, 0) for n in nodes] + [(8, n, 1, 0) for n in nodes[::3]], "key long, node long, n int, pos int")
    true = spark.createDataFrame(sorted(links), "a long, b long")
    labels = simhash_neardup._groups(shared, 0.8, lambda candidates: candidates.join(true, ["a", "b"])).collect()
    found = {}
    for r in labels:
        found.setdefault(r["label"], set()).add(r["node"])
    assert {frozenset(g) for g in found.values()} == joined(nodes, links)


def sliding(rng, n, kept):
    """Two texts of n five-word shingles each, that share ``kept`` of them: the last words of the second are others."""
    words = [f"x{rng.getrandbits(40)}" for _ in range(n + 4)]
    return " ".join(words), " ".join(words[: kept + 4] + [f"y{rng.getrandbits(40)}" for _ in range(n - kept)])


def test_pairs_about_the_similarity_at_all_sizes(spark):
    rng, docs, want = random.Random(6), [], {}
    for n in (1, 4, 5, 8, 9, 10, 12, 16, 25, 50, 120, 500):
        for kept in range(n):
            exact = kept / (2 * n - kept)
            if 0.7 <= exact <= 0.9 and (n < 100 or kept % (n // 40) == 0):
                for text in sliding(rng, n, kept):
                    docs.append((len(docs), text))
                want[len(docs) - 1] = len(docs) - 2 if exact >= 0.8 else len(docs) - 1
    # 4 of 5 and 8 of 10 shingles, the one set within the other: a similarity of just 0.8, whatever the rounding.
    for n in (5, 10, 15, 35, 400):
        text, _ = sliding(rng, n, n)
        docs += [(len(docs), text), (len(docs) + 1, " ".join(text.split()[: n * 4 // 5 + 4]))]
        want[len(docs) - 1] = len(docs) - 2
    assert 12 < sum(i != first for i, first in want.items()) < len(want) - 12
    found = {r["id"]: r["first"] for r in simhash_neardup.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: found[i] for i in want} == want


def test_groups_are_those_of_all_pairs(spark):
    rng, docs = random.Random(7), []
    words, passage = [f"w{i}" for i in range(300)], [f"p{i}" for i in range(60)]
    for g in range(25):
        base = rng.choices(words, k=rng.randrange(3, 80)) + passage * (g % 2)
        for c in range(rng.randrange(1, 9)):
            text = base[: len(base) - rng.randrange(len(base) // 6 + 1)]
            for _ in range(c * len(base) // 120):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs), " ".join(text)))
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) or {t} for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    found = {}
    for r in simhash_neardup.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found.setdefault(r["first"], set()).add(r["id"])
    assert {frozenset(g) for g in found.values()} == joined(list(sets), links)


def test_hot_and_other_keys_are_joined_alike(spark):
    rows = [(i, 0 if i % 3 else i % 1500) for i in range(6000)] + [(7, 0), (7, 0)]
    frame = spark.createDataFrame(rows, "id long, key long")
    counted = cut(frame.groupBy("key").agg(F.min("id").alias("least"), F.when(F.col("key") == 3, None).otherwise(F.max("id")).alias("most"), F.count("*").alias("n")))
    want = frame.join(counted.drop("n"), "key").select("id", "key", "least", "most")
    found = join_hot(frame, counted, ["key"])
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert join_hot(frame.limit(0), counted.limit(0), ["key"]).count() == 0


def with_last_words(rng, base, n):
    return " ".join(base[:-n] + [f"z{rng.getrandbits(40)}" for _ in range(n)])


def test_close_copies_are_grouped_by_fingerprints_and_golay_keys(spark, monkeypatch):
    rng, docs = random.Random(8), []
    for g in range(12):
        base = [f"x{rng.getrandbits(40)}" for _ in range(400)]
        docs += [(4 * g, " ".join(base)), (4 * g + 1, with_last_words(rng, base, 3)), (4 * g + 2, with_last_words(rng, base, 40)), (4 * g + 3, with_last_words(rng, base, 200))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    prints = {i: simhash_neardup.majority(simhash_neardup.shingle_hashes(t.encode(), 5)) for i, t in docs}
    apart = lambda a, b: ((prints[a] ^ prints[b]) & ((1 << 64) - 1)).bit_count()
    assert sum(apart(4 * g, 4 * g + 1) <= 4 for g in range(12)) > 6 and sum(apart(4 * g, 4 * g + 2) > 4 for g in range(12)) > 6
    groups = lambda: {r["id"]: r["first"] for r in simhash_neardup.near_duplicate_groups(frame).collect()}
    whole = groups()
    assert whole == {i: i if i % 4 == 3 else i - i % 4 for i, _ in docs}
    # Without the comparison by shared keys, those within four bits are left, and only if their shingles are similar too.
    monkeypatch.setattr(simhash_neardup, "_links", lambda shared, similarity, alike: spark.createDataFrame([], "a long, b long"))
    alone = groups()
    assert all(alone[4 * g + 1] == (4 * g if apart(4 * g, 4 * g + 1) <= 4 else 4 * g + 1) for g in range(12) if apart(4 * g + 1, 4 * g + 2) > 4)
    assert all(alone[i] == i for i in range(3, 48, 4)) and all(whole[alone[i]] == whole[i] for i in alone)


def test_each_node_has_one_nearest_print(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(60) for _ in range(5)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(60), rng.randrange(4))) for b in base for _ in range(40)] + base * 3
    nodes = dict(enumerate(prints))
    found = simhash_neardup.nearest_prints(spark.createDataFrame(list(nodes.items()), "node long, fp long")).collect()
    pairs = [(r["a"], r["b"]) for r in found]
    assert all(a < b and (nodes[a] ^ nodes[b]).bit_count() <= 4 for a, b in pairs) and len(set(pairs)) == len(pairs) < len(nodes)
    least = {p: min(n for n in nodes if nodes[n] == p) for p in set(prints)}
    want = {(least[p], n) for n, p in nodes.items() if n != least[p]}
    for p in least:
        lower = [q for q in least if q < p and (p ^ q).bit_count() <= 4]
        want |= {tuple(sorted((least[p], least[min(lower)])))} if lower else set()
    assert set(pairs) == want


def test_all_close_prints_are_compared(spark):
    rng, prints, true = random.Random(10), {}, set()
    for g in range(20):
        base = rng.getrandbits(60)
        # The least node or print of its neighbourhood is unlike the others, which are alike in two groups.
        near = sorted(base ^ sum(1 << k for k in rng.sample(range(60), 2)) for _ in range(7))
        nodes = [100 * g + k for k in range(10)]
        prints |= dict(zip(nodes, [near[0], *near, near[3], near[3]]))
        true |= {(a, b) for group in (nodes[2:6], nodes[6:8] + nodes[9:]) for a in group for b in group if a < b}
    classes = spark.createDataFrame([(n, 5, p) for n, p in prints.items()], "node long, n int, fp long")
    links = cut(simhash_neardup.hamming_links(classes.select("fp").distinct()))
    nearest = simhash_neardup.nearest_prints(classes, links=links)
    known = spark.createDataFrame(sorted(true), "a long, b long").hint("merge")
    alike = lambda pairs: pairs.join(known, ["a", "b"])
    within = {(a, b) for a, b in true if (prints[a] ^ prints[b]).bit_count() <= 4}
    pairs = lambda found: {(r["a"], r["b"]) for r in found.select("a", "b").collect()}
    wanted = joined(list(prints), within)
    assert joined(list(prints), pairs(alike(nearest))) != wanted
    found = pairs(simhash_neardup.close_links(classes, links, nearest, 0.8, alike))
    assert joined(list(prints), found) == wanted and found <= within
