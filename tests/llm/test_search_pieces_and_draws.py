"""Lexical search, pieces and importance resampling against plain versions, over a small table and awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from terravane.llm import importance, lexical, pieces
from terravane.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, key long, score long, ids string, row string, `rank` int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def awkward_texts():
    rng = random.Random(5)
    blanks = ["", " ", "  ", "   ", "\t", "\n", "▁", "\x00", "​", "　", "  ▁ "]
    made = ["".join(rng.choice(blanks + ["a", "the", "Straße", "日本", "é", "é", "😀", "<s>", "</s>", "<0x0A>", "x" * 40, "1234", "##"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    return [None, "", " ", "▁", "word", "word ", " word", "A b C", "x" * 20_000, "to be " * 30_000, "same words of a text " * 6, "same words of a text " * 6, *made]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(None if i in (7, 11) else i // 2, t, 1, 2, "x", "y", 3) for i, t in enumerate(awkward_texts())]
    return spark.createDataFrame(rows * 2, SCHEMA).repartition(5, "text")


@pytest.fixture(scope="module")
def items(spark):
    texts = ["same words of a text", "the the WORD to", "", None, "nowhere-to-be-found xyzzy", "é straße 日本", "a b c x the 1234 to be", "same words of a text"]
    return spark.createDataFrame([(i % 7, t, "clash") for i, t in enumerate(texts)], "item_id long, text string, key string")


# --- pieces


@pytest.mark.parametrize("hot_bytes", [0, 2_000, pieces.HOT_BYTES])
def test_ids_and_decoded_texts_are_those_of_the_library(spark, awkward, hot_bytes):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.Model(spark, MODEL)
    for docs in (awkward, spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = docs.count()
        found = pieces.encode(docs, model, decoded="again", hot_bytes=hot_bytes).withColumn("back", pieces.decode(F.col("ids"), model)).collect()
        assert len(found) == rows
        for r in found:
            want = sp.encode(r["text"] or "")
            assert r["ids"] == want
            assert r["back"] == r["again"] == (sp.decode(want) if want else "")


def test_other_columns_stay_and_ids_replace_a_column_of_that_name(spark, awkward):
    model = pieces.Model(spark, MODEL)
    for hot_bytes in (0, pieces.HOT_BYTES):
        found = pieces.encode(awkward, model, hot_bytes=hot_bytes)
        assert sorted(found.columns) == sorted(awkward.columns)
        assert dict(found.dtypes)["ids"] == "array<int>"
        assert found.where("row = 'y' and key = 1").count() == awkward.count()
    assert pieces.encode(awkward.where("false"), model).collect() == []
    alone = pieces.encode(awkward.select("text"), model, into="text", decoded="row")
    assert alone.columns == ["text", "row"] and alone.count() == awkward.count()


def test_the_table_holds_chunks_that_recur_within_its_bound(spark, awkward):
    table = pieces.recurring(awkward.coalesce(1))
    want = Counter(c for t in awkward_texts() * 2 for c in pieces.chunks(t or ""))
    assert {r["chunk"]: r["n"] for r in table.collect()} == {c: n for c, n in want.items() if n > 1}
    size = lambda rows: sum(5 * len(r["chunk"].encode()) + pieces.ENTRY_BYTES for r in rows)
    for limit in (0, 3_000, 20_000, 1 << 30):
        kept = pieces.frequent(table, limit).collect()
        left = {r["chunk"]: r["n"] for r in table.collect()}
        for r in kept:
            left.pop(r["chunk"])
        assert size(kept) <= limit
        assert not kept or not left or min(r["n"] for r in kept) > max(left.values())
    assert not left


def test_models_whose_chunks_depend_on_each_other_are_refused():
    class Crossing:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁of", "of▁the"][i]

    with pytest.raises(ValueError, match="reach over"):
        pieces.check(Crossing())


# --- lexical search


def ranked(docs, queries, k=10):
    """A plain version: every document scored for every item."""
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, n_words = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(queries):
        scores = []
        for i, c, n in held:
            if n:
                m = 25 + 75 * n * n_docs // n_words
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
                if s > 0:
                    scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("shard,step,k", [(1 << 13, 32, 10), (7, 1, 1), (1, 3, 1000)])
def test_search_equals_scoring_every_document(spark, awkward, items, monkeypatch, shard, step, k):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "STEP", step)
    queries = [(r["item_id"], r["text"]) for r in items.collect()]
    got = lexical.search(lexical.index(awkward), items, k).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == ranked(rows_of(awkward), queries, k)


def test_search_over_the_given_tables(spark):
    docs, queries = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = ranked(rows_of(docs), [(r["item_id"], r["text"]) for r in queries.collect()])
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in QUERIES["op11_lexical_search"](spark, SMALL).collect()), key=str) == want


def test_queries_in_several_blocks_and_thresholds_from_some_shards(spark, awkward, items, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 9)
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "SHARD_WORDS", 500)
    got = lexical.search(lexical.index(awkward), items).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == ranked(rows_of(awkward), [(r["item_id"], r["text"]) for r in items.collect()])


def test_search_in_empty_tables(spark, awkward, items):
    assert lexical.search(lexical.index(awkward.where("false")), items).collect() == []
    assert lexical.search(lexical.index(awkward), items.where("false")).collect() == []
    assert lexical.search(lexical.index(awkward.where("text is null")), items).collect() == []


def test_leaves_without_documents_are_passed_over(spark):
    """Five documents make a tree of eight leaves."""
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "b") for i in range(5)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "a b"), (2, "b")], "item_id long, text string")
    got = lexical.search(lexical.index(docs), items, 100).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == ranked(rows_of(docs), rows_of(items.toDF("doc_id", "text")), 100)


def test_a_tree_keeps_both_orders(spark):
    """At each level the postings of a node are together, and those of a list among them by falling impact."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(12)))) for i in range(100)], "doc_id long, text string").coalesce(1)
    row = lexical.index(docs).first()
    import numpy as np
    import pyarrow as pa

    tree = lexical.Tree(np.array(row["doc_ids"]), pa.array(row["terms"]), np.array(row["ends"]), np.array(row["impacts"]), bytes(row["bits"]))
    assert row["doc_ids"] == sorted(row["doc_ids"])
    for start, end in zip(tree.starts, tree.ends):
        assert list(tree.impacts[start:end]) == sorted(tree.impacts[start:end], reverse=True)
    term = np.arange(len(row["terms"]))
    level, prefix, lo, hi = np.zeros(1, int), np.zeros(1, int), tree.starts[None], tree.ends[None]
    for _ in range(tree.levels):
        level, prefix, lo, hi, _ = tree._children(level, prefix, lo, hi, np.ones(len(term), int))
    texts = {r["doc_id"]: Counter(words(r["text"])) for r in docs.collect()}
    for i, d in enumerate(prefix.tolist()):
        here = {row["terms"][t] for t in term if lo[i, t] < hi[i, t]}
        assert here == (set(texts[row["doc_ids"][d]]) if d < 100 else set())


# --- importance resampling


def resampled(docs, target, share=5, least=20):
    runs = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: crc32(f.encode()) % 10_000
    held = [(i, words(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, w in held for f in runs(w)), Counter(bucket(f) for x in target for f in runs(words(x)))
    whole = (s.total() + 10_000) / 1.0, (t.total() + 10_000) / 1.0
    gains = {b: math.floor(1000 * math.log((t[b] + 1) * whole[0] / ((s[b] + 1) * whole[1]))) for b in s}
    gain = gains.__getitem__
    out = []
    for i, w in held:
        weight = sum(gain(bucket(f)) for f in runs(w))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(runs(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [1 << 17, 4])
def test_draws_equal_a_plain_version(spark, monkeypatch, rows):
    monkeypatch.setattr(importance, "RANGE_ROWS", rows)
    docs, target = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    assert drawn_rows(QUERIES["op13_importance"](spark, SMALL)) == resampled(rows_of(docs), [r["text"] for r in target.collect()])
    for share in (0, 40) if rows == 4 else ():
        gain = importance.gains(importance.histogram(docs), importance.histogram(target))
        found = importance.draw(importance.score(docs.repartition(7, "doc_id"), gain), share)
        assert drawn_rows(found) == resampled(rows_of(docs), [r["text"] for r in target.collect()], share)


def test_draws_from_awkward_rows(spark, awkward, items):
    """Nulls, repeated ids and rows, and ties: equal rows may swap their ranks, the ranks themselves are one to n."""
    found = importance.resample(awkward, items)
    want = resampled(rows_of(awkward), [r["text"] for r in items.collect()])
    assert drawn_rows(found) == want
    some = importance.draw(importance.score(awkward, importance.gains(importance.histogram(awkward), importance.histogram(items))), 50, 0)
    assert drawn_rows(some) == resampled(rows_of(awkward), [r["text"] for r in items.collect()], 50, 0)
    assert sorted(r["rank"] for r in some.where("rank is not null").collect()) == list(range(1, awkward.count() // 2 + 1))


def test_draws_from_empty_tables(spark, awkward, items):
    assert importance.resample(awkward.where("false"), items).collect() == []
    assert importance.resample(awkward, items.where("false")).count() == awkward.count()


def test_a_tournament_merges_sorted_runs():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(n)]
        assert list(importance.Tournament([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
