"""Held-out accuracy of the models, pages against plain extraction, the mixture's sums, near copies, the pipeline."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from terravane.llm import html_extract, langid_ecoc, mixing, quality_knn, simhash_neardup
from terravane.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    df = QUERIES[name](spark, TINY)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_knn"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert len(held) > 50 and sum(pairs) / len(pairs) > 0.98


def test_quality_with_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "Plain words here."), (2, None), (3, ""), (None, "x"), (1, "again")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (None, 0), (3, None)], "doc_id long, quality int")
    for labels in (none, some):
        model = quality_knn.fit(docs, labels, "quality")
        scores = [r["s"] for r in docs.select(quality_knn.quality(docs, model).alias("s")).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)


def test_language_on_held_out_rows(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op4_langid_ecoc"](spark, SF).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) / len(rows) > 0.98


def test_language_with_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et la souris", "fr"), (3, None, "fr"), (4, "123 !?", "en"), (5, "", None), (6, "the house", None)], "doc_id long, text string, lang string")
    model = langid_ecoc.fit(docs)
    got = {r["doc_id"]: r["f"] for r in docs.select("doc_id", langid_ecoc.identify(docs, model).alias("f")).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "fr", "und", "und", "und", "en"]
    empty = langid_ecoc.fit(docs.where("false"))
    assert all(r["f"]["lang_pred"] == "und" for r in docs.select(langid_ecoc.identify(docs, empty).alias("f")).collect())
    codes = langid_ecoc.codewords(6)
    assert len({tuple(c) for c in codes.tolist()}) == 6


PAGES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<html><body><nav><a href=x>Menu</a></nav><article><header><h1>T&amp;C</h1></header><p>One  <b>two</b>\n three.<p>Four&nbsp;five<br>six</article><aside>Side</aside><footer>&copy;</footer>", "T&C\nOne two three.\nFour five six"),
    ("<body><div id='sidebar'>Lots of links <a href=a>one</a></div><div class=content><p>A long paragraph of the article's text, with many words in it.</p><p>Another long paragraph, which also has a number of words.</p></div><div class='cookie-notice'>We use cookies on this site and on others too, as many do.</div></body>",
     "A long paragraph of the article's text, with many words in it.\nAnother long paragraph, which also has a number of words."),
    ("<article><h2>Title</h2><ul><li>First<li>Second</ul><form>Send <input></form><div class=comments><p>Nice one!</p></div><script>var x='</p>'</script><p>End</article>", "Title\nFirst\nSecond\nEnd"),
    ("<article><p>a &lt;b&gt; &#233; &#x1F600;</p><!-- no --><table><tr><td>1<td>2</table></article>", "a <b> é 😀\n1\n2"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<p class=\"unclosed>text", "text"),
    ("<form action=x><div><article><p>Inside of a form.</p></article><input></div></form>", "Inside of a form."),
    ("<body><form id=aspnet><div id=top><a href=a>Home</a> <a href=b>News</a></div><div class=text><p>" + "A sentence of the page. " * 9 + "</p><p>" + "Another of them. " * 9 + "</p></div></form></body>",
     ("A sentence of the page. " * 9).strip() + "\n" + ("Another of them. " * 9).strip()),
    ("<main><article><p>The first of two.</p></article><article><p>The second of two.</p></article></main>", "The first of two.\nThe second of two."),
    ("<body><article><p>The first of two.</p></article><article><p>The second of two.</p></article><footer>x</footer></body>", "The first of two.\nThe second of two."),
    ("<body><div class=content>" + ("<div class=part><div class=inner>" + f"<p>{'Words of a part. ' * 12}</p>" * 4 + "</div></div>") * 3 + "</div></body>", "\n".join([("Words of a part. " * 12).strip()] * 12)),
    ("<body><div class=content><div class=part><div class=inner>" + f"<p>{'Words of a part. ' * 12}</p>" * 4 + "</div></div><div class=part><div class=inner>" + f"<p>{'Fewer words. ' * 7}</p>" * 2 + "</div></div></div></body>",
     "\n".join([("Words of a part. " * 12).strip()] * 4 + [("Fewer words. " * 7).strip()] * 2)),
    ("<article><p class='share-of-market'>It has a share of the market.</p><section id=related-work><p>Others did it too.</p></section></article>", "It has a share of the market.\nOthers did it too."),
    ("<article><p>Press <button>Start</button> to begin.</p><div class=feedback><p>Great post!</p></div><button>Share</button></article>", "Press Start to begin."),
    ("<main><article><p>The text of the page.</p></article><section id=comments><article class=comment><p>I don't agree.</p></article></section></main>", "The text of the page."),
    ("<article><p>The text of the page.</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul><div class='related-posts'><p>More of this</p></div></article>", "The text of the page."),
    ("<main><h1>Heading</h1><article><p>The text of the page.</p></article></main>", "Heading\nThe text of the page."),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_pages(page, want):
    assert html_extract.extract(page) == want


def test_pages_query(spark):
    import html
    import re

    rows = {r["page_id"]: r for r in QUERIES["op10_html_extract"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        want = "\n".join(x for x in parts if x)
        assert rows[p["page_id"]]["text"] == want and rows[p["page_id"]]["n_chars"] == len(want)


def test_mixture_sums(spark):
    rng = random.Random(2)
    docs = [(i, f"s{min(int(rng.expovariate(0.8)), 5)}" if i % 40 else None, " ".join(["w"] * rng.randrange(30))) for i in range(600)]
    docs += [(7, "s0", "a b"), (7, "s0", "a b"), (None, "s1", "a b c"), (9999, "empty", None)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("weight", F.lit("clash"))
    rows = mixing.mix(frame, entropy=0.97, repeats=3.0, blocks=8).collect()
    placed = Counter((r["doc_id"], r["source"]) for r in rows)
    assert all(placed[d[:2]] >= 1 for d in docs)
    assert [(r["weight"], r["block"], r["place"]) for r in rows if r["source"] == "empty"] == [(0.0, 0, 0)]
    rows = [r for r in rows if r["source"] != "empty"]
    tokens, spent, weights = Counter(), Counter(), {}
    for _, s, t in docs:
        tokens[s] += len((t or "").split())
    by_source = defaultdict(list)
    for r in rows:
        spent[r["source"]] += r["n_tokens"]
        weights[r["source"]] = r["weight"]
        by_source[r["source"]].append((r["place"], r["n_tokens"], r["pass"], r["block"]))
    assert abs(sum(weights.values()) - 1) < 1e-9
    ratio = [spent[s] / tokens[s] for s in weights]
    assert max(ratio) <= 3.3
    total = sum(spent.values())
    assert all(abs(spent[s] / total - w) < 0.02 for s, w in weights.items())
    for s, places in by_source.items():
        places.sort()
        at = 0
        for place, n, turn, block in places:
            assert place == at and turn == place // tokens[s] or n == 0 or place == at
            at = place + n


def test_mixture_keeps_texts_without_words_and_clashing_columns(spark):
    docs = [(i, "a" if i % 3 else "b", "w w w" if i % 2 else "") for i in range(40)] + [(40, "none", ""), (41, "none", None), (42, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("weight", F.lit("clash")).withColumn("block", F.lit("x")).withColumn("tokens", F.lit(1))
    rows = mixing.mixture(frame)
    assert rows.columns == ["doc_id", "source", "text", "tokens", "n_tokens", "weight", "pass", "block", "place"]
    found = rows.collect()
    assert {r["doc_id"] for r in found} == set(range(43)) and all(0 <= r["block"] < mixing.BLOCKS for r in found)
    assert mixing.mixture(frame.where("false")).count() == 0


def test_languages_without_texts_are_not_predicted(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et la souris", "fr"), (3, None, "zz"), (4, "12 34", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid_ecoc.fit(docs)
    assert model.languages == ["en", "fr"] and model.trust.shape == model.codes.shape
    assert abs(model.trust.mean(axis=1) - 1).max() < 1e-9
    assert model.decode("qqq xyx jjj")[0] in ("en", "fr")


def test_language_decoding_is_the_plain_one(spark):
    import numpy as np

    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(120)
    model = langid_ecoc.fit(docs)
    got = {r["doc_id"]: r["f"]["lang_pred"] for r in docs.select("doc_id", langid_ecoc.identify(docs, model).alias("f")).collect()}
    for r in docs.collect():
        margins = np.array([sum(float(model.weights[g, b]) for g in langid_ecoc.grams(r["text"])) / (len(langid_ecoc.grams(r["text"])) + 20) for b in range(model.codes.shape[1])])
        losses = [sum(model.trust[k, b] * np.log1p(np.exp(-model.codes[k, b] * margins[b])) for b in range(len(margins))) for k in range(len(model.languages))]
        assert got[r["doc_id"]] == model.languages[int(np.argmin(losses))]


def test_quality_votes_are_those_of_the_exact_neighbours(spark):
    import numpy as np

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = quality_knn.fit(docs, spark.read.parquet(f"{TINY}/labels.parquet"), "quality")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality_knn.quality(docs, model).alias("s")).collect()}
    for r in docs.limit(40).collect():
        own = model.latent([quality_knn.term_rates((r["text"] or "").encode())])[0]
        near = sorted(((float(own @ v), float(y)) for v, y in zip(model.vectors, model.labels)), reverse=True)[: model.neighbours]
        total = sum(max(c, 0) for c, _ in near)
        want = sum(max(c, 0) * y for c, y in near) / total if total > 1e-6 else model.prior
        assert abs(got[r["doc_id"]] - want) < 1e-3


def test_fixed_budget_and_single_source(spark):
    docs = spark.createDataFrame([(i, "a" if i < 90 else "b", "w w w w w") for i in range(100)], "doc_id long, source string, text string")
    rows = mixing.mix(docs, budget=200, entropy=1.0, repeats=100.0).toPandas()
    assert abs(rows[rows.source == "a"].n_tokens.sum() - 100) <= 5 and abs(rows[rows.source == "b"].n_tokens.sum() - 100) <= 5
    assert mixing.mix(docs.where("source = 'a'")).count() == 90
    assert mixing.mix(docs.where("false")).count() == 0


def test_near_copies_by_similarity(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    docs, group = [], {}
    for g in range(60):
        base = rng.choices(words, k=rng.randrange(60, 500))
        for c in range(rng.randrange(1, 5)):
            text = base[:]
            for _ in range(c * len(base) // 400):
                text[rng.randrange(len(text))] = rng.choice(words)
            group[len(docs)] = g
            docs.append((len(docs), " ".join(text)))
    docs += [(1000, None), (1001, ""), (1002, docs[0][1].upper()), (1003, "only three words"), (1003, "only three words"), (None, docs[5][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("n_chars", F.length("text"))
    found = {r["id"]: r["first"] for r in simhash_neardup.near_duplicate_groups(frame).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    null = -(1 << 63)
    assert found[1001] == 1000 and found[1002] == found[0] and found[null] == null
    assert all(found[i] == first[g] or g == group[5] for i, g in group.items())
    kept = simhash_neardup.keep_first(frame)
    assert kept.columns == frame.columns
    assert sum(r["doc_id"] == 1003 for r in kept.collect()) == 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == before
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert sum(q == 0 for i, q in labels.items() if i in kept) < 0.2 * sum(q == 0 for q in labels.values())
