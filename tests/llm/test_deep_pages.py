"""Pages with very many open and stray tags, and tables without rows."""

import time

from terravane.llm import html_extract


def test_stray_end_tags_take_no_longer_the_deeper_they_stand():
    began = time.time()
    for page in ("<div>" * 40_000 + "</p>" * 40_000 + "<p>text", "<div>" * 40_000 + "<li>x" * 2_000, "<p>" * 40_000 + "</i></b>" * 20_000):
        html_extract.parse(page)
    assert time.time() - began < 20


def test_end_tags_close_what_is_open_and_no_more():
    tree = lambda node: [k if isinstance(k, str) else (k.tag, tree(k)) for k in node.kids]
    assert tree(html_extract.parse("<div><p>a</i></p>b</div></div>c")) == [("div", [("p", ["a"]), "b"]), "c"]
    assert tree(html_extract.parse("<ul><li>a<li>b<ul><li>c</ul>d</ul>e")) == [("ul", [("li", ["a"]), ("li", ["b", ("ul", [("li", ["c"])]), "d"])]), "e"]
    assert tree(html_extract.parse("<p>a<b>c<p>d</b>e")) == [("p", ["a", ("b", ["c"])]), ("p", ["d", "e"])]


def test_no_pages(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.extract_pages(rows).orderBy("page_id").collect()] == ["", ""]
    assert html_extract.extract_pages(rows.where("false")).collect() == []
