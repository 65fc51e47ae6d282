"""Spans of matches, also of very many in one text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from terravane.llm import pii, secret_scan, spans


def test_spans_are_those_of_finditer(spark):
    rng = random.Random(1)
    texts = ["", "a", "1", "12 3", "é1😀22", *("".join(rng.choice("ab1 😀é") for _ in range(rng.randrange(300))) for _ in range(60))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern in ("[0-9]+", "a", "(?:b|1)+ ?", "[^a]+"):
        for r in rows.select("text", spans.match_spans(F.col("text"), pattern, 3).alias("s")).collect():
            assert [(s["start"], s["end"], s["value"], s["kind"]) for s in r["s"]] == [(m.start(), m.end(), m.group(), 3) for m in re.finditer(pattern, r["text"])]


@pytest.mark.parametrize("most", [0, 64])
def test_masks_are_the_same_by_places_and_by_signs(spark, monkeypatch, most):
    monkeypatch.setattr(spans, "MANY", most)
    text = "é😀 mail a@b.cc or +1 555 123 4567, " * 20
    rows = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert got == {1: "é😀 mail <EMAIL> or <PHONE>, " * 20, 2: "none", 3: None}


def test_a_megabyte_of_numbers(spark):
    """Some hundred thousand matches in one text; the time was quadratic in them once."""
    numbers = " ".join(f"{i % 97};{i}" for i in range(120_000))
    rows = spark.createDataFrame([(1, numbers + " call 4539148803436467 or a@b.cc")], "doc_id long, text string").repartition(1)
    assert len(numbers) > 1_000_000
    pii.digest(rows.limit(0)).collect()
    began = time.time()
    found = pii.digest(rows).first()
    assert (found["n_card"], found["n_email"]) == (1, 1)
    assert found["spans"].split(",")[0] == f"card:{len(numbers) + 6}:{len(numbers) + 22}"
    assert "<CARD> or <EMAIL>" in pii.redact(rows).first()["text"]
    took = time.time() - began
    assert took < 60, took


def test_a_megabyte_of_tokens(spark):
    tokens = " ".join(f"token={i:012d}abcdef" for i in range(30_000))
    rows = spark.createDataFrame([(1, tokens)], "doc_id long, text string")
    found = rows.select(spans.match_spans(F.col("text"), secret_scan.ASSIGN, 0).alias("s")).first()["s"]
    assert len(found) == 30_000 and found[-1]["end"] == len(tokens)
