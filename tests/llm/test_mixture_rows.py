"""Rows that repeat an id keep their own columns through the mixture."""

from collections import Counter

from terravane.llm import mixing


def test_rows_of_one_id_and_text_keep_their_columns(spark):
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "y"), (1, "a b c", "s", "y"), (2, "d", "t", None), (None, None, None, "z"), (2, "d", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    placed = mixing.mixture(docs)
    first = [tuple(r[c] for c in docs.columns) for r in placed.where("pass = 0").collect()]
    assert Counter(first) == Counter(rows)
    assert placed.columns == [*docs.columns, *mixing.PLACED]
    assert mixing.mixture(docs.where("false")).collect() == []
