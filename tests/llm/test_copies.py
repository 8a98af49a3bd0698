import json

import pytest

from khata.llm import copies


def found(docs, lines, rows):
    return [r[:3] for r in rows(copies.hidden_copies(docs, lines))]


def test_documents_and_lines(spark, rows):
    docs = spark.createDataFrame([(3, "A, b!", "Wiki"), (1, "ab", "wiki "), (2, "ab", None), (4, "AB", None), (5, None, "wiki"), (6, " . ", "wiki"), (7, " .", "wiki"), (8, "a+b", "wiki"), (9, " a　B।", "W-I_K I")], "doc_id BIGINT, text STRING, source STRING")
    one = lambda **x: json.dumps(x, ensure_ascii=False)
    raw = [one(text="X y", source="s"), one(source="S", text="xY.", word_count=2), '{"text": "xy", "source": "s"', None, "", "[1]", one(text=None, source="s"), one(text="xy", source=None), one(text="xy"), one(text="xy", source="s") + " x"]
    lines = spark.createDataFrame([(k + 1, r) for k, r in enumerate(raw)], "line_id BIGINT, raw STRING")
    assert found(docs, lines, rows) == [("documents", 1, 3), ("documents", 1, 9), ("documents", 2, 4), ("raw_lines", 1, 2), ("raw_lines", 8, 9)]
    assert found(docs.limit(0), lines.limit(0), rows) == []


def test_collapsed_counts(spark, rows):
    docs = spark.createDataFrame([(i, "same " * (i % 2 + 1), "s", "c", 1) for i in range(1, 7)], "doc_id BIGINT, text STRING, source STRING, key STRING, id INT")
    assert rows(copies.collapsed(docs)) == [(1, 3), (2, 3)]


def test_collapsed_records_of_both_tables(spark, rows):
    docs = spark.createDataFrame([(2, "A b", "s"), (5, "ab!", "S"), (6, None, "s")], "doc_id BIGINT, text STRING, source STRING")
    raw = ['{"text": "ab", "source": "s"}', '{"source": "S", "text": "A.B"}', '{"text": "alone", "source": null}', "[1]", None]
    lines = spark.createDataFrame([(k + 1, r) for k, r in enumerate(raw)], "line_id BIGINT, raw STRING")
    assert rows(copies.collapsed_records(docs, lines)) == [("documents", 2, 2), ("raw_lines", 1, 2), ("raw_lines", 3, 1)]


def test_one_group_of_very_many(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'Hot!' as text", "'s' as source")
    lines = spark.createDataFrame([], "line_id BIGINT, raw STRING")
    out = copies.hidden_copies(docs, lines)
    assert out.count() == 2999 and out.where("keep_id = 0 AND n_copies = 3000").count() == 2999


@pytest.mark.parametrize("text", ["a" * 100_000, "ক্ষ " * 5000])
def test_long_texts(spark, rows, text):
    docs = spark.createDataFrame([(1, text, "s"), (2, text.upper() + "!", "s")], "doc_id BIGINT, text STRING, source STRING")
    assert found(docs, spark.createDataFrame([], "line_id BIGINT, raw STRING"), rows) == [("documents", 1, 2)]


def test_many_sources_give_the_same(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(i, "same", f"s-{i % 40}") for i in range(80)], "doc_id BIGINT, text STRING, source STRING")
    first = rows(copies.collapsed(docs))
    monkeypatch.setattr(copies, "MOST_VALUES", 10)
    assert rows(copies.collapsed(docs)) == first and len(first) == 40
