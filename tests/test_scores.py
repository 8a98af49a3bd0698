import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from khata.operators import score


def test_accuracy_and_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (None, 1)], "y INT, g INT")
    n, accuracy, f1 = score.accuracy_macro_f1(df, "y", "g").first()
    assert (n, accuracy) == (4, 0.5)
    assert f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_entity_f1(spark):
    rows = [(1, ["B-PER", "I-PER", "O", "B-LOC"], ["B-PER", "I-PER", "O", "B-PER"]), (2, ["I-LOC", "O"], ["B-LOC", "O"])]
    df = spark.createDataFrame(rows, "s INT, t ARRAY<STRING>, g ARRAY<STRING>")
    assert tuple(score.entity_f1(df, ["s"], "t", "g").first()) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert tuple(score.entity_f1(df.limit(0), ["s"], "t", "g").first()) == (0.0, 0.0, 0.0)


def test_bleu_of_equal_and_shorter_text(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e f")], "k INT, g STRING, t STRING")
    got = score.bleu(df, "k", "g", "t").first()
    assert got["bleu"] == pytest.approx(100 * math.exp(1 - 6 / 5))
    assert score.bleu(df, "k", "t", "t").first()["bleu"] == pytest.approx(100)
    other = spark.createDataFrame([(1, "x y", "a b")], "k INT, g STRING, t STRING")
    assert score.bleu(other, "k", "g", "t").first()["bleu"] == 0


def test_chrf(spark):
    df = spark.createDataFrame([(1, "abcdefg", "abcdefg")], "k INT, g STRING, t STRING")
    assert score.chrf(df, "k", "g", "t").first()["chrf"] == pytest.approx(100)


def test_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat was sat")], "k INT, g STRING, t STRING")
    one, two, longest = score.rouge(df, "k", "g", "t").first()
    assert (one, two, longest) == pytest.approx((6 / 7, 2 / 5, 6 / 7))


def test_contamination(spark, rows):
    items = spark.createDataFrame([(1, " Hello World "), (2, "absent"), (3, None), (4, "  ")], "i INT, text STRING")
    docs = spark.createDataFrame([("hello world", "s"), ("<|lang_bn|>x<|lang_en|>absent\nmore", "s"), (None, None)], "text STRING, source STRING")
    assert score.contamination(items, docs, "text", ["text", "source"]).count() == 1
    found = score.contamination_by_segment(items, docs, "text", "text")
    assert found.count() == 2
    assert tuple(score.gate(found, items, "text").first()) == (2, 2, 1.0, False)


def test_mean_std_text(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("b", 0.6), ("c", None)], "m STRING, v DOUBLE")
    assert {r["m"]: r["shown"] for r in score.mean_std(df, ["m"], "v").collect()} == {"a": "0.50", "b": "0.50 ± 0.10", "c": "N/A"}


def test_schedule_and_perplexity(spark):
    df = spark.range(101).select("id", score.learning_rate(F.col("id"), 10, 100).alias("r"))
    rate = {r["id"]: r["r"] for r in df.collect()}
    assert rate[0] == 0 and rate[10] == pytest.approx(1) and rate[100] == pytest.approx(0.1)
    assert spark.createDataFrame([(50.0,)], "l DOUBLE").select(score.perplexity("l")).first()[0] == pytest.approx(math.exp(20))


def test_needle_and_labels(spark):
    df = spark.createDataFrame([(1, list(range(10, 20)))], "doc_id INT, ids ARRAY<INT>")
    got = score.needle_prompts(df, "ids", F.array(F.lit(1), F.lit(2)), [6], [0.5]).first()
    assert got["prompt"] == [10, 11, 1, 2, 12, 13] and got["actual_tokens"] == 6
    words = spark.createDataFrame([(["ab", "c"], [4, 5])], "w ARRAY<STRING>, t ARRAY<INT>")
    pieces = F.transform("w", lambda x: F.length(x))
    assert score.aligned_labels(words, "w", "t", pieces, 5).first()["labels"] == [4, -100, 5, -100, -100]
    assert score.aligned_labels(words, "w", "t", pieces, 2).first()["labels"] == [4, -100]


def test_pending_and_pivot(spark, rows):
    grid = spark.createDataFrame([("a", 1), ("a", 2)], "m STRING, s INT")
    assert rows(score.pending(grid, grid.where("s = 1"), ["m", "s"])) == [("a", 2)]
    table = spark.createDataFrame([("a", "x", "1")], "m STRING, t STRING, v STRING")
    assert rows(score.summary_pivot(table, "m", "t", ["x", "y"], "v")) == [("a", "1", "N/A")]


def test_label_align_covers_every_language(spark, tmp_path):
    from khata.plans import registry

    rows = [(1, "en", "The river Padma"), (2, "bn", "নদীর ধারে"), (3, "hi", "नदी")]
    spark.createDataFrame(rows, "sample_id BIGINT, lang STRING, text STRING").write.parquet(f"{tmp_path}/lang_samples.parquet")
    assert {r["sample_id"] for r in registry.queries()["label_align"](spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_throughput_leaves_breaks_out(spark):
    rows = [("a", 1, "2024-01-01 00:00:00", 10), ("a", 2, "2024-01-01 00:00:10", 30), ("a", 3, "2024-01-01 09:00:00", 20), ("a", 4, "2024-01-01 09:00:10", 40), ("b", 5, "2024-01-01 00:00:00", 5)]
    log = spark.createDataFrame(rows, "run STRING, id INT, ts STRING, n INT").withColumn("ts", F.to_timestamp("ts"))
    got = {r["id"]: (r["tokens"], r["elapsed_s"], r["tokens_per_s"], r["eta_s"]) for r in score.throughput(log, ["run"], "ts", "n", 200, 3600).collect()}
    assert got == {1: (10, 0, None, None), 2: (40, 10, 4, 40), 3: (60, 10, 6, (200 - 60) / 6), 4: (100, 20, 5, 20), 5: (5, 0, None, None)}


def test_grids_flags_and_labels(spark, rows):
    df = spark.createDataFrame([("d", "m", 0.5), ("d", "n", None)], "dataset STRING, model STRING, v DOUBLE")
    got = score.looked_up(df, [("d", "n"), ("d", "m"), ("e", "m")], ["dataset", "model"], F.format_string("%.1f", "v"))
    assert [r["shown"] for r in got.orderBy("place").collect()][1:] == ["0.5", "N/A"]
    flagged = spark.createDataFrame([(1, True), (2, False), (3, None)], "i INT, skipped BOOLEAN")
    assert rows(score.without_skipped(flagged).select("i")) == [(2,), (3,)]
    assert rows(df.select(score.labelled("model", {"m": "M"}))) == [("M",), ("n",)]


def naive_counts(x, y, most):
    out = []
    for n in range(1, most + 1):
        u, v = (Counter(tuple(z[k : k + n]) for k in range(len(z) - n + 1)) for z in (x, y))
        out.append([(u & v).total(), u.total(), v.total()])
    return out


@pytest.mark.parametrize("alphabet", [3, 40, 200_000])
def test_clipped_counts_of_many_pairs(alphabet):
    rng = np.random.default_rng(alphabet)
    pairs = [(rng.integers(0, alphabet, int(rng.integers(0, 12))).tolist(), rng.integers(0, alphabet, int(rng.integers(0, 12))).tolist()) for _ in range(200)]
    units = np.array([u for p in pairs for side in p for u in side], np.int64)
    side = np.repeat(np.arange(400), [len(s) for p in pairs for s in p])
    assert score.clipped(units, side, 200, 6).tolist() == [naive_counts(x, y, 6) for x, y in pairs]
    assert score.clipped(units[:0], side[:0], 2, 3).tolist() == [[[0, 0, 0]] * 3] * 2


def test_common_lengths_of_many_pairs(monkeypatch):
    def naive(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = np.random.default_rng(0)
    many = [(rng.integers(0, 5, int(rng.integers(0, 20))), rng.integers(0, 5, int(rng.integers(0, 20)))) for _ in range(100)]
    monkeypatch.setattr(score, "TOGETHER", 7)
    assert score.common_lengths([a for a, _ in many], [b for _, b in many]).tolist() == [naive(a, b) for a, b in many]
