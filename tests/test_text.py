import unicodedata

import pytest
from pyspark.sql import functions as F

from khata.functions import prompts
from khata.functions import text as X

SIGNS = ["a\xa0b\x1cc d \x85e​f", "", "  ", None, " x ", "one\ntwo\tthree", "　 q"]


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "t STRING").select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text", SIGNS)
def test_words_are_those_of_split(spark, text):
    expected = None if text is None else text.split()
    assert one(spark, text, X.words("t")) == expected
    assert one(spark, text, X.word_count("t")) == (None if text is None else len(expected))
    assert one(spark, text, X.collapse("t")) == (None if text is None else " ".join(expected))
    assert one(spark, text, X.strip("t")) == (None if text is None else text.strip())


@pytest.mark.parametrize("text", ["é", "plain", "য়", "য়", "ো", None, ""])
def test_nfc(spark, text):
    assert one(spark, text, X.nfc("t")) == (None if text is None else unicodedata.normalize("NFC", text))


def test_normalize_doc_keeps_one_blank_line(spark):
    assert one(spark, "\n a\n\n\n\nb\n\nc \t", X.normalize_doc("t")) == "a\n\nb\n\nc"


def test_segments(spark):
    got = one(spark, "<|task_translate_bn_en|><|lang_bn|>x y<|lang_en|>z", X.segments("t"))
    assert [tuple(s) for s in got] == [("<|task_translate_bn_en|>", ""), ("<|lang_bn|>", "x y"), ("<|lang_en|>", "z")]
    assert [tuple(s) for s in one(spark, "plain", X.segments("t"))] == [("", "plain")]
    assert one(spark, "", X.segments("t")) == []


@pytest.mark.parametrize(("region", "token"), [("BD", X.BN), ("WB", "<|lang_wbn|>"), ("EN", X.EN), ("BNLS", "<|lang_bnls|>"), ("MIX", "<|lang_mix|>"), ("python", "<|lang_code|>"), (None, X.BN), ("BN_EN_parallel", X.BN)])
def test_language_token(spark, region, token):
    assert one(spark, region, X.language_token("t")) == token


def test_bands_are_upper_exclusive(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (0, 49, 50, 999, 1000, 10_000)], "n INT").select(X.band("n")).collect()]
    assert got == ["20-50", "20-50", "50-100", "500-1k", "1k-2k", "10k+"]


def test_chat_in_order_of_turn(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "k INT, turn INT, role STRING, content STRING")
    assert prompts.chat(df, ["k"], ask=True).first()["chat"] == "<|im_start|><|user|>\na<|im_end|>\n<|im_start|><|assistant|>\nb<|im_end|>\n<|im_start|><|assistant|>\n"


def test_sizes_and_times(spark):
    assert one(spark, "2048", prompts.shown_size(F.col("t").cast("long"))) == "2.0 KB"
    assert one(spark, "3723", prompts.shown_time(F.col("t").cast("long"))) == "1h 02m 03s"
    assert one(spark, "59", prompts.shown_time(F.col("t").cast("long"))) == "59s"


def test_templates_expand_nothing_in_values(spark):
    from khata.functions import ids, prompts

    df = spark.createDataFrame([("{b} x", "y")], "a STRING, b STRING")
    row = df.select(prompts.filled("{a}|{b}|{c}", a="a", b="b").alias("one"), prompts.few_shot("{a}={b}", [{"a": "1", "b": "2"}], "\n", a="a", b="b").alias("two"), prompts.joined_pair("a", "b").alias("three")).first()
    assert tuple(row) == ("{b} x|y|{c}", "1=2\n{b} x=y", "{b} x । y")
    shards = spark.createDataFrame([(0, 0, 5), (1, 5, 5), (2, 5, 30)], "shard INT, start LONG, stop LONG")
    got = ids.located(spark.range(31).withColumnRenamed("id", "at"), "at", shards, block=4).collect()
    assert sorted((r["at"], r["shard"], r["row"]) for r in got) == [(k, 0, k) for k in range(5)] + [(k, 2, k - 5) for k in range(5, 30)]
