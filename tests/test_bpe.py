import os
import random

import pytest
from pyspark.sql import functions as F

from khata.functions import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"), reason="no tokenizer here")

TEXTS = [None, "", " ", "Hello  world\n\n it's", "আমি বাংলায় গান গাই", "a b\x1c c\u2003d", "\U0001f600\u200d!", "internationalization " * 3, "\t\ttab   ", "b" + " " * 6000 + "c"]


def plain(text):
    return bpe._byte_bpe(bpe.FOLDER).encode_ordinary(text)


def test_ids_and_back(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i INT, t STRING")
    got = {r["i"]: (r["ids"], r["back"]) for r in df.select("i", bpe.encoded("t").alias("ids"), bpe.decoded(bpe.encoded("t")).alias("back")).collect()}
    assert got == {i: (None, None) if t is None else (plain(t), t) for i, t in enumerate(TEXTS)}


def test_cut_texts_hold_whole_signs(spark):
    df = spark.createDataFrame([(n, TEXTS[4] + " \U0001f600") for n in range(60)], "n INT, t STRING")
    for r in df.select("n", "t", bpe.decoded(F.slice(bpe.encoded("t"), F.lit(1), F.col("n"))).alias("cut")).collect():
        assert r["t"].startswith(r["cut"]) and "\ufffd" not in r["cut"]


def test_metrics_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice(TEXTS)) for _ in range(60)]
    got = {r["g"]: r for r in bpe.tokenizer_metrics(spark.createDataFrame(rows, "g STRING, text STRING"), ["g"]).collect()}
    for g in "ab":
        texts = [t for k, t in rows if k == g and t is not None]
        tokens, words = sum(len(plain(t)) for t in texts), sum(max(len(t.split()), 1) for t in texts)
        each = [w for t in texts for w in t.split()]
        r = got[g]
        assert (r["docs"], r["tokens"]) == (len(texts), tokens)
        assert r["fertility"] == pytest.approx(tokens / words, abs=6e-4) and r["compression"] == pytest.approx(sum(map(len, texts)) / tokens, abs=6e-3)
        assert r["hyper_fragmented_pct"] == pytest.approx(100 * sum(len(plain(w)) > 3 for w in each) / len(each), abs=6e-3)
        assert r["round_trip_fail_pct"] == 0 == r["unknown_pct"]


def test_signs_without_a_piece(spark):
    own = bpe._piece_bpe(bpe.FOLDER)
    rows = [("a\U00010330 \U00010330ক",), ("b দ \u4e00",), (None,), ("",)]
    got = {r["sign"]: r["n"] for r in bpe.unknown_signs(spark.createDataFrame(rows, "text STRING")).collect()}
    expected = {}
    for (t,) in rows:
        for c in t or "":
            if c != " " and any(own.is_byte(i) for i in own.encode(c)):
                expected[c] = expected.get(c, 0) + 1
    assert got == expected and got["\U00010330"] == 2


def test_empty_table(spark):
    none = spark.createDataFrame([], "g STRING, text STRING")
    assert bpe.tokenizer_metrics(none, ["g"]).count() == bpe.unknown_signs(none).count() == 0
