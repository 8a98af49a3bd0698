import pytest
from pyspark.sql import functions as F

from khata.operators import ingest, pack
from khata.operators import normalize as N


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_pair_checks(spark):
    pairs = [(1, words(3), words(3), None), (2, words(2), words(3), None), (3, words(10), words(4), 2.0), (4, words(4), words(10), 1.0), (5, words(10), words(3), None), (6, None, words(3), None), (7, words(3), words(3), 1.0)]
    df = spark.createDataFrame(pairs, "pair_id LONG, bn STRING, en STRING, score DOUBLE")
    got = {r["pair_id"]: r["fails"] for r in ingest.pair_checks(df).collect()}
    assert got == {1: None, 2: "short", 3: None, 4: "score", 5: "ratio", 6: "empty", 7: "score"}


def test_pair_dedup_and_mirror(spark, rows):
    df = spark.createDataFrame([(1, "a b c", "x y z", None, "s"), (2, "a b c", "q r s", None, "s")], "pair_id LONG, bn STRING, en STRING, score DOUBLE, source STRING")
    kept = ingest.pair_dedup(ingest.good_pairs(df))
    assert rows(kept.select("pair_id")) == [(1,)]
    assert rows(ingest.mirrored(kept).select("direction", "text", "word_count")) == [
        ("bn_en", "<|task_translate_bn_en|><|lang_bn|>a b c<|lang_en|>x y z", 6),
        ("en_bn", "<|task_translate_en_bn|><|lang_en|>x y z<|lang_bn|>a b c", 6),
    ]


def test_sources_under_any_spelling(spark, rows):
    docs = spark.createDataFrame([(1, " Wiki-Bangla"), (2, "else"), (3, None)], "doc_id LONG, source STRING")
    sources = spark.createDataFrame([("wiki_bangla", 1, "bn")], "source STRING, priority INT, domain STRING")
    assert rows(ingest.with_source(docs, sources).select("doc_id", "name", "priority")) == [(1, "wiki_bangla", 1), (2, "other", 99), (3, "other", 99)]


def test_content_filter(spark, rows):
    df = spark.createDataFrame([(1, "Please LOGIN now"), (2, "loginname"), (3, None), (4, "read  more"), (5, "| a | b | c | d | e | f ")], "i LONG, text STRING")
    assert rows(ingest.content_filter(df, ["login"], [r"read\s+more"], r"(\|\s*\w+\s*){6,}").select("i")) == [(2,), (3,)]


GOLDEN = {"ঃ": "standalone_nasalization", "ে": "standalone_vowel_sign", "৳": "symbol", "়": "standalone_mark", "ঃঃ": "repeated_char", "্": "standalone_halant", "িং": "mixed_diacritics", "ঌ": "other_single_char", "িা": "stacked_vowel_signs", "ঁং": "stacked_nasal_marks", "৵৹": "other_multi_char", "": None}


def test_failure_classes(spark):
    df = spark.createDataFrame([(t,) for t in GOLDEN] + [(None,)], "t STRING").select("t", N.failure_class("t").alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == GOLDEN | {None: None}


@pytest.mark.parametrize(("policy", "text", "failed"), [("drop", "ক ক্ষ", []), ("keep_original", "ক ে ক্ষ", []), ("collect", "ক ে ক্ষ", [(1, "ে")]), ("drop_and_collect", "ক ক্ষ", [(1, "ে")])])
def test_policies(spark, policy, text, failed):
    df = spark.createDataFrame([("ক ে  ক্্ষ",)], "t STRING").select(N.normalize_words("t", policy).alias("n"))
    got = df.first()["n"]
    assert got["text"] == text
    assert [tuple(f) for f in got["failed"]] == failed


def test_error_policy_and_unknown(spark):
    df = spark.createDataFrame([("ক ে",)], "t STRING")
    with pytest.raises(Exception, match="not normalizable"):
        df.select(N.normalize_words("t", "error")).collect()
    with pytest.raises(ValueError):
        N.normalize_words("t", "other")
    assert spark.createDataFrame([(None,)], "t STRING").select(N.normalize_words("t").alias("n")).first()["n"] is None


def test_only_bangla_segments_are_normalized(spark):
    df = spark.createDataFrame([("<|task_translate_bn_en|><|lang_bn|>ক ে খ<|lang_en|>z ে",)], "t STRING").select(N.normalize_segments("t").alias("n"))
    got = df.first()["n"]
    assert got["text"] == "<|task_translate_bn_en|><|lang_bn|>ক খ<|lang_en|>z ে"
    assert got["failed"] == ["ে"]


def test_packing_toy_case(spark, rows):
    docs = [(1, [1, 2, 3, 9]), (2, [4, 9]), (3, [5, 6, 7, 8, 9]), (4, []), (5, None)]
    df = spark.createDataFrame(docs, "doc_id LONG, ids ARRAY<INT>")
    assert rows(pack.packed(df, "ids", "doc_id", 4, 1)) == [(0, 0, [1, 2, 3, 9]), (1, 0, [4, 9, 5, 6])]
    assert pack.packed(df.limit(0), "ids", "doc_id", 4).count() == 0


def test_packing_against_a_loop(spark, rows):
    docs = [(i, [i * 100 + k for k in range(i * 7 % 23)]) for i in range(40)]
    flat = [t for _, ids in docs for t in ids]
    df = spark.createDataFrame(docs, "doc_id LONG, ids ARRAY<INT>")
    got = [r["input_ids"] for r in pack.packed(df, "ids", "doc_id", 8, 1000).orderBy("seq").collect()]
    assert got == [flat[k : k + 8] for k in range(0, len(flat) - 7, 8)]


def test_segment_lengths_and_entropy(spark, rows):
    df = spark.createDataFrame([(0, 0, [7, 3, 8, 9, 3, 5, 3, 3])], "shard INT, seq INT, input_ids ARRAY<INT>")
    assert [r[3] for r in rows(pack.segment_lengths(df))] == [1, 2, 1]
    counts = pack.token_counts(df, ["shard"])
    assert round(pack.entropy(counts, ["shard"]).first()["bits"], 6) == 2.0
    assert tuple(pack.densities(df).first())[2:] == (4, 0)
    assert pack.shard_audit(df, 8).first()["valid_shape"]
    assert {(r["n"], r["first_rank"], r["tokens"]) for r in pack.zipf(counts).collect()} == {(4, 1, 1), (1, 2, 4)}


def test_hash_ids(spark):
    import hashlib

    got = spark.createDataFrame([("ab cd",)], "t STRING").select(pack.token_ids(F.col("t")).alias("x")).first()["x"]
    assert got == [146 + int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 47854 for w in ("ab", "cd")] + [3]
