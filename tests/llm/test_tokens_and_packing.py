import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from khata.llm import packing, tokens

from .conftest import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no tokenizer here")

TEXTS = [None, "", " ", "Hello  world\n\n  it's", "আমি বাংলায়", "a b\x1c c  d", "<|endoftext|> x", "word " * 3000, "z" * 4000, "\U0001f600‍!", "\t\t\ttab   end   ", "Hello  world\n\n  it's"]


def plain(text):
    return tokens.encoding().encode_ordinary(text) if text else []


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x85  a'1.")), max_size=60))
@settings(max_examples=300)
def test_chunks_give_the_ids_of_the_whole(text):
    assert np.frombuffer(tokens.token_bytes(text), np.int32).tolist() == plain(text)


def test_corpus_ids_and_lengths(documents):
    df = documents(TEXTS)
    expected = {i + 1: plain(t) for i, t in enumerate(TEXTS)}
    encoded = tokens.encode_corpus(df)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == expected
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_lengths(df).collect()} == {i: len(x) for i, x in expected.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in expected.items() if x}
    raw = {r["doc_id"]: bytes(r["raw"]) for r in tokens.decode_corpus(encoded).collect()}
    assert raw == {i + 1: (t or "").encode() for i, t in enumerate(TEXTS)}
    for operator in (tokens.encode_corpus, tokens.token_lengths, tokens.token_counts):
        assert operator(df.limit(0)).count() == 0


def test_hot_pieces_are_spread_and_exact(spark):
    df = spark.createDataFrame([(i, "the same words here") for i in range(2000)], "doc_id BIGINT, text STRING")
    assert {r["n_tokens"] for r in tokens.token_counts(df).collect()} == {len(plain("the same words here"))}


def test_own_pieces_of_every_code_point():
    encode = tokens.encoding().encode_ordinary
    for start in range(0, 0x110000, 0x400):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}\n" for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        got = [i for chunk in tokens.CHUNK.findall(text) for p in tokens.pieces_of(chunk) for i in tokens.encoding()._core_bpe.encode_single_piece(p.encode())]
        assert got == encode(text), hex(start)


@pytest.mark.parametrize("sign", [" ", "\t", "\n", "a", "\u00a0"])
@pytest.mark.parametrize("n", [1_000_000])
def test_long_runs(sign, n):
    own = tokens.encoding()._core_bpe.encode_single_piece
    run = sign * n
    got = np.frombuffer(tokens.token_bytes(f"b{run}c d{run}"), np.int32)
    if sign == "a":
        expected = [*own(f"b{run}c".encode()), *own(f" d{run}".encode())]
    elif sign == " ":
        expected = [*own(b"b"), *own(run[1:].encode()), *own(b" c"), *own(b" d"), *own(run.encode())]
    else:
        expected = [*own(b"b"), *own(run[1:].encode()), *own(sign.encode()), *own(b"c"), *own(b" d"), *own(run.encode())]
    assert got.tolist() == expected


@pytest.mark.parametrize("n", [4095, 4096, 4097, 4098, 5000])
@pytest.mark.parametrize("run", [" ", "\n", "\t ", "\u3000"])
def test_runs_about_the_length_where_they_are_cut(n, run):
    text = f"x{run * n}y{run * n}"
    assert np.frombuffer(tokens.token_bytes(text), np.int32).tolist() == plain(text)


def test_each_piece_is_tokenized_once(spark):
    df = spark.createDataFrame([(i, f"the same words here {i % 7} {'z' * 40}") for i in range(500)], "doc_id BIGINT, text STRING").repartition(4)
    lengths = tokens.piece_lengths(df)
    pieces = lengths.collect()
    assert len(pieces) == len({r["key"] for r in pieces}) == 4 + 7 + 1
    assert {r["docs"] for r in pieces} == {500, 72, 71}


@pytest.mark.parametrize("hot", [0, 3, 50_000])
def test_hot_pieces_change_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(tokens, "HOT_PIECES", hot)
    many = [t for t in TEXTS if t] + ["common words " * 8000 + f"own{k} {'y' * 90}{k}" for k in range(12)]  # documents of 100 KB
    df = spark.createDataFrame(list(enumerate(many)), "doc_id BIGINT, text STRING")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(plain(t)) for i, t in enumerate(many)}


def test_lone_surrogates_have_ids():
    assert np.frombuffer(tokens.token_bytes("a\ud800b"), np.int32).tolist() == plain("a�b")


def test_budget(spark, rows):
    docs = spark.createDataFrame([(1, "a b", "Wiki-Bangla", "BD"), (2, None, "wiki_bangla", "BD"), (3, "a", "other", "und"), (4, "a", None, None)], "doc_id BIGINT, text STRING, source STRING, language_region STRING")
    sources = spark.createDataFrame([("wiki_bangla", "bn")], "source STRING, domain STRING")
    got = {tuple(r) for r in tokens.token_budget(docs, sources).collect()}
    assert got == {("wiki_bangla", "BD", "bn", 2, 2), ("other", None, None, 1, 1), (None, None, None, 1, 1)}


def check(packed, lengths, capacity):
    boxes, pieces = {}, {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
        if r["n_tokens"]:
            boxes[r["container"]] = boxes.get(r["container"], 0) + r["n_tokens"]
        else:
            assert r["container"] is None
    assert all(n <= capacity for n in boxes.values())
    for i, n in lengths.items():
        own = sorted(pieces[i])
        assert sum(x for _, x in own) == (n or 0) and [k for k, _ in own] == list(range(len(own)))
        assert all(x == capacity for _, x in own[:-1])
    return boxes


@pytest.mark.parametrize("seed", [0, 1])
def test_packing_is_valid_and_tight(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = {i: int(n) for i, n in enumerate(rng.gamma(2, 180, 3000).astype(int))}
    lengths |= {-1: None, -2: 0, -3: 2048, -4: 5000}
    df = spark.createDataFrame(list(lengths.items()), "doc_id BIGINT, n_tokens BIGINT")
    boxes = check(packing.pack_lengths(df).collect(), lengths, 2048)
    total = sum(n or 0 for n in lengths.values())
    assert len(boxes) <= 1.012 * total / 2048 + 1
    report = packing.fill_report(packing.pack_lengths(df)).first()
    assert report["tokens"] == total and report["containers"] == len(boxes)


def test_the_program_covers_the_demand_without_waste():
    rng = np.random.default_rng(0)
    demand = np.bincount(np.clip(np.exp(rng.normal(5, 1, 50_000)).astype(int), 1, 512), minlength=513)
    found = packing.fillings(demand, 512)
    served = sum(x * counts for counts, x in found)
    assert np.allclose(served, demand) and all(counts @ np.arange(513) <= 512 for counts, _ in found)
    size, start, containers, times, first = packing.plan(demand, 512)
    assert (first + containers).max() <= 1.0005 * packing.least_containers(demand, 512) + 1
    assert packing.left_to_rounding(demand, 512) < 0.05


@pytest.mark.parametrize("values", [[], [5], [7, 7, 7], [10] * 11, [1, 9, 5, 5, 10, 25], [6] * 9])
def test_small_packings(spark, values):
    lengths = dict(enumerate(values))
    df = spark.createDataFrame(list(lengths.items()), "doc_id BIGINT, n_tokens BIGINT")
    boxes = check(packing.pack_lengths(df, 10).collect(), lengths, 10)
    assert len(boxes) >= -(-sum(values) // 10)


def test_hot_length_over_many_ranking_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_TASK", 50)
    lengths = {i: 1000 if i % 3 else 300 + i for i in range(600)}
    df = spark.createDataFrame(list(lengths.items()), "doc_id BIGINT, n_tokens BIGINT")
    check(packing.pack_lengths(df).collect(), lengths, 2048)


def test_documents(documents):
    assert packing.pack_documents(documents(TEXTS)).where("n_tokens = 0").count() == 2
