import itertools
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from khata.llm import glyphs

SAME = [
    ("ড়", "ড়"),
    ("ো", "ো"),
    ("কৌ", "কৌ"),
    ("কমেন্টেব়", "কমেন্টের"),
    ("অাজ", "আজ"),
    ("café", "café"),
    ("Ｔｈｅ", "The"),
    ("ofﬁce", "office"),
    ("Thе", "The"),
    ("Ανο", "Avo"),
    ("a b", "a b"),
    ("a b", "a b"),
    ("a​b﻿", "ab"),
    ("so­ft", "soft"),
    ("ক‌ল", "কল"),
    ("ক্‌ ", "ক্ "),
    ("2012‑02", "2012-02"),
    ("ত্‍", "ৎ"),
    ("a\r ", "a\n\n"),
    ("ẋ̣", "ẋ̣"),
]
APART = [("a  b", "a b"), ("a\tb", "a b"), ("a\nb", "a b"), ("A", "a"), ("m²", "m2"), ("ক্‌ষ", "ক্ষ"), ("র‍্য", "র্য"), ("র", "ৰ"), ("a–b", "a-b"), ("é", "e")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert glyphs.canonical(a) == glyphs.canonical(b)


@pytest.mark.parametrize(("a", "b"), APART)
def test_apart(a, b):
    assert glyphs.canonical(a) != glyphs.canonical(b)


@given(st.lists(st.text(max_size=20), max_size=6))
def test_a_batch_gives_what_each_text_gives(many):
    assert glyphs.canonical_all(many) == [glyphs.canonical(t) for t in many]


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=30))
def test_forms_of_one_text_are_equal_and_stay(text):
    done = glyphs.canonical(text)
    assert glyphs.canonical(unicodedata.normalize("NFD", text)) == done == glyphs.canonical(unicodedata.normalize("NFC", text))
    assert glyphs.canonical(done) == done


def test_pairs_against_brute_force(documents):
    texts = [None, "", "...", "a b", "a b", "a b", "a  b", "ড়", "ড়", "x" * 5000, "x" * 4999 + "х", "​a b", "!!", "​!!"]
    got = {tuple(r) for r in glyphs.same_looking_pairs(documents(texts)).collect()}
    shown = lambda t: any(unicodedata.category(c)[0] in "LNS" for c in t)
    expected = {(i + 1, j + 1) for i, j in itertools.combinations(range(len(texts)), 2) if (a := texts[i]) and (b := texts[j]) and a != b and shown(a) and glyphs.canonical(a) == glyphs.canonical(b)}
    assert got == expected and expected


def test_classes_count_the_pairs(documents):
    many = ["a b", "a b", "a\u00a0b", "a\u2009b", "x", "x", None, "", "Thе", "The", "ՕꓐᎪ", "OBA"]
    df = documents(many)
    links = {}
    for a, b in ((r[0], r[1]) for r in glyphs.same_looking_pairs(df).collect()):
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = {r["doc_id"]: (r["class_id"], r["text_id"], r["n_links"]) for r in glyphs.same_looking_classes(df).collect()}
    assert {i: n for i, (_, _, n) in got.items()} == links and len(links) == 8
    assert got[2] == (1, 1, 2) and got[4] == (1, 4, 3) and got[12][0] == 11


def test_no_rows(documents):
    empty = documents(["a"]).limit(0)
    assert glyphs.same_looking_classes(empty).count() == 0
    assert glyphs.same_looking_pairs(empty).count() == 0
    assert glyphs.canonical_texts(empty).count() == 0


def test_canonical_texts_keep_null_and_empty(documents):
    got = {r["doc_id"]: r["text"] for r in glyphs.canonical_texts(documents([None, "", "Thе", "Thе"])).collect()}
    assert got == {1: None, 2: "", 3: "The", 4: "The"}


def test_many_copies_meet_only_what_differs(spark):
    docs = spark.range(1500).selectExpr("id as doc_id", "case when id = 7 then 'thе same' else 'the same' end as text")
    pairs = glyphs.same_looking_pairs(docs)
    assert pairs.count() == 1499 and pairs.where("doc_a = 7 OR doc_b = 7").count() == 1499
