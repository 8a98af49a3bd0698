import time

import pytest

from khata.llm import quality
from khata.llm.prepare import prepared

BN = "নদীর ধারে কারখানার শ্রমিকেরা জানায় যে মাছের খামার নতুন করে তৈরি হয়েছে।"
EN = "The farmers of the village said that they had not seen so much rain before the end of spring."

PROSE = [
    EN,
    BN,
    f"{BN} {BN}",
    "\n".join([EN, EN, EN]),
    "\n".join(EN.split()),
    EN.lower().replace(".", ""),
    f"- {EN}\n- {EN}",
    BN.encode().decode("latin-1"),
    f"{EN}\n{EN}\n- tea\n- milk",
]
JUNK = [
    "| 1 | a |\n|---|---|\n| 2 | b |\n| 3 | c |",
    "tea\t12\t13\t14\nmilk\t5\t6\t7",
    "12,tea,5,2020-01-01\n13,milk,6,2020-01-02",
    "tea .......... 12\nmilk ......... 14\nrice ..... 16",
    "• the old bridge\n• the rice seeds\n• Rupganj",
    "1. the old bridge\n2) Rupganj\n3. tea",
    "tea: 12\nmilk: 13\nrice: the old bridge",
    "Home » News » Sports » Login\nHome | News | Sports | 123",
    "https://a.example/1\nhttps://b.example/2?x=1",
    "2020-01-01 10:00:00 INFO worker-1 shard=3 took=4ms\n2020-01-01 10:00:01 WARN worker-2 shard=3 took=4ms",
    "9f86d081884c7d659a2feaa0c55ad015\n60303ae22b998861bce3b28f33eec1be",
    "%&/{}[]<>#*~ ^@\\|=+\n&%$ {}[] <>#*~^@",
    "the old bridge Rupganj 123 Rupganj the old bridge 123 123 the old bridge Rupganj Rupganj",
    "12 kg rice\n3 pcs old boats\n7 l milk",
    "tea, milk, rice, the old bridge, Rupganj, the winter vegetables, boats, the pond",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert quality.Page(prepared([text])[0]).is_prose()


@pytest.mark.parametrize("text", JUNK)
def test_junk(text):
    page = quality.Page(prepared([text])[0])
    assert not page.is_prose(), page.chars
    assert not quality.Page(prepared([f"{text}\n{EN[:40]}"])[0]).chars.keys() <= {"prose"}


def test_punctuation_only_is_no_case(documents):
    assert quality.not_prose(documents(["!!!!!!", "-----\n....", "%%%% +++= <>|"])).collect() == [(3,)]


def test_half_decides():
    row = "tea\t12\t13\t14\n"
    assert quality.Page(EN + "\n" + row * 2).is_prose()
    assert not quality.Page(EN + "\n" + row * 20).is_prose()


def test_table(documents):
    df = documents([None, "", "  \n", "...", EN, JUNK[0], JUNK[0], EN * 2000])
    assert sorted(r[0] for r in quality.not_prose(df).collect()) == [6, 7]
    stats = {r["doc_id"]: r for r in quality.text_stats(df).collect()}
    assert len(stats) == 8 and stats[5]["words"] == 19 and stats[5]["share_ended"] == 1.0 and stats[5]["is_prose"]
    assert stats[1]["words"] == 0 and stats[1]["is_prose"] is None and stats[1]["mean_word_length"] is None
    assert stats[6]["reasons"][0]["rule"] == "words with a letter" and stats[6]["is_prose"] is False
    assert all(r["value"] < r["threshold"] and r["chars"] > 0 for r in stats[6]["reasons"]) and stats[5]["reasons"] == [] == stats[8]["reasons"]
    assert quality.not_prose(df.limit(0)).count() == quality.text_stats(df.limit(0)).count() == 0


def test_a_line_of_more_than_a_million_words():
    page = quality.Page("said rice " * 600_000)
    assert (page.words, page.common) == (1_200_000, 600_000)


@pytest.mark.parametrize("sign", [".", " ", "|", "7", " .", "a", "a,", "- "])
def test_a_line_of_a_megabyte_takes_time_in_proportion(sign):
    text = sign * (1_000_000 // len(sign))
    began = time.perf_counter()
    quality.Page(text)
    assert time.perf_counter() - began < 2


def test_long_texts_are_judged_in_pieces_as_a_whole(monkeypatch):
    text = "\n".join([EN, "tea\t12\t13\t14", BN, "- milk", "- rice"] * 40)
    whole = quality.Page(text)
    monkeypatch.setattr(quality, "TOGETHER", 200)
    parts = quality.Page(text)
    assert (parts.words, parts.common, parts.is_prose()) == (whole.words, whole.common, whole.is_prose())
    assert sum(parts.chars.values()) == pytest.approx(sum(whole.chars.values()), rel=0.05)


def test_texts_of_a_batch_do_not_mix():
    many = [EN, JUNK[0], "", "tea", JUNK[5], BN, "\n", EN]
    pages = quality.Pages(many)
    assert pages.prose().tolist() == [quality.Page(t).is_prose() for t in many]
    assert pages.prose_lines()[0] == [EN] and pages.prose_lines()[5] == [BN] and pages.prose_lines()[1] == []
