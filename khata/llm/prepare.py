"""Texts made ready for reading: garbled stretches restored, unusual characters in their usual form."""

from __future__ import annotations

import re

from khata.llm import garble, glyphs

#: Anything beyond ASCII, Indic scripts and usual marks, or not drawn, or not the usual space.
UNUSUAL = re.compile("[^\\x09\\x0a\\x20-\\x7e\u0900-\u0dff\u2013\u2014\u2018\u2019\u201c\u201d]")
#: Letters with marks in the form that normalization gives them.
USUAL = (("\u09df", "\u09af\u09bc"), ("\u09dc", "\u09a1\u09bc"), ("\u09dd", "\u09a2\u09bc"), ("\u09c7\u09be", "\u09cb"), ("\u09c7\u09d7", "\u09cc"), ("\u09ac\u09bc", "\u09b0"), ("\u0985\u09be", "\u0986"))
CONTROL = re.compile(r"<\|[^<>|\s]*\|>")


def usual(word: str) -> str:
    for a, b in USUAL:
        if a in word:
            word = word.replace(a, b)
    return word


def prepared(many: list[str | None]) -> list[str]:
    """The texts, null as empty, control tokens as line breaks."""
    out: list[str] = []
    odd: list[int] = []
    for i, t in enumerate(many):
        if not t:
            out.append("")
            continue
        if UNUSUAL.search(t):
            t = garble.restored(t)[0]
            odd.append(i)
        else:
            t = usual(t)
        out.append(CONTROL.sub("\n", t) if "<|" in t else t)
    for i, t in zip(odd, glyphs.canonical_all([out[i] for i in odd]), strict=True):
        out[i] = t
    return out
