"""Problem 9: garbled text from wrong character encoding.

Text in UTF-8 that was decoded under a legacy encoding is re-encoded under each
candidate and strictly decoded as UTF-8, token by token (a token is a run of signs
that only the candidate's upper half has). Each token gets the fall of a garbling
cost: how many signs it has too many, and how unlike writing it looks (capitals
inside words, symbols at letters, control characters, two scripts in one word).
Tokens that the candidate does not explain count against it. Stretches of tokens
whose sum passes a threshold, which rises with the number of places where chance
had an opportunity, are restored; the best candidate wins the round, and rounds go
on, for layers and for stretches under other encodings, until no cost falls.
Signs whose bytes were lost are marked by a replacement character.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.arrow import sliced, texts

#: Single-byte encodings that text may have been decoded with; the first of equal gain wins.
LATIN = ("cp1252", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-2", "cp1254", "cp852", "cp858", "iso8859-9", "cp1257")
#: Those whose upper half has the letters of another script, so that ordinary words can be valid by chance.
SCRIPT = ("cp1251", "cp866", "koi8-r", "iso8859-5", "mac_cyrillic", "iso8859-7", "cp1253", "cp1256", "cp874")
#: Double-byte encodings.
DOUBLE = ("gb18030", "big5hkscs", "cp932", "cp949", "euc_jp")

#: Signs that ordinary text of this corpus's scripts has; texts with no other sign are not looked at.
ORDINARY = "\\x00-\\x7fऀ-෿​-‍–—‘’“”⁠﻿"
OTHER = re.compile(f"[^{ORDINARY}]")
#: What restored text may hold: Indic scripts, Latin letters, punctuation and signs of typesetting, pictures.
GOOD = re.compile("[\x80-ſƒˆ˜̀-ͯऀ-෿Ḁ-ỿ‐-⁤₠-₿℀-™←-⇿∀-⋿①-➿ﬀ-ﬆ️﻿�\U0001f000-\U0001faff]+")
STRONG = re.compile("[ऀ-෿]")
UNASSIGNED = re.compile("[" + "".join(re.escape(chr(n)) for n in range(0x80, 0x3000) if unicodedata.category(chr(n)) == "Cn") + "]")
BEYOND = re.compile("[^\\x00-\\x7f]+")
#: Signs of Chinese, Japanese and Korean, which the double-byte readings give.
EAST = re.compile("[ぁ-鿿가-힣-｡-ﾟ]")
#: Only where two signs that are neither ASCII nor Indic meet, or an eastern one stands, can there be a garbled stretch.
HINT = re.compile("[^\\x00-\\x7fऀ-෿]{2}|" + EAST.pattern)
#: Marks that stand at letters in ordinary text.
TYPESET = frozenset("\xa0–—‘’‚“”„•…«»‹›·")

#: Symbols that stand at letters in ordinary text.
ATTACHED = frozenset("©®™°€£¥¢§¶†‡ªº")

#: Falls of cost: a sign of two bytes, of three, and of four (or a mark of typesetting, whose bytes hardly occur in words), by kind of candidate; each oddity; a lost sign; a token that isn't explained.
WORTH = {"latin": (0.5, 3.0, 3.0), "script": (0.5, 1.0, 2.0), "double": (0.5, 1.0, 3.0)}
#: Oddities: an unlikely place of a sign, two scripts in one word, a control character.
PLACE, MIXED, CONTROL = 2.0, 2.5, 2.0
LOST, UNEXPLAINED = -0.5, -3.0
#: The sum that a stretch has to reach.
LEAST = {"latin": 2.0, "script": 3.0, "double": 3.0}

_UNITS = (
    rb"(?P<good>(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+)"
    rb"|(?P<lost>%s[\xe0-\xef](?:[\x80-\xbf]\xff|\xff[\x80-\xbf\xff]?)|[\xc2-\xdf]\xff|\xf0(?:[\x80-\xbf]{2}\xff|[\x80-\xbf]\xff[\x80-\xbf\xff]?|\xff[\x80-\xbf\xff]{0,2})|\xff[\x80-\xbf]{0,2}|[\xe0-\xef][\x80-\xbf]\Z|\xf0[\x80-\xbf]{1,2}\Z|\A[\x80-\xbf]{1,2})"
    rb"|(?P<rest>.)"
)
#: Of a Latin candidate also a sequence whose last byte was dropped is known; among letters of other scripts that would fit words.
_UNIT = {kind: re.compile(_UNITS % (rb"[\xe0-\xef][\x80-\xbf](?=[\xc2-\xf4])|" if kind == "latin" else b""), re.S) for kind in ("latin", "script", "double")}


def kind_of(name: str) -> str:
    return "double" if name in DOUBLE else "script" if name in SCRIPT else "latin"


@functools.cache
def _signs(name: str) -> dict[str, int]:
    """The sign of each byte from 80; a byte that the encoding lacks is the control character of that number."""
    out = {}
    for b in range(0x80, 0x100):
        out[bytes([b]).decode(name, "replace")] = b
    out.pop("�", None)
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return {c: b for c, b in out.items() if len(c) == 1}


@functools.cache
def _single(name: str) -> tuple[re.Pattern, dict[int, int], frozenset[str], frozenset[str], re.Pattern]:
    """What finds tokens of a single-byte encoding, the byte of each sign (FF for a lost one), the signs that begin and go on a sequence, and what finds a sequence."""
    signs = _signs(name)

    def some(least: int, most: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in signs.items() if least <= b <= most) + "]"

    def begun(least: int, most: int, more: int) -> list[str]:
        return [some(least, most) + some(0x80, 0xBF) * more] if any(least <= b <= most for b in signs.values()) else []

    sequence = re.compile("|".join([*begun(0xC2, 0xDF, 1), *begun(0xE0, 0xEF, 2), *begun(0xF0, 0xF4, 3)]))
    token = re.compile("[" + "".join(map(re.escape, signs)) + "�]+")
    bytes_ = {ord(c): b if b < 0xFF else 0xFE for c, b in signs.items()} | {0xFFFD: 0xFF}
    return token, bytes_, frozenset(c for c, b in signs.items() if b >= 0xC2), frozenset(c for c, b in signs.items() if b <= 0xBF), sequence


@functools.cache
def _code(sign: str, name: str) -> bytes | None:
    """The bytes of a sign under a double-byte encoding, FF for a lost one, None if it has none."""
    if sign == "�":
        return b"\xff"
    try:
        code = sign.encode(name)
    except UnicodeError:
        return None
    return code.replace(b"\xff", b"\xfe")


def _double_tokens(text: str, name: str) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """Runs of signs beyond ASCII that the encoding has: begin, end, bytes, and where each sign's bytes begin."""
    for m in BEYOND.finditer(text):
        at, codes = m.start(), []
        for k in range(m.start(), m.end() + 1):
            own = _code(text[k], name) if k < m.end() else None
            if own is not None:
                codes.append(own)
                continue
            if codes:
                yield at, k, b"".join(codes), [0, *itertools.accumulate(map(len, codes))]
            at, codes = k + 1, []


def _script(c: str) -> str:
    """A rough script of a letter: the range that it lies in."""
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "latin"
    return "east" if n >= 0x2E80 else str(n >> 7)


def oddity(token: str, before: str, after: str, script_matters: bool) -> float:
    """How unlike writing a token looks in its place."""
    cost = 0.0
    whole = before + token + after
    for i, (a, b) in enumerate(zip(whole, whole[1:])):  # noqa: B905
        if a.isascii() and b.isascii():
            continue
        if a.islower() and b.isupper():
            cost += PLACE
        if "\x80" <= b <= "\x9f":
            cost += CONTROL
        if ("─" <= a <= "▟") != ("─" <= b <= "▟") and not (a.isascii() or b.isascii() or a.isspace() or b.isspace()):
            cost += PLACE
        if a.isalpha():
            if b in TYPESET:
                after_b = whole[i + 2 : i + 3]
                if after_b.isalpha() and (a in "ÃÂ" or b in "‘“„‚‹«"):
                    cost += PLACE
                elif a in "ÃÂ" and b == "\xa0" and not whole[i - 1 : i].isupper():
                    cost += PLACE
            elif not b.isascii() and not b.isalpha() and not b.isspace() and unicodedata.category(b) not in ("Mn", "Mc"):
                if not a.isascii() or unicodedata.category(b)[0] == "S" and b not in ATTACHED:
                    cost += PLACE
            elif a in "ÃÂĂ" and b.isalpha() and not b.isascii():
                cost += PLACE
            elif ("｡" <= a <= "ﾟ") != ("｡" <= b <= "ﾟ") and b.isalpha() and not a.isascii() and not b.isascii():
                cost += PLACE
            elif script_matters and b.isalpha() and _script(a) != _script(b) and "latin" in (_script(a), _script(b)):
                cost += MIXED
        elif b.isalpha() and not b.isascii() and (a.isascii() and a.isdigit() and b in "ÃÂ" or not a.isascii() and unicodedata.category(a) in ("Sm", "So") and a not in ATTACHED):
            cost += PLACE
        elif a in "ÃÂ" and not b.isascii() and not b.isalnum():
            cost += PLACE
    if "\x80" <= whole[:1] <= "\x9f":
        cost += CONTROL
    return cost


def _read(code: bytes, kind: str) -> tuple[list[tuple[int, int, str | None]], float, int, int] | None:
    """The units of a token's bytes (begin, end, text or None where lost), the fall of cost by its signs, how many bytes are explained, and how many signs are lost. None if it isn't explained."""
    units: list[tuple[int, int, str | None]] = []
    worth = WORTH[kind]
    fall, explained, lost, rest = 0.0, 0, 0, 0
    foreign: set[str] = set()  # letters of scripts that only a whole word of them makes likely
    for m in _UNIT[kind].finditer(code):
        if m.lastgroup == "good":
            new = m.group().decode()
            strange = BEYOND.findall(new)
            if UNASSIGNED.search(new):
                return None
            if any(not GOOD.fullmatch(s) for s in strange):
                foreign.update(c for s in strange for c in s if not GOOD.fullmatch(c))
                if kind != "latin" or not all(map(str.isalpha, foreign)) or len({ord(c) >> 8 if c < "⺀" else 0x2E for c in foreign}) > 1:
                    return None
                fall += 0.5 * sum(map(len, strange))
            else:
                for s in strange:
                    for c in s:
                        fall += worth[(c >= "ࠀ") + (c >= "\U00010000" or "\u2010" <= c <= "\u203f")]
            explained += sum(len(s.encode()) for s in strange)
            units.append((m.start(), m.end(), new))
        elif m.lastgroup == "lost":
            lost += 1
            fall += LOST
            units.append((m.start(), m.end(), None))
        else:
            rest += 1
            units.append((m.start(), m.end(), None))
    if not explained or rest and (kind != "latin" or rest * 3 > explained) or foreign and (rest or explained < 4):
        return None
    return units, fall + rest * UNEXPLAINED, explained, lost


#: Words repeat, so what was read of short ones is remembered (a bounded memo that changes nothing but the speed).
_read_short = functools.lru_cache(50_000)(_read)


def _stretches(parts: list[tuple], least: float) -> list[tuple]:
    """The parts of the stretches whose sum of falls (the first of each part) reaches `least`, in order; a stretch ends where its sum has sunk to 0, and what follows its top is looked at again."""
    out: list[tuple] = []
    pending = [parts]
    while pending:
        run: list[tuple] = []
        total = most = 0.0
        upto = 0
        for p in [*pending.pop(), (-math.inf,)]:
            total += p[0]
            if total > 0:
                run.append(p)
                if total > most:
                    most, upto = total, len(run)
                continue
            if most >= least:
                out += [q for q in run[:upto] if q[0] > 0]
                if upto < len(run):
                    pending.append(run[upto:])
            run, total, most, upto = [], 0.0, 0.0, 0
    return sorted(out, key=lambda q: q[1])


def _reread(text: str, name: str) -> tuple[str, float, int, int]:
    """The text with its stretches under `name` restored, the gain, how many signs that concerns, and how many signs are lost in them."""
    kind = kind_of(name)
    parts: list[tuple] = []
    against = 0
    if kind == "double":
        found = _double_tokens(text, name)
    else:
        token, bytes_, _, _, sequence = _single(name)
        found = ((m.start(), m.end(), old.translate(bytes_).encode("latin-1") if sequence.search(old := m.group()) else b"", None) for m in token.finditer(text))
    for start, end, code, places in found:
        got, cut = (_read_short if len(code) <= 64 else _read)(code, kind) if code else None, (0, 0)
        if got is None and code and places is None:  # marks at the edges may be as they were written
            old = text[start:end]
            left = len(old) - len(old.lstrip("‘’“”„«»–—…\xa0�"))
            right = len(old) - len(old.rstrip("‘’“”„«»–—…\xa0�"))
            for cut in ((left, 0), (0, right), (left, right)):
                if any(cut) and sum(cut) < len(old) and (got := _read(code[cut[0] : len(code) - cut[1]], kind)):
                    break
        if got is None:
            if "�" in text[start:end]:
                continue  # too little is left of it to say anything
            if kind != "latin" and any(map(str.isalpha, text[start:end])):
                against += 1
                parts.append((UNEXPLAINED,))
            continue
        start, end = start + cut[0], end - cut[1]
        units, fall, explained, lost = got
        if fall < LEAST[kind]:
            odd = oddity(text[start:end], text[max(0, start - 1) : start], text[end : end + 1], kind != "latin")
            fall = fall + odd if odd or kind != "latin" else 0.0
        if fall <= 0:
            continue
        if places is None:
            new = "".join(n if n is not None else "�" if b"\xff" in code[a + cut[0] : b + cut[0]] else text[start + a : start + b] for a, b, n in units)
        else:
            # where no letter of three bytes is near, a lost mark keeps the sign that its other bytes gave
            index = {} if STRONG.search("".join(n or "" for _, _, n in units)) else {p: k for k, p in enumerate(places)}
            new = "".join(n if n is not None else text[start + index[a] : start + index[b]] if a in index and b in index else "�" for a, b, n in units)
        parts.append((fall, start, end, new, explained, lost))
    least = LEAST[kind] + (math.log1p(against) if kind != "latin" else 0.0)
    out, at, gain, met, lost = [], 0, 0.0, 0, 0
    for _, start, end, new, explained, gone in _stretches(parts, least):
        out += [text[at:start], new]
        at = end
        gain += explained - 3 * gone
        met += end - start
        lost += gone
    return "".join([*out, text[at:]]), max(gain, 0.5) if out else 0.0, met, lost


def _weight(text: str) -> int:
    """The signs beyond ASCII, eastern ones twice; undoing a layer leaves fewer."""
    return sum(map(len, BEYOND.findall(text))) + len(EAST.findall(text))


def _rounds(text: str, complete: bool) -> tuple[str, list[str], bool]:
    """The text restored, the encodings undone in order, and whether nothing was lost. `complete`: only by candidates that leave no unusual sign unexplained."""
    used: list[str] = []
    whole = True
    weight = _weight(text)
    while HINT.search(text):
        signs = set(text)
        odd = len(OTHER.findall(text))
        best, most, which, gone = "", 0.0, "", 0
        for name in (*LATIN, *SCRIPT, *DOUBLE):
            if name in DOUBLE:
                if not EAST.search(text):
                    break
            else:
                leads, follow = _single(name)[2:4]
                if leads.isdisjoint(signs) or follow.isdisjoint(signs):
                    continue
            new, gain, met, lost = _reread(text, name)
            if gain > most and (met >= odd or not complete) and _weight(new) < weight:
                best, most, which, gone = new, gain, name, lost
                if met >= odd and not lost:
                    break  # nothing is left to explain
        if not most:
            break
        text, weight = best, _weight(best)
        whole = whole and not gone
        used.append(which)
    return text, used, whole


def _all_rounds(text: str) -> tuple[str, list[str], bool]:
    """As _rounds: first what one encoding explains as a whole, then line by line, as lines may come from different places, then what only the text together shows."""
    text, used, whole = _rounds(text, True)
    if "\n" in text and HINT.search(text):
        lines = text.split("\n")
        known: set[tuple[str, ...]] = set()
        for k, line in enumerate(lines):
            lines[k], more, ok = _rounds(line, False)
            if tuple(more) not in known:
                known.add(tuple(more))
                used += more
            whole = whole and ok
        text = "\n".join(lines)
    text, more, ok = _rounds(text, False) if HINT.search(text) else (text, [], True)
    return text, used + more, whole and ok and "�" not in text


def restored(text: str) -> tuple[str, int, list[str]]:
    """The text with garbled stretches restored as far as they can be, how many layers or encodings were undone, and their names.

    Rounds go on until none lowers the weight of the text, so there is no bound on layers and encodings.
    """
    text, used, _ = _all_rounds(text)
    return text, len(used), used


def is_garbled(text: str) -> bool:
    """Whether a stretch can be restored, or a replacement character, which only a decoder that failed writes, remains."""
    return "�" in text or bool(_all_rounds(text)[1])


def _scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    ids = batch.column(0).to_pylist()
    for i, t in zip(ids, texts(batch.column(1)), strict=True):
        if t and OTHER.search(t):
            new, used, whole = _all_rounds(t)
            if used or "�" in t:
                rows.append((i, new, used, whole))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.bool_())], names=["id", "text", "encodings", "whole"])


def garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a garbled stretch: (`id_col`, text restored as far as possible, encodings undone in order, whole).

    `whole` is false where a sign's bytes were lost or a replacement character remains.
    Null and empty texts are never garbled; repeated rows each come out. No shuffle.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(sliced(_scan, "t"), "id BIGINT, text STRING, encodings ARRAY<STRING>, whole BOOLEAN").withColumnRenamed("id", id_col)
