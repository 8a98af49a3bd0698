"""Problem 3: per-document text quality statistics.

Every line gets its statistics from arrays over the code points of a whole batch:
words, words with a letter, word lengths, symbols, bullets, marks at the end, common
words and the most frequent pair of words. The published thresholds for documents
are applied to stretches of a document (a line, or neighbouring lines of fewer than
five words together), each failure with its reason. A document is not prose when
more than half of its characters lie in stretches that fail.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.arrow import sliced, texts
from khata.llm.prepare import prepared, usual
from khata.llm.words import CLAUSE

COMMON = frozenset(usual(w) for w in CLAUSE)
#: What a word is rid of before it is looked up.
_KEPT = r"[^\w\u0900-\u0963\u0966-\u096f\u0971-\u09f6\u09f8-\u0dff]+"
EDGES = re.compile(f"^{_KEPT}|{_KEPT}$")

# Published thresholds. Shares of words with a letter, mean word length, hash marks and ellipses a word, lines with a bullet,
# and characters in the most frequent pair of words are those of the Gopher rules; lines ending in punctuation is that of FineWeb; the least words of a line that is judged by itself that of C4.
LEAST_ALPHABETIC, LONGEST_MEAN, MOST_SYMBOLS, MOST_BULLETS, MOST_PAIR = 0.8, 10.0, 0.1, 0.9, 0.2
LEAST_ENDED, LEAST_WORDS = 0.12, 5
#: A line with a bullet is a sentence all the same if it has the two stop words. Two stop words in the fifty words that a document has at least (Gopher), as a rate, and from STOPS_FROM words on at least two.
LEAST_COMMON, STOPS_FROM = 0.04, 20
#: The rules in the order in which reasons are given: name and threshold.
RULES = (("words with a letter", LEAST_ALPHABETIC), ("mean word length", LONGEST_MEAN), ("symbols a word", MOST_SYMBOLS), ("lines with a bullet", MOST_BULLETS), ("characters in the most frequent pair", MOST_PAIR), ("common words", LEAST_COMMON))
#: Code points that are looked at together; a longer line is judged in parts that end at white space.
TOGETHER = 1 << 20
SPACE, LETTER, DIGIT, CLOSER, TERMINAL, BULLET, MARK, PICTURE, DASH = (1 << k for k in range(9))


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The classes of each code point as bits, and its lower case."""
    kind = np.zeros(0x110000, np.uint16)
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)]:
        c = chr(cp)
        category = unicodedata.category(c)
        kind[cp] = SPACE * c.isspace() | LETTER * (category[0] == "L" or category in ("Mn", "Mc")) | DIGIT * (category[0] == "N") | MARK * (category[0] in "PS") | PICTURE * (category in ("So", "Sk") or cp in (0x200D, 0xFE0F)) | DASH * (category == "Pd")
        if len(c.lower()) == 1:
            lower[cp] = ord(c.lower())
    for a, b in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x33480)):
        kind[a:b] = LETTER
    for signs, bit in (("\"'”’)]»", CLOSER), (".!?।॥৷…", TERMINAL), ("•◦▪‣●○■□►▶➢✓✔★☆*–—→·+-", BULLET)):
        for c in signs:
            kind[ord(c)] |= bit
    return kind, lower


#: Powers of an odd number, one for each place in a word; words of more signs share the last.
_POWER = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)
_MIX, _LINE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[end] - total[start]


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the code points, where words begin and end, and a fingerprint of each word's letters and digits."""
    kind, lower = _classes()
    k = kind[points]
    ink = (k & SPACE) == 0
    edge = np.diff(np.concatenate([[0], ink.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept = (k & (LETTER | DIGIT)) > 0
    nth = np.cumsum(kept)
    word = np.maximum(np.cumsum(edge[:-1] == 1) - 1, 0)
    place = np.minimum(nth - 1 - (np.concatenate([[0], nth])[start][word] if len(start) else 0), 63)
    with np.errstate(over="ignore"):
        mixed = np.where(kept, lower[points].astype(np.uint64) * _MIX * _POWER[np.maximum(place, 0)], np.uint64(0))
        return k, start, end, _sums(mixed, start, end)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


@functools.cache
def _common() -> np.ndarray:
    return np.unique(_words(_points("\n".join(sorted(COMMON))))[3])


#: What is known of each line: the document, where it begins and ends in its block, and counts.
COUNTS = ("words", "plain", "alphabetic", "signs", "letters", "common", "ended", "ellipses", "hashes", "bullet", "marks", "pair", "chars")


def _lines(block: str) -> dict[str, np.ndarray]:
    """Statistics of the lines with words in a block of texts, which NULs set apart."""
    p = _points(block)
    k, start, end, word = _words(p)
    real = p[start] != 0
    text, line = np.cumsum(p == 0)[start[real]], np.cumsum(p == 10)[start[real]]
    start, end, word = start[real], end[real], word[real]
    if not len(start):
        return {name: np.zeros(0, np.int64) for name in (*COUNTS, "text", "from", "to")}
    first = np.concatenate([[True], line[1:] != line[:-1]])
    at = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    last = np.concatenate([at[1:], [len(line)]]) - 1
    n = len(at)

    def count(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, n)

    def having(bits: int) -> np.ndarray:
        return _sums(((k & bits) > 0).astype(np.int64), start, end)

    letters, inks, size = having(LETTER), having(LETTER | DIGIT), end - start
    low, high = start[at], end[last]
    # bullets: one sign or two of those that stand before items, or a number or letter with a point or bracket
    own = np.zeros(len(p) + 1, np.int64)
    head, head_letters, head_inks, head_size = at, letters[at], inks[at], size[at]
    closed = np.isin(p[end[head] - 1], (46, 41))
    bullet = (head_size <= 3) & (having(BULLET)[head] == head_size) | closed & ((head_size <= 6) & (head_letters == 0) & (head_inks > 0) | (head_size <= 3) & (head_letters == 1))
    dashes = having(DASH) == size
    dashes[at[bullet]] = True  # a bullet is no word
    counted = ~dashes
    # the last sign that isn't a closing mark or a picture
    telling = np.maximum.accumulate(np.where((k & (CLOSER | SPACE | PICTURE)) == 0, np.arange(len(p)), -1))[high - 1]
    inside = telling >= low
    telling = np.maximum(telling, 0)
    ended = inside & ((k[telling] & TERMINAL) > 0)
    dots = (p == 46) & np.concatenate([[False], p[:-1] == 46]) & np.concatenate([[False] * 2, p[:-2] == 46]) & ~np.concatenate([[False] * 3, p[:-3] == 46])
    own = dots | (p == 0x2026)
    ellipses = _sums(own.astype(np.int64), low, high) - (inside & ((p[telling] == 0x2026) | (p[telling] == 46) & (p[np.maximum(telling - 1, 0)] == 46)))
    pair = np.zeros(n)
    if len(of) > 1:
        same = of[1:] == of[:-1]
        with np.errstate(over="ignore"):
            both = (word[1:] ^ (word[:-1] * _LINE))[same] ^ of[1:][same].astype(np.uint64) * _POWER[0]
        _, which, times = np.unique(both, return_inverse=True, return_counts=True)
        space = np.bincount(which, (size[1:] + size[:-1])[same])
        np.maximum.at(pair, of[1:][same], np.where(times >= 3, space, 0)[which])
    return {
        "text": text[at], "from": low, "to": high, "words": count(inks > 0), "plain": count(counted), "alphabetic": count(counted & (letters > 0)), "signs": count(np.where(counted, size, 0)), "letters": count(inks), "common": count(np.isin(word, _common()) & (inks > 0)),
        "ended": ended, "ellipses": np.maximum(ellipses, 0), "hashes": _sums((p == 35).astype(np.int64), low, high), "bullet": bullet, "marks": count(having(MARK)), "pair": pair, "chars": high - low,
    }


class Pages:
    """Prepared texts judged together: statistics and failures by text, and the lines of prose."""

    def __init__(self, many: list[str]):
        self.n = len(many)
        blocks: list[str] = []
        parts: list[dict[str, np.ndarray]] = []
        held: list[tuple[int, str]] = []
        size = 0

        def close() -> None:
            nonlocal held, size
            if held:
                block = "".join(t + "\n\0\n" for _, t in held)
                own = _lines(block)
                own["text"] = np.array([i for i, _ in held], np.int64)[own["text"]]
                own["block"] = np.full(len(own["text"]), len(blocks))
                blocks.append(block)
                parts.append(own)
            held, size = [], 0

        for i, t in enumerate(many):
            for piece in _pieces(t):
                if size + len(piece) > TOGETHER:
                    close()
                held.append((i, piece))
                size += len(piece)
        close()
        names = (*COUNTS, "text", "from", "to", "block")
        self.lines = {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64) for name in names}
        self._blocks = blocks
        self._judge()

    def _judge(self) -> None:
        own = self.lines
        m = len(own["text"])
        short = own["words"] < LEAST_WORDS
        new = np.ones(m, bool)
        new[1:] = ~(short[1:] & short[:-1] & (own["text"][1:] == own["text"][:-1]))
        self.of = np.cumsum(new) - 1
        n = int(new.sum())
        u = {name: np.bincount(self.of, own[name], n) for name in COUNTS if name != "pair"}
        u["pair"] = np.zeros(n)
        np.maximum.at(u["pair"], self.of, own["pair"])
        lines = np.bincount(self.of, minlength=n)
        self.unit_text = own["text"][new]
        words = np.maximum(u["plain"], 1)
        self.values = (u["alphabetic"] / words, u["signs"] / words, (u["hashes"] + u["ellipses"]) / words, u["bullet"] / np.maximum(lines, 1), u["pair"] / np.maximum(u["signs"], 1), u["common"] / words)
        a, length, symbols, bullets, pair, common = self.values
        few = (common < LEAST_COMMON) & (u["plain"] >= LEAST_WORDS - 1) | (u["common"] < 2) & (u["plain"] >= STOPS_FROM)
        sentences = u["ended"] > LEAST_ENDED * lines
        self.failed = (a < LEAST_ALPHABETIC, length > LONGEST_MEAN, symbols > MOST_SYMBOLS, (bullets > MOST_BULLETS) & ~sentences & (u["common"] < 2 * lines), (pair > MOST_PAIR) & ~sentences, few)
        self.bad = np.any(self.failed, axis=0) if n else np.zeros(0, bool)
        self.unit_chars = u["chars"]
        self.total = np.bincount(self.unit_text, u["chars"], self.n)
        self.bad_chars = np.bincount(self.unit_text, u["chars"] * self.bad, self.n)

    def prose(self) -> np.ndarray:
        """Whether at most half of each text's characters lie in stretches that fail."""
        return 2 * self.bad_chars <= self.total

    def by_text(self, name: str) -> np.ndarray:
        return np.bincount(self.lines["text"], self.lines[name], self.n)

    def prose_lines(self) -> list[list[str]]:
        """The lines of prose of each text."""
        out: list[list[str]] = [[] for _ in range(self.n)]
        own = self.lines
        for j in np.flatnonzero(~self.bad[self.of]) if len(self.of) else ():
            out[own["text"][j]].append(self._blocks[own["block"][j]][own["from"][j] : own["to"][j]])
        return out

    def reasons(self) -> list[list[dict]]:
        """For each text that isn't prose the rules that stretches of it fail: name, mean value there, threshold, and the characters in these stretches."""
        out: list[list[dict]] = [[] for _ in range(self.n)]
        prose = self.prose()
        for (rule, threshold), value, failed in zip(RULES, self.values, self.failed, strict=True):
            size = np.bincount(self.unit_text[failed], self.unit_chars[failed], self.n)
            mean = np.bincount(self.unit_text[failed], (value * self.unit_chars)[failed], self.n) / np.maximum(size, 1)
            for i in np.flatnonzero((size > 0) & ~prose):
                out[i].append({"rule": rule, "value": float(mean[i]), "threshold": threshold, "chars": int(size[i])})
        return out


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of at most about TOGETHER signs, cut at line breaks, or at other white space in longer lines."""
    at = 0
    while len(text) - at > TOGETHER:
        end = text.rfind("\n", at, at + TOGETHER)
        if end <= at:
            end = text.rfind(" ", at, at + TOGETHER)
        end = end if end > at else at + TOGETHER
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:] if at else text


class Page:
    """One prepared text: characters by failed rule (prose under 'prose'), counts, and the lines of prose."""

    def __init__(self, text: str):
        self._pages = pages = Pages([text])
        self.words, self.common = int(pages.by_text("words")[0]), int(pages.by_text("common")[0])
        self.chars = {rule: int(pages.unit_chars[failed].sum()) for (rule, _), failed in zip(RULES, pages.failed, strict=True) if failed.any()}
        if (~pages.bad).any():
            self.chars["prose"] = int(pages.unit_chars[~pages.bad].sum())
        self.prose = pages.prose_lines()[0]

    def is_prose(self) -> bool:
        return bool(self._pages.prose()[0])


def has_content(text: str) -> bool:
    """Whether a text has any letter, digit or symbol; one of punctuation only is neither prose nor junk."""
    return any(unicodedata.category(c)[0] in "LNS" for c in text)


STATS = "id BIGINT, words BIGINT, mean_word_length DOUBLE, symbol_ratio DOUBLE, lines BIGINT, share_ended DOUBLE, share_marked DOUBLE, share_common DOUBLE, share_prose DOUBLE, is_prose BOOLEAN, reasons ARRAY<STRUCT<rule: STRING, value: DOUBLE, threshold: DOUBLE, chars: BIGINT>>"
_REASONS = pa.list_(pa.struct([("rule", pa.string()), ("value", pa.float64()), ("threshold", pa.float64()), ("chars", pa.int64())]))


def _share(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """a / b, null over nothing."""
    return pa.array(a / np.maximum(b, 1), pa.float64(), mask=b == 0)


def _stats(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ready = prepared(texts(batch.column(1)))
    pages = Pages(ready)
    words, lines = pages.by_text("words"), np.bincount(pages.lines["text"], minlength=pages.n)
    known = np.array([bool(t) and has_content(t) for t in ready], bool)
    yield pa.RecordBatch.from_arrays(
        [
            batch.column(0), pa.array(words.astype(np.int64)), _share(pages.by_text("letters"), words), _share(pages.by_text("marks"), np.array([len(t) for t in ready], np.int64)), pa.array(lines.astype(np.int64)), _share(pages.by_text("ended"), lines),
            _share(pages.by_text("bullet"), lines), _share(pages.by_text("common"), words), _share(pages.total - pages.bad_chars, pages.total), pa.array(pages.prose(), pa.bool_(), mask=~known), pa.array(pages.reasons(), _REASONS),
        ],
        names=["id", "words", "mean_word_length", "symbol_ratio", "lines", "share_ended", "share_marked", "share_common", "share_prose", "is_prose", "reasons"],
    )


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics and a verdict for every document, with a reason for each rule that one which isn't prose fails.

    Shares and means over nothing are null. `is_prose` is null for null, empty or
    blank texts and those of a few marks only. Documents that pass have no reason.
    Repeated rows each come out. No shuffle.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(sliced(_stats, "t", 4 << 20), STATS).withColumnRenamed("id", id_col)


def _verdicts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ready = prepared(texts(batch.column(1)))
    at = [i for i in np.flatnonzero(~Pages(ready).prose()).tolist() if has_content(ready[i])]
    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64()))], names=["id"])


def not_prose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which more than half of the characters belong to lists, tables or junk, by the rules of text_stats."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(sliced(_verdicts, "t", 4 << 20), "id BIGINT").withColumnRenamed("id", id_col)
