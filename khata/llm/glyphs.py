"""Problem 2: visually identical text with different characters.

Texts are exploded into positioned code points, one array for a whole batch.
Look-up tables that every worker builds by rule from the Unicode data (the
decomposition and look-alike mappings) replace them, combining marks are put in
canonical order, marked letters that are drawn like a plain one are joined, and
joiners stay only where they change a conjunct. The array is then cut back into
the strings, or hashed per document to find texts that look the same.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.arrow import sliced, texts
from khata.session import written

# Letters drawn like a plain one, in the order of the plain ones. The scope: letters of Cyrillic, Greek, Armenian, Cherokee, Lisu and phonetic
# script that common fonts give the outline of one ASCII letter in the same case, marks likewise, and dandas. Wide, narrow, styled-by-width and
# ligature forms, marks and white space follow from the Unicode data. Letters that only resemble each other (I, l and 1; O and 0; rn and m) stay apart.
LOOKALIKES = {
    "АВЕКМНОРСТУХЅІЈԌԚԜӀѴ": "ABEKMHOPCTYXSIJGQWIV",
    "асеһіјорѕхуԁԛԝӏѵ": "acehijopsxydqwlv",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ανιορυϲϳ": "aviopucj",
    "ɡɑ": "ga",
    "ҮϹͿ": "YCJ",
    "ՕօոսհՏ": "OonuhS",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏆᏙᏚᏞᏟᏢᏦᏴ": "DRTAJEWMHGZIVSLCPKB",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
    "−꞉∶ʼ": "-::’",
    "৷": "।",
}
# A base and the mark after it, drawn like a single letter.
MARKED = {"ব়": "র", "অা": "আ"}
VIRAMAS = "্्"
ZWNJ, ZWJ = 0x200C, 0x200D
SIZE = 0x110000
DROP = -1


def _plain(cp: int) -> str | None:
    """What a code point is replaced by, without its place in a word; None if by itself, empty if it isn't drawn."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if ch in "\t\n":
        return None
    if ch in "\r\x85\u2028\u2029":
        return "\n"
    if kind == "Zs":
        return " "
    if cp in (ZWNJ, ZWJ):
        return None
    if kind in ("Cc", "Cf") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return ""
    how = unicodedata.decomposition(ch)
    if how.startswith(("<wide>", "<narrow>", "<noBreak>")) or how.startswith("<compat>") and ("LIGATURE" in unicodedata.name(ch, "") or "ROMAN NUMERAL" in unicodedata.name(ch, "") or cp == 0xB5):
        ch = unicodedata.normalize("NFKC", ch)
    ch = unicodedata.normalize("NFD", ch)
    ch = "".join(_lookalikes().get(c, c) for c in ch)
    return None if ch == chr(cp) else ch


@functools.cache
def _lookalikes() -> dict[str, str]:
    found = {a: b for many, plain in LOOKALIKES.items() for a, b in zip(many, plain, strict=True)}
    return found | {"\u2010": "-"}


@functools.cache
def tables() -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The mapping by code point (-1 dropped, -2-k the k-th expansion), the expansions, combining classes, consonants, and whether a sign is a letter, digit or symbol."""
    to = np.arange(SIZE, dtype=np.int32)
    more: list[np.ndarray] = []
    marks = np.zeros(SIZE, np.uint8)
    consonant = np.zeros(SIZE, bool)
    shown = np.zeros(SIZE, bool)
    shown[0x20000:0x33480] = shown[0x3400:0xA000] = shown[0xAC00:0xD7A4] = True
    shown[0xE000:0xF900] = shown[0xF0000:SIZE] = False
    rest = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
    for cp in rest:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        shown[cp] = kind[0] in "LNS"
        marks[cp] = unicodedata.combining(ch)
        plain = _plain(cp)
        if plain == "":
            to[cp] = DROP
        elif plain is not None and len(plain) == 1:
            to[cp] = ord(plain)
        elif plain is not None:
            to[cp] = -2 - len(more)
            more.append(np.array([ord(c) for c in plain], np.int32))
    to[0xFFF9:0xFFFC] = DROP
    for a, b in ((0x0995, 0x09BA), (0x0915, 0x093A), (0x09DC, 0x09E0), (0x0958, 0x0960), (0x09F0, 0x09F2)):
        consonant[a:b] = True
    return to, more, marks, consonant, shown


def _at(points: np.ndarray, step: int) -> np.ndarray:
    """The code point `step` places further on, 0 beyond the ends."""
    out = np.zeros_like(points)
    if step > 0:
        out[:-step] = points[step:]
    else:
        out[-step:] = points[:step]
    return out


def _joined(points: np.ndarray, consonant: np.ndarray) -> np.ndarray:
    """Khanda ta for its older spelling; joiners only where, next to a virama between two consonants, they change the conjunct."""
    join = (points == ZWJ) | (points == ZWNJ)
    if not join.any():
        return points
    virama = np.isin(points, [ord(c) for c in VIRAMAS])
    ta = (points == 0x09A4) & (_at(points, 1) == 0x09CD) & (_at(points, 2) == ZWJ)
    if ta.any():
        points = points.copy()
        at = np.flatnonzero(ta)
        points[at] = 0x09CE
        keep = np.ones(len(points), bool)
        keep[at + 1] = keep[at + 2] = False
        points = points[keep]
        join, virama = join[keep], virama[keep]
    # what stands around a joiner once other joiners are gone
    idle = join & ~((_at(virama, -1) | _at(virama, 1)))
    if idle.any():
        points, join, virama = points[~idle], join[~idle], virama[~idle]
    base = consonant[points] | (points == 0x09BC) | (points == 0x093C)
    after = join & _at(virama, -1) & _at(base, -2) & _at(consonant[points], 1)
    before = join & _at(virama, 1) & _at(base, -1) & _at(consonant[points], 2)
    return points[~join | after | before]


def _ordered(points: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Combining marks in the order of their classes."""
    rank = marks[points]
    wrong = np.flatnonzero((rank[1:] > 0) & (rank[:-1] > rank[1:]))
    if not len(wrong):
        return points
    run = np.cumsum(rank == 0)
    at = np.flatnonzero(rank)
    at = at[np.isin(run[at], run[wrong])]
    points = points.copy()
    points[at] = points[at[np.lexsort((at, rank[at], run[at]))]]
    return points


def canonical_points(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the canonical forms, one after another, and where each text begins and ends (n + 1 offsets, a NUL after each)."""
    to, more, marks, consonant, _ = tables()
    joined = "\0".join(t.replace("\0", "") if "\0" in t else t for t in many).replace("\r\n", "\n") + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)
    ends = points == 0
    points = to[points]
    points[ends] = 0
    gone = points == DROP
    if gone.any():
        points = points[~gone]
    wide = np.flatnonzero(points < -1)
    if len(wide):
        size = np.ones(len(points), np.int64)
        which = -2 - points[wide]
        lengths = np.array([len(m) for m in more])
        size[wide] = lengths[which]
        first = np.cumsum(size) - size
        points = np.repeat(points, size)
        for k in range(int(lengths[which].max())):
            has = lengths[which] > k
            points[first[wide[has]] + k] = np.array([m[k] if len(m) > k else 0 for m in more], np.int32)[which[has]]
    points = _joined(points, consonant)
    points = _ordered(points, marks)
    for pair, plain in MARKED.items():
        at = np.flatnonzero((points[:-1] == ord(pair[0])) & (points[1:] == ord(pair[1])))
        if len(at):
            points = points.copy()
            points[at] = ord(plain)
            points = np.delete(points, at + 1)
    stops = np.flatnonzero(points == 0)
    return points, np.concatenate([[0], stops + 1])


def canonical(text: str) -> str:
    """One text in its canonical form, recomposed."""
    return canonical_all([text])[0]


def canonical_all(many: list[str]) -> list[str]:
    if not many:
        return []
    points, at = canonical_points(many)
    whole = points.astype("<i4").tobytes().decode("utf-32-le", "surrogatepass").split("\0")
    return [unicodedata.normalize("NFC", t) for t in whole[: len(many)]]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _looks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    shown = tables()[4]
    ids, many = batch.column(0), texts(batch.column(1))
    kept = [i for i, t in enumerate(many) if t]
    out: list[tuple] = []
    if kept:
        some = [many[i] for i in kept]
        points, at = canonical_points(some)
        signs = np.add.reduceat(shown[points], at[:-1])  # every text has at least its NUL
        for k, i in enumerate(kept):
            if signs[k]:
                look = xxhash.xxh3_128_digest(points[at[k] : at[k + 1]].data)
                raw = xxhash.xxh3_128_digest(some[k].encode("utf-8", "surrogatepass"))
                out.append((i, *_halves(look), *_halves(raw)))
    rows = list(zip(*out, strict=True)) if out else [[]] * 5
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), *(pa.array(r, pa.int64()) for r in rows[1:])], names=["id", "look_hi", "look_lo", "raw_hi", "raw_lo"])


def looks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, a 128-bit fingerprint of what each text looks like, and one of the text itself.

    Null and empty texts, and those without any letter, digit or symbol, give no row.
    Repeated rows and ties each give their own row; columns other than the two named are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(sliced(_looks, "t"), "id BIGINT, look_hi BIGINT, look_lo BIGINT, raw_hi BIGINT, raw_lo BIGINT")


def same_looking_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs doc_a < doc_b whose texts are different strings but look the same.

    Classes of equal strings are paired first, their members joined to them after,
    so that a large group of exact copies never meets itself: the work follows the
    number of pairs that are asked for.
    """
    members = written(looks(docs, id_col, text_col), "looks")
    look, raw = ["look_hi", "look_lo"], ["raw_hi", "raw_lo"]
    ends = [f(c).alias(f"{name}_{c}") for c in raw for name, f in (("min", F.min), ("max", F.max))]
    mixed = members.groupBy(*look).agg(*ends).where("min_raw_hi != max_raw_hi OR min_raw_lo != max_raw_lo").select(*look)
    members = written(members.join(mixed, look, "left_semi"), "mixed")  # what follows reads these few only
    classes = members.select(*look, *raw).distinct()
    a = classes.select(*look, F.col("raw_hi").alias("a_hi"), F.col("raw_lo").alias("a_lo"))
    b = classes.select(*look, F.col("raw_hi").alias("b_hi"), F.col("raw_lo").alias("b_lo"))
    pairs = a.join(b, look).where(F.struct("a_hi", "a_lo") < F.struct("b_hi", "b_lo"))
    of = lambda side: members.select(F.col("id").alias(f"{side}_id"), *look, F.col("raw_hi").alias(f"{side}_hi"), F.col("raw_lo").alias(f"{side}_lo"))
    found = pairs.join(of("a"), [*look, "a_hi", "a_lo"]).join(of("b"), [*look, "b_hi", "b_lo"])
    return found.where("a_id != b_id").select(F.least("a_id", "b_id").alias("doc_a"), F.greatest("a_id", "b_id").alias("doc_b"))


def same_looking_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, class_id, text_id, n_links): the documents that look like one of another text, without writing out the pairs.

    `class_id` is the smallest id of all that look alike, `text_id` that of those with
    the same string, `n_links` how many documents look the same and are different
    strings. Counts are summed before they travel, and a hot class is a count, not a
    group in one task.
    """
    members = written(looks(docs, id_col, text_col), "looks")
    look, raw = ["look_hi", "look_lo"], ["raw_hi", "raw_lo"]
    by_text = members.groupBy(*look, *raw).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("text_id"))
    by_look = by_text.groupBy(*look).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("strings"), F.min("text_id").alias("class_id")).where("strings > 1").drop("strings")
    classes = by_text.join(by_look, look).select(*look, *raw, "class_id", "text_id", (F.col("total") - F.col("n")).alias("n_links"))
    return members.join(classes, [*look, *raw]).select(F.col("id").alias(id_col), "class_id", "text_id", "n_links")


def _canonical_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    many = texts(batch.column(1))
    kept = [i for i, t in enumerate(many) if t]
    done: list[str | None] = list(many)
    for i, t in zip(kept, canonical_all([many[i] for i in kept]), strict=True):
        done[i] = t
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=["id", "text"])


def canonical_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text in its canonical form: (`id_col`, `text`). A null text stays null, an empty one empty."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(sliced(_canonical_batch, "t"), "id BIGINT, text STRING").withColumnRenamed("id", id_col)
