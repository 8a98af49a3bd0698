"""Text functions on columns, with the semantics of Unicode-aware string methods."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space: what a Unicode-aware split() splits on, as signs and as a pattern. Java's \s knows ASCII only, with (?U) all but U+001C to U+001F.
SPACE_SIGNS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = r"(?U)[\s\x1c-\x1f]+"
WORD = r"(?U)[^\s\x1c-\x1f]+"

# The control tokens of the text format.
BN, EN = "<|lang_bn|>", "<|lang_en|>"
BN_EN, EN_BN = "<|task_translate_bn_en|>", "<|task_translate_en_bn|>"
CONTROL = r"<\|[^>]+\|>"


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


_nfc = _nfc.asNondeterministic()  # else the optimizer copies it into filters and calls it once for each copy


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfc(c: str | Column) -> Column:
    """Unicode NFC. ASCII text, which it can't change, is not sent to Python; null stays null."""
    c = _col(c)
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, c).otherwise(_nfc(F.when(~ascii_only, c)))


def strip(c: str | Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(_col(c), F.lit(SPACE_SIGNS))


def collapse(c: str | Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), SPACES, " "))


def normalize_text(c: str | Column) -> Column:
    """NFC on one line with single spaces."""
    return collapse(nfc(c))


def normalize_doc(c: str | Column) -> Column:
    """NFC with paragraphs kept: at most one blank line in a row, nothing at the ends."""
    return strip(F.regexp_replace(nfc(c), r"\n{3,}", "\n\n"))


def word_count(c: str | Column) -> Column:
    """The number of words; 0 for a blank text, null for null."""
    return F.regexp_count(_col(c), F.lit(WORD))


def words(c: str | Column) -> Column:
    """The words in order."""
    return F.filter(F.split(_col(c), SPACES), lambda w: w != "")


def prefixed(tag: str, c: str | Column) -> Column:
    return F.concat(F.lit(tag), _col(c))


def content_key(c: str | Column) -> Column:
    """The digest under which a field is compared with held-out material."""
    return F.sha2(F.lower(strip(c)), 256)


def segments(c: str | Column) -> Column:
    """The control tokens of a text, each with the text after it, in order; text before the first has an empty tag."""
    parts = F.split(_col(c), rf"(?={CONTROL})")
    parts = F.filter(parts, lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, f"^({CONTROL})?", 0).alias("tag"), F.regexp_replace(p, f"^{CONTROL}", "").alias("body")))


# Language tokens, by what a lower-cased language_region holds or is; the first rule that fits counts.
LANGUAGE_RULES = (
    ("<|lang_code|>", ("code",), ("python",)),
    ("<|lang_bnls|>", ("banglish", "bnls"), ()),
    ("<|lang_mix|>", ("mix",), ()),
    ("<|lang_en|>", (), ("en", "english")),
    ("<|lang_wbn|>", ("wb", "west"), ()),
)


def language_token(region: str | Column) -> Column:
    """The language token that a language_region calls for; Bangla where no rule fits or it is null."""
    r = F.coalesce(F.lower(_col(region)), F.lit(""))
    out = F.lit(BN)
    for token, holds, equals in reversed(LANGUAGE_RULES):
        fits = F.lit(False)
        for part in holds:
            fits = fits | r.contains(part)
        out = F.when(fits | r.isin(*equals) if equals else fits, F.lit(token)).otherwise(out)
    return out


# Tokens of sentiment labels.
SENTIMENT = {"positive": "<|positive|>", "negative": "<|negative|>", "neutral": "<|neutral|>", "mixed": "<|mixed|>", "offensive": "<|offensive|>"}


def script_counts(c: str | Column, first: str = "\u0980", last: str = "\u09ff") -> Column:
    """Signs of a script's block, ASCII digits, ASCII letters and all others."""
    c = _col(c)
    own, digits, latin = (F.regexp_count(c, F.lit(p)) for p in (f"[{first}-{last}]", "[0-9]", "[A-Za-z]"))
    return F.struct(own.alias("own"), digits.alias("digits"), latin.alias("latin"), (F.length(c) - own - digits - latin).alias("other"))


#: Upper bounds (exclusive) and names of the word-count classes.
BANDS = ((50, "20-50"), (100, "50-100"), (200, "100-200"), (500, "200-500"), (1000, "500-1k"), (2000, "1k-2k"), (5000, "2k-5k"), (10000, "5k-10k"))
LAST_BAND = "10k+"


def band(n: str | Column) -> Column:
    """The class of a word count."""
    out = None
    for bound, name in BANDS:
        out = F.when(_col(n) < bound, name) if out is None else out.when(_col(n) < bound, name)
    return out.otherwise(LAST_BAND)
