"""Public tokenizers as columns. Their files are local: `KHATA_TOKENIZERS`, or a parameter, names the folder."""

from __future__ import annotations

import base64
import functools
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions.text import SPACES, WORD

FOLDER = os.environ.get("KHATA_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE, PIECE_BPE = "byte_bpe_50k", "piece_bpe_32k"
#: The pattern that byte_bpe_50k splits text by before its merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern has it; a text is cut before white space that follows something else, where the pattern always cuts.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Runs of white space of more signs are cut by rule; matching them takes a stack that follows their length.
LONG_RUN = 4096
_RUN = re.compile(f"[{SPACE}]+")
#: What a worker remembers of chunks and words, at most.
_MOST = 300_000


def cut(chunk: str) -> tuple[str, str]:
    """A chunk's long run of white space that is a piece of its own, and the rest: before other signs the pattern leaves the run's last sign to them."""
    m = _RUN.match(chunk) if len(chunk) > LONG_RUN else None
    if m is None or m.end() <= LONG_RUN:
        return "", chunk
    end = m.end() if m.end() == len(chunk) else m.end() - 1
    return chunk[:end], chunk[end:]


@functools.cache
def _byte_bpe(folder: str):
    import tiktoken

    with open(os.path.join(folder, f"{BYTE_BPE}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(BYTE_BPE, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _piece_bpe(folder: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{PIECE_BPE}.model"))


class _Ids(dict):
    """Chunk -> its ids; forgets everything once _MOST chunks are held."""

    def __init__(self, folder: str):
        super().__init__()
        self.own = _byte_bpe(folder)

    def __missing__(self, chunk: str) -> list[int]:
        run, rest = cut(chunk)
        if run:
            return self.own._core_bpe.encode_single_piece(run.encode()) + self.own.encode_ordinary(rest)
        ids = self.own.encode_ordinary(chunk)
        if len(chunk) <= 64:
            if len(self) >= _MOST:
                self.clear()
            self[chunk] = ids
        return ids


@functools.cache
def _memo(folder: str) -> _Ids:
    return _Ids(folder)


def _lists(many: list[list[int] | None]) -> pa.Array:
    return pa.array(many, pa.list_(pa.int32()))


def encoded(text: str | Column, folder: str = FOLDER) -> Column:
    """The ids of a text by byte_bpe_50k, without special tokens; null for null."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(column: pa.Array) -> pa.Array:
        known = _memo(folder).__getitem__
        return _lists([None if t is None else [i for c in CHUNK.findall(t) for i in known(c)] for t in column.to_pylist()])

    return ids(text)


def decoded(ids: str | Column, folder: str = FOLDER) -> Column:
    """The text of a list of ids; bytes that are no whole sign at the end of a cut list are left out, others become U+FFFD."""

    @F.arrow_udf(T.StringType())
    def text(column: pa.Array) -> pa.Array:
        own = _byte_bpe(folder)
        return pa.array([None if i is None else _whole(own.decode_bytes(i)) for i in column.to_pylist()], pa.string())

    return text(ids)


def _whole(raw: bytes) -> str:
    for cut in range(min(3, len(raw)) + 1):
        tail = raw[len(raw) - cut - 1 : len(raw) - cut] if cut < len(raw) else b""
        if cut == 0 and tail < b"\x80":
            break
        if tail >= b"\xc2":  # an open sequence begins here
            need = 2 if tail < b"\xe0" else 3 if tail < b"\xf0" else 4
            return (raw if cut + 1 >= need else raw[: len(raw) - cut - 1]).decode("utf-8", "replace")
    return raw.decode("utf-8", "replace")


def cut_text(text: str | Column, most: int, folder: str = FOLDER) -> Column:
    """A text cut to its first `most` tokens."""
    return decoded(F.slice(encoded(text, folder), 1, most), folder)


@functools.cache
def _word_lengths(folder: str) -> dict[str, int]:
    return {}


def measured(text: str | Column, folder: str = FOLDER) -> Column:
    """struct<tokens, round_trip, long_words>: the tokens of a text, whether decoding them gives it back but for white space, and its words of more than three tokens, each word encoded by itself."""
    kind = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("long_words", T.LongType())])

    @F.arrow_udf(kind)
    def measure(column: pa.Array) -> pa.Array:
        own, known, lengths = _byte_bpe(folder), _memo(folder).__getitem__, _word_lengths(folder)
        rows = []
        for t in column.to_pylist():
            if t is None:
                rows.append(None)
                continue
            ids = [i for c in CHUNK.findall(t) for i in known(c)]
            long = 0
            for w in t.split():
                n = lengths.get(w)
                if n is None:
                    n = len(own.encode_ordinary(w))
                    if len(lengths) >= _MOST:
                        lengths.clear()
                    if len(w) <= 64:
                        lengths[w] = n
                long += n > 3
            back = own.decode_bytes(ids).decode("utf-8", "replace")
            rows.append({"tokens": len(ids), "round_trip": back == t or "".join(back.split()) == "".join(t.split()), "long_words": long})
        return pa.array(rows, pa.struct([("tokens", pa.int64()), ("round_trip", pa.bool_()), ("long_words", pa.int64())]))

    return measure(text)


def tokenizer_metrics(docs: DataFrame, by: list[str], text: str = "text", folder: str = FOLDER) -> DataFrame:
    """By group: docs, tokens, tokens a document, fertility (tokens a word), compression (signs a token), per cent of unknown tokens (a byte vocabulary has none), of documents that decoding doesn't give back, and of words of more than three tokens.

    Null texts are left out. A text without words counts as one of one word, as in the usual report.
    """
    own = docs.where(F.col(text).isNotNull()).select(*by, measured(text, folder).alias("m"), F.regexp_count(text, F.lit(WORD)).alias("w"), F.length(text).alias("c"))
    total = own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("m.tokens").alias("tokens"), F.sum(F.greatest("w", F.lit(1))).alias("words"), F.sum("w").alias("true_words"), F.sum("c").alias("signs"), F.count_if(~F.col("m.round_trip")).alias("failed"), F.sum("m.long_words").alias("long")
    )
    share = lambda a, b, places: F.round(F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)), places)
    per_cent = lambda a, b, places: F.round(F.lit(100.0) * F.col(a) / F.greatest(F.col(b), F.lit(1)), places)
    return total.select(
        *by, "docs", "tokens", share("tokens", "docs", 1).alias("tokens_per_doc"), share("tokens", "words", 3).alias("fertility"), share("signs", "tokens", 2).alias("compression"), F.lit(0.0).alias("unknown_pct"), per_cent("failed", "docs", 2).alias("round_trip_fail_pct"), per_cent("long", "true_words", 2).alias("hyper_fragmented_pct")
    )


def unknown_signs(docs: DataFrame, text: str = "text", folder: str = FOLDER) -> DataFrame:
    """(sign, n): signs that piece_bpe_32k has no piece for, so that it falls back to their bytes, with how often texts hold them.

    Each distinct sign of the corpus is asked once; its occurrences are counted by the JVM.
    """
    signs = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(F.regexp_replace(text, SPACES, ""), "")).alias("sign")).where("sign <> ''").groupBy("sign").agg(F.count(F.lit(1)).alias("n"))

    @F.arrow_udf(T.BooleanType())
    def by_bytes(column: pa.Array) -> pa.Array:
        own = _piece_bpe(folder)
        mark = own.piece_to_id("▁")
        many = own.encode(column.to_pylist(), num_threads=1)
        return pa.array([any(own.is_byte(i) or own.is_unknown(i) for i in ids if i != mark) for ids in many], pa.bool_())

    return signs.where(by_bytes("sign"))
