"""Problems 5 and 7: a public byte-level BPE tokenizer over the whole corpus.

The rank file is local (`KHATA_TOKENIZERS` or a parameter names the folder) and is
read by each Python worker; it is never trained and never copied. Texts are cut
where the tokenizer's own pre-splitting pattern always cuts, namely before white
space that follows something else, so each chunk can be encoded on its own; chunks
repeat, and each worker remembers the ids of the chunks it met (a bounded memo
that changes nothing but the speed).
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.arrow import sliced, texts
from khata.functions import bpe
from khata.functions.bpe import CHUNK, FOLDER, PATTERN, SPACE, cut
from khata.session import written

NAME = bpe.BYTE_BPE
#: Chunks of more characters are not remembered, and at most so many are.
LONGEST, MOST = 64, 300_000


@functools.cache
def encoding(folder: str = FOLDER, name: str = NAME) -> tiktoken.Encoding:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Memo(dict):
    """Chunk -> what `make` gives for it; forgets everything once MOST chunks are held."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> object:
        value = self.make(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= MOST:
                self.clear()
            self[chunk] = value
        return value


@functools.cache
def _ids_memo(folder: str, name: str) -> Memo:
    tokenizer = encoding(folder, name)
    encode, whole = tokenizer.encode_ordinary, tokenizer._core_bpe.encode_single_piece

    def ids(chunk: str) -> bytes:
        run, rest = cut(chunk)
        return np.array(whole(run.encode()) + encode(rest) if run else encode(rest), np.int32).tobytes()

    return Memo(ids)


def _clean(text: str) -> str:
    """Lone surrogates, which have no bytes, as U+FFFD."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def token_bytes(text: str, folder: str = FOLDER, name: str = NAME) -> bytes:
    """The ids of a text as little-endian 32-bit integers, one after another."""
    get = _ids_memo(folder, name).__getitem__
    try:
        return b"".join(map(get, CHUNK.findall(text)))
    except UnicodeEncodeError:
        return b"".join(map(get, CHUNK.findall(_clean(text))))


def decode(ids: list[int], folder: str = FOLDER, name: str = NAME) -> bytes:
    """The bytes that a list of ids stands for; tokens may end inside a character, so bytes, not text, are exact."""
    return encoding(folder, name).decode_bytes(ids)


def _encoded(batch: pa.RecordBatch, folder: str, name: str) -> Iterator[pa.RecordBatch]:
    parts = [token_bytes(t, folder, name) if t else b"" for t in texts(batch.column(1))]
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    ids = pa.ListArray.from_arrays(pa.array(offsets), values)
    yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """Every row with the ids of its text, without special tokens: (`id_col`, ids ARRAY<INT>).

    The empty list for a null or empty text. Strings of special tokens in a text are
    ordinary text. Repeated rows come out as often as they come in. No shuffle.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    run = sliced(lambda batch: _encoded(batch, folder, name), "t", 8 << 20)
    return own.mapInArrow(run, "id BIGINT, ids ARRAY<INT>").withColumnRenamed("id", id_col)


def _decoded(batch: pa.RecordBatch, folder: str, name: str) -> Iterator[pa.RecordBatch]:
    made = [None if ids is None else decode(ids, folder, name) for ids in batch.column(1).to_pylist()]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "raw"])


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """The raw bytes of each list of ids: (`id_col`, raw BINARY); a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _decoded(batch, folder, name)

    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, "id BIGINT, raw BINARY").withColumnRenamed("id", id_col)


def _lengths(batch: pa.RecordBatch, folder: str, name: str) -> Iterator[pa.RecordBatch]:
    made = [len(token_bytes(t, folder, name)) // 4 if t else 0 for t in texts(batch.column(1))]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "n_tokens"])


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(`id_col`, n_tokens BIGINT) of every row, encoded where it lies; 0 for a null or empty text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(sliced(lambda batch: _lengths(batch, folder, name), "t"), "id BIGINT, n_tokens BIGINT").withColumnRenamed("id", id_col)


# Problem 5: lengths from a dictionary of distinct pieces.

#: At most so many pieces, those of the most documents in the whole corpus, are looked up where the documents lie: the bound of what is broadcast.
#: Any other piece is in about as many documents as more than HOT_PIECES others at most, so no key of the join has more than about one part in HOT_PIECES of the postings.
HOT_PIECES = 50_000
#: Pieces of more characters are known by a 128-bit fingerprint.
KEY_LENGTH = 32
#: The pattern, with its own white space, for a splitter that gives the pieces themselves.
_PIECES = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"(?!\S)", f"(?![^{SPACE}])"))


def pieces_of(chunk: str) -> list[str]:
    """The tokenizer's own pieces of a chunk, each of which is merged by itself."""
    run, rest = cut(chunk)
    return [run, *_PIECES.findall(rest)] if run else _PIECES.findall(rest)


class _Codes(dict):
    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code


_CHUNKS = Memo(pieces_of)


def _postings(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pieces of a batch, and of each pair of piece and row: the piece's number, the row, and how often."""
    chunk_code, piece_code = _Codes(), _Codes()
    flat: list[int] = []
    sizes = np.zeros(batch.num_rows, np.int64)
    for i, t in enumerate(texts(batch.column(1))):
        if t:
            try:
                t.encode()
            except UnicodeEncodeError:
                t = _clean(t)
            own = CHUNK.findall(t)
            sizes[i] = len(own)
            flat += map(chunk_code.__getitem__, own)
    rows = np.repeat(np.arange(batch.num_rows), sizes)
    pairs, times = np.unique(np.array(flat, np.int64) * max(batch.num_rows, 1) + rows, return_counts=True)
    chunk, row = np.divmod(pairs, max(batch.num_rows, 1))
    parts = [[piece_code[p] for p in _CHUNKS[c]] for c in chunk_code]
    length = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(length) - length
    each = length[chunk] if len(chunk) else np.zeros(0, np.int64)
    codes = np.array([c for p in parts for c in p], np.int64)
    at = np.repeat(start[chunk] if len(chunk) else each, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    key = codes[at] * max(batch.num_rows, 1) + np.repeat(row, each) if len(at) else np.zeros(0, np.int64)
    both, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, np.repeat(times, each), len(both)).astype(np.int64)
    which, at_row = np.divmod(both, max(batch.num_rows, 1))
    return list(piece_code), which, at_row, total


def _key(piece: str) -> str:
    return piece if len(piece) <= KEY_LENGTH else "\0" + xxhash.xxh3_128_hexdigest(piece.encode())


def _distinct(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Each distinct piece of a batch: key, the piece itself if the key isn't it, and how many rows hold it."""
    pieces, which, _, _ = _postings(batch)
    docs = np.bincount(which, minlength=len(pieces)).astype(np.int64)
    long = [p if len(p) > KEY_LENGTH else None for p in pieces]
    yield pa.RecordBatch.from_arrays([pa.array(map(_key, pieces), pa.string()), pa.array(long, pa.string()), pa.array(docs, pa.int64())], names=["key", "long", "docs"])


def tokenized(piece: str, folder: str, name: str) -> int:
    """How many tokens a piece has."""
    return len(encoding(folder, name)._core_bpe.encode_single_piece(piece.encode()))


def _tokenized(batches: Iterator[pa.RecordBatch], folder: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [tokenized(key if long is None else long, folder, name) for key, long in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.int64())], names=["key", "docs", "n"])


def piece_lengths(docs: DataFrame, text_col: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, docs, n): every distinct piece of the corpus with the documents that hold it and its tokens, tokenized once. Counts are summed in each task before they travel."""
    own = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("t"))
    each = own.mapInArrow(sliced(_distinct, "t"), "key STRING, long STRING, docs BIGINT").groupBy("key", "long").agg(F.sum("docs").alias("docs"))
    return each.mapInArrow(lambda batches: _tokenized(batches, folder, name), "key STRING, docs BIGINT, n BIGINT")


def _weighed(batch: pa.RecordBatch, hot: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """For each row the sum over its hot pieces, under a key that no piece has, and its other pieces with their frequencies."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    pieces, which, row, times = _postings(batch)
    keys = [_key(p) for p in pieces]
    length = np.array([hot.get(k, -1) for k in keys], np.int64)
    own = length[which] if len(which) else np.zeros(0, np.int64)
    known = own >= 0
    total = np.bincount(row[known], own[known] * times[known], batch.num_rows).astype(np.int64)
    some = np.flatnonzero(total)
    rest = ~known
    all_keys = [f"\1{i}" for i in ids[some].tolist()] + [keys[k] for k in which[rest].tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[row[rest]]]), pa.int64()), pa.array(all_keys, pa.string()), pa.array(np.concatenate([total[some], times[rest]]), pa.int64())], names=["id", "key", "times"])


def _hot(lengths: DataFrame) -> dict[str, int]:
    """The lengths of the hot pieces: all from a level of documents on, the lowest with at most HOT_PIECES pieces. Levels are sixteenths of a doubling, so both the counts by level and the pieces are few, whatever the number of tasks."""
    leveled = lengths.withColumn("level", F.floor(F.log2("docs") * 16))
    total, least = 0, None
    for r in sorted(leveled.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        total += r["n"]
        if total > HOT_PIECES:
            break
        least = r["level"]
    return {} if least is None else {r["key"]: r["n"] for r in leveled.where(F.col("level") >= least).select("key", "n").collect()}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(`id_col`, n_tokens) of every row that has tokens, by way of distinct pieces.

    Each distinct piece of the corpus, cut as the tokenizer cuts, is tokenized once and
    its length kept in a written table. The pieces of the most documents, at most
    HOT_PIECES, are looked up where the documents lie; the frequencies of all others
    are joined with the table. `id_col` must be unique. Null and empty texts give no row.
    """
    lengths = written(piece_lengths(docs, text_col, folder, name), "pieces")
    hot = _hot(lengths)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    postings = own.mapInArrow(sliced(lambda batch: _weighed(batch, hot), "t"), "id BIGINT, key STRING, times BIGINT")
    joined = postings.join(lengths.select("key", "n"), "key", "left")
    return joined.groupBy("id").agg(F.sum(F.col("times") * F.coalesce("n", F.lit(1))).alias("n_tokens")).withColumnRenamed("id", id_col)


#: The labels that name languages (fixed values of the data model).
LABELS = ("AS", "BD", "BNLS", "BN_EN_parallel", "EN", "HI", "MIX", "WB")


def plain_name(col: str | F.Column) -> F.Column:
    """A source's name without case, spaces, hyphens and underscores."""
    return F.lower(F.regexp_replace(col, r"[\s\u00a0_\-]+", ""))


def labelled_counts(docs: DataFrame, sources: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(doc_id, n_tokens, source, language_region, domain) of every document.

    All spellings of a source count under its name in `sources`; one that `sources`
    lacks under its trimmed, lower-case self, with a null domain, and a null or blank
    one under null. A language_region that is null, blank or names no language is
    null. Documents without tokens have 0. The sources are few; whether they are
    broadcast, Spark decides by their size; no text is in that join.
    """
    counts = token_counts(docs, "doc_id", "text", folder, name)
    label = docs.select("doc_id", F.col("source").alias("spelt"), F.when(F.col("language_region").isin(*LABELS), F.col("language_region")).alias("language_region"))
    known = sources.select(F.col("source").alias("name"), "domain", plain_name("source").alias("key")).dropDuplicates(["key"])
    named = label.join(known, plain_name("spelt") == F.col("key"), "left")
    source = F.coalesce("name", F.when(F.trim("spelt") != "", F.lower(F.trim("spelt"))))
    named = named.select("doc_id", source.alias("source"), "language_region", "domain")
    return named.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "language_region", "domain")


def token_budget(docs: DataFrame, sources: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """Documents and tokens by source, language_region and domain, as labelled_counts has them; missing labels are slices of their own, with null."""
    each = labelled_counts(docs, sources, folder, name)
    return each.groupBy("source", "language_region", "domain").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
