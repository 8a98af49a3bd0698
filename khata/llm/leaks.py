"""Problem 4: evaluation texts leaking into training text.

Words of items and documents are 64-bit fingerprints, so both sides are cut to words
where they lie and neither passes through the driver. One pass over the corpus takes
from each document the n-grams that some item has (a filter of bounded size keeps
the others from travelling) with the passage around them. Counted over the corpus,
they give the seeds: every n-gram of an item that is rare, and of each window of
PASSAGE words without one its rarest. Seeds are joined with the documents' n-grams,
hot ones spread by a salt, and each pair of passage and item that meets is scored by
a Smith-Waterman alignment, which also finds edited and paraphrased copies, and by
its longest run of equal words. A document that holds PASSAGE words in a row of an
item holds that window's seed, so none is missed.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.arrow import sliced, texts
from khata.llm import glyphs
from khata.llm.prepare import CONTROL, UNUSUAL, usual
from khata.llm.tokens import MOST, Memo
from khata.session import written

#: Words in a row that make a leak, and words of a seed.
PASSAGE, SEED = 10, 5
#: Words on either side of known n-grams that a passage takes in; n-grams no further apart share a passage.
AROUND = 24
#: Scores of an alignment.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A document's passage has at most so many words; the next one begins OVERLAP words before its end.
BLOCK_WORDS, OVERLAP = 192, 64
#: Longer items are cut into parts of PART words, each of which begins OVERLAP words before the end of the one before.
PART = 160
#: An n-gram that the corpus has at most so often is a seed of each item that holds it; of windows without one, the rarest is.
RARE = 10_000
#: An n-gram that the corpus has more often is spread over further tasks of the join, one for each so many.
HOT = 200_000
#: No more hot n-grams than this are broadcast (16 MB).
MOST_HOT = 1_000_000
#: Bits of the filter that keeps n-grams of no item from travelling: so many for each n-gram, at most MOST_BITS (32 MB), whatever the number of items. What it lets through by chance the join drops.
BITS, MOST_BITS = 16, 1 << 28
#: Pairs that are aligned at once.
TOGETHER = 2048


@functools.cache
def _marks() -> re.Pattern:
    """Every sign of Unicode's categories P and S."""
    of = [cp for cp in range(0x20, 0x1FBFF) if unicodedata.category(chr(cp))[0] in "PS"]
    spans: list[list[int]] = []
    for cp in of:
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]+")


def _bare(plain: str) -> str:
    return _marks().sub("", plain).lower()


def word_of(token: str) -> str:
    """A token without punctuation and symbols, lower-cased, in its canonical form; may be empty."""
    return _bare(glyphs.canonical(token) if UNUSUAL.search(token) else usual(unicodedata.normalize("NFC", token)).replace("৷", "।"))


def words_of(text: str) -> list[str]:
    return [w for w in map(word_of, CONTROL.sub(" ", text).split()) if w]


def hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit fingerprint of each n words in a row."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    own = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ own[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _number(word: str) -> int:
    """A word's fingerprint, never 0; -1 if nothing is left of the word."""
    return (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1) & 0x7FFFFFFFFFFFFFFF if word else -1


class Numbers(Memo):
    """Token -> number of its word."""

    def __init__(self) -> None:
        super().__init__(lambda token: _number(word_of(token)))

    def meet(self, tokens: set[str]) -> None:
        """Looks up the unusual ones of new tokens together, which is far cheaper than one by one."""
        if len(self) > MOST:
            self.clear()
        new = [t for t in tokens if t not in self and UNUSUAL.search(t)]
        for t, plain in zip(new, glyphs.canonical_all(new), strict=True):
            self[t] = _number(_bare(plain))


_NUMBERS = Numbers()


def numbered(many: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word numbers one after another, a 0 after each text, and where each text begins."""
    split = [(CONTROL.sub(" ", t) if "<|" in t else t).split() if t else [] for t in many]
    _NUMBERS.meet(set().union(*split))
    parts, starts, at = [], [], 0
    for tokens in split:
        starts.append(at)
        own = np.fromiter(map(_NUMBERS.__getitem__, tokens), np.int64, len(tokens))
        own = own[own >= 0]
        parts += [own, np.zeros(1, np.int64)]
        at += len(own) + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts, np.int64)


def grams_of(words: np.ndarray) -> np.ndarray:
    """The fingerprint of each n-gram, as a signed number."""
    return hashes(words, SEED).view(np.int64)


def _pack(many: list[np.ndarray]) -> pa.Array:
    return pa.array([w.astype("<i8").tobytes() for w in many], pa.binary())


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Items as parts of at most PART words: item, the part's fingerprint, its words and n-grams."""
    ids = batch.column(0).to_pylist()
    words, starts = numbered(texts(batch.column(1)))
    ends = [*starts[1:], len(words)]
    rows: list[tuple] = []
    for i, a, b in zip(ids, starts, ends, strict=True):
        own = words[a : b - 1]
        for at in range(0, max(1, len(own) - OVERLAP if len(own) > PART else 1), PART - OVERLAP):
            part = own[at : at + PART]
            if len(part) >= SEED:
                rows.append((i, xxhash.xxh3_64_intdigest(part.tobytes()) >> 1, part, grams_of(part)))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), _pack(cols[2]), pa.array([g.tolist() for g in cols[3]], pa.list_(pa.int64()))], names=["item_id", "part", "words", "grams"])


def _filter(grams: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of n-grams with two bits each, built by the executors in words of 64 bits; and the number of its bits."""
    n = grams.count()
    bits = 1 << max(12, min((BITS * max(n, 1) - 1).bit_length(), MOST_BITS.bit_length() - 1))
    places = grams.select(F.explode(F.array(*_places(F.col("gram"), bits))).alias("place"))
    rows = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("own")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[rows.column("at").to_numpy()] = rows.column("own").to_numpy()
    return table.view(np.uint64), bits


def _places(gram, bits: int) -> tuple:
    """The two places of an n-gram in the filter; for columns and for arrays."""
    if isinstance(gram, np.ndarray):
        own = gram.view(np.uint64)
        return own & np.uint64(bits - 1), (own >> np.uint64(32)) & np.uint64(bits - 1)
    return gram.bitwiseAND(F.lit(bits - 1).cast("bigint")), F.shiftrightunsigned(gram, 32).bitwiseAND(F.lit(bits - 1).cast("bigint"))


def _may_have(table: np.ndarray, bits: int, grams: np.ndarray) -> np.ndarray:
    out = np.ones(len(grams), bool)
    for place in _places(grams, bits):
        out &= (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out


def _passages(batch: pa.RecordBatch, table: np.ndarray, bits: int, run: int) -> Iterator[pa.RecordBatch]:
    """The passages of documents about n-grams that items may have, where `run` of these stand in a row: document, fingerprint, words, the n-grams."""
    ids = batch.column(0).to_pylist()
    words, starts = numbered(texts(batch.column(1)))
    rows: list[tuple] = []
    size = len(words) - SEED + 1
    if size > 0:
        grams = grams_of(words)
        inside = np.cumsum(np.concatenate([[0], words == 0]))
        hit = _may_have(table, bits, grams) & (inside[SEED:] == inside[:-SEED])
        if run > 1:
            streak = np.concatenate([[0], np.cumsum(hit)])
            full = np.flatnonzero(streak[run:] - streak[:-run] == run) if len(hit) >= run else np.zeros(0, np.int64)
            near = np.zeros(len(hit) + 1, np.int64)
            np.add.at(near, full, 1)
            np.add.at(near, full + run, -1)
            hit = np.cumsum(near)[:-1] > 0
        at = np.flatnonzero(hit)
        docs = np.searchsorted(starts, at, "right") - 1
        cut = np.flatnonzero((np.diff(at) > AROUND) | (np.diff(docs) > 0)) + 1
        ends = [*starts[1:], len(words)]
        for own, doc in zip(np.split(at, cut), np.split(docs, cut), strict=True):
            if not len(own):
                continue
            d = int(doc[0])
            low, high = max(int(starts[d]), int(own[0]) - AROUND), min(int(ends[d]) - 1, int(own[-1]) + SEED + AROUND)
            for begin in range(low, max(low + 1, high - OVERLAP), BLOCK_WORDS - OVERLAP):
                part = words[begin : min(begin + BLOCK_WORDS, high)]
                known = np.unique(grams[own[(own >= begin) & (own + SEED <= begin + len(part))]])
                if len(known):
                    rows.append((ids[d], xxhash.xxh3_64_intdigest(part.tobytes()) >> 1, part, known))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), _pack(cols[2]), pa.array([g.tolist() for g in cols[3]], pa.list_(pa.int64()))], names=["doc_id", "passage", "words", "grams"])


def chosen(grams: list[int], often: list[int], rare: int) -> set[int]:
    """The seeds of a part: its n-grams that the corpus has, but not more than `rare` times, and of each window of PASSAGE words without one the rarest that the corpus has. A window that stands in a document has all its n-grams there, so none is missed."""
    out = {g for g, n in zip(grams, often, strict=True) if 0 < n <= rare}
    span = PASSAGE - SEED + 1
    for start in range(max(1, len(grams) - span + 1)):
        window = range(start, min(start + span, len(grams)))
        if not any(grams[i] in out for i in window):
            best = min(window, key=lambda i: (not often[i], often[i], i))
            if often[best]:
                out.add(grams[best])
    return out


def _seeds(batches: Iterator[pa.RecordBatch], rare: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for i, p, grams, known in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            often = {r["gram"]: r["n"] for r in known}
            rows += [(i, p, g) for g in sorted(chosen(grams, [often.get(g, 0) for g in grams], rare))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "part", "gram"])


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The best local alignment score of each pair of word sequences, all at once."""
    return aligned(pairs)[0]


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of word sequences the best local alignment score and the longest run of equal words, all at once."""
    if not pairs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    rows, cols = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a = np.full((rows, len(pairs)), -1, np.int64)
    b = np.full((cols, len(pairs)), -2, np.int64)
    for k, (x, y) in enumerate(pairs):
        a[: len(x), k], b[: len(y), k] = x, y
    b[b == 0] = -2
    above = np.zeros((cols + 1, len(pairs)), np.int32)
    best, longest = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32)
    run = np.zeros((cols + 1, len(pairs)), np.int32)
    for i in range(rows):
        # matches and gaps in b at once; gaps in a by a running maximum along the row
        same = b == a[i]
        run[1:] = np.where(same, run[:-1] + 1, 0)
        longest = np.maximum(longest, run.max(axis=0))
        step = np.where(same, MATCH, MISMATCH)
        own = np.zeros_like(above)
        own[1:] = np.maximum(np.maximum(above[:-1] + step, above[1:] + GAP), 0)
        slope = (np.arange(cols + 1) * -GAP)[:, None].astype(np.int32)
        own = np.maximum.accumulate(own + slope, axis=0) - slope
        above = own
        best = np.maximum(best, own.max(axis=0))
    return best, longest


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The alignment of each pair of item part and passage; pairs of like length together, so that little is padded."""
    for batch in batches:
        a = [np.frombuffer(w, "<i8") for w in batch.column(2).to_pylist()]
        b = [np.frombuffer(w, "<i8") for w in batch.column(3).to_pylist()]
        order = sorted(range(len(a)), key=lambda k: (len(a[k]) // 16, len(b[k])))
        score, run = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for s in range(0, len(order), TOGETHER):
            own = order[s : s + TOGETHER]
            score[own], run[own] = aligned([(a[k], b[k]) for k in own])
        share = score / (MATCH * np.array([max(len(w), 1) for w in a])) if a else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(run), pa.array(score), pa.array(share)], names=["doc_id", "item_id", "run", "score", "share"])


def _salted(met: DataFrame, seeds: DataFrame, often: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: an n-gram of more than HOT occurrences is spread by the document over one task for each HOT of them. Such n-grams are at most the occurrences over HOT; a small number of them is broadcast."""
    hot = often.where(F.col("n") > HOT).select("gram", F.expr(f"cast(ceil(n / {HOT}) as int)").alias("salts"))
    many = hot.count()
    if not many:
        return met.withColumn("salt", F.lit(0)), seeds.withColumn("salt", F.lit(0))
    hot = F.broadcast(hot) if many <= MOST_HOT else hot
    salts = F.coalesce("salts", F.lit(1))
    met = met.join(hot, "gram", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).drop("salts")
    return met, seeds.join(hot, "gram", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")


def alignments(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", run: int = 1) -> DataFrame:
    """(doc_id, item_id, run, score, share): documents that meet a seed of an item, one row for each pair.

    `run` is the longest run of equal words, `score` that of the best local alignment,
    `share` the score against the best possible (of a part, where the item is longer
    than PART words). Every pair that shares PASSAGE words in a row is among the rows.
    With the parameter `run` only passages are looked at where so many n-grams of items
    stand in a row. Null and empty texts, and items of fewer than SEED words, give
    none; rows of one id that are repeated count as one, with the best values.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    parts = written(wanted.mapInArrow(sliced(_parts, "t"), "item_id BIGINT, part BIGINT, words BINARY, grams ARRAY<BIGINT>").dropDuplicates(["item_id", "part"]), "items")
    schema = "doc_id BIGINT, item_id BIGINT, run BIGINT, score BIGINT, share DOUBLE"
    each = parts.select("item_id", "part", F.explode(F.array_distinct("grams")).alias("gram"))
    table, bits = _filter(each.select("gram").distinct())
    shared = spark.sparkContext.broadcast(table)

    def taken(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return _passages(batch, shared.value, bits, run)

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    passages = written(own.mapInArrow(sliced(taken, "t"), "doc_id BIGINT, passage BIGINT, words BINARY, grams ARRAY<BIGINT>"), "passages")
    met = passages.select("doc_id", "passage", F.explode("grams").alias("gram"))
    often = written(met.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "often")
    known = each.join(often, "gram").groupBy("item_id", "part").agg(F.collect_list(F.struct("gram", "n")).alias("known"))  # at most PART of each
    seeds = parts.select("item_id", "part", "grams").join(known, ["item_id", "part"]).mapInArrow(lambda batches: _seeds(batches, RARE), "item_id BIGINT, part BIGINT, gram BIGINT")
    met, seeds = _salted(met, seeds, often)
    pairs = met.join(seeds, ["gram", "salt"]).select("doc_id", "passage", "item_id", "part").distinct()
    pairs = pairs.join(passages.select("doc_id", "passage", F.col("words").alias("b")).dropDuplicates(["doc_id", "passage"]), ["doc_id", "passage"])
    pairs = pairs.join(parts.select("item_id", "part", F.col("words").alias("a")), ["item_id", "part"]).select("doc_id", "item_id", "a", "b")
    return pairs.mapInArrow(_scored, schema).groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("run", "score", "share")))


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold at least PASSAGE words in a row of an item, by their alignments; the run of equal words is the exact check."""
    found = alignments(docs, items, run=PASSAGE - SEED + 1)
    return found.where((F.col("score") >= MATCH * PASSAGE) & (F.col("run") >= PASSAGE)).select("doc_id", "item_id")
