"""Problem 1: missing or wrong document language labels.

The family of a word is its script; within a family of closely related languages,
one-versus-one linear support vector machines separate them. Their features are the
letter sequences of words, so a margin is a sum over words and each worker computes
it once for each distinct word. A language is in a document when some stretch of it
has margins that only a whole sentence reaches; a family of another script, when its
words run on for a sentence. Only prose counts (see khata.llm.quality), and garbled
stretches are read restored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.arrow import sliced, texts
from khata.llm.prepare import CONTROL, prepared
from khata.llm.quality import EDGES, Pages
from khata.llm.tokens import LABELS, Memo

#: Families, by script, and their languages.
FAMILIES = (("bn", "as"), ("en", "bnls"), ("hi",))
#: The languages a label stands for; MIX stands for any two or more.
STANDS_FOR = {"BD": {"bn"}, "WB": {"bn"}, "EN": {"en"}, "HI": {"hi"}, "AS": {"as"}, "BNLS": {"bnls"}, "BN_EN_parallel": {"bn", "en"}}
#: At most so many labelled sentences of each language train the model.
SAMPLES = 400
#: Longest letter sequence, and the cost of errors in training.
LONGEST, COST = 4, 30.0
#: Words that a sentence has at least, the sum of margins that it reaches at least, and how many times the
#: highest sum that names and chance gave in held-out text of the other language.
LEAST_WORDS, LEAST_MARGIN, ABOVE_CHANCE = 6, 4.0, 1.75
#: Words of a sentence's beginning that confidence is learnt from; longer ones are sure anyway.
BEGINNING = 6
#: Of a margin of one word, no more counts.
CLIP = 2.0


def family(word: str) -> int:
    """1 + the number of the family whose script most letters have, 0 for none."""
    counts = [0, 0, 0]
    for c in word:
        n = ord(c)
        if 0x0980 <= n < 0x0A00:
            counts[0] += not 0x09E6 <= n <= 0x09EF
        elif 0x0900 <= n < 0x0980:
            counts[2] += not 0x0964 <= n <= 0x096F
        elif n < 0x0250 and c.isalpha():
            counts[1] += 1
    best = max(counts)
    return counts.index(best) + 1 if best else 0


def grams(word: str) -> list[str]:
    framed = f"^{word}$"
    out = [framed]
    for n in range(1, LONGEST + 1):
        out += [framed[i : i + n] for i in range(len(framed) - n + 1)]
    return out


def _fit(a: list[list[str]], b: list[list[str]]) -> tuple[dict[str, float], float]:
    """Weights and bias of a linear support vector machine, by dual coordinate descent; sentences are means over their words."""
    index: dict[str, int] = {}
    many = a + b
    rows = []
    for words in many:
        row: dict[int, float] = {}
        for w in words:
            own = grams(w)
            for g in own:
                k = index.setdefault(g, len(index))
                row[k] = row.get(k, 0.0) + 1 / math.sqrt(len(own)) / len(words)
        rows.append(row)
    x = np.zeros((len(many), len(index) + 1), np.float32)
    for i, row in enumerate(rows):
        x[i, list(row)] = list(row.values())
    x[:, -1] = 1.0
    y = np.array([1.0] * len(a) + [-1.0] * len(b), np.float32)
    size = (x * x).sum(1)
    alpha, w = np.zeros(len(many)), np.zeros(x.shape[1], np.float32)
    rng = np.random.default_rng(0)
    for _ in range(60):
        for i in rng.permutation(len(many)):
            step = (1 - y[i] * (x[i] @ w)) / size[i]
            new = min(max(alpha[i] + step, 0.0), COST)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return {g: float(w[k]) for g, k in index.items() if abs(w[k]) > 1e-4}, float(w[-1])


class Model:
    """Margins of words for each pair of related languages, learnt from labelled sentences."""

    def __init__(self, samples: list[tuple[str, str]]):
        by: dict[str, list[list[str]]] = {}
        for lang, text in sorted(samples):
            words = [w for w in (word_of(t) for t in prepared([text])[0].split()) if family(w)]
            if words:
                by.setdefault(lang, []).append(words)
        self.pairs: dict[tuple[str, str], tuple[dict[str, float], float]] = {}
        for members in FAMILIES:
            for a, b in itertools.combinations([m for m in members if m in by], 2):
                self.pairs[a, b] = _fit(by[a], by[b])
        chance = self._by_chance(by)
        self.sure: dict[tuple[str, str], tuple[float, float]] = {pair: self._calibrated(by, pair) for pair in self.pairs}
        self.least = {m: max(LEAST_MARGIN, ABOVE_CHANCE * chance.get(m, 0.0)) for m in by}
        self._coded: Memo | None = None

    def __getstate__(self) -> dict:
        return {"pairs": self.pairs, "least": self.least, "sure": self.sure, "_coded": None}

    def _by_chance(self, by: dict[str, list[list[str]]]) -> dict[str, float]:
        """For each language the highest sum of its margins in held-out text of its related languages, by two folds."""
        most: dict[str, float] = {}
        for (a, b), fold in itertools.product(self.pairs, (0, 1)):
            part = Model.__new__(Model)
            part.pairs = {(a, b): _fit(by[a][fold::2], by[b][fold::2])}
            for lang, other, sign in ((a, b, 1), (b, a, -1)):
                words = itertools.chain.from_iterable(by[other][1 - fold :: 2])
                most[lang] = max(most.get(lang, 0.0), highest(np.array([sign * part.margin(a, b, w) for w in words])))
        return most

    def _calibrated(self, by: dict[str, list[list[str]]], pair: tuple[str, str]) -> tuple[float, float]:
        """Slope and offset of the chance that a stretch is of the pair's first language, by the sum of its margins: logistic regression on the beginnings of held-out sentences, up to BEGINNING words."""
        sums: list[float] = []
        first: list[bool] = []
        for fold in (0, 1):
            part = Model.__new__(Model)
            part.pairs = {pair: _fit(by[pair[0]][fold::2], by[pair[1]][fold::2])}
            for lang in pair:
                for words in by[lang][1 - fold :: 2]:
                    upto = np.cumsum([part.margin(*pair, w) for w in words[:BEGINNING]])
                    sums += upto.tolist()
                    first += [lang == pair[0]] * len(upto)
        x, y = np.array(sums), np.array(first, float)
        y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # no chance is quite 0 or 1
        slope, offset = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
            w = p * (1 - p) + 1e-9
            a, b, c = (w * x * x).sum() + 1e-6, (w * x).sum(), w.sum() + 1e-6
            g, h = ((y - p) * x).sum(), (y - p).sum()
            step = (c * g - b * h) / (a * c - b * b), (a * h - b * g) / (a * c - b * b)
            slope, offset = slope + step[0], offset + step[1]
            if max(map(abs, step)) < 1e-6:
                break
        return float(slope), float(offset)

    def confidence(self, lang: str, total: float, own: int, words: int) -> float:
        """The chance that a stretch is of a language: `total` is the sum of margins for it against the related one, `own` of its `words` are of its family."""
        share = (own + 1) / (words + 2)
        for (a, b), (slope, offset) in self.sure.items():
            if lang in (a, b):
                z = slope * total + offset if lang == a else slope * total - offset
                return share / (1 + math.exp(-min(max(z, -30.0), 30.0)))
        return share

    def margin(self, a: str, b: str, word: str) -> float:
        """The margin of `word` for a (above 0) against b."""
        weights, bias = self.pairs[a, b]
        own = grams(word)
        value = bias + sum(weights.get(g, 0.0) for g in own) / math.sqrt(len(own))
        return min(max(value, -CLIP), CLIP)

    def coded(self) -> Memo:
        """Token -> 100 x family + margin of the family's first language against its second; 0 for what is no word."""
        if self._coded is None:

            def code(token: str) -> float:
                word = word_of(token)
                f = family(word)
                if not f:
                    return 0.0
                members = FAMILIES[f - 1]
                return 100.0 * f + (self.margin(*members, word) if members in self.pairs else CLIP / 2)

            self._coded = Memo(code)
        return self._coded


def word_of(token: str) -> str:
    return EDGES.sub("", token).lower()


def highest(values: np.ndarray) -> float:
    """The highest sum of a stretch of at least LEAST_WORDS of `values`."""
    if len(values) < LEAST_WORDS:
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums[LEAST_WORDS:] - np.minimum.accumulate(sums)[:-LEAST_WORDS]).max())


def longest_run(families: np.ndarray, f: int) -> int:
    """The longest run of words of family f; what is no word doesn't interrupt."""
    own = families[families > 0] == f
    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def languages(coded: np.ndarray, least: dict[str, float] | None = None, model: Model | None = None) -> dict[str, float]:
    """The languages of a text from the codes of its tokens, each with a confidence from 0 to 1 (calibrated where a model is given); `least` has the sum that a language's sentence reaches."""
    families = np.rint(coded / 100.0).astype(np.int8)
    margins = coded - 100.0 * families
    counts = np.bincount(families, minlength=len(FAMILIES) + 1)
    out: dict[str, float] = {}
    present = [f for f in range(1, len(FAMILIES) + 1) if counts[f]]
    for f in present:
        most = counts[f] == counts[1:].max()
        if not most and (counts[f] < LEAST_WORDS or longest_run(families, f) < LEAST_WORDS):
            continue
        members, own = FAMILIES[f - 1], margins[families == f]
        mean = float(own.mean())
        if len(members) == 1:
            own_words = int(counts[f])
            out[members[0]] = model.confidence(members[0], 0.0, own_words, own_words) if model else 1.0
            continue
        up, down = float(own[own > 0].sum()), float(-own[own < 0].sum())
        if min(up, down) >= LEAST_MARGIN:
            up, down = highest(own), highest(-own)
        reached = least or {}
        found = [(m, s) for m, s in zip(members, (up, down), strict=True) if s >= reached.get(m, LEAST_MARGIN)] or [(members[mean < 0], abs(float(own.sum())))]
        if len(found) == 2 and len(own) < 2 * LEAST_WORDS:
            found = [max(found, key=lambda x: x[1])]
        for m, s in found:
            out[m] = model.confidence(m, s, int(counts[f]), int(counts[f])) if model else 1 / (1 + math.exp(-min(s, 30.0)))
    return out


def train(samples: DataFrame, most: int = SAMPLES) -> Model:
    """A model from labelled sentences (sample_id, lang, text), `most` of each language at the most."""
    known = [m for members in FAMILIES for m in members]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("sample_id"), "sample_id"))
    rows = samples.where(F.col("lang").isin(known) & F.col("text").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text").collect()
    return Model([(r["lang"], r["text"]) for r in rows])


def _read(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[int, dict[str, float]]]:
    """For every row whose text counts, its number and its languages."""
    code = model.coded().__getitem__
    pages = Pages(prepared(texts(batch.column(1))))
    for k, (prose, lines) in enumerate(zip(pages.prose().tolist(), pages.prose_lines(), strict=True)):
        if not prose or not lines:
            continue
        tokens = " ".join(lines).split()
        yield k, languages(np.fromiter(map(code, tokens), np.float64, len(tokens)), model.least, model)


def label_is_wrong(label: str | None, found: set[str]) -> bool:
    """Whether a label is missing or stands for other languages than those found."""
    if label not in LABELS:
        return True
    return len(found) < 2 if label == "MIX" else STANDS_FOR[label] != found


def _mislabelled(batch: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    ids, labels = batch.column(0), batch.column(2).to_pylist()
    rows = [(k, lang, sure) for k, found in _read(batch, model) if found and label_is_wrong(labels[k], set(found)) for lang, sure in found.items()]
    at, langs, sure = zip(*rows, strict=True) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["id", "lang", "confidence"])


def mislabelled(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "language_region") -> DataFrame:
    """(`id_col`, lang, confidence): one row for each language of each document whose label is missing or wrong.

    Null, empty and blank texts, those without letters, and lists, tables or junk give
    no row. Repeated rows each come out. No shuffle; the model's size is bounded by the
    sample that trained it.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.trim(label_col).alias("label"))
    return own.mapInArrow(sliced(lambda batch: _mislabelled(batch, model), "t", 4 << 20), "id BIGINT, lang STRING, confidence DOUBLE").withColumnRenamed("id", id_col)


SEGMENT = "id BIGINT, segment INT, lang STRING, confidence DOUBLE, begin BIGINT, end BIGINT, text STRING"
_TOKEN = re.compile(r"\S+")
_STOPS, _CLOSERS = frozenset(".!?।॥৷…"), frozenset("\"'”’)]»")
_STOP = re.compile(r"[.!?।॥৷…][\"'”’)\]»]*$")
#: What a change of language costs, against 1 for each word that it explains and 1 for each that it doesn't: inside a sentence, and between two.
WITHIN, BETWEEN = 4.0, 1.0


def _blanked(text: str) -> str:
    """A text with line breaks for its control tokens, of the same length."""
    return CONTROL.sub(lambda m: "\n" * len(m.group()), text) if "<|" in text else text


def _tokens(text: str, ready: str) -> tuple[list[re.Match], list[str]]:
    """The tokens of a text as they stand in it, and their prepared forms. Where preparing the whole text changed how many there are, each is prepared by itself."""
    found = list(_TOKEN.finditer(_blanked(text)))
    plain = ready.split()
    if len(plain) != len(found):
        plain = prepared([m.group() for m in found])
    return found, plain


def _paths(scores: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The best language of each token: the sum of scores less the cost of each change (Viterbi's algorithm)."""
    n, many = scores.shape
    back = np.zeros((n, many), np.int8)
    total = scores[0].tolist()
    rows, costs = scores.tolist(), change.tolist()
    for i in range(1, n):
        top = max(range(many), key=total.__getitem__)
        jump = total[top] - costs[i]
        for k in range(many):
            if jump > total[k]:
                back[i, k], total[k] = top, jump
            else:
                back[i, k] = k
            total[k] += rows[i][k]
    out = np.zeros(n, np.int64)
    out[-1] = max(range(many), key=total.__getitem__)
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _segments(text: str, ready: str, found: dict[str, float], model: Model) -> list[tuple[str, float, int, int]]:
    """The stretches of a text by the languages that were found in it: (lang, confidence, begin, end), in code points of the text as it stands."""
    langs = sorted(found)
    if len(langs) == 1:  # the whole text, with the confidence that it has
        own = _blanked(text)
        return [(langs[0], found[langs[0]], len(own) - len(own.lstrip()), len(own.rstrip()))]
    tokens, plain = _tokens(text, ready)
    if not tokens or not langs:
        return []
    code = model.coded().__getitem__
    values = np.fromiter(map(code, plain), np.float64, len(plain))
    families = np.rint(values / 100.0).astype(np.int64)
    margins = values - 100.0 * families
    scores = np.zeros((len(tokens), len(langs)))
    signs = []
    for k, lang in enumerate(langs):
        f = next(i for i, members in enumerate(FAMILIES, 1) if lang in members)
        members = FAMILIES[f - 1]
        sign = 1.0 if lang == members[0] else -1.0
        signs.append((f, sign))
        both = len(members) > 1 and all(m in found for m in members)
        scores[:, k] = np.where(families == f, sign * margins if both else 1.0, np.where(families > 0, -1.0, 0.0))
    blank = _blanked(text)
    between = np.zeros(len(tokens), bool)
    for i, m in enumerate(tokens[:-1]):
        end = m.end()
        between[i + 1] = blank[end - 1] in _STOPS or blank[end] == "\n" or blank[end - 1] in _CLOSERS and _STOP.search(m.group()) is not None or "\n" in blank[end : tokens[i + 1].start()]
    path = _paths(scores, np.where(between, BETWEEN, WITHIN))
    for k in range(len(langs)):  # a language that was found has its best stretch at least
        if not (path == k).any():
            sums = np.concatenate([[0.0], np.cumsum(scores[:, k])])
            least = np.minimum.accumulate(sums)
            end = int((sums[1:] - least[:-1]).argmax())
            path[int(sums[: end + 1].argmin()) : end + 1] = k
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(tokens)]
    out = []
    for a, b in itertools.pairwise(edges):
        f, sign = signs[path[a]]
        own = families[a:b] == f
        out.append((langs[path[a]], model.confidence(langs[path[a]], float(sign * margins[a:b][own].sum()), int(own.sum()), int((families[a:b] > 0).sum())), tokens[a].start(), tokens[b - 1].end()))
    return out


def _read_whole(many: list[str | None], model: Model) -> Iterator[tuple[int, list[tuple[str, float, int, int]]]]:
    ready = prepared(many)
    code = model.coded().__getitem__
    pages = Pages(ready)
    for k, (prose, lines) in enumerate(zip(pages.prose().tolist(), pages.prose_lines(), strict=True)):
        if prose and lines:
            tokens = " ".join(lines).split()
            found = languages(np.fromiter(map(code, tokens), np.float64, len(tokens)), model.least, model)
            yield k, _segments(many[k], ready[k], found, model)


def segments_of(text: str, model: Model) -> list[tuple[str, float, int, int]]:
    """The stretches of a text by language: (lang, confidence, begin, end). A change inside a sentence takes more words than one between sentences; words of no language that the text has go with their neighbours."""
    return next((found for _, found in _read_whole([text], model)), [])


def _segmented(batch: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    many = texts(batch.column(1))
    rows = [(k, n, lang, sure, begin, end, many[k][begin:end]) for k, found in _read_whole(many, model) for n, (lang, sure, begin, end) in enumerate(found)]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
    made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
    yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], names=["id", "segment", "lang", "confidence", "begin", "end", "text"])


def segments(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, segment, lang, confidence, begin, end, text): each document's stretches by language, in order.

    begin and end count code points of the text as it stands, so `text` is the part
    between them. The languages are those that mislabelled() finds; documents that it
    doesn't read (no words, lists, tables or junk) give no row. No shuffle.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(sliced(lambda batch: _segmented(batch, model), "t", 4 << 20), SEGMENT).withColumnRenamed("id", id_col)
