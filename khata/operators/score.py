"""Scores of predictions and summaries of runs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions.text import content_key, segments, words


def contamination(items: DataFrame, corpus: DataFrame, item_text: str, key_fields: list[str]) -> DataFrame:
    """(item_key): distinct held-out keys that equal a whole field of the corpus. The corpus's keys are reduced before they are shuffled."""
    own = items.where(F.trim(F.coalesce(item_text, F.lit(""))) != "").select(content_key(item_text).alias("item_key")).distinct()
    fields = corpus.select(F.explode(F.array(*(content_key(f) for f in key_fields))).alias("item_key")).where("item_key IS NOT NULL")
    return own.join(fields, "item_key", "left_semi")


def contamination_by_segment(items: DataFrame, corpus: DataFrame, item_text: str, text: str) -> DataFrame:
    """As contamination, against the parts of texts between control tokens and their lines."""
    own = items.where(F.trim(F.coalesce(item_text, F.lit(""))) != "").select(content_key(item_text).alias("item_key")).distinct()
    bodies = corpus.select(F.explode(segments(text)).alias("s")).select(F.explode(F.split("s.body", "\n")).alias("line"))
    return own.join(bodies.select(content_key("line").alias("item_key")), "item_key", "left_semi")


def gate(found: DataFrame, items: DataFrame, item_text: str, most: float = 0.02) -> DataFrame:
    """One row: held-out keys, those found, the rate and whether it passes."""
    own = items.where(F.trim(F.coalesce(item_text, F.lit(""))) != "").select(content_key(item_text).alias("item_key"))
    marks = own.select("item_key", F.lit(0).alias("hit")).unionByName(found.select("item_key", F.lit(1).alias("hit")))
    counts = marks.groupBy("item_key").agg(F.max("hit").alias("hit")).agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    rate = F.col("found").cast("double") / F.greatest("items", F.lit(1))
    return counts.select("items", "found", rate.alias("rate"), (rate <= most).alias("passes"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def accuracy_macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, accuracy and the unweighted mean of F1 over all labels of either side, 0 where undefined. Rows with a null on either side are left out."""
    table = confusion(df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()), truth, guess)
    by_truth = table.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("truths"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hits"))
    by_guess = table.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guesses"))
    f1 = F.coalesce(F.lit(2.0) * F.col("hits") / F.nullif(F.coalesce("truths", F.lit(0)) + F.coalesce("guesses", F.lit(0)), F.lit(0)), F.lit(0.0))
    labels = by_truth.join(by_guess, "label", "full").withColumn("f1", f1)
    return labels.agg(F.coalesce(F.sum("truths"), F.lit(0)).alias("n"), (F.sum("hits").cast("double") / F.sum("truths")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def entity_spans(df: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """(keys, kind, start, stop) of BIO-tagged entities; an I without its B begins an entity, as in the usual scorer."""
    tagged = df.select(*keys, F.posexplode(tags).alias("pos", "tag"))
    where = Window.partitionBy(*keys).orderBy("pos")
    kind = F.when(F.col("tag").rlike("^[BI]-"), F.substring("tag", 3, 1000))
    before = F.lag("kind").over(where)
    starts = F.col("kind").isNotNull() & (F.col("tag").startswith("B-") | before.isNull() | (before != F.col("kind")))
    own = tagged.withColumn("kind", kind).withColumn("starts", starts).withColumn("span", F.sum(F.col("starts").cast("int")).over(where))
    return own.where("kind IS NOT NULL").groupBy(*keys, "span").agg(F.first("kind").alias("kind"), F.min("pos").alias("start"), F.max("pos").alias("stop")).drop("span")


def entity_f1(df: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """One row: precision, recall and micro F1 of whole entities; 0 where undefined."""
    of = lambda tags, side: entity_spans(df, keys, tags).select(*keys, "kind", "start", "stop", F.lit(side).alias("side"))
    spans = of(truth, 0).unionByName(of(guess, 1)).groupBy(*keys, "kind", "start", "stop").agg(F.max((F.col("side") == 0).cast("int")).alias("t"), F.max("side").alias("g"))
    all_ = spans.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("truths"), F.coalesce(F.sum("g"), F.lit(0)).alias("guesses"), F.count_if((F.col("t") == 1) & (F.col("g") == 1)).alias("hits"))
    share = lambda x, y: F.coalesce(F.col(x).cast("double") / F.nullif(F.col(y), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(F.lit(2.0) * F.col("hits") / F.nullif(F.col("truths") + F.col("guesses"), F.lit(0)), F.lit(0.0))
    return all_.select(share("hits", "guesses").alias("precision"), share("hits", "truths").alias("recall"), f1.alias("f1"))


def clipped(units: np.ndarray, side: np.ndarray, pairs: int, most: int) -> np.ndarray:
    """Of many pairs of sequences at once, one after another in `units` (numbers), `side` being 2 x pair + 0 or 1: for each pair and n up to `most` the clipped matches, n-grams of the one and of the other."""
    out = np.zeros((pairs, most, 3), np.int64)
    units = np.unique(units, return_inverse=True)[1]
    many = int(units.max()) + 1 if len(units) else 1
    gram, span = units, many
    for n in range(1, most + 1):
        if n > 1:
            if 2 * pairs * span * many >= 1 << 62:  # numbers of n-grams that have become too large are given anew
                gram = np.unique(gram, return_inverse=True)[1]
                span = int(gram.max()) + 1 if len(gram) else 1
            gram, span = gram[:-1] * many + units[n - 1 :], span * many
        whole = side[: len(gram)] == side[n - 1 : n - 1 + len(gram)]
        own, which = side[: len(gram)][whole], gram[whole]
        if not len(own):
            break
        keys, at = np.unique((own >> 1) * (int(which.max()) + 1) + which, return_inverse=True)
        pair = keys // (int(which.max()) + 1)
        first = np.bincount(at, own & 1 == 0, len(keys))
        second = np.bincount(at, own & 1, len(keys))
        for k, counts in enumerate((np.minimum(first, second), first, second)):
            out[:, n - 1, k] = np.bincount(pair, counts, pairs)
    return out


def _sequences(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The units of two columns of word lists or strings as numbers, first and second of each pair in turn, and the side of each."""
    n = len(a)
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
        parts = [t or "" for both in zip(a.to_pylist(), b.to_pylist(), strict=True) for t in both]
        lengths = np.fromiter(map(len, parts), np.int64, 2 * n)
        units = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        return units, np.repeat(np.arange(2 * n), lengths)
    sides = []
    for k, column in enumerate((a, b)):
        lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        sides.append((column.flatten(), np.repeat(np.arange(n) * 2 + k, lengths)))
    words_ = pa.concat_arrays([x for x, _ in sides]).dictionary_encode()
    at = np.concatenate([x for _, x in sides])
    order = np.argsort(at, kind="stable")
    return words_.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], at[order]


def _counts(most: int):
    """For each pair of word lists or strings and each n up to `most`: clipped matches, n-grams of the one and of the other, one after another; all pairs of a batch together."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        units, side = _sequences(a, b)
        made = clipped(units, side, len(a), most)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * (3 * most)), pa.array(made.ravel()))

    return count


def ngram_matches(df: DataFrame, key: str, guess: Column, truth: Column, most: int) -> DataFrame:
    """(key, n, matches, guesses, truths): clipped matches and numbers of n-grams of each pair, for n from 1 to `most`. A pair is counted where it lies; its n-grams are never shuffled."""
    counted = df.select(key, _counts(most)(guess, truth).alias("c"))
    each = F.array(*(F.struct(F.lit(n).alias("n"), *(F.get("c", F.lit(3 * (n - 1) + k)).alias(name) for k, name in enumerate(("matches", "guesses", "truths")))) for n in range(1, most + 1)))
    return counted.select(key, F.explode(each).alias("x")).select(key, "x.*")


def bleu(df: DataFrame, key: str, guess: str, truth: str, most: int = 4) -> DataFrame:
    """One row: corpus BLEU on white-space words (0-100), brevity penalty and the sides' lengths; 0 if an order has no match."""
    n = ngram_matches(df, key, words(guess), words(truth), most).groupBy("n").agg(F.sum("matches").alias("m"), F.sum("guesses").alias("g"), F.sum("truths").alias("t"))
    one = n.agg(
        F.sum(F.when((F.col("m") > 0) & (F.col("g") > 0), F.log(F.col("m").cast("double") / F.col("g")))).alias("logs"),
        F.count_if(F.col("m") > 0).alias("orders"),
        F.max(F.when(F.col("n") == 1, F.col("g"))).alias("guess_words"),
        F.max(F.when(F.col("n") == 1, F.col("t"))).alias("truth_words"),
    )
    penalty = F.when(F.col("guess_words") >= F.col("truth_words"), 1.0).otherwise(F.exp(1 - F.col("truth_words").cast("double") / F.col("guess_words")))
    score = F.when(F.col("orders") == most, F.lit(100.0) * penalty * F.exp(F.col("logs") / most)).otherwise(0.0)
    return one.select(score.alias("bleu"), penalty.alias("brevity"), "guess_words", "truth_words")


def chrf(df: DataFrame, key: str, guess: str, truth: str, most: int = 6, beta: float = 2.0) -> DataFrame:
    """One row: corpus chrF (0-100) on letters without white space, mean of precision and of recall over the orders."""
    signs = lambda c: F.regexp_replace(c, r"\s+", "")
    n = ngram_matches(df, key, signs(guess), signs(truth), most).groupBy("n").agg(F.sum("matches").alias("m"), F.sum("guesses").alias("g"), F.sum("truths").alias("t"))
    ok = n.where("g > 0 AND t > 0").agg(F.avg(F.col("m").cast("double") / F.col("g")).alias("p"), F.avg(F.col("m").cast("double") / F.col("t")).alias("r"))
    f = F.coalesce((1 + beta**2) * F.col("p") * F.col("r") / F.nullif(beta**2 * F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))
    return ok.select((F.lit(100.0) * f).alias("chrf"))


#: Pairs whose longest common subsequences are found at once.
TOGETHER = 2048


def common_lengths(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """The length of the longest common subsequence of each pair of number sequences, many pairs at once."""
    out = np.zeros(len(first), np.int32)
    order = sorted(range(len(first)), key=lambda k: (len(first[k]) // 16, len(second[k])))
    for s in range(0, len(order), TOGETHER):
        own = order[s : s + TOGETHER]
        rows, cols = max(len(first[k]) for k in own), max(len(second[k]) for k in own)
        a, b = np.full((rows, len(own)), -1, np.int64), np.full((cols, len(own)), -2, np.int64)
        for i, k in enumerate(own):
            a[: len(first[k]), i], b[: len(second[k]), i] = first[k], second[k]
        row = np.zeros((cols + 1, len(own)), np.int32)
        for word in a:
            new = row.copy()
            new[1:] = np.maximum(row[1:], np.where(b == word, row[:-1] + 1, 0))
            row = np.maximum.accumulate(new, axis=0)
        out[own] = row[-1]
    return out


@F.arrow_udf(T.IntegerType())
def _common_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """The length of the longest common subsequence of two word lists."""
    units, side = _sequences(a, b)
    parts = np.split(units, np.searchsorted(side, np.arange(1, 2 * len(a))))
    return pa.array(common_lengths(parts[::2], parts[1::2]), pa.int32())


def rouge(df: DataFrame, key: str, guess: str, truth: str) -> DataFrame:
    """One row: mean ROUGE-1, ROUGE-2 and ROUGE-L F1 over the pairs, on lower-cased white-space words; 0 where undefined."""
    g, t = words(F.lower(guess)), words(F.lower(truth))
    f = lambda m, a, b: F.coalesce(F.lit(2.0) * m / F.nullif(a + b, F.lit(0)), F.lit(0.0))
    both = df.where(F.col(guess).isNotNull() & F.col(truth).isNotNull())
    n = ngram_matches(both, key, g, t, 2).select(F.col("n").alias("kind"), f(F.col("matches"), F.col("guesses"), F.col("truths")).alias("f"))
    longest = both.select(g.alias("g"), t.alias("t")).select(F.lit(0).alias("kind"), f(_common_length("g", "t"), F.size("g"), F.size("t")).alias("f"))
    sums = n.unionByName(longest).groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("f"))), F.lit(0.0)).alias(name) for k, name in ((1, "a"), (2, "b"), (0, "l"))), F.greatest(F.count_if(F.col("kind") == 0), F.lit(1)).cast("double").alias("pairs"))
    return sums.select(*((F.col(x) / F.col("pairs")).alias(name) for x, name in (("a", "rouge1"), ("b", "rouge2"), ("l", "rouge_l"))))


def aligned_labels(df: DataFrame, words_col: str, tags_col: str, pieces: Column, most: int, ignore: int = -100) -> DataFrame:
    """Adds `labels`: the tag of each word at its first piece, `ignore` at the others and as padding up to `most`. `pieces` counts the pieces of each word."""
    per = F.transform(F.arrays_zip(F.col(tags_col).alias("tag"), pieces.alias("n")), lambda x: F.concat(F.array(x["tag"].cast("int")), F.array_repeat(F.lit(ignore), x["n"].cast("int") - 1)))
    cut = F.slice(F.flatten(per), 1, most)
    return df.withColumn("labels", F.concat(cut, F.array_repeat(F.lit(ignore), F.lit(most) - F.size(cut))))


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """By group: runs with a value, mean and population standard deviation (null for one run), and the text '0.50 ± 0.10'; 'N/A' for none."""
    own = df.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_pop(value)).alias("std"))
    text = F.when(F.col("runs") == 0, "N/A").when(F.col("std").isNull(), F.format_string("%.2f", "mean")).otherwise(F.format_string("%.2f ± %.2f", "mean", "std"))
    return own.withColumn("shown", text)


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def summary_pivot(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """Rows by `row`, a column for each of `values`, 'N/A' where nothing is."""
    wide = df.groupBy(row).pivot(column, values).agg(F.first(value))
    return wide.select(row, *(F.coalesce(F.col(f"`{v}`"), F.lit("N/A")).alias(v) for v in values))


def perplexity(loss: str | Column, most: float = 20.0) -> Column:
    return F.exp(F.least(F.col(loss) if isinstance(loss, str) else loss, F.lit(most)))


def learning_rate(step: Column, warmup: int, total: int, least: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to `least`."""
    progress = (step - warmup) / float(max(total - warmup, 1))
    return F.when(step < warmup, step / float(max(warmup, 1))).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


def needle_prompts(haystacks: DataFrame, ids: str, needle: Column, lengths: list[int], depths: list[float]) -> DataFrame:
    """For each haystack, length and depth: the token ids cut to the length with the needle's ids at that depth."""
    grid = F.array(*(F.struct(F.lit(n).alias("context_length"), F.lit(d).alias("needle_depth")) for n in lengths for d in depths))
    each = haystacks.withColumn("_g", F.explode(grid)).withColumn("_n", needle)
    room = F.greatest(F.col("_g.context_length") - F.size("_n"), F.lit(0))
    each = each.withColumn("_h", F.slice(ids, 1, room.cast("int")))
    at = F.floor(F.size("_h") * F.col("_g.needle_depth")).cast("int")
    prompt = F.concat(F.slice("_h", 1, at), F.col("_n"), F.slice("_h", at + 1, F.greatest(F.size("_h") - at, F.lit(0))))
    return each.select(*haystacks.columns, "_g.context_length", "_g.needle_depth", prompt.alias("prompt")).withColumn("actual_tokens", F.size("prompt"))




def throughput(log: DataFrame, by: list[str], time: str, tokens: str, goal: int, most_gap: int, ties: list[str] | None = None) -> DataFrame:
    """Adds to each step of a log, by group in order of time: tokens so far, elapsed_s without gaps of more than `most_gap` seconds (restarts), tokens_per_s and eta_s until `goal` tokens; null while nothing has elapsed."""
    over = Window.partitionBy(*by).orderBy(time, *(ties or []))
    gap = F.coalesce(F.unix_micros(time) - F.lag(F.unix_micros(time)).over(over), F.lit(0))
    own = log.withColumn("_gap", gap).withColumn("tokens", F.sum(tokens).over(over).cast("double")).withColumn("elapsed_s", F.sum(F.when(F.col("_gap") <= most_gap * 1_000_000, F.col("_gap")).otherwise(0)).over(over).cast("double") / 1_000_000)
    rate = F.when(F.col("elapsed_s") > 0, F.col("tokens") / F.col("elapsed_s"))
    left = F.greatest(F.lit(float(goal)) - F.col("tokens"), F.lit(0.0))
    return own.withColumn("tokens_per_s", rate).withColumn("eta_s", F.when((F.col("tokens") > 0) & (F.col("elapsed_s") > 0), left / (F.col("tokens") / F.col("elapsed_s")))).drop("_gap")


def looked_up(df: DataFrame, grid: list[tuple], keys: list[str], shown: Column, none: str = "N/A") -> DataFrame:
    """(place, keys, shown): the configured keys in their order, each with its row's value as text, or `none`."""
    rows = [(k, *values) for k, values in enumerate(grid)]
    places = df.sparkSession.createDataFrame(rows, f"place INT, {', '.join(f'{k} STRING' for k in keys)}")
    return places.join(df.select(*keys, shown.alias("_shown")), keys, "left").select("place", *keys, F.coalesce("_shown", F.lit(none)).alias("shown"))


def without_skipped(df: DataFrame, flag: str = "skipped") -> DataFrame:
    """The rows whose flag isn't set; a null flag is none."""
    return df.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def labelled(name: str | Column, labels: dict[str, str]) -> Column:
    """The label of a name; one without a label goes by itself."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), c), c)
