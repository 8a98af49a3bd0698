"""Queries on evaluation data: scores, contamination, runs, schedules, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import ids as I
from khata.functions import text as X
from khata.operators import pack, score
from khata.operators.dedup import ranked
from khata.plans.common import Registry, sql_collapse, sql_count, sql_strip, sql_words, table

R = Registry()

# labels

_GUESS = "CAST(len(text) % 3 AS INTEGER)"
_LABELLED = f"(SELECT item_id, split, label AS y, {_GUESS} AS g FROM sentnob WHERE text IS NOT NULL AND label IS NOT NULL)"


def _labelled(spark, folder):
    """Labels against a rule that stands in for a model."""
    own = table(spark, folder, "sentnob").where("text IS NOT NULL AND label IS NOT NULL")
    return own.select("item_id", "split", F.col("label").alias("y"), (F.length("text") % 3).cast("int").alias("g"))


@R.add(
    f"""WITH c AS (SELECT y, g, count(*) AS n FROM {_LABELLED} GROUP BY ALL), l AS (SELECT y AS label FROM c UNION SELECT g FROM c),
    f AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE y = label AND g = label), 0) AS h, coalesce((SELECT sum(n) FROM c WHERE y = label), 0) AS t, coalesce((SELECT sum(n) FROM c WHERE g = label), 0) AS p FROM l)
    SELECT CAST(sum(t) AS BIGINT) AS n, CAST(sum(h) AS DOUBLE) / sum(t) AS accuracy, avg(CASE WHEN t + p > 0 THEN CAST(2.0 AS DOUBLE) * h / (t + p) ELSE CAST(0 AS DOUBLE) END) AS macro_f1 FROM f"""
)
def accuracy_macro_f1(spark, folder):
    return score.accuracy_macro_f1(_labelled(spark, folder), "y", "g")


@R.add(f"SELECT y AS truth, g AS guess, count(*) AS n FROM {_LABELLED} GROUP BY ALL")
def confusion(spark, folder):
    return score.confusion(_labelled(spark, folder), "y", "g")


@R.add("SELECT split, label, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY split) AS share FROM sentnob GROUP BY split, label")
def label_distribution(spark, folder):
    own = table(spark, folder, "sentnob").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy("split").agg(F.sum("n").alias("total"))
    return own.join(total, "split").select("split", "label", "n", (F.col("n").cast("double") / F.col("total")).alias("share"))


@R.add("SELECT item_id, CASE label WHEN 0 THEN '<|positive|>' WHEN 1 THEN '<|negative|>' WHEN 2 THEN '<|neutral|>' END AS token FROM sentnob")
def sentiment_tokens(spark, folder):
    names = F.create_map(*(F.lit(x) for pair in ((0, "positive"), (1, "negative"), (2, "neutral")) for x in pair))
    tokens = F.create_map(*(F.lit(x) for pair in X.SENTIMENT.items() for x in pair))
    return table(spark, folder, "sentnob").select("item_id", tokens[names[F.col("label")]].alias("token"))


@R.add("SELECT DISTINCT lang FROM lang_samples")
def distinct_labels(spark, folder):
    return table(spark, folder, "lang_samples").select("lang").distinct()


@R.add("SELECT sample_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label FROM lang_samples")
def label_encoding(spark, folder):
    from pyspark.sql import Window

    own = table(spark, folder, "lang_samples")
    names = own.select("lang").distinct()  # as many rows as there are labels
    numbers = names.withColumn("label", (F.row_number().over(Window.orderBy("lang")) - 1).cast("int"))
    return own.join(numbers, "lang").select("sample_id", "label")


# held-out material in the corpus

_KEY = "sha256(lower({}))"
_ITEMS = f"(SELECT DISTINCT {_KEY.format(sql_strip('text'))} AS item_key FROM sentnob WHERE split IN ('validation', 'test') AND trim(coalesce(text, '')) <> '')"
_PARTS = f"(SELECT unnest(string_split(body, chr(10))) AS line FROM (SELECT regexp_replace(unnest(list_filter(string_split(regexp_replace(text, '(<\\|[^>]+\\|>)', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '')), '^<\\|[^>]+\\|>', '') AS body FROM documents WHERE text IS NOT NULL))"


def _held_out(spark, folder):
    return table(spark, folder, "sentnob").where("split in ('validation', 'test')")


@R.add(f"SELECT item_key FROM {_ITEMS} WHERE item_key IN (SELECT {_KEY.format(sql_strip('text'))} FROM documents WHERE text IS NOT NULL UNION ALL SELECT {_KEY.format(sql_strip('source'))} FROM documents WHERE source IS NOT NULL)")
def contamination_exact(spark, folder):
    return score.contamination(_held_out(spark, folder), table(spark, folder, "documents"), "text", ["text", "source"])


@R.add(f"SELECT item_key FROM {_ITEMS} WHERE item_key IN (SELECT {_KEY.format(sql_strip('line'))} FROM {_PARTS})")
def contamination_segment(spark, folder):
    return score.contamination_by_segment(_held_out(spark, folder), table(spark, folder, "documents"), "text", "text")


@R.add(f"SELECT items, found, CAST(found AS DOUBLE) / greatest(items, 1) AS rate, CAST(found AS DOUBLE) / greatest(items, 1) <= CAST(0.02 AS DOUBLE) AS passes FROM (SELECT count(*) AS items, count(*) FILTER (item_key IN (SELECT {_KEY.format(sql_strip('line'))} FROM {_PARTS})) AS found FROM {_ITEMS})")
def contamination_gate(spark, folder):
    items = _held_out(spark, folder)
    return score.gate(score.contamination_by_segment(items, table(spark, folder, "documents"), "text", "text"), items, "text")


# translations and summaries: each pair's English side against that of the pair before it in its batch

_TRANSLATED = "(SELECT pair_id, en AS guess, lag(en) OVER (PARTITION BY batch ORDER BY pair_id) AS truth FROM parallel_pairs WHERE en IS NOT NULL)"
_SPLIT = "(SELECT pair_id AS k, {} AS a, {} AS b FROM " + _TRANSLATED + " WHERE truth IS NOT NULL)"


def _translated(spark, folder):
    from pyspark.sql import Window

    own = table(spark, folder, "parallel_pairs").where("en IS NOT NULL")
    before = F.lag("en").over(Window.partitionBy("batch").orderBy("pair_id"))
    return own.select("pair_id", F.col("en").alias("guess"), before.alias("truth")).where("truth IS NOT NULL")


def _sql_grams(source: str, orders: range) -> str:
    """Clipped matches by pair and order in SQL."""
    each = " UNION ALL ".join(
        f"SELECT k, {n} AS n, 0 AS s, array_to_string(a[i:i + {n - 1}], chr(1)) AS gram FROM (SELECT k, a, unnest(range(1, len(a) - {n - 1} + 1)) AS i FROM {source}) UNION ALL SELECT k, {n}, 1, array_to_string(b[i:i + {n - 1}], chr(1)) FROM (SELECT k, b, unnest(range(1, len(b) - {n - 1} + 1)) AS i FROM {source})"
        for n in orders
    )
    return f"(SELECT k, n, sum(least(x, y)) AS m, sum(x) AS g, sum(y) AS t FROM (SELECT k, n, gram, count(*) FILTER (s = 0) AS x, count(*) FILTER (s = 1) AS y FROM ({each}) GROUP BY ALL) GROUP BY k, n)"


_WORDS = _SPLIT.format(sql_words("guess"), sql_words("truth"))
_LOWER = _SPLIT.format(sql_words("lower(guess)"), sql_words("lower(truth)"))
_SIGNS = _SPLIT.format("string_split(regexp_replace(guess, '\\s+', '', 'g'), '')", "string_split(regexp_replace(truth, '\\s+', '', 'g'), '')")


@R.add(
    f"""WITH o AS (SELECT n, CAST(sum(m) AS DOUBLE) AS m, sum(g) AS g, sum(t) AS t FROM {_sql_grams(_WORDS, range(1, 5))} GROUP BY n),
    x AS (SELECT sum(CASE WHEN m > 0 THEN ln(m / g) END) AS logs, count(*) FILTER (m > 0) AS orders, CAST(max(CASE WHEN n = 1 THEN g END) AS BIGINT) AS guess_words, CAST(max(CASE WHEN n = 1 THEN t END) AS BIGINT) AS truth_words FROM o),
    y AS (SELECT *, CASE WHEN guess_words >= truth_words THEN CAST(1 AS DOUBLE) ELSE exp(1 - CAST(truth_words AS DOUBLE) / guess_words) END AS brevity FROM x)
    SELECT round(CASE WHEN orders = 4 THEN 100 * brevity * exp(logs / 4) ELSE CAST(0 AS DOUBLE) END, 7) AS bleu, brevity, guess_words, truth_words FROM y"""
)
def bleu(spark, folder):
    return score.bleu(_translated(spark, folder), "pair_id", "guess", "truth").withColumn("bleu", F.round("bleu", 7))


@R.add(
    f"""WITH o AS (SELECT n, CAST(sum(m) AS DOUBLE) AS m, sum(g) AS g, sum(t) AS t FROM {_sql_grams(_SIGNS, range(1, 7))} GROUP BY n), x AS (SELECT avg(m / g) AS p, avg(m / t) AS r FROM o WHERE g > 0 AND t > 0)
    SELECT round(coalesce(100 * 5 * p * r / nullif(4 * p + r, 0), 0), 7) AS chrf FROM x"""
)
def chrf(spark, folder):
    return score.chrf(_translated(spark, folder), "pair_id", "guess", "truth").select(F.round("chrf", 7).alias("chrf"))


@R.add(
    f"""WITH o AS (SELECT n, CASE WHEN g + t > 0 THEN CAST(2.0 AS DOUBLE) * m / (g + t) ELSE CAST(0 AS DOUBLE) END AS f FROM {_sql_grams(_LOWER, range(1, 3))}), p AS (SELECT count(*) AS pairs FROM {_LOWER})
    SELECT round(sum(CASE WHEN n = 1 THEN f END) / max(pairs), 7) AS rouge1, round(sum(CASE WHEN n = 2 THEN f END) / max(pairs), 7) AS rouge2 FROM o, p"""
)
def rouge_ngrams(spark, folder):
    own = score.rouge(_translated(spark, folder), "pair_id", "guess", "truth")
    return own.select(F.round("rouge1", 7).alias("rouge1"), F.round("rouge2", 7).alias("rouge2"))


@R.add(
    f"""WITH RECURSIVE w AS (SELECT k, a, b FROM {_LOWER}), r AS (SELECT k, 0 AS i, [0 FOR j IN range(len(b) + 1)] AS cells FROM w UNION ALL
    SELECT k, i + 1, list_prepend(0, [list_max(c[1:j]) FOR j IN range(1, len(b) + 1)]) FROM (SELECT r.k, i, w.b, [greatest(cells[j + 1], CASE WHEN w.b[j] = w.a[i + 1] THEN cells[j] + 1 ELSE 0 END) FOR j IN range(1, len(w.b) + 1)] AS c FROM r JOIN w ON r.k = w.k WHERE i < len(w.a)))
    SELECT round(avg(CASE WHEN len(a) + len(b) > 0 THEN CAST(2.0 AS DOUBLE) * cells[len(cells)] / (len(a) + len(b)) ELSE CAST(0 AS DOUBLE) END), 7) AS rouge_l FROM r JOIN w ON r.k = w.k WHERE i = len(a)"""
)
def rouge_longest(spark, folder):
    return score.rouge(_translated(spark, folder), "pair_id", "guess", "truth").select(F.round("rouge_l", 7).alias("rouge_l"))


@R.add()
def rouge(spark, folder):
    return score.rouge(_translated(spark, folder), "pair_id", "guess", "truth")


def _tagged(samples):
    """Sentences as tagged words: capitalised words are entities, by length of two kinds; the guess takes longer ones only."""
    own = samples.select("sample_id", X.words("text").alias("words"))
    kind = lambda w: F.when(F.length(w) % 2 == 0, "PER").otherwise("LOC")
    tag = lambda least: lambda w: F.when(w.rlike("^[A-Z]") & (F.length(w) >= least), F.concat(F.lit("B-"), kind(w))).otherwise("O")
    return own.select("sample_id", "words", F.transform("words", tag(1)).alias("truth"), F.transform("words", tag(7)).alias("guess"))


_TAGS = f"(SELECT sample_id, w FROM (SELECT sample_id, unnest({sql_words('text')}) AS w FROM lang_samples WHERE lang IN ('en', 'bnls')) WHERE regexp_matches(w, '^[A-Z]'))"


@R.add(
    f"""SELECT CAST(1 AS DOUBLE) AS precision, CAST(p AS DOUBLE) / t AS recall, CAST(2.0 AS DOUBLE) * p / (p + t) AS f1 FROM (SELECT count(*) AS t, count(*) FILTER (length(w) >= 7) AS p FROM {_TAGS})"""
)
def entity_f1(spark, folder):
    return score.entity_f1(_tagged(table(spark, folder, "lang_samples").where("lang in ('en', 'bnls')")), ["sample_id"], "truth", "guess")


_TAG_IDS = f"(SELECT sample_id, [[CASE WHEN regexp_matches(w, '^[A-Z]') THEN 1 ELSE 0 END] || [-100 FOR j IN range(CAST(ceil(length(w) / 6.0) AS INTEGER) - 1)] FOR w IN {sql_words('text')}] AS each FROM lang_samples WHERE text IS NOT NULL)"


@R.add(f"SELECT sample_id, list_resize(flatten(each)[1:48], 48, -100) AS labels FROM {_TAG_IDS}")
def label_align(spark, folder):
    own = _tagged(table(spark, folder, "lang_samples")).withColumn("ids", F.transform("truth", lambda t: F.when(t == "O", 0).otherwise(1)))
    pieces = F.transform("words", lambda w: F.ceil(F.length(w) / 6).cast("int"))
    return score.aligned_labels(own, "words", "ids", pieces, 48).select("sample_id", "labels")


# runs


@R.add(
    """SELECT model, task, dataset, count(macro_f1) AS runs, round(avg(macro_f1), 8) AS mean, CASE WHEN count(macro_f1) > 1 THEN round(stddev_pop(macro_f1), 8) END AS std,
    CASE WHEN count(macro_f1) = 0 THEN 'N/A' WHEN count(macro_f1) = 1 THEN printf('%.2f', avg(macro_f1)) ELSE printf('%.2f ± %.2f', avg(macro_f1), stddev_pop(macro_f1)) END AS shown FROM run_results GROUP BY ALL"""
)
def mean_std_seeds(spark, folder):
    own = score.mean_std(table(spark, folder, "run_results"), ["model", "task", "dataset"], "macro_f1")
    return own.withColumn("mean", F.round("mean", 8)).withColumn("std", F.round("std", 8))


@R.add(
    """SELECT model, coalesce(max(CASE WHEN task = '01_sentiment' THEN v END), 'N/A') AS "01_sentiment", coalesce(max(CASE WHEN task = '02_ner' THEN v END), 'N/A') AS "02_ner", coalesce(max(CASE WHEN task = '03_nli' THEN v END), 'N/A') AS "03_nli"
    FROM (SELECT model, task, CAST(count(*) AS VARCHAR) AS v FROM run_results GROUP BY ALL) GROUP BY model"""
)
def summary_pivot(spark, folder):
    own = table(spark, folder, "run_results").groupBy("model", "task").agg(F.count(F.lit(1)).cast("string").alias("v"))
    return score.summary_pivot(own, "model", "task", ["01_sentiment", "02_ner", "03_nli"], "v")


SEEDS = (42, 1552, 1839)


@R.add("SELECT m.model, CAST(s.seed AS INTEGER) AS seed FROM (SELECT DISTINCT model FROM run_results) m, (VALUES (42), (1552), (1839)) s(seed) WHERE NOT EXISTS (SELECT 1 FROM run_results r WHERE r.model = m.model AND r.seed = s.seed)")
def pending_runs(spark, folder):
    """Of each model the configured seeds that have no run."""
    runs = table(spark, folder, "run_results")
    grid = runs.select("model").distinct().withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    return score.pending(grid, runs, ["model", "seed"])


@R.add("SELECT task, count(*) AS runs, count(*) FILTER (macro_f1 IS NOT NULL OR entity_f1 IS NOT NULL) AS completed, count(*) FILTER (macro_f1 IS NULL AND entity_f1 IS NULL AND accuracy IS NOT NULL) AS partial, count(*) FILTER (macro_f1 IS NULL AND entity_f1 IS NULL AND accuracy IS NULL) AS failed FROM run_results GROUP BY task")
def manifest_counts(spark, folder):
    no_f1 = F.col("macro_f1").isNull() & F.col("entity_f1").isNull()
    return table(spark, folder, "run_results").groupBy("task").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~no_f1).alias("completed"), F.count_if(no_f1 & F.col("accuracy").isNotNull()).alias("partial"), F.count_if(no_f1 & F.col("accuracy").isNull()).alias("failed")
    )


@R.add("SELECT model, task, run_id, score FROM (SELECT model, task, run_id, coalesce(macro_f1, entity_f1) AS score, row_number() OVER (PARTITION BY model, task ORDER BY coalesce(macro_f1, entity_f1) DESC, logged_at, run_id) AS r FROM run_results WHERE coalesce(macro_f1, entity_f1) IS NOT NULL) WHERE r = 1")
def best_run(spark, folder):
    """The best run of each model and task; the first of equal ones."""
    own = table(spark, folder, "run_results").withColumn("score", F.coalesce("macro_f1", "entity_f1")).where("score IS NOT NULL")
    return ranked(own, ["model", "task"], [F.desc("score"), F.asc("logged_at"), F.asc("run_id")]).where("rank = 1").select("model", "task", "run_id", "score")


@R.add("SELECT model, run_id FROM (SELECT model, run_id, row_number() OVER (PARTITION BY model ORDER BY logged_at DESC, run_id DESC) AS r, row_number() OVER (PARTITION BY model ORDER BY coalesce(macro_f1, entity_f1, -1) DESC, run_id) AS b FROM run_results) WHERE r <= 3 OR b = 1")
def retain_runs(spark, folder):
    """Of each model the last three runs and the best one (a retention rule)."""
    own = table(spark, folder, "run_results").withColumn("score", F.coalesce("macro_f1", "entity_f1", F.lit(-1.0)))
    last = ranked(own, ["model"], [F.desc("logged_at"), F.desc("run_id")]).withColumnRenamed("rank", "last")
    return ranked(last, ["model"], [F.desc("score"), F.asc("run_id")]).where("last <= 3 OR rank = 1").select("model", "run_id")


@R.add("SELECT model, arg_max(run_id, logged_at) AS run_id FROM (SELECT model, max(run_id) AS run_id, logged_at FROM run_results GROUP BY model, logged_at) GROUP BY model")
def latest_run(spark, folder):
    return table(spark, folder, "run_results").groupBy("model").agg(F.max(F.struct("logged_at", "run_id")).alias("m")).select("model", "m.run_id")


@R.add("SELECT *, accuracy - lag(accuracy) OVER (PARTITION BY model, task ORDER BY logged_at, run_id) AS change FROM (SELECT run_id, model, task, logged_at, accuracy FROM run_results)")
def accuracy_changes(spark, folder):
    from pyspark.sql import Window

    over = Window.partitionBy("model", "task").orderBy("logged_at", "run_id")
    return table(spark, folder, "run_results").select("run_id", "model", "task", "logged_at", "accuracy").withColumn("change", F.col("accuracy") - F.lag("accuracy").over(over))


@R.add("SELECT task, round(avg(p), 4) AS overall FROM (SELECT task, dataset, avg(exp(least((1 - accuracy) * 30, 20))) AS p FROM run_results WHERE accuracy IS NOT NULL GROUP BY ALL) GROUP BY task")
def perplexity_rollup(spark, folder):
    """The mean over subsets of their perplexities, each subset counting the same."""
    own = table(spark, folder, "run_results").where("accuracy IS NOT NULL").select("task", "dataset", score.perplexity((1 - F.col("accuracy")) * 30).alias("p"))
    return own.groupBy("task", "dataset").agg(F.avg("p").alias("p")).groupBy("task").agg(F.round(F.avg("p"), 4).alias("overall"))


@R.add("SELECT range AS step, CASE WHEN range < 100 THEN range / CAST(100 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * CAST(0.5 AS DOUBLE) * (1 + cos(pi() * ((range - 100) / CAST(900 AS DOUBLE)))) END AS rate FROM range(1000)")
def lr_schedule(spark, folder):
    own = spark.range(1000).withColumnRenamed("id", "step")
    return own.select("step", score.learning_rate(F.col("step"), 100, 1000).alias("rate"))


@R.add("SELECT event_id, value - lag(value) OVER w AS change, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def metric_log_rates(spark, folder):
    from pyspark.sql import Window

    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select("event_id", (F.col("value") - F.lag("value").over(over)).alias("change"), (micros - F.lag(micros).over(over)).alias("elapsed"))


# domains

_DOMAIN = "CASE WHEN f LIKE 'opus\\_nmt%' ESCAPE '\\' OR contains(f, '_nmt_') THEN 'nmt' WHEN f LIKE 'sn\\_%' ESCAPE '\\' OR contains(f, '_sn_') THEN 'sn' WHEN f LIKE 'en\\_%' ESCAPE '\\' OR contains(f, '_en_') THEN 'en' WHEN f LIKE 'bn\\_%' ESCAPE '\\' OR contains(f, '_bn_') THEN 'bn' ELSE 'other' END"


def domain_of(name):
    """The domain a shard's name says; the first rule that fits counts."""
    rules = (("nmt", ("opus_nmt",), "_nmt_"), ("sn", ("sn_",), "_sn_"), ("en", ("en_",), "_en_"), ("bn", ("bn_",), "_bn_"))
    out = F.lit("other")
    for domain, (begins,), holds in reversed(rules):
        out = F.when(name.startswith(begins) | name.contains(holds), domain).otherwise(out)
    return out


_NAMED = "(SELECT coalesce(s.domain, 'other') || '_' || split_part(l.file, '/', -1) AS f, line_id FROM raw_lines l LEFT JOIN sources s ON starts_with(split_part(l.file, '/', -1), s.source))"


def _shards(spark, folder):
    """Files named after their domain, with their lines."""
    base = F.element_at(F.split("file", "/"), -1)
    files = table(spark, folder, "raw_lines").groupBy(base.alias("base")).agg(F.count(F.lit(1)).alias("lines"))
    known = table(spark, folder, "sources").select(F.col("source").alias("key"), F.col("domain").alias("d"))
    files = files.withColumn("key", F.regexp_replace("base", r"(_[0-9]+)?\.jsonl$", ""))
    return files.join(known, "key", "left").select(F.concat(F.coalesce("d", F.lit("other")), F.lit("_"), "base").alias("f"), "lines")


@R.add(f"SELECT domain, lines, CAST(lines AS DOUBLE) / sum(lines) OVER () AS share FROM (SELECT {_DOMAIN} AS domain, count(*) AS lines FROM {_NAMED} GROUP BY 1)")
def domain_share(spark, folder):
    from pyspark.sql import Window

    own = _shards(spark, folder).groupBy(domain_of(F.col("f")).alias("domain")).agg(F.sum("lines").alias("lines"))  # five rows
    return own.withColumn("total", F.sum("lines").over(Window.partitionBy())).select("domain", "lines", (F.col("lines").cast("double") / F.col("total")).alias("share"))


@R.add(
    f"""SELECT name, CAST(100.0 AS DOUBLE) * bn / t AS bn, CAST(100.0 AS DOUBLE) * en / t AS en, CAST(100.0 AS DOUBLE) * nmt / t AS nmt, CAST(100.0 AS DOUBLE) * sn / t AS sn FROM (SELECT regexp_replace(f, '.*_([0-9]+)\\.jsonl$', '\\1') AS name,
    count(*) FILTER ({_DOMAIN} = 'bn') AS bn, count(*) FILTER ({_DOMAIN} = 'en') AS en, count(*) FILTER ({_DOMAIN} = 'nmt') AS nmt, count(*) FILTER ({_DOMAIN} = 'sn') AS sn, count(*) AS t FROM {_NAMED} GROUP BY 1)"""
)
def domain_pivot(spark, folder):
    """Shares of the domains by number of file, in per cent."""
    own = _shards(spark, folder).select(F.regexp_replace("f", r".*_([0-9]+)\.jsonl$", "$1").alias("name"), domain_of(F.col("f")).alias("domain"), "lines")
    total = own.groupBy("name").agg(F.sum("lines").alias("t"))
    wide = own.groupBy("name").pivot("domain", ["bn", "en", "nmt", "sn"]).sum("lines").na.fill(0).join(total, "name")
    return wide.select("name", *((F.lit(100.0) * F.col(d) / F.col("t")).alias(d) for d in ("bn", "en", "nmt", "sn")))


_LABELS = {"bn": "Bangla", "en": "English", "sn": "Verified Bangla", "nmt": "Translation pairs"}


@R.add(f"SELECT DISTINCT split_part(file, '/', -1) AS base, {_DOMAIN} AS domain, CASE {_DOMAIN} WHEN 'bn' THEN 'Bangla' WHEN 'en' THEN 'English' WHEN 'sn' THEN 'Verified Bangla' WHEN 'nmt' THEN 'Translation pairs' ELSE {_DOMAIN} END AS label FROM (SELECT file, replace(split_part(file, '/', -1), 'opus_', 'opus_nmt_') AS f FROM raw_lines)")
def domain_labels(spark, folder):
    """The files' own names with their domain and its label; a domain without a label goes by its name. Names of one collection carry its domain as shards do."""
    base = F.element_at(F.split("file", "/"), -1)
    own = table(spark, folder, "raw_lines").select(base.alias("base")).distinct().withColumn("domain", domain_of(F.replace(F.col("base"), F.lit("opus_"), F.lit("opus_nmt_"))))
    return own.withColumn("label", score.labelled("domain", _LABELS))


# chats and prompts

_TURNS = "(SELECT batch, pair_id, 0 AS turn, 'user' AS role, bn AS content FROM parallel_pairs WHERE bn IS NOT NULL UNION ALL SELECT batch, pair_id, 1, 'assistant', en FROM parallel_pairs WHERE en IS NOT NULL)"


@R.add(f"SELECT pair_id, string_agg('<|im_start|><|' || role || '|>' || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|><|assistant|>' || chr(10) AS chat FROM {_TURNS} GROUP BY pair_id")
def chat_render(spark, folder):
    from khata.functions.prompts import chat

    own = table(spark, folder, "parallel_pairs").select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("bn").alias("content")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("en").alias("content")))).alias("m")).select("pair_id", "m.*").where("content IS NOT NULL")
    return chat(own, ["pair_id"], ask=True)


@R.add("SELECT pair_id, replace('Translate: {source}\\n', '{source}', bn) AS prompt FROM parallel_pairs WHERE bn IS NOT NULL")
def prompts(spark, folder):
    from khata.functions.prompts import filled

    return table(spark, folder, "parallel_pairs").where("bn IS NOT NULL").select("pair_id", filled("Translate: {source}\\n", source="bn").alias("prompt"))


@R.add("SELECT pair_id, 'Q: one = ?' || chr(10) || 'A: 1' || chr(10) || chr(10) || 'Q: ' || bn || ' = ?' || chr(10) || 'A: ' || en AS prompt FROM parallel_pairs WHERE bn IS NOT NULL AND en IS NOT NULL")
def few_shot_prompts(spark, folder):
    """A template after one example; what the values hold is not expanded."""
    from khata.functions.prompts import few_shot

    own = table(spark, folder, "parallel_pairs").where("bn IS NOT NULL AND en IS NOT NULL")
    return own.select("pair_id", few_shot("Q: {q} = ?\nA: {a}", [{"q": "one", "a": "1"}], q="bn", a="en").alias("prompt"))


@R.add("SELECT pair_id, bn || ' । ' || en AS text FROM parallel_pairs WHERE bn IS NOT NULL AND en IS NOT NULL")
def sentence_pairs(spark, folder):
    from khata.functions.prompts import joined_pair

    return table(spark, folder, "parallel_pairs").where("bn IS NOT NULL AND en IS NOT NULL").select("pair_id", joined_pair("bn", "en").alias("text"))


def _haystacks(spark, folder):
    docs = table(spark, folder, "documents").where(F.length("text") >= 500)
    return docs.select("doc_id", pack.token_ids("text", end=False).alias("ids"))


_DEPTHS, _LENGTHS = (0.0, 0.5, 1.0), (64, 128)
_GRID = f"""(SELECT doc_id, n, context_length, CAST(needle_depth AS DOUBLE) AS needle_depth FROM (SELECT doc_id, len({sql_words('text')}) AS n FROM documents WHERE length(text) >= 500), (VALUES (64), (128)) c(context_length), (VALUES (0.0), (0.5), (1.0)) d(needle_depth))"""
_NEEDLE = (7, 8, 9)  # no ids of words


def _prompts(spark, folder):
    return score.needle_prompts(_haystacks(spark, folder), "ids", F.array(*map(F.lit, _NEEDLE)), list(_LENGTHS), list(_DEPTHS))


@R.add(f"SELECT doc_id, context_length, needle_depth, CAST(floor(least(n, context_length - 3) * needle_depth) AS INTEGER) AS needle_at, CAST(least(n, context_length - 3) + 3 AS INTEGER) AS tokens, TRUE AS whole FROM {_GRID}")
def needle_places(spark, folder):
    """Of each prompt where the needle begins, whether it stands there whole, and the prompt's length."""
    own = _prompts(spark, folder).withColumn("needle_at", (F.array_position("prompt", _NEEDLE[0]) - 1).cast("int"))
    whole = F.slice("prompt", F.col("needle_at") + 1, F.lit(len(_NEEDLE))) == F.array(*map(F.lit, _NEEDLE))
    return own.select("doc_id", "context_length", "needle_depth", "needle_at", F.col("actual_tokens").cast("int").alias("tokens"), whole.alias("whole"))


_ASKED = "md5(doc_id || ':' || context_length || ':' || CAST(needle_depth * 10 AS INTEGER)) < 'a'"


@R.add(f"SELECT context_length, needle_depth, count(*) AS prompts, avg(CASE WHEN {_ASKED} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy FROM {_GRID} GROUP BY GROUPING SETS ((context_length, needle_depth), (context_length), (needle_depth), ())")
def retrieval_by_place(spark, folder):
    """The share of answers that hold what was expected, by length and depth, by each of them, and overall. The answers stand in for a model's: a digest decides which hold it, in other letter case."""
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("context_length").cast("string"), (F.col("needle_depth") * 10).cast("int").cast("string")))
    own = _prompts(spark, folder).select("context_length", "needle_depth", F.concat(F.lit("Secret-"), F.substring(key, 1, 6)).alias("expected"), key.alias("key"))
    given = F.when(F.col("key") < "a", F.concat(F.lit("It is  "), F.upper("expected"), F.lit("."))).otherwise("I don't know.")
    hit = own.select("context_length", "needle_depth", I.contains_answer(given, "expected").cast("double").alias("hit"))
    return hit.cube("context_length", "needle_depth").agg(F.count(F.lit(1)).alias("prompts"), F.avg("hit").alias("accuracy"))


# logs, grids and samples

_GAP, _GOAL = 3600, 1_000_000
_STEPS = "(SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS gap FROM events)"


@R.add(
    f"""SELECT event_id, tokens, elapsed_s, CASE WHEN elapsed_s > 0 THEN round(tokens / elapsed_s, 6) END AS tokens_per_s, CASE WHEN tokens > 0 AND elapsed_s > 0 THEN round(greatest({_GOAL} - tokens, 0) / (tokens / elapsed_s), 3) END AS eta_s
    FROM (SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS DOUBLE) AS tokens, CAST(sum(CASE WHEN gap <= {_GAP}000000 THEN gap ELSE 0 END) OVER w AS DOUBLE) / 1000000 AS elapsed_s FROM {_STEPS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
)
def throughput(spark, folder):
    """Of each step of a log tokens so far, seconds so far without the breaks between restarts, tokens a second, and seconds until the goal."""
    own = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").alias("step_tokens"))
    return score.throughput(own, ["user_id"], "ts", "step_tokens", _GOAL, _GAP, ["event_id"]).select("event_id", "tokens", "elapsed_s", F.round("tokens_per_s", 6).alias("tokens_per_s"), F.round("eta_s", 3).alias("eta_s"))


@R.add(
    """SELECT CAST(g.place AS INTEGER) AS place, g.dataset, g.model, coalesce(printf('%.4f', m.v), 'N/A') AS shown FROM (SELECT row_number() OVER () - 1 AS place, dataset, model FROM (SELECT * FROM (VALUES ('ancholik', 'model_01'), ('ancholik', 'model_10'), ('wikiann', 'model_01'), ('wikiann', 'model_10'), ('SentNoB', 'model_32'), ('SentNoB', 'none')) x(dataset, model))) g
    LEFT JOIN (SELECT dataset, model, max(coalesce(macro_f1, entity_f1)) AS v FROM run_results GROUP BY ALL) m ON g.dataset = m.dataset AND g.model = m.model"""
)
def grid_lookup(spark, folder):
    """The configured datasets and models in their order, each with its best score, or N/A."""
    best = table(spark, folder, "run_results").groupBy("dataset", "model").agg(F.max(F.coalesce("macro_f1", "entity_f1")).alias("v"))
    grid = [("ancholik", "model_01"), ("ancholik", "model_10"), ("wikiann", "model_01"), ("wikiann", "model_10"), ("SentNoB", "model_32"), ("SentNoB", "none")]
    return score.looked_up(best, grid, ["dataset", "model"], F.when(F.col("v").isNotNull(), F.format_string("%.4f", "v")))


@R.add("SELECT run_id, model, task FROM run_results WHERE coalesce(macro_f1, entity_f1, accuracy) IS NOT NULL")
def not_skipped(spark, folder):
    """Results that are not flagged as skipped; a run without any metric is."""
    own = table(spark, folder, "run_results").withColumn("skipped", F.coalesce("macro_f1", "entity_f1", "accuracy").isNull())
    return score.without_skipped(own).select("run_id", "model", "task")


@R.add(f"SELECT item_key FROM {_ITEMS} WHERE item_key IN (SELECT {_KEY.format(sql_strip('line'))} FROM {_PARTS}) ORDER BY item_key LIMIT 10")
def contamination_samples(spark, folder):
    """Ten of the held-out keys that were found, the first by key (the feature)."""
    return score.contamination_by_segment(_held_out(spark, folder), table(spark, folder, "documents"), "text", "text").orderBy("item_key").limit(10)


@R.add(f"SELECT doc_id, {sql_collapse('text')} AS line, {sql_count('text')} AS n FROM (SELECT doc_id, array_to_string([trim(l, ' ') FOR l IN string_split(text, chr(10)) IF length(trim(l, ' ')) >= 40 AND NOT starts_with(trim(l, ' '), '|')], ' ') AS text FROM documents WHERE length(text) >= 500) WHERE length(text) >= 500")
def article_cleanup(spark, folder):
    """Long articles without short and markup lines, as one line."""
    from khata.functions.prompts import cleaned_article

    own = table(spark, folder, "documents").where(F.length("text") >= 500).select("doc_id", cleaned_article("text").alias("t")).where(F.length("t") >= 500)
    return own.select("doc_id", X.collapse("t").alias("line"), X.word_count("t").cast("bigint").alias("n"))
