"""Queries that write a table in a format and read it back: each format's sink and source against the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import text as X
from khata.plans.common import SOURCED, Registry, sourced, sql_words, table
from khata.plans.packing import _SEQS, _seqs
from khata.session import scratch, written
from khata.sources import archives, files, lines, npy, places

R = Registry()

_FIELDS = ("text", "source", "source_type", "language_region", "word_count")


@R.add(f"SELECT {', '.join(_FIELDS)} FROM documents")
def jsonl_round_trip(spark, folder):
    """JSON lines, written over what was there and read strictly."""
    place = scratch(spark, "jsonl")
    files.write_jsonl(table(spark, folder, "documents").select(*_FIELDS), place)
    return lines.read_jsonl(spark, place, strict=True).select(*_FIELDS)


@R.add("SELECT log_id, token, batch FROM failure_log, (VALUES (1), (2)) b(batch)")
def jsonl_append(spark, folder):
    """Two runs appended to one log, each line with its time of writing."""
    place = scratch(spark, "log")
    own = table(spark, folder, "failure_log").select("log_id", "token")
    for batch in (1, 2):
        files.write_jsonl(own.withColumn("batch", F.lit(batch)), place, append=True, stamped=True)
    return spark.read.schema("log_id BIGINT, token STRING, batch INT, timestamp STRING").json(place).where("timestamp IS NOT NULL").drop("timestamp")


@R.add("SELECT s AS source, n FROM (SELECT source AS s, count(*) AS n FROM failure_log WHERE token IS NOT NULL GROUP BY source)")
def side_output(spark, folder):
    """A failure log that is there only if it has rows, counted by source; one without rows leaves nothing, and a path that isn't there reads as no rows."""
    own = table(spark, folder, "failure_log").select("source", "token")
    one, none = scratch(spark, "failures"), scratch(spark, "none")
    files.write_if_any(own.where("token IS NOT NULL"), one)
    files.write_if_any(own.where("false"), none)
    schema = own.schema
    both = lines.read_jsonl(spark, one, schema, missing_ok=True).unionByName(lines.read_jsonl(spark, none, schema, missing_ok=True))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_PLAIN = "regexp_replace({}, '[\\t\\r\\n]', ' ', 'g')"


@R.add(f"SELECT {_PLAIN.format('raw')} AS value FROM raw_lines WHERE raw IS NOT NULL")
def archive_lines(spark, folder):
    """Lines as members of tar.bz2 and zip archives, one for each written file."""
    place = scratch(spark, "lines")
    table(spark, folder, "raw_lines").where("raw IS NOT NULL").select(F.regexp_replace("raw", "[\\t\\r\\n]", " ").alias("value")).write.text(place)
    packed = scratch(spark, "archives")
    archives.write_archives(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(place), packed).write.format("noop").mode("overwrite").save()
    return archives.read_lines(spark, packed, ".jsonl").select("value")


@R.add(f"SELECT shard, seq, input_ids FROM {_SEQS}")
def npy_round_trip(spark, folder):
    """Packed sequences as shards of 16-bit numbers. The place must be mounted."""
    npy.register(spark)
    place = places.mounted(scratch(spark, "npy"))
    _seqs(spark, folder).repartition("shard").write.format("npy_shards").mode("overwrite").save(place)
    return spark.read.format("npy_shards").load(place)


def _tag(word):
    return F.when(word.rlike("^[A-Z]"), "B-PER").otherwise("O")


def _tagged_file(spark, folder):
    """Sentences as 'token tag' lines, a blank line after each."""
    place = scratch(spark, "conll")
    own = table(spark, folder, "lang_samples").where(F.size(X.words("text")) > 0)
    body = F.array_join(F.transform(X.words("text"), lambda w: F.concat(w, F.lit(" "), _tag(w))), "\n")
    own.select(F.concat(body, F.lit("\n")).alias("value")).write.text(place)
    return lines.read_conll(spark, place)


_SENTENCES = f"(SELECT {sql_words('text')} AS tokens FROM lang_samples WHERE len({sql_words('text')}) > 0)"


@R.add(f"SELECT tokens, [CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'B-PER' ELSE 'O' END FOR w IN tokens] AS tags FROM {_SENTENCES}")
def conll_sentences(spark, folder):
    return _tagged_file(spark, folder).select("tokens", "tags")


@R.add("SELECT 'BIO' AS scheme")
def conll_scheme(spark, folder):
    return lines.tag_scheme(_tagged_file(spark, folder))


@R.add(f"SELECT {_PLAIN.format('bn')} AS a, {_PLAIN.format('en')} AS b, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM parallel_pairs WHERE bn IS NOT NULL AND en IS NOT NULL")
def scored_tsv(spark, folder):
    """Pairs and scores as compressed lines of nine columns; pairs with a side missing have fewer and are left out, a missing score is empty and counts as 0."""
    place = scratch(spark, "tsv")
    plain = [F.regexp_replace(c, "[\\t\\r\\n]", " ") for c in ("bn", "en")]
    more = F.array_repeat(F.lit("x"), 6)
    whole = F.concat(F.array(*plain, F.coalesce(F.col("score").cast("string"), F.lit(""))), more)
    line = F.when(F.col("bn").isNotNull() & F.col("en").isNotNull(), F.array_join(whole, "\t")).otherwise(F.concat_ws("\t", *plain))
    table(spark, folder, "parallel_pairs").select(line.alias("value")).write.option("compression", "gzip").text(place)
    return lines.read_scored_tsv(spark, place)


@R.add(f"SELECT {_PLAIN.format('bn')} AS bn, {_PLAIN.format('en')} AS en FROM parallel_pairs WHERE bn IS NOT NULL AND en IS NOT NULL")
def aligned_lines(spark, folder):
    """The sides of pairs in two sets of line files, joined again by place: both sets are written from the same files of a sorted table."""
    own = table(spark, folder, "parallel_pairs").where("bn IS NOT NULL AND en IS NOT NULL").select("pair_id", *(F.regexp_replace(c, "[\\t\\r\\n]", " ").alias(c) for c in ("bn", "en")))
    own = written(own.repartitionByRange(4, "pair_id").sortWithinPartitions("pair_id"), "sorted")
    sides = []
    for c in ("bn", "en"):
        sides.append(scratch(spark, c))
        own.select(F.col(c).alias("value")).write.text(sides[-1])
    return lines.read_aligned(spark, *sides).select("bn", "en")


@R.add("SELECT CAST(run_id AS INTEGER) AS run_id, accuracy, macro_f1 FROM run_results")
def metrics_csv(spark, folder):
    """Metrics as CSV files with a header in a folder for each model, looked for in all of them."""
    place = scratch(spark, "csv")
    table(spark, folder, "run_results").select("run_id", "accuracy", "macro_f1", F.coalesce("model", F.lit("none")).alias("model")).write.partitionBy("model").option("header", True).csv(place)
    return files.read_metrics(spark, place)


@R.add("SELECT 'run_results' AS log, CAST(run_id AS BIGINT) AS step, accuracy, NULL::DOUBLE AS value FROM run_results UNION ALL SELECT 'events', event_id, NULL, value FROM events")
def metrics_append(spark, folder):
    """Two logs under the union of their headers."""
    a = table(spark, folder, "run_results").select(F.lit("run_results").alias("log"), F.col("run_id").alias("step"), "accuracy")
    return files.append_metrics(a, table(spark, folder, "events").select(F.lit("events").alias("log"), F.col("event_id").alias("step"), "value"))


@R.add("SELECT doc_id, text FROM documents")
def parquet_shards(spark, folder):
    """Parquet files of at most 500 rows in groups of 100, under names of their own."""
    place = scratch(spark, "shards")
    files.write_parquet_shards(table(spark, folder, "documents").select("doc_id", "text"), place, 500, 100, "docs")
    return spark.read.option("pathGlobFilter", "docs_shard_*.parquet").parquet(place)


@R.add("SELECT count(*) AS feeds FROM sentnob WHERE text IS NOT NULL")
def newline_count(spark, folder):
    """The line feeds of a file set with a text a line."""
    place = scratch(spark, "texts")
    files.write_lines(table(spark, folder, "sentnob"), place)
    return spark.range(1).select(F.lit(files.line_count(spark, place)).cast("bigint").alias("feeds"))


@R.add(f"SELECT value FROM (SELECT {_PLAIN.format('bn')} AS value FROM parallel_pairs WHERE bn IS NOT NULL UNION ALL SELECT {_PLAIN.format('en')} FROM parallel_pairs WHERE en IS NOT NULL)")
def lines_concatenated(spark, folder):
    """Parts written as one table of lines and deleted."""
    parts = []
    for c in ("bn", "en"):
        parts.append(scratch(spark, f"part-{c}"))
        table(spark, folder, "parallel_pairs").where(F.col(c).isNotNull()).select(F.regexp_replace(c, "[\\t\\r\\n]", " ").alias("value")).write.text(parts[-1])
    out = scratch(spark, "whole")
    files.concatenated(spark, parts, out, remove=True)
    if any(places.exists(spark, p) for p in parts):
        raise RuntimeError("a part is still there")
    return spark.read.option("lineSep", "\n").text(out)


@R.add("SELECT 'train' AS split, count(*) FILTER (split = 'train') AS n FROM sentnob UNION ALL SELECT 'validation', count(*) FILTER (split = 'validation') FROM sentnob UNION ALL SELECT 'test', count(*) FILTER (split = 'test') FROM sentnob")
def splits_found(spark, folder):
    """Split files by their names: data_train, dev and test; a name that says no split, and a folder, are passed over."""
    place = scratch(spark, "splits")
    own = table(spark, folder, "sentnob")
    for name, split in (("data_train", "train"), ("dev", "validation"), ("test", "test"), ("notes", "train")):
        passing = scratch(spark, name)
        # one file for each split is what is to be found; the rows are ids only
        own.where(F.col("split") == split).select(F.col("item_id").cast("string").alias("value")).coalesce(1).write.text(passing)
        fs, at = places._at(spark, place)
        fs.mkdirs(at)
        places.renamed(spark, places.listed(spark, passing, "part-*")[0], f"{place}/{name}.txt")
    found = files.split_files(spark, place)
    return files.prioritised_union([spark.read.text(p).select(F.lit(split).alias("split")) for split, p in found.items()]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT source FROM sources WHERE source < 'o'")
def sources_there(spark, folder):
    """Of the sources' folders those that are there: only the ones whose name comes before 'o' are written."""
    place = scratch(spark, "there")
    names = sorted(r["source"] for r in table(spark, folder, "sources").select("source").collect())  # eight
    for n in names:
        if n < "o":
            spark.range(1).write.parquet(f"{place}/{n}")
    found = files.existing(spark, {n: f"{place}/{n}" for n in names})
    return spark.createDataFrame([(n,) for n in found], "source STRING")


_BUDGET = 20_000


@R.add(f"SELECT name, doc_id FROM (SELECT name, doc_id, coalesce(sum(coalesce(word_count, 0)) OVER (ORDER BY priority, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {SOURCED} WHERE priority < 99) WHERE b < {_BUDGET}")
def budget_chain(spark, folder):
    """Sources by priority, each opened only if those before it don't meet the budget of words; one that isn't there is passed over."""
    docs = sourced(spark, folder)
    order = [r["priority"] for r in table(spark, folder, "sources").select("priority").distinct().orderBy("priority").collect()]  # eight
    of = lambda p: lambda: docs.where(F.col("priority") == p).drop("priority")
    missing = lambda: spark.read.parquet(f"{folder}/no-such-source.parquet")
    return files.until_met([missing, *map(of, order)], F.coalesce("word_count", F.lit(0)), "doc_id", _BUDGET).select("name", "doc_id")


@R.add("SELECT count(*) AS docs, coalesce(sum(word_count), 0) AS words FROM documents WHERE word_count >= 20")
def dry_run(spark, folder):
    """What a run would write, without writing it."""
    place = scratch(spark, "dry")
    counts = files.write_or_count(table(spark, folder, "documents").where("word_count >= 20"), place, dry=True)
    if places.exists(spark, place):
        raise RuntimeError("a dry run has written")
    return spark.createDataFrame([(counts["docs"], counts["words"])], "docs BIGINT, words BIGINT")


@R.add("SELECT task AS name, count(*) AS runs, count(DISTINCT model) AS models FROM run_results GROUP BY task")
def report_round_trip(spark, folder):
    """A small report by task as YAML under a stamped name, found by the fallback pattern and read as rows."""
    import tempfile

    own = table(spark, folder, "run_results").groupBy("task").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("model").alias("models")).collect()  # a row for each task
    with tempfile.TemporaryDirectory() as here:  # reports are the driver's own
        files.write_report({r["task"]: {"runs": r["runs"], "models": r["models"]} for r in own}, files.stamped_name(here, "report", "json"))
        return files.report_rows(spark, files.read_report(f"{here}/report.json", f"{here}/**/report_*.json"))


@R.add("SELECT doc_id, coalesce(text, '') AS text, 0 AS label FROM documents WHERE source IS NOT NULL")
def columns_guessed(spark, folder):
    """A CSV whose columns go by other names, read under the wanted ones."""
    place = scratch(spark, "guess")
    own = table(spark, folder, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("ID"), F.coalesce("text", F.lit("")).alias("Sentence"), F.lit(0).alias("Polarity"))
    own.write.parquet(place)
    return files.guessed_columns(spark.read.parquet(place), {"doc_id": ["doc_id", "id"], "text": ["text", "sentence"], "label": ["label", "polarity"]})

