import gzip
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from khata.sources import archives, files, lines, npy
from khata.streaming import ingest


def test_jsonl_skips_or_stops(spark, tmp_path, rows):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "source": "s"}\n{"text": "cut\n{"text": 5}\n\n')
    path = str(tmp_path / "a.jsonl")
    assert rows(lines.read_jsonl(spark, path).select("text")) == [("5",), ("x",)]
    with pytest.raises(Exception):
        lines.read_jsonl(spark, path, strict=True).collect()


@pytest.mark.parametrize(("raw", "text"), [('{"source":"s","text":"a\\u09be"}', "aা"), ('{"text":"a"', None), ('[{"text":"a"}]', None), ('{"text":"a"} {"text":"b"}', None), ("{'text':'a'}", None), ("", None), (None, None), (' {"text":"a"} ', "a"), ('{"text":"a"},{"text":"b"}', None)])
def test_json_lines_are_whole_objects(spark, raw, text):
    got = lines.parsed(spark.createDataFrame([(raw,)], "raw STRING"), "raw").collect()
    assert [r["text"] for r in got] == ([text] if text else [])


def test_tsv_scores(spark, tmp_path, rows):
    body = "\n".join("\t".join(["a", "b", s, *"cdefgh"]) for s in ("1.5", "", "x")) + "\ntoo\tfew\n"
    with gzip.open(tmp_path / "p.tsv.gz", "wt") as f:
        f.write(body)
    assert rows(lines.read_scored_tsv(spark, str(tmp_path / "p.tsv.gz")).select("score")) == [(0.0,), (1.5,), (None,)]


def test_aligned_and_conll(spark, tmp_path, rows):
    (tmp_path / "a").write_text("1\n2\n3\n")
    (tmp_path / "b").write_text("x\ny\n")
    assert rows(lines.read_aligned(spark, str(tmp_path / "a"), str(tmp_path / "b"))) == [(0, "1", "x"), (1, "2", "y")]
    (tmp_path / "c").write_text("-DOCSTART- O\n\na B-PER\nb O\n\n\nc _ I-LOC\n")
    got = lines.read_conll(spark, str(tmp_path / "c"))
    assert sorted((r["tokens"], r["tags"]) for r in got.collect()) == [(["a", "b"], ["B-PER", "O"]), (["c"], ["I-LOC"])]
    assert lines.tag_scheme(got).first()["scheme"] == "BIO"


def test_npy_round_trip(spark, tmp_path):
    npy.register(spark)
    rows = [(s, k, [s, k, 65535]) for s in range(3) for k in range(4)]
    df = spark.createDataFrame(rows, npy.SCHEMA).repartition(3, "shard")
    out = str(tmp_path / "shards")
    df.write.format("npy_shards").mode("overwrite").save(out)
    assert np.load(npy.shard_files(out)[1]).dtype == np.uint16
    assert sorted(tuple(r) for r in spark.read.format("npy_shards").load(out).collect()) == rows
    assert spark.read.format("npy_shards").option("max_shards", 2).load(out).count() == 8


def test_archives(spark, tmp_path, rows):
    (tmp_path / "m.jsonl").write_text("1\n2\n")
    with tarfile.open(tmp_path / "x.tar.bz2", "w:bz2") as t:
        t.add(tmp_path / "m.jsonl", "d/m.jsonl")
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.write(tmp_path / "m.jsonl", "m.jsonl")
    for name in ("x.tar.bz2", "x.zip"):
        assert rows(archives.read_lines(spark, str(tmp_path / name), ".jsonl").select("line_no", "value")) == [(0, "1"), (1, "2")]


def test_parquet_shards_and_reports(spark, tmp_path):
    import pyarrow.parquet as pq

    files.write_parquet_shards(spark.range(1000).coalesce(1), str(tmp_path / "p"), 400, 100)
    got = sorted(pq.ParquetFile(p).metadata.num_rows for p in (tmp_path / "p").glob("*.parquet"))
    assert got == [200, 400, 400]
    first = pq.ParquetFile(tmp_path / "p" / "data_shard_0000.parquet").metadata
    assert (first.num_row_groups, first.row_group(0).num_rows, first.row_group(0).column(0).compression) == (4, 100, "ZSTD")
    files.write_jsonl(spark.createDataFrame([(1, None)], "a INT, b STRING"), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))) == {"a": 1, "b": None}
    assert not files.write_if_any(spark.range(0), str(tmp_path / "none"))
    files.write_report({"a": [1]}, str(tmp_path / "r.json"))
    assert files.read_report(str(tmp_path / "r.json")) == {"a": [1]} and files.read_report(str(tmp_path / "no.json")) is None
    assert files.markdown([{"a": 1}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1 | N/A |\n"


def test_guessed_columns_and_metrics(spark, rows):
    df = spark.createDataFrame([("x", 1)], "Data STRING, Label INT")
    assert rows(files.guessed_columns(df, {"text": ["sentence", "data"], "label": ["label"]})) == [("x", 1)]
    with pytest.raises(ValueError):
        files.guessed_columns(df, {"text": ["none"]})
    both = files.append_metrics(spark.createDataFrame([(1, 2.0)], "step INT, loss DOUBLE"), spark.createDataFrame([(2, 3.0)], "step INT, ppl DOUBLE"))
    assert both.columns == ["step", "loss", "ppl"] and both.count() == 2
    union = files.prioritised_union([spark.range(1), spark.range(2)])
    assert rows(union) == [(0, 0), (0, 1), (1, 1)]


def test_append_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.range(3).write.parquet(src)
    run = lambda: ingest.append(ingest.file_stream(spark, src, spark.range(0).schema), out, mark).awaitTermination()
    run()
    run()
    assert spark.read.parquet(out).count() == 3
    spark.range(3, 5).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() == 5


def test_first_seen_budget_and_windows(spark, tmp_path, rows):
    src = str(tmp_path / "src")
    spark.createDataFrame([(i, "a" if i < 4 else "b", 5, f"2024-01-01 00:{i:02d}:00") for i in range(8)], "i INT, g STRING, w INT, ts STRING").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = lambda: ingest.file_stream(spark, src, spark.read.parquet(src).schema)

    def run(df, name):
        ingest.append(df, str(tmp_path / name), str(tmp_path / f"{name}-mark")).awaitTermination()
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    assert run(ingest.first_seen(stream().select("g"), "g"), "first").count() == 2
    assert rows(run(ingest.within_budget(stream(), "g", "w", "i", 7), "budget").select("g", "i")) == [("a", 0), ("a", 1), ("b", 4), ("b", 5)]
    windows = ingest.windowed_counts(stream(), "ts", ["g"], "4 minutes", "0 seconds")
    assert rows(run(windows, "windows").select("g", "n"))[:1] == [("a", 4)]


def test_npy_shards_of_two_tasks_are_an_error(spark, tmp_path):
    npy.register(spark)
    df = spark.createDataFrame([(0, k, [k, k]) for k in range(8)], npy.SCHEMA).repartition(4, "seq")
    with pytest.raises(Exception, match="more than one task"):
        df.write.format("npy_shards").mode("overwrite").save(str(tmp_path / "twice"))
    assert not list((tmp_path / "twice").glob("*"))


@pytest.mark.parametrize("bad", [[1, 2, 3], [70000, 1], [-1, 1]])
def test_npy_refuses_what_it_cannot_hold(spark, tmp_path, bad):
    npy.register(spark)
    df = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, bad)], npy.SCHEMA).coalesce(1)
    with pytest.raises(Exception):
        df.write.format("npy_shards").mode("overwrite").save(str(tmp_path / "bad"))


def test_npy_overwrite_in_any_order_of_rows(spark, tmp_path):
    npy.register(spark)
    out = str(tmp_path / "o")
    for n in (3, 2):
        rows = [(s, k, [s * 10 + k] * 4) for s in range(n) for k in range(5)]
        spark.createDataFrame(rows[::-1], npy.SCHEMA).repartition(n, "shard").write.format("npy_shards").mode("overwrite").save(out)
        assert sorted(tuple(r) for r in spark.read.format("npy_shards").load(out).collect()) == rows


def test_missing_files_line_counts_and_splits(spark, tmp_path):
    assert lines.read_jsonl(spark, str(tmp_path / "none.jsonl"), missing_ok=True).count() == 0
    (tmp_path / "train.txt").write_text("a\nb\r\n\nc")
    (tmp_path / "x_dev.txt").write_text("a\n")
    (tmp_path / "empty.txt").write_text("")
    assert [files.line_count(spark, str(tmp_path / n)) for n in ("train.txt", "x_dev.txt", "empty.txt", "*.txt")] == [3, 1, 0, 4]
    assert {k: v.rsplit("/", 1)[-1] for k, v in files.split_files(spark, str(tmp_path)).items()} == {"train": "train.txt", "validation": "x_dev.txt"}
    assert files.existing(spark, {"a": str(tmp_path / "train.txt"), "b": str(tmp_path / "no")}) == {"a": str(tmp_path / "train.txt")}
    files.concatenated(spark, [str(tmp_path / "x_dev.txt"), str(tmp_path / "train.txt")], str(tmp_path / "all"), remove=True)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "all")).collect()) == ["", "a", "a", "b", "c"] and not (tmp_path / "train.txt").exists()


def test_sources_until_the_budget_is_met(spark, rows):
    opened = []

    def source(name, *weights):
        def open_():
            opened.append(name)
            return spark.createDataFrame([(k, w) for k, w in enumerate(weights)], "i INT, w INT") if weights else spark.read.parquet("/none/such")

        return open_

    got = files.until_met([source("a", 5, 5), source("b"), source("c", 3, 3, 3), source("d", 1)], "w", "i", 14)
    assert rows(got.select("priority", "i")) == [(0, 0), (0, 1), (1, 0), (1, 1)] and opened == ["a", "b", "c"]
    assert files.until_met([source("a", 5), source("d", 1)], "w", "i", 0).count() == 2


def test_dry_runs_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("x", 2), ("y", None)], "text STRING, word_count INT")
    assert files.write_or_count(df, str(tmp_path / "w"), dry=True) == {"docs": 2, "words": 2} and not (tmp_path / "w").exists()
    assert files.write_or_count(df, str(tmp_path / "w")) == {"docs": 2, "words": 2} and spark.read.json(str(tmp_path / "w")).count() == 2
    assert files.write_if_any(df, str(tmp_path / "some")) and not (files.write_if_any(df.limit(0), str(tmp_path / "no")) or (tmp_path / "no").exists())
    import datetime

    path = files.stamped_name(str(tmp_path), "report", "json", datetime.datetime(2024, 1, 2, 3, 4, 5))
    files.write_report({"a": {"x": 1}, "b": {"y": 2.5}}, path)
    assert path.endswith("report_20240102_030405.json")
    report = files.read_report(str(tmp_path / "report.json"), str(tmp_path / "other_*.json"), str(tmp_path / "report_*.json"))
    assert [tuple(r) for r in files.report_rows(spark, report).collect()] == [("a", 1, None), ("b", None, 2.5)]


def test_metric_batches_take_their_own_place(spark, tmp_path, rows):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(3).write.parquet(src)
    for mark in ("one", "two"):  # a checkpoint that was lost makes the same batch come again
        ingest.into_table(ingest.file_stream(spark, src, spark.range(0).schema), out, str(tmp_path / mark)).awaitTermination()
    assert rows(spark.read.parquet(out).select("id")) == [(0,), (1,), (2,)]
