"""Line-based files: JSON lines, tab-separated scores, aligned texts, tagged tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.operators.ingest import DOCUMENT
from khata.sources import places

_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parsed(df: DataFrame, raw: str, schema: T.StructType = DOCUMENT, keep: bool = False) -> DataFrame:
    """Adds the fields of `schema` from a column of JSON lines; lines that are no complete object are left out, or kept with `valid` false."""
    whole = F.from_json(F.concat(F.lit("["), F.col(raw), F.lit("]")), T.ArrayType(schema), _STRICT)
    own = df.withColumn("_j", F.when(F.col(raw).rlike(r"^\s*\{"), whole))
    own = own.withColumn("valid", F.coalesce(F.size("_j") == 1, F.lit(False)))
    if not keep:
        own = own.where("valid")
    return own.select(*df.columns, *(F.get("_j", F.lit(0))[f].alias(f) for f in schema.names), *(["valid"] if keep else []))


def numbered(spark: SparkSession, path: str, order: str = "ord") -> DataFrame:
    """(value, order): the lines of text files with their places from 0, files in order of path.

    A line's place is its block's offset plus its number inside the block. Blocks (of
    files, as Spark splits them) are few, so their offsets take one small window; lines
    are not sorted.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"))
    blocks = read.groupBy("_f", "_s").agg(F.min("_m").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("_f", "_s", "_lo", before.alias("_o"))
    return read.join(offsets, ["_f", "_s"]).select("value", (F.col("_o") + F.col("_m") - F.col("_lo")).alias(order))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, strict: bool = False, missing_ok: bool = False) -> DataFrame:
    """JSON lines, blank ones left out. Malformed lines are skipped, or, if strict, stop the query. With `missing_ok` a path that isn't there gives no rows."""
    if missing_ok and not places.exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where("_bad IS NULL").drop("_bad")


def read_scored_tsv(spark: SparkSession, path: str, columns: int = 9) -> DataFrame:
    """(a, b, score) from tab-separated lines, gzip included; lines with too few columns are left out, an empty score is 0, one that is no number null."""
    part = F.split("value", "\t", -1)
    read = spark.read.text(path).select(part.alias("p")).where(F.size("p") >= columns)
    score = F.coalesce(F.expr("try_cast(p[2] AS double)"), F.when(F.col("p")[2] == "", 0.0))
    return read.select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), score.alias("score"))


def read_aligned(spark: SparkSession, first: str, second: str, names: tuple[str, str] = ("bn", "en")) -> DataFrame:
    """Two line files joined by place; the longer one's surplus is left out."""
    a, b = (numbered(spark, p).withColumnRenamed("value", n) for p, n in zip((first, second), names, strict=True))
    return a.join(b, "ord").select("ord", *names)


def read_conll(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """(sentence, tokens, tags) from 'token ... tag' lines; a blank line ends a sentence, -DOCSTART- lines are left out."""
    from khata.operators.ordered import prefix_sum

    own = numbered(spark, path).where(~F.col("value").startswith("-DOCSTART-"))
    blank = F.trim("value") == ""
    own = prefix_sum(own, F.when(blank, 1), "ord", "sentence").where(~blank)
    part = F.split(F.trim("value"), separator)
    each = own.select("sentence", F.struct("ord", F.get(part, F.lit(0)).alias("token"), F.element_at(part, -1).alias("tag")).alias("x"))
    return each.groupBy("sentence").agg(F.array_sort(F.collect_list("x")).alias("x")).select("sentence", F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform("x", lambda x: x["tag"]).alias("tags"))


def tag_scheme(df: DataFrame, tags: str = "tags") -> DataFrame:
    """One row: whether the tags are BIO or BILOU."""
    each = df.select(F.explode(tags).alias("t"))
    return each.agg(F.when(F.bool_or(F.col("t").startswith("L-") | F.col("t").startswith("U-")), "BILOU").otherwise("BIO").alias("scheme"))
