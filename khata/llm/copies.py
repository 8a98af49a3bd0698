"""Problem 6: duplicates hidden by formatting differences.

Columns are dictionary-encoded. Of a column with few distinct values each distinct
value is canonicalised once; the dictionary is broadcast once its size is checked.
The values of a near-unique column such as a text are canonicalised where they lie,
since a dictionary of them would be as large as the table. Integer identifiers are two
64-bit hashes of the canonical value, so they need no coordination between tasks and
are the same by either way. A record becomes the sorted tuple of its (field,
identifier) integers, and only tuples and record ids travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.session import written

#: A dictionary of more values than this, or of longer ones, is not broadcast; its column is canonicalised where it lies.
MOST_VALUES, LONGEST_VALUE = 20_000, 1_000
#: Unicode white space (with U+001C to U+001F) and punctuation.
LOOSE = r"[\p{P}\p{Z}\t-\r\x1c-\x20\x85]+"


def canonical(col: str | Column) -> Column:
    """A value without white space, punctuation and letter case; null stays null."""
    return F.lower(F.regexp_replace(col, LOOSE, ""))


def identifier(col: str | Column) -> Column:
    """Two 64-bit integers for a value; null has its own."""
    own = F.col(col) if isinstance(col, str) else col
    return F.struct(F.xxhash64(F.lit(1), col).alias("hi"), F.xxhash64(F.lit(2), col, own.isNull()).alias("lo"))


def _tuple(fields: list[str]) -> Column:
    """The record's (field number, identifier) integers, in the order of the fields' names."""
    return F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"_{k}.hi").alias("hi"), F.col(f"_{k}.lo").alias("lo")) for k in range(len(fields))))


def _dictionary(records: DataFrame, value: str, k: int) -> DataFrame | None:
    """The identifier of each distinct value; None if there are too many for a broadcast."""
    values = records.select(F.col(value).alias("d")).distinct().select(F.when(F.coalesce(F.length("d"), F.lit(0)) <= LONGEST_VALUE, F.col("d")).alias("d"), (F.length("d") > LONGEST_VALUE).alias("long"))
    known = values.limit(MOST_VALUES + 1).collect()  # bounded in number and length
    if len(known) > MOST_VALUES or any(r["long"] for r in known):
        return None
    own = records.sparkSession.createDataFrame([(r["d"],) for r in known], f"d{k} STRING")
    return own.select(f"d{k}", identifier(canonical(f"d{k}")).alias(f"_{k}"))


def encoded(records: DataFrame, id_col: str, fields: dict[str, bool], text: str | None = None) -> DataFrame:
    """(id, key): every record as its integer tuple.

    `fields` maps each field to whether it has few distinct values. Records whose
    `text` field is null or has nothing but white space and punctuation give no row.
    """
    names = sorted(fields)
    out = records.select(F.col(id_col).alias("id"), *(F.col(f"`{f}`").alias(f"v{k}") for k, f in enumerate(names)))
    for k, f in enumerate(names):
        dictionary = _dictionary(out, f"v{k}", k) if fields[f] else None
        if dictionary is not None:
            out = out.join(F.broadcast(dictionary), F.col(f"v{k}").eqNullSafe(F.col(f"d{k}")), "left").drop(f"v{k}", f"d{k}")
        else:
            out = out.withColumn("c", canonical(f"v{k}"))
            if f == text:
                out = out.where("c != ''")
            out = out.withColumn(f"_{k}", identifier("c")).drop("c", f"v{k}")
    return out.select("id", _tuple(names).alias("key"))


def document_keys(docs: DataFrame) -> DataFrame:
    return encoded(docs, "doc_id", {"text": False, "source": True}, "text")


def json_records(lines: DataFrame, id_col: str = "line_id", raw_col: str = "raw") -> DataFrame:
    """(id, text, source) of the lines that are one complete JSON object; the order of fields and other fields don't matter."""
    options = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    one = F.from_json(F.concat(F.lit("["), F.col(raw_col), F.lit("]")), "array<struct<text: string, source: string>>", options)
    read = lines.where(F.col(raw_col).rlike(r"^\s*\{")).select(F.col(id_col).alias("id"), one.alias("one"))
    return read.where(F.size("one") == 1).select("id", F.col("one")[0]["text"].alias("text"), F.col("one")[0]["source"].alias("source"))


def _keys(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(tab, id, key) of the records of both tables."""
    lines_keys = encoded(json_records(lines), "id", {"text": False, "source": True}, "text")
    of = lambda keys, tab: keys.select(F.lit(tab).alias("tab"), "*")
    return of(document_keys(docs), "documents").unionByName(of(lines_keys, "raw_lines"))


def hidden_copies(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(tab, keep_id, copy_id, n_copies) over documents and raw_lines.

    Records whose text is null, or blank but for punctuation, and lines that are not
    complete JSON objects are no cases. A null source equals only a null source.
    """
    both = written(_keys(docs, lines), "keys")
    keys = both.select("id", F.struct("tab", "key").alias("key"))
    found = keys.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return keys.join(found, "key").where("id != keep_id").select(F.col("key.tab").alias("tab"), "keep_id", F.col("id").alias("copy_id"), "n_copies")


def collapsed(docs: DataFrame) -> DataFrame:
    """One row of each group of same documents, the one with the smallest id, with the number of its copies (doc_id, n_copies)."""
    keys = document_keys(docs)
    return keys.groupBy("key").agg(F.min("id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).select("doc_id", "n_copies")


def collapsed_records(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """As collapsed, over documents and raw_lines, whose records are not compared with each other (tab, keep_id, n_copies); a record without copies counts 1."""
    return _keys(docs, lines).groupBy("tab", "key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).select("tab", "keep_id", "n_copies")
