"""What the registered queries share: tables, and pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from khata.functions.text import BANDS, LAST_BAND
from khata.operators import ingest
from khata.session import balanced


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{folder}/{name}.parquet"))


def sourced(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the name, priority and domain of their source."""
    return ingest.with_source(table(spark, folder, "documents"), table(spark, folder, "sources"))


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None) -> Callable:
        """Registers a query under its function's name, with the SQL that says the same."""

        def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return register


#: The white-space class for RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_words(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{WS}+'), lambda w: w <> '')"


def sql_count(col: str) -> str:
    return f"CAST(len({sql_words(col)}) AS BIGINT)"


def sql_collapse(col: str) -> str:
    return f"trim(regexp_replace({col}, '{WS}+', ' ', 'g'), ' ')"


def sql_strip(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


def sql_normalize_text(col: str) -> str:
    return sql_collapse(f"nfc_normalize({col})")


def sql_normalize_doc(col: str) -> str:
    return sql_strip(f"regexp_replace(nfc_normalize({col}), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_key(col: str) -> str:
    return f"lower(regexp_replace({col}, '[\\s\\x{{a0}}_\\-]+', '', 'g'))"


#: Documents with the name, priority and domain of their source.
SOURCED = f"(SELECT d.*, coalesce(s.source, 'other') AS name, coalesce(s.priority, 99) AS priority, s.domain AS domain FROM documents d LEFT JOIN sources s ON {sql_key('d.source')} = {sql_key('s.source')})"


def sql_band(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} < {n} THEN '{name}'" for n, name in BANDS) + f" ELSE '{LAST_BAND}' END"
