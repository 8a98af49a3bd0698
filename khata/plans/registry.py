"""All registered queries outside of khata.llm."""

from __future__ import annotations

from collections.abc import Callable

from khata.plans import documents, failures, formats, packing, pairs, scores, small, streams, tokenizers

PARTS = (documents.R, pairs.R, failures.R, packing.R, scores.R, small.R, streams.R, formats.R, tokenizers.R)


def queries() -> dict[str, Callable]:
    return {name: query for part in PARTS for name, query in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
