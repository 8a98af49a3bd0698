"""Prompts and chats as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chat format.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def chat(messages: DataFrame, by: list[str], ask: bool = False) -> DataFrame:
    """(by, chat): a conversation's messages (turn, role, content) in order of turn; `ask` adds the opening of an answer."""
    one = F.concat(F.lit(f"{TURN_START}<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit(f"{TURN_END}\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", one.alias("m"))))
    whole = F.array_join(F.transform(ordered, lambda x: x["m"]), "")
    return messages.groupBy(*by).agg((F.concat(whole, F.lit(f"{TURN_START}<|assistant|>\n")) if ask else whole).alias("chat"))


def filled(template: str, **fields: str | Column) -> Column:
    """A template with its {names} replaced by columns; what a value holds is never expanded. Null if a value that the template names is null."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, fields)) + r")\}", template) if fields else [template]
    return F.concat(*(F.lit(p) if k % 2 == 0 else (F.col(fields[p]) if isinstance(fields[p], str) else fields[p]) for k, p in enumerate(parts)))


def few_shot(template: str, examples: list[dict[str, str]] | None = None, between: str = "\n\n", **fields: str | Column) -> Column:
    """A filled template after the same template filled with examples, or, with none, alone."""
    shown = [template.format_map(e) + between for e in examples or []]
    return F.concat(F.lit("".join(shown)), filled(template, **fields))


def joined_pair(first: str | Column, second: str | Column, between: str = " । ") -> Column:
    """Two sentences as one text."""
    return F.concat(*(F.col(c) if isinstance(c, str) else c for c in (first,)), F.lit(between), *(F.col(c) if isinstance(c, str) else c for c in (second,)))


def cleaned_article(text: str | Column, least: int = 40, markup: str = "|") -> Column:
    """A text's lines of at least `least` signs that begin with no markup, joined by spaces."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= least) & ~x.startswith(markup)), " ")


def shown_size(size: str | Column) -> Column:
    """A number of bytes as text."""
    n = (F.col(size) if isinstance(size, str) else size).cast("double")
    out = F.format_string("%.0f B", n)
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024.0**k, F.format_string(f"%.1f {unit}", n / 1024.0**k)).otherwise(out)
    return out


def shown_time(seconds: str | Column) -> Column:
    """A duration as 1h 02m 03s."""
    s = F.floor(F.col(seconds) if isinstance(seconds, str) else seconds)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))
