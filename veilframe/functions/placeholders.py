"""Placeholder tokens and the instruction sentence sent along with masked text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import find_spans
from veilframe.functions.textforms import WIDE_SPACE

# Brackets per style, the token pattern and the instruction sentence.
STYLES = {"square": ("[", "]"), "curly": ("{{", "}}"), "guillemet": ("«", "»")}
TOKEN_BODY = r"[A-Z_]+_[0-9]+"
TOKEN = rf"\[{TOKEN_BODY}\]|\{{\{{{TOKEN_BODY}\}}\}}|«{TOKEN_BODY}»"
INSTRUCTION = "Сохраняй метки в квадратных скобках вида [PERSON_1] в ответе без изменений."


def format_placeholder(type_: Column, number: Column, style: str = "square") -> Column:
    if style not in STYLES:
        raise ValueError(f"unknown placeholder style: {style!r}")
    left, right = STYLES[style]
    return F.concat(F.lit(left), type_, F.lit("_"), number.cast("string"), F.lit(right))


def find_placeholders(text: Column) -> Column:
    """Placeholder tokens of any style, as spans."""
    return find_spans(text, TOKEN)


def parse_placeholder(token: Column) -> Column:
    """``STRUCT<type, num>`` of a token, NULL for anything else. ``num`` is NULL beyond BIGINT."""
    inner = F.regexp_replace(F.regexp_replace(token, r"^[\[{«]+", ""), r"[\]}»]+$", "")
    shape = "^([A-Z_]+)_([0-9]+)$"
    return F.when(inner.rlike(shape), F.struct(
        F.regexp_extract(inner, shape, 1).alias("type"),
        F.regexp_extract(inner, shape, 2).try_cast("bigint").alias("num")))


def append_instruction(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(INSTRUCTION)), text).otherwise(F.concat(text, F.lit("\n\n" + INSTRUCTION)))


def strip_instruction(text: Column) -> Column:
    bare = F.regexp_replace(F.replace(text, F.lit(INSTRUCTION), F.lit("")), "\n{3,}", "\n\n")
    return F.when(
        F.contains(text, F.lit(INSTRUCTION)), F.regexp_replace(bare, f"[\\s{WIDE_SPACE}]+\\z", "")).otherwise(text)


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out
