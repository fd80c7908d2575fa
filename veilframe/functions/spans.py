"""Span search inside a text column: where a pattern matches, not only what it matches.

Spark's ``regexp_extract_all`` returns values without positions. Here one ``regexp_replace`` pass brackets
every match with two noncharacters, a split cuts the text at them, and a running total of the piece lengths
gives the positions. Offsets are half-open, zero-based and count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode noncharacters: never assigned, never matched by any detector.
OPEN = "\ufdd0"
CLOSE = "\ufdd1"
REPLACEMENT = "\ufffd"

SPAN_TYPE = "array<struct<start:int,end:int,match:string>>"

# Arrays longer than this are scanned in blocks, so a running total stays close to linear.
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def without_marks(text: Column) -> Column:
    """Replace the two bracket characters (one for one, so offsets stay) in texts that hold them."""
    return F.when(
        F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)),
        F.translate(text, OPEN + CLOSE, REPLACEMENT * 2),
    ).otherwise(text)


def _running(values: Column, first: Column, merge: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(
        values,
        F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(merge(F.coalesce(F.try_element_at(acc, F.lit(-1)), first), x))),
    )


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Inclusive running fold of an int array under an associative ``merge``."""
    zero_col = F.lit(zero)

    def in_blocks(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(cuts, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

        def with_carry(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, zero_col, merge))
            carried = F.concat(F.array(zero_col), _running(totals, zero_col, merge))
            return F.flatten(F.zip_with(
                parts, F.slice(carried, F.lit(1), F.size(parts)), lambda p, c: _running(p, c, merge)))

        return let(blocks, with_carry)

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, _running(v, zero_col, merge)).otherwise(in_blocks(v)))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def bracket(text: Column, regex: str, tail: bool = False) -> Column:
    """Cut a text behind each match; the matched part of a piece follows :data:`OPEN`. The last piece has no match.

    With ``tail`` the pattern must be two groups, and only the second one is bracketed. The pattern must not match
    the empty text.
    """
    shown = f"$1{OPEN}$2{CLOSE}" if tail else f"{OPEN}$0{CLOSE}"
    return F.split(F.regexp_replace(text, regex, shown), CLOSE)


def no_pieces() -> Column:
    """Pieces of a text without a match."""
    return F.array(F.lit(""))


def place(pieces: Column, *extra: Column) -> Column:
    """Spans of bracketed pieces: ``ARRAY<STRUCT<start, end, match>>`` (plus constant ``extra`` fields)."""
    def located(hits: Column) -> Column:
        ends = running_sum(F.transform(hits, lambda p: F.length(p) - 1))
        return F.zip_with(hits, ends, lambda p, e: F.struct(
            (e - F.length(_after_open(p))).alias("start"), e.alias("end"), _after_open(p).alias("match"), *extra))

    return let(F.slice(pieces, F.lit(1), F.size(pieces) - 1), located)


def find_spans(text: Column, regex: str, clean: bool = False) -> Column:
    """All leftmost non-overlapping matches as ``ARRAY<STRUCT<start, end, match>>``.

    ``clean=True`` says the text cannot hold the bracket characters.
    """
    return place(bracket(text if clean else without_marks(text), regex))


def _after_open(piece: Column) -> Column:
    return F.substring_index(piece, OPEN, -1)


# Texts longer than this with many spans are cut into overlapping chunks before spans are read out of them.
LONG_TEXT = 16_384
MANY_SPANS = 64
CHUNK_TYPE = "struct<size:int,parts:array<string>>"


def chunked(text: Column, spans: Column) -> Column:
    """``STRUCT<size, parts>`` of a long text with many spans, else NULL. Part ``i`` is the ``2 * size`` characters
    from ``i * size``: reading a span then costs a part's length and not its distance from the text's start."""
    def build(n: Column) -> Column:
        size = F.greatest(F.lit(4096), F.ceil(n / 256).cast("int"))
        return F.struct(size.alias("size"), F.transform(
            F.sequence(F.lit(0), F.floor(n / size).cast("int")),
            lambda b: F.substring(text, b * size + 1, size * 2)).alias("parts"))

    return F.when((F.size(spans) > MANY_SPANS) & (F.length(text) > LONG_TEXT), let(F.length(text), build))


def read_out(text: Column, chunks: Column | None, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` on."""
    plain = F.substring(text, start + 1, length)
    if chunks is None:
        return plain
    return F.when(
        length <= chunks["size"],
        F.substring(F.get(chunks["parts"], F.floor(start / chunks["size"]).cast("int")),
                    start % chunks["size"] + 1, length)).otherwise(plain)


def around(text: Column, start: Column, end: Column, radius: int, chunks: Column | None = None) -> Column:
    """The text within ``radius`` characters of a span, cut at the text's ends."""
    left = F.greatest(start - radius, F.lit(0))
    return read_out(text, chunks, left, end + radius - left)


def rewrite(text: Column, spans: Column, replacement: Callable[[Column, Column], Column],
            gap: Callable[[Column], Column] = lambda piece: piece) -> Column:
    """Replace sorted, disjoint spans of a text; ``replacement(span, index)`` gives the new piece."""

    def build(s: Column, chunks: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            prev = F.when(i > 0, F.element_at(s, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
            return F.concat(gap(read_out(text, chunks, prev, span["start"] - prev)), replacement(span, i))

        last = F.element_at(s, -1)["end"]
        tail = gap(F.substring(text, last + 1, F.length(text)))
        return F.concat(F.array_join(F.transform(s, piece), ""), tail)

    return F.when(
        F.size(spans) > 0, let(spans, lambda s: let(chunked(text, s), lambda chunks: build(s, chunks))),
    ).otherwise(gap(text))
