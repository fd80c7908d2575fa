"""Text views: compatibility normalisation with an offset map, lookalike folding, script counts, entropy."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import CLOSE, OPEN, REPLACEMENT, bracket, let, running_sum

# Cyrillic letters and the Latin letters they are folded to, position by position.
CYRILLIC_LOOKALIKES = "аеорсхукАВЕКМНОРСТХ"
LATIN_LOOKALIKES = "aeopcxykABEKMHOPCTX"

CYRILLIC = "[\\u0400-\\u04ff]"

# White space beyond the regex engine's ASCII \s that survives normalisation.
WIDE_SPACE = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

SHIFT_TYPE = "array<struct<start:int,end:int,source:int>>"


@lru_cache(maxsize=1)
def _compat_tables() -> tuple[str, str, dict[str, str]]:
    """Per code point: NFKC, then without U+0300-U+036F. One-to-one changes go to ``translate`` strings,
    the rest (expansions and deletions) to a map."""
    src, dst, other = [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        char = chr(cp)
        folded = "".join(c for c in unicodedata.normalize("NFKC", char) if not "\u0300" <= c <= "\u036f")
        if folded == char:
            continue
        if len(folded) == 1:
            src.append(char)
            dst.append(folded)
        else:
            other[char] = folded
    return "".join(src), "".join(dst), other


def _char_class(chars) -> str:
    bounds: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if bounds and cp == bounds[-1][1] + 1:
            bounds[-1][1] = cp
        else:
            bounds.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in bounds) + "]"


# Blocks that make up most non-ASCII text and hold no character that normalisation changes.
COMMON_BLOCKS = ((0xC0, 0x131), (0x400, 0x52F), (0x2018, 0x2023), (0x2012, 0x2016), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _not_common() -> str:
    """Lookaheads that turn the common characters away one short range at a time, before a long class is tried."""
    blocks = ((0x00, 0x7F), *COMMON_BLOCKS)
    return "".join(f"(?=[^\\x{{{a:x}}}-\\x{{{b:x}}}])" for a, b in blocks)


@lru_cache(maxsize=1)
def unusual_class() -> str:
    """Regex for a character that normalisation changes, or one of the bracket characters."""
    src, _, other = _compat_tables()
    return _not_common() + _char_class(set(src) | set(other) | {OPEN, CLOSE})


@lru_cache(maxsize=1)
def resized_class() -> str:
    """Regex class of the characters whose normal form is not exactly one character long."""
    return _not_common() + _char_class(_compat_tables()[2])


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def may_change(text: Column) -> Column:
    """Whether normalisation could change the text; false for almost all texts, at the price of one quick look."""
    return ~is_ascii(text) & text.rlike(unusual_class())


def same_length_form(text: Column) -> Column:
    """One-to-one part of the normalisation; offsets do not move."""
    src, dst, _ = _compat_tables()
    return F.translate(text, src + OPEN + CLOSE, dst + REPLACEMENT * 2)


def _resized_form(char: Column) -> Column:
    """Normal form of one character of :func:`resized_class`. ``translate`` finds its number by hash (as a private-use
    character), and the number is a place in a constant array; a map would be searched from its start."""
    forms = _compat_tables()[2]
    chars = sorted(forms)
    numbers = "".join(chr(0xE000 + i) for i in range(len(chars)))
    table = F.split(F.lit(OPEN.join(forms[c] for c in chars)), OPEN)
    return F.get(table, F.ascii(F.translate(char, "".join(chars), numbers)) - 0xE000)


def resize(text: Column) -> Column:
    """Expand or delete the remaining characters of a :func:`same_length_form` text.

    Gives ``STRUCT<text, shifts>``; each shift is the span of one replacement in the new text and the offset of the
    character it stands for. The text is cut behind each such character, and the pieces are joined again: each is
    looked at once, however many there are.
    """
    def build(pieces: Column) -> Column:
        parts = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
            F.substring_index(p, OPEN, 1).alias("gap"), _resized_form(F.substring_index(p, OPEN, -1)).alias("new")))

        def assemble(parts: Column) -> Column:
            ends = running_sum(F.transform(parts, lambda x: F.length(x["gap"]) + F.length(x["new"])))
            sources = running_sum(F.transform(parts, lambda x: F.length(x["gap"]) + 1))
            spans = F.zip_with(parts, ends, lambda x, e: F.struct((e - F.length(x["new"])).alias("start"), e.alias("end")))
            shifts = F.zip_with(spans, sources, lambda s, at: F.struct(s["start"], s["end"], (at - 1).alias("source")))
            body = F.concat(F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], x["new"])), ""),
                            F.element_at(pieces, -1))
            return F.struct(body.alias("text"), shifts.alias("shifts"))

        return let(parts, assemble)

    return let(bracket(text, resized_class()), build)


def source_offset(shifts: Column, pos: Column) -> Column:
    """Offset in the source text of the character at ``pos`` of a normalised text: a binary search for the last shift that
    begins there or before."""
    def narrow(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        before = (acc["low"] < acc["high"]) & (F.get(shifts, middle)["start"] <= pos)
        return F.struct(F.when(before, middle + 1).otherwise(acc["low"]).alias("low"),
                        F.when(before, acc["high"]).otherwise(middle).alias("high"))

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(shifts) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(shifts).alias("high"))

    def moved(s: Column) -> Column:
        return F.when(s.isNull(), pos).when(pos < s["end"], s["source"]).otherwise(s["source"] + 1 + pos - s["end"])

    return let(F.get(shifts, F.aggregate(halvings, start, narrow, lambda acc: acc["low"]) - 1), moved)


def normalize(text: Column) -> Column:
    """Normalised text (NFKC per character, combining marks U+0300-U+036F dropped)."""
    def full(flat: Column) -> Column:
        return F.when(flat.rlike(resized_class()), resize(flat)["text"]).otherwise(flat)

    return F.when(~may_change(text), text).otherwise(let(same_length_form(text), full))


def normalize_with_map(text: Column) -> Column:
    """``STRUCT<text, shifts>``; ``shifts`` is NULL where offsets did not move."""
    plain = F.struct(text.alias("text"), F.lit(None).cast(SHIFT_TYPE).alias("shifts"))

    def full(flat: Column) -> Column:
        return F.when(flat.rlike(resized_class()), resize(flat)).otherwise(
            F.struct(flat.alias("text"), F.lit(None).cast(SHIFT_TYPE).alias("shifts")))

    return F.when(~may_change(text), plain).otherwise(let(same_length_form(text), full))


def fold_lookalikes(text: Column, target: str = "en") -> Column:
    """Map letters that look alike in Cyrillic and Latin to one script; one for one."""
    if target == "en":
        return F.translate(text, CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES)
    if target == "ru":
        return F.translate(text, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES)
    raise ValueError(f"unknown target script: {target!r}")


def cyrillic_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?iu)[а-яё]"))


def latin_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    def bits(t: Column) -> Column:
        n = F.length(t).cast("double")
        chars = F.filter(F.split(t, ""), lambda c: c != "")

        def share(c: Column) -> Column:
            return (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / n

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))

    return let(text, bits)
