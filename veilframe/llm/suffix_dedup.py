"""Suffix-array dedup: 50-byte strings that also start in an earlier text, by suffix arrays built by linear grouping.

Texts meet on winnowed anchors of their bytes, see ``repeats``. The stretches that share an anchor become one text with
separators; its suffix array brings equal strings together, and each string's first text is the least id of its run.
Stretches too long for one array are cut into blocks, and the sorted strings of an anchor's blocks are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.repeats import BYTES, without_repeats
from veilframe.llm.suffix_groups import suffix_arrays

BATCH_SYMBOLS = 200_000
# Stretches of an anchor that are longer in sum get several arrays; one of them alone would hold up the others.
ARRAY_SYMBOLS = 2_048


def _equal_neighbours(symbols: np.ndarray, array: np.ndarray, fits: np.ndarray, width: int) -> np.ndarray:
    """Whether an entry of the array and the one before it begin with the same ``width`` symbols."""
    same = np.zeros(len(array), bool)
    left = np.flatnonzero(fits[1:] & fits[:-1]) + 1
    for k in range(width):
        left = left[symbols[array[left] + k] == symbols[array[left - 1] + k]]
    same[left] = True
    return same


def _blocks(anchor: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each stretch, and whether it is one of several of its anchor."""
    order = np.argsort(anchor, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    new = np.append(True, anchor[order][1:] != anchor[order][:-1])
    part = (before - before[np.flatnonzero(new)][np.cumsum(new) - 1]) // ARRAY_SYMBOLS
    new[1:] |= part[1:] != part[:-1]
    block = np.empty(len(anchor), np.int64)
    block[order] = np.cumsum(new) - 1
    return block, (np.bincount(anchor[order][new]) > 1)[anchor]


def _merged(data: np.ndarray, anchor: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the strings of ``width`` bytes at the places; equal strings of an anchor have the same."""
    number = anchor
    for k in range(0, width, 8):
        piece = np.zeros(len(place), np.uint64)
        for at in range(k, min(k + 8, width)):
            piece = piece << np.uint64(8) | data[place + at]
        order = np.lexsort((piece, number))
        new = np.append(True, (piece[order][1:] != piece[order][:-1]) | (number[order][1:] != number[order][:-1]))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
    return number


def by_suffix_array(spans: np.ndarray, data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which windows of the stretches also start in a text with a smaller id, decided on the bytes themselves."""
    n = spans["n"].astype(np.int64)
    repeated = np.zeros(n.sum(), bool)
    if not len(spans):
        return repeated
    window = np.cumsum(n) - n
    size = n + width  # with the separator
    anchor = np.unique(spans["a"], return_inverse=True)[1]
    block, split = _blocks(anchor, size)
    parts = []  # of split anchors: a string's least id, anchor and place; the strings and windows of an array
    for batch in _batches(np.bincount(block, size).astype(np.int64)):
        chosen = np.flatnonzero(np.isin(block, batch))
        chosen = chosen[np.argsort(block[chosen], kind="stable")]
        length = size[chosen]
        piece = np.repeat(np.arange(len(chosen)), length)
        offset = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        symbols = data[np.minimum(starts[chosen][piece] + offset, len(data) - 1)].astype(np.int64) + len(chosen)
        symbols[np.cumsum(length) - 1] = np.arange(len(chosen))
        sums = np.bincount(block[chosen], length).astype(np.int64)
        sums = sums[sums > 0]
        array = suffix_arrays(symbols, np.cumsum(sums) - sums, sums)
        fits = offset < length[piece] - width
        fits_in_order = fits[array]
        same = _equal_neighbours(symbols, array, fits_in_order, width)[fits_in_order]
        array = array[fits_in_order]
        owner = chosen[piece[array]]
        row, ids = window[owner] + offset[array], spans["d"][owner]
        begins = np.flatnonzero(~same)
        string, least = np.cumsum(~same) - 1, np.minimum.reduceat(ids, begins)
        repeated[row] = ids > least[string]
        if split[owner].any():
            head = begins[split[owner[begins]]]
            mine = np.cumsum(split[owner[begins]]) - 1
            some = split[owner]
            parts.append((least[string[head]], anchor[owner[head]], starts[owner[head]] + offset[array[head]],
                          mine[string[some]], row[some], ids[some]))
    if parts:
        least, owner, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
        number = _merged(data, owner, place, width)
        least_of = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least_of, number, least)
        below = 0
        for strings, _, _, mine, row, ids in parts:
            repeated[row] = ids > least_of[number[below + mine]]
            below += len(strings)
    return repeated


def _batches(sizes: np.ndarray):
    """Groups of similar size, about ``BATCH_SYMBOLS`` together."""
    order = np.argsort(sizes, kind="stable")
    number = np.cumsum(sizes[order]) // BATCH_SYMBOLS
    for k in np.unique(number):
        yield order[number == k]


def suffix_dedup(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text",
                 carry: list[str] | None = None) -> DataFrame:
    """Remove each byte covered by a string of ``min_bytes`` UTF-8 bytes that also starts in a text with a smaller id.

    ``kept`` holds the remaining bytes, which may begin or end within a character. Null and empty texts have no bytes;
    nulls in the id, ties and clashing names as in ``without_repeats``.
    """
    return without_repeats(docs, BYTES, by_suffix_array, min_bytes, id_col, text_col, carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed",
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
