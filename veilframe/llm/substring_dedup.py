"""Substring dedup: seed and extend.

Texts meet on winnowed anchors of their words (the seeds), see ``repeats``. Around a shared anchor a match is extended
to both sides as far as the anchor's windows reach, and stretches of at least ``min_words`` words are kept as repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import rolling as R
from veilframe.llm.repeats import WORDS, without_repeats


def extended(spans: np.ndarray, codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which windows around shared anchors, seed and both extensions, also start in a text with a smaller id."""
    n = spans["n"].astype(np.int64)
    stretch = np.repeat(np.arange(len(spans)), n)
    at = starts[stretch] + np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n)
    whole = R.stretch_hash(R.prefix(codes, R.RUN_BASE), R.RUN_BASE, at, at + width)
    anchor, ids = spans["a"][stretch], spans["d"][stretch]
    order = np.lexsort((ids, whole, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = ids[order] > least
    return out


def substring_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text",
                    carry: list[str] | None = None) -> DataFrame:
    """Remove each word covered by ``min_words`` consecutive words that also start in a text with a smaller id.

    Words are runs of characters other than blank and \\t to \\r. ``kept`` holds the words that stay, joined by one
    blank. Null and empty texts have no words; nulls in the id, ties and clashing names as in ``without_repeats``.
    """
    return without_repeats(docs, WORDS, extended, min_words, id_col, text_col, carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed",
                        F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))
