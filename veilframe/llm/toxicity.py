"""Toxicity by a weighted lexicon.

Text and lexicon are folded alike: lower case, lookalike letters to Latin, digits and signs that stand for letters to
those letters. An Aho-Corasick automaton finds the lexicon's words (whole words only) and its exception phrases; a word
inside an exception phrase does not count. The sum of weights, alone and normalised by length, goes through a logistic
function. Words, weights, phrases and the function are learned from labelled texts.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict, dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that look like Latin ones, and digits and signs used for letters. l, i, 1, | and ! are one.
LOOKALIKES = "аaвbсcеeнhкkмmоoрpтtуyхxѕsіiјjԁdԛqԝwαaβbεeηnιiκkνvοoρpτtυuχxγy"
STAND_INS = "0o1i3e4a5s7t8b@a$s!i|ili"
FOLD = str.maketrans({s[i]: s[i + 1] for s in (LOOKALIKES, STAND_INS) for i in range(0, len(s), 2)})
# A word may hold digits and signs; signs at its ends are not part of it.
WORD = regex.compile(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}@$!|]*[\p{L}\p{M}\p{N}])?")

MAX_TERMS = 4_000
LABELLED_ROWS = 30_000  # most labelled texts that are learned from, chosen by hash of the id
LEAST_TEXTS = 4
SCORES = "weight double, n_terms long, n_words long, score double"


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


@dataclass(frozen=True)
class Lexicon:
    """``terms`` and ``exceptions`` are folded; ``function`` holds the bias and the weights of the features."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    function: tuple[float, ...] = (-3.0, 1.0, 0.5)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Lexicon:
        d = json.loads(text)
        return Lexicon(d["terms"], tuple(d["exceptions"]), tuple(d["function"]))


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(term, (len(term), weight, term))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None, phrase))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float, str]]:
        """Whole-word terms outside exception phrases: start and end in the folded text, weight, term.

        A letter before or after makes the word another one; a sign or digit there does not.
        """
        if not len(self.automaton):
            return []
        plain = text.lower()
        found, excused, n = [], [], len(plain)
        for last, (size, weight, term) in self.automaton.iter(plain.translate(FOLD)):
            start, end = last + 1 - size, last + 1
            if (start and plain[start - 1].isalpha()) or (end < n and plain[end].isalpha()):
                continue
            (excused if weight is None else found).append((start, end, weight, term))
        if excused:
            found = [f for f in found if not any(s <= f[0] and f[1] <= e for s, e, _, _ in excused)]
        return found

    def features(self, text: str) -> tuple[float, int, int]:
        found = self.matches(text)
        return sum(f[2] for f in found), len(found), len(text.split())

    def scores(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(weight, words) @ np.array(self.lexicon.function), -30, 30)))


def design(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Features: bias, sum of weights, and weights per 100 words, both damped."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], 1)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _count_words(batches):
    """Texts of either label that hold a word, of a partition."""
    counts = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts[toxic].update(set(map(fold, WORD.findall(text or ""))))
        if sum(map(len, counts)) > 500_000:
            yield _counted(counts)
            counts = (Counter(), Counter())
    yield _counted(counts)


def _counted(counts) -> pa.RecordBatch:
    words = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([
        pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()),
        pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])


def _phrases(terms: dict[str, float]):
    """Two-word phrases around terms, with the label of the text."""
    def count(batches):
        matcher, counts = Matcher(Lexicon(terms)), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded, seen = fold(text or ""), set()
                for start, end, _, _ in matcher.matches(text or ""):
                    before, after = regex.search(r"[\p{L}\p{M}]+ $", folded[max(0, start - 40):start]), \
                        regex.match(r" [\p{L}\p{M}]+", folded[end:end + 40])
                    if before:
                        seen.add(before[0] + folded[start:end])
                    if after:
                        seen.add(folded[start:end] + after[0])
                counts.update((p, toxic) for p in seen)
        items = list(counts.items())
        yield pa.RecordBatch.from_arrays([
            pa.array([p for (p, _), _ in items], pa.string()),
            pa.array([n if t else 0 for (_, t), n in items], pa.int64()),
            pa.array([0 if t else n for (_, t), n in items], pa.int64())], ["phrase", "toxic", "clean"])

    return count


def _features(lexicon: Lexicon):
    def find(batches):
        matcher = Matcher(lexicon)
        for b in batches:
            rows = [matcher.features(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()),
                b.column(1)], ["weight", "words", "toxic"])

    return find


def learn(labelled: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """Learn a lexicon from columns text and toxic (0 or 1), a bounded number of rows.

    A word's weight is the logarithm of its share among toxic texts over its share among others; a term is a word of at
    least ``LEAST_TEXTS`` toxic texts with a weight over 1.5 and more toxic than other texts. Phrases of a term that
    three or more other texts and no toxic one hold are exceptions. No row or no toxic row: an empty lexicon.
    """
    labelled = labelled.select(F.col("text").cast("string"), F.col("toxic").cast("int")).filter("toxic IN (0, 1)")
    totals = labelled.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    if not totals.t:
        return Lexicon({}, (), (-4.0, 0.0, 0.0))
    counts = labelled.mapInArrow(_count_words, "word string, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (totals.t + 1)) - F.log((F.col("clean") + 0.5) / (totals.c + 1))
    rows = counts.filter(f"toxic >= {LEAST_TEXTS} AND toxic > clean AND length(word) > 2").withColumn(
        "weight", weight).filter("weight > 1.5").orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "word").limit(
        max_terms).collect()
    terms = {r.word: r.weight for r in rows}
    found = labelled.mapInArrow(_phrases(terms), "phrase string, toxic long, clean long").groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic = 0 AND clean >= 3")
    phrases = tuple(r.phrase for r in found.orderBy(F.desc("clean"), "phrase").limit(max_terms).collect())
    rows = labelled.mapInArrow(_features(Lexicon(terms, phrases)), "weight double, words long, toxic int").collect()
    x = design(np.array([r.weight for r in rows]), np.array([r.words for r in rows]))
    return Lexicon(terms, phrases, tuple(_fit(x, np.array([r.toxic for r in rows], float))))


def _score(lexicon: Lexicon, n_kept: int):
    def score(batches):
        matcher = Matcher(lexicon)
        for b in batches:
            rows = [matcher.features(t or "") for t in b.column(n_kept).to_pylist()]
            weight, terms, words = (np.array(c, k) for c, k in zip(zip(*rows), (float, np.int64, np.int64))) \
                if rows else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n_kept], pa.array(weight), pa.array(terms), pa.array(words),
                 pa.array(matcher.scores(weight, words))],
                [*b.schema.names[:n_kept], "weight", "n_terms", "n_words", "score"])

    return score


def toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and weight, n_terms, n_words, score (0 to 1) of each row.

    A null or empty text has no terms and the score of none. A kept column named like a result is refused.
    """
    keep = docs.columns if keep is None else keep
    if {"weight", "n_terms", "n_words", "score"} & set(keep):
        raise ValueError("a kept column has the name of a result")
    chosen = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(_score(lexicon, len(keep)), ", ".join([*fields, SCORES]))


def fold_number(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def learned_from(docs: DataFrame, labels: DataFrame, max_rows: int = LABELLED_ROWS) -> Lexicon:
    """Learn from the labelled rows outside fold 0, at most ``max_rows`` of them, the first by hash of the id."""
    chosen = labels.filter("toxic IN (0, 1)").filter(fold_number(F.col("doc_id")) != 0).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers.
    chosen = chosen.select(F.col("doc_id").alias("__labelled"), "toxic")
    return learn(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__labelled")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = learned_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity(docs, lexicon, keep=["doc_id"])
    return scored.select("doc_id", (fold_number(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")
