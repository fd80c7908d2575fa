"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words are counted over the whole corpus; the most frequent ones get a class each or share one, all others fall into
classes by hash. The network predicts a word's class from the classes of the words on both sides, the word itself
masked; the word's share of its class, by its own count, does the rest. It is trained in numpy: every partition goes
over all its tokens once from the same start, and the weights are averaged by tokens. A document's score is the sum of
the conditional log-probabilities of its words.

The counts stay a table, as there are more words than a task can hold. The texts are dealt into blocks, and a block gets
the counts of its own words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import rolling as R
from veilframe.llm.repeats import BLOBS, SHARE_BYTES, _batch, _blobs, _cogrouped, _grouped
from veilframe.plans.staging import stage

SIDE = 2  # words on each side
HIDDEN = 16
VOCABULARY = 8_192
OWN = 48  # the most frequent words are classes of their own
SHARED = 32  # classes of the rest of the vocabulary
RARE = 16  # classes of all other words
CLASSES = OWN + SHARED + RARE
EDGE = CLASSES  # stands for words outside the text
BATCH = 4_096
RATE = 0.5
SEED = 5
COUNTED = np.dtype([("word", "<u8"), ("n", "<i8")])
SCORES = "n_tokens long, log_likelihood double, mean_log_prob double"


@dataclass
class Words:
    """``known``: sorted hashes of the vocabulary; ``group`` and ``share``: class and log share in it. Every other word
    has a rare class; ``rare_share`` is the log share of a word that comes once there, or never. ``counts`` (word, n)
    holds those that come more often; tasks get the counts of their own words instead."""

    known: np.ndarray
    group: np.ndarray
    share: np.ndarray
    rare_share: np.ndarray
    counts: DataFrame | None = None

    def classes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and log share of each word as far as the vocabulary tells, and which words are not in it."""
        rare = (codes % np.uint64(RARE)).astype(np.int64)
        group, share, hit = rare + OWN + SHARED, self.rare_share[rare], np.zeros(len(codes), bool)
        if len(self.known) and len(codes):
            at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            hit = self.known[at] == codes
            group[hit], share[hit] = self.group[at[hit]], self.share[at[hit]]
        return group, share, ~hit

    def look_up(self, codes: np.ndarray, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Class and log share of each word. ``counted``: COUNTED rows of the words, in order; by default they are
        fetched from the table, on the driver only."""
        group, share, rare = self.classes(codes)
        if counted is None:
            counted = self._fetch(np.unique(codes[rare]))
        if len(counted) and rare.any():
            known, asked = np.ascontiguousarray(counted["word"]), codes[rare]
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            share[rare] += np.where(known[at] == asked, np.log(counted["n"][at]), 0.0)
        return group, share

    def _fetch(self, codes: np.ndarray) -> np.ndarray:
        if self.counts is None or not len(codes):
            return np.zeros(0, COUNTED)
        asked = self.counts.sparkSession.createDataFrame([(int(c),) for c in codes.view(np.int64)], "word long")
        found = [(r.word, r.n) for r in self.counts.join(F.broadcast(asked), "word").collect()]
        out = np.zeros(len(found), COUNTED)
        out["word"] = np.array([w for w, _ in found], np.int64).view(np.uint64)
        out["n"] = [n for _, n in found]
        return _in_order(out)

    def sent(self) -> Words:
        """What every task gets: the vocabulary and one share a rare class."""
        return replace(self, counts=None)


def _in_order(counted: np.ndarray) -> np.ndarray:
    return counted[np.argsort(counted["word"])]


def _count(batches):
    def flush(found):
        words, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    found, size = [], 0
    for b in batches:
        for codes, _ in _tokens(b, 0):
            found.append(codes)
            size += len(codes)
            if size > 1 << 21:
                yield flush(found)
                found, size = [], 0
    if found:
        yield flush(found)


def _tokens(batch, column: int | str):
    """Word hashes of slices of a batch, and where its rows begin."""
    data, offsets = R.texts(batch.column(column))
    for lo, hi in R.slices(offsets):
        part, rel = R.lower(data[offsets[lo]:offsets[hi]]), offsets[lo:hi + 1] - offsets[lo]
        starts, ends = R.words(part, rel)
        yield R.word_codes(part, starts, ends), np.searchsorted(starts, rel)


def count_words(docs: DataFrame, text_col: str = "text", vocabulary: int = VOCABULARY) -> Words:
    """Counts of all words of all texts. What reaches the driver is ``vocabulary`` rows and one row a rare class; the
    counts of all other words stay a table."""
    counts = stage(docs.select(F.col(text_col).cast("string")).mapInArrow(_count, "word long, n long").groupBy(
        "word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    known = np.array([r.word for r in top], np.int64).view(np.uint64)
    n = np.array([r.n for r in top], float)
    group = np.where(np.arange(len(top)) < OWN, np.arange(len(top)),
                     OWN + (known % np.uint64(SHARED)).astype(np.int64))
    total = np.bincount(group, n, CLASSES) if len(top) else np.zeros(CLASSES)
    share = np.log(n / total[group]) if len(top) else n
    order = np.argsort(known)
    rest = counts
    if len(top) == vocabulary:
        last = top[-1]
        rest = counts.filter((F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("word") > last.word)))
    # One more token of a rare class stands for the words never seen. The sign bit is cleared as the classes are a power
    # of two.
    total = np.zeros(RARE)
    for r in rest.groupBy(F.expr(f"word & {RARE - 1}").alias("k")).agg(F.sum("n").alias("n")).collect():
        total[r.k] = r.n
    return Words(known[order], group[order], share[order], -np.log(total + 1), rest.filter("n > 1"))


class Network:
    """hidden = tanh(sum over places of embedding[place, class] + bias); output = softmax(hidden @ out + bias)."""

    SHAPES = ((2 * SIDE, CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(SEED)
            self.parts = [rng.normal(0, 0.1, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32)
                          for s in self.SHAPES]
        else:
            cuts = np.cumsum([int(np.prod(s)) for s in self.SHAPES])[:-1]
            self.parts = [p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, cuts), self.SHAPES)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and probabilities of the classes."""
        table, bias, out, out_bias = self.parts
        hidden = np.tanh(sum(table[k, context[k]] for k in range(2 * SIDE)) + bias)
        logits = hidden @ out + out_bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return hidden, logits

    def learn(self, context: np.ndarray, group: np.ndarray, rate: float):
        table, bias, out, out_bias = self.parts
        hidden, error = self.forward(context)
        error[np.arange(len(group)), group] -= 1
        error *= rate / len(group)
        back = (error @ out.T) * (1 - hidden * hidden)
        out -= hidden.T @ error
        out_bias -= error.sum(0)
        bias -= back.sum(0)
        for k in range(2 * SIDE):
            order = np.argsort(context[k], kind="stable")
            at = context[k][order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            table[k, at[first]] -= np.add.reduceat(back[order], first, axis=0)


def contexts(group: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Classes of the words before and after each word of its text; EDGE beyond its ends."""
    size = np.diff(bounds)
    start, end = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    here = np.arange(len(group))
    rows = []
    for step in (*range(-SIDE, 0), *range(1, SIDE + 1)):
        at = here + step
        inside = (at >= start) & (at < end)
        rows.append(np.where(inside, group[np.clip(at, 0, max(0, len(group) - 1))], EDGE))
    return np.stack(rows)


def _train(words_sent, flat: np.ndarray):
    def train(batches):
        words, network, seen = words_sent.value, Network(flat), 0
        for b in batches:
            for codes, bounds in _tokens(b, 0):
                group, _, _ = words.classes(codes)
                context = contexts(group, bounds)
                # Texts are mixed within the slice so that a step sees many of them.
                order = np.random.default_rng(len(codes)).permutation(len(codes))
                for at in range(0, len(order), BATCH):
                    some = order[at:at + BATCH]
                    network.learn(context[:, some], group[some], RATE * min(1.0, len(some) / BATCH))
                seen += len(codes)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat) + 1)), pa.array(np.append(network.flat() * seen, seen))],
                ["place", "value"])

    return train


def fit(docs: DataFrame, words: Words, text_col: str = "text", rounds: int = 1) -> Network:
    """Train over all tokens of all texts, ``rounds`` times. Each round averages the partitions' weights by a sum per
    place; the driver gets one number per weight."""
    sent = docs.sparkSession.sparkContext.broadcast(words.sent())  # at most the vocabulary
    flat = Network().flat()
    for _ in range(rounds):
        sums = docs.select(F.col(text_col).cast("string")).mapInArrow(
            _train(sent, flat), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        if not sums:
            break
        total = np.zeros(len(flat) + 1)
        for r in sums:
            total[r.place] = r.value
        flat = total[:-1] / total[-1]
    return Network(flat)


def _asked(words_sent):
    """The different words of a block that are not in the vocabulary."""
    def ask(key, table):
        words, found = words_sent.value, [np.zeros(0, np.uint64)]
        for codes, _ in _tokens(table, "__text"):
            found.append(np.unique(codes[words.classes(codes)[2]]))
        codes = np.unique(np.concatenate(found)).view(np.int64)
        return pa.table({"key": pa.array(np.full(len(codes), key[0].as_py(), np.int64)), "word": pa.array(codes)})

    return ask


def _answers(batches):
    """Rows (key, word, n) packed, some hundred thousand at a time."""
    def flush(found):
        rows = np.concatenate([rows for _, rows in found])
        return _batch(*_blobs(COUNTED, rows, np.concatenate([keys for keys, _ in found])))

    found, size = [], 0
    for b in batches:
        rows = np.zeros(b.num_rows, COUNTED)
        rows["word"], rows["n"] = b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
        found.append((b.column(0).to_numpy(), rows))
        size += len(rows)
        if size > 1 << 19:
            yield flush(found)
            found, size = [], 0
    if found:
        yield flush(found)


def _score(words_sent, flat: np.ndarray, schema: pa.Schema):
    def score(key, table, blobs):
        words, network = words_sent.value, Network(flat)
        counted = _in_order(np.frombuffer(b"".join(x.as_py() for x in blobs.column("blob")), COUNTED))
        sizes, sums = [], []
        for codes, bounds in _tokens(table, "__text"):
            group, share = words.look_up(codes, counted)
            context = contexts(group, bounds)
            log = np.empty(len(codes))
            for at in range(0, len(codes), BATCH):
                some = slice(at, at + BATCH)
                own = group[some]
                _, p = network.forward(context[:, some])
                log[some] = np.log(np.maximum(p[np.arange(len(own)), own], 1e-30))
            running = np.append(0.0, np.cumsum(log + share))
            sizes.append(np.diff(bounds))
            sums.append(running[bounds[1:]] - running[bounds[:-1]])
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        total = np.concatenate(sums) if sums else np.zeros(0)
        total[n == 0] = 0.0
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        kept = [table.column(f"__c{i}").cast(schema.field(i).type) for i in range(len(schema) - 3)]
        return pa.Table.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(total), mean], names=schema.names)

    return score


def lm_score(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, words: Words | None = None,
             network: Network | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and n_tokens, log_likelihood, mean_log_prob (per token) of each row.

    Without ``words`` and ``network`` both come from ``docs``. Null and empty texts have no tokens, a log-likelihood
    of 0 and a null mean. A kept column named like a result is refused.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keep = docs.columns if keep is None else keep
    if {"n_tokens", "log_likelihood", "mean_log_prob"} & set(keep):
        raise ValueError("a kept column has the name of a result")
    words = words or count_words(docs, text_col)
    network = network or fit(docs, words, text_col)
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    fields = docs.select(*keep).schema.fields
    # The block follows from the row itself, so both steps see the same blocks.
    spread = [c for c, f in zip(keep, fields) if not re.search("map<|variant|void", f.dataType.simpleString())]
    rows = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)], text.alias("__text"), F.pmod(
        F.xxhash64(text, *spread), F.lit(max(32, int(size // SHARE_BYTES)))).alias("key"))
    sent = docs.sparkSession.sparkContext.broadcast(words.sent())
    blocks = rows.groupBy("key")  # the same exchange serves both steps that read the texts
    if words.counts is None:
        answers = docs.sparkSession.createDataFrame([], BLOBS)
    else:
        asked = blocks.applyInArrow(_grouped(_asked(sent)), "key long, word long")
        answers = asked.join(words.counts, "word").select("key", "word", "n").mapInArrow(_answers, BLOBS)
    schema = StructType([*fields, *StructType.fromDDL(SCORES).fields])
    return blocks.cogroup(answers.groupBy("key")).applyInArrow(
        _cogrouped(_score(sent, network.flat(), to_arrow_schema(schema))), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
