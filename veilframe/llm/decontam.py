"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages; TF-IDF weighs their words by document counts over the whole corpus. A randomised
SVD (random projection, power iterations, small exact SVD; the products are Spark jobs over the passages) gives a latent
space of bounded size. Every window of every document is folded into that space, and windows close to a passage by
cosine are checked on their words: the longest common subsequence, and the passage's answer (its last words).

The space is cut to ``RANK`` directions, so it holds some passages of a large benchmark badly. Beside it, whatever the
cosine, every window in which ``SEED`` consecutive words of a passage begin gets the same check on its words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import rolling as R

PASSAGE = 64  # words of a benchmark passage at most
BLOCK = 16  # windows start at every block of a text
# Blocks of a window, by the longest passage it is for: a window holds any such passage that starts in its first block.
SCALES = ((16, 2), (32, 3), (PASSAGE, 5))
RANK = 256
OVERSAMPLE = 16
POWER_STEPS = 2
COSINE = 0.4
WEIGHT = 0.3  # of a passage's squared length that a window must give along it
SHARE = 0.65  # of a passage's words found in order, within twice its length
SEED = 4  # consecutive words; a shorter passage is a seed as a whole
WEAK_SHARE = 0.5  # enough if the answer, the passage's last quarter, is there in one piece
FOUND = "item_id {item}, passage long, first_word long, cosine double, share double, answer boolean"

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def _lower_utf8(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII, Latin-1 and Cyrillic letters, byte by byte; each keeps its length."""
    out = R.lower(data)
    lead = np.append(np.uint8(0), data[:-1])
    latin = (lead == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    first = (lead == 0xD0) & (data >= 0x90) & (data <= 0x9F)
    second = (lead == 0xD0) & (data >= 0xA0) & (data <= 0xAF)
    out[latin | first] += 0x20
    out[second] -= 0x20
    out[np.flatnonzero(second) - 1] = 0xD1
    return out


def plain_words(data: np.ndarray, offsets: np.ndarray):
    """Letters and digits in runs, lower-cased: starts, ends and hashes. Any other ASCII character parts words."""
    data = np.where(_LETTER[data], _lower_utf8(data), np.uint8(0x20))
    starts, ends = R.words(data, offsets)
    return starts, ends, R.word_codes(data, starts, ends)


def _texts(docs: pa.RecordBatch | pa.Table, column: int):
    """Yield (lo, hi, bounds, codes): the words of rows lo..hi, row k's between bounds[k - lo] and the next."""
    data, offsets = R.texts(docs.column(column))
    for lo, hi in R.slices(offsets):
        rel = offsets[lo:hi + 1] - offsets[lo]
        starts, _, codes = plain_words(data[offsets[lo]:offsets[hi]], rel)
        yield lo, hi, np.searchsorted(starts, rel), codes


@dataclass
class Space:
    """``features``: sorted word hashes; ``fold``: a row for each, idf times its latent direction."""

    features: np.ndarray
    idf: np.ndarray
    fold: np.ndarray
    items: list
    words: list[np.ndarray]  # of each passage
    numbers: list[int]  # of each passage within its item
    latent: np.ndarray  # unit vectors of the passages
    length: np.ndarray  # of the passages' vectors
    documents: int


class _Lookup:
    """Positions of hashes in a sorted array; a small bitmap answers most misses."""

    def __init__(self, features: np.ndarray):
        self.features, self.seen = features, np.zeros(1 << 22, bool)
        self.seen[(features & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codes that are features, and their positions."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[(codes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.features, codes[at]), len(self.features) - 1)
        hit = self.features[place] == codes[at]
        return at[hit], place[hit]


def _seed_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = R.mix(out + codes[k:len(codes) - n + 1 + k])
    return out


class _Seeds:
    """Passages by their runs of ``SEED`` words; shorter passages by all their words.

    A short passage whose words meet by chance in a document or more of the corpus is none: only the cosine tells
    whether it is quoted.
    """

    def __init__(self, space: Space):
        lookup, self.kinds = _Lookup(space.features), []
        by_size: dict[int, list[int]] = {}
        for p, w in enumerate(space.words):
            if len(w) >= SEED or len(w) and (
                    space.idf[np.unique(lookup.find(w)[1])].sum() >= np.log(space.documents + 1)):
                by_size.setdefault(min(SEED, len(w)), []).append(p)
        for n, passages in by_size.items():
            found = [np.unique(_seed_codes(space.words[p], n)) for p in passages]
            codes = np.concatenate(found)
            owner = np.repeat(np.array(passages), [len(x) for x in found])
            order = np.argsort(codes, kind="stable")
            seeds, edges = np.unique(codes[order], return_index=True)
            self.kinds.append((n, _Lookup(seeds), np.append(edges, len(order)), owner[order]))

    def find(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of ``codes`` that are seeds, each with every passage that has it."""
        words, passages = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, lookup, edges, owner in self.kinds:
            at, place = lookup.find(_seed_codes(codes, n))
            within = at + n <= bounds[np.searchsorted(bounds, at, "right")]
            at, place = at[within], place[within]
            count = edges[place + 1] - edges[place]
            words.append(np.repeat(at, count))
            passages.append(owner[np.repeat(edges[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        return np.concatenate(words), np.concatenate(passages)


def _passages(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, passage number and packed word hashes of every benchmark passage."""
    item = benchmark.schema[item_col].dataType.simpleString()

    def cut(batches):
        for b in batches:
            rows, numbers, words = [], [], []
            for lo, hi, bounds, codes in _texts(b, 1):
                for k in range(hi - lo):
                    own = codes[bounds[k]:bounds[k + 1]]
                    for at in range(0, len(own), PASSAGE):
                        if at and len(own) - at < PASSAGE // 2:
                            continue  # covered by the last full passage below
                        rows.append(lo + k)
                        numbers.append(at // PASSAGE)
                        words.append(own[at:at + PASSAGE].tobytes())
                    if len(own) > PASSAGE and 0 < len(own) % PASSAGE < PASSAGE // 2:
                        rows.append(lo + k)
                        numbers.append(-(-len(own) // PASSAGE))
                        words.append(own[-PASSAGE:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64()),
                 pa.array(words, pa.binary())], ["item", "number", "words"])

    texts = benchmark.select(F.col(item_col), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull())
    return texts.mapInArrow(cut, f"item {item}, number long, words binary")


def _document_counts(features_sent):
    def count(batches):
        lookup = _Lookup(np.frombuffer(features_sent.value, np.uint64))
        total, counts = 0, np.zeros(len(lookup.features), np.int64)
        for b in batches:
            total += b.num_rows
            for lo, hi, bounds, codes in _texts(b, 0):
                at, place = lookup.find(codes)
                row = np.searchsorted(bounds, at, "right") - 1
                pairs = np.unique(row * (len(counts) + 1) + place)
                counts += np.bincount(pairs % (len(counts) + 1), minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(counts[held], total))],
                                         ["feature", "n"])

    return count


def _product(features: np.ndarray, idf: np.ndarray, matrix: np.ndarray):
    """A'A times ``matrix`` (features x l), summed over the passages of a partition."""
    def run(batches):
        lookup = _Lookup(features)
        out = np.zeros(matrix.shape)
        for b in batches:
            for x in b.column(0):
                _, place = lookup.find(np.frombuffer(x.as_py(), np.uint64))
                row = matrix[place] * idf[place][:, None]
                np.add.at(out, place, idf[place][:, None] * row.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

    return run


def build_space(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                rank: int = RANK, max_features: int = 1 << 18, seed: int = 7) -> Space:
    """Latent space of the benchmark's passages, with document counts of their words over all of ``docs``.

    The words of the benchmark are the features, at most ``max_features`` of them: what is broadcast and collected is
    bounded by that and ``rank``. A larger benchmark is refused; split it.
    """
    from veilframe.plans.staging import stage

    spark = docs.sparkSession
    passages = stage(_passages(benchmark, item_col, text_col))
    rows = passages.orderBy("item", "number").limit(max_features).collect()
    words = [np.frombuffer(r.words, np.uint64) for r in rows]
    features = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    if len(features) > max_features or len(rows) == max_features:
        raise ValueError(f"the benchmark has more than {max_features} words or passages")
    sent = spark.sparkContext.broadcast(features.tobytes())
    summed = docs.select(F.col(text_col).cast("string")).mapInArrow(
        _document_counts(sent), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(features) + 1, np.int64)
    for r in summed.collect():
        counts[r.feature] = r.n  # the number of documents comes last
    total, counts = counts[-1], counts[:-1]
    idf = np.log((total + 1) / (counts + 1)) + 0.05

    width = min(rank + OVERSAMPLE, max(1, len(rows)))
    basis = np.random.default_rng(seed).standard_normal((len(features), width))
    few = passages.select("words").coalesce(8)
    for _ in range(POWER_STEPS + 1):
        if not len(features):
            break
        basis, _ = np.linalg.qr(basis)
        basis = sum(np.frombuffer(r.part, float).reshape(basis.shape) for r in few.mapInArrow(
            _product(features, idf, basis), "part binary").collect())
    basis, _ = np.linalg.qr(basis)
    # Exact SVD of the passages within the projected space.
    lookup = _Lookup(features)
    small = np.array([(basis[p] * idf[p][:, None]).sum(0) for p in (lookup.find(w)[1] for w in words)])
    if len(small):
        _, _, right = np.linalg.svd(small.reshape(len(rows), -1), full_matrices=False)
        basis = basis @ right[:rank].T
        latent = small @ right[:rank].T
        length = np.linalg.norm(latent, axis=1)
        latent /= np.maximum(length, 1e-12)[:, None]
    else:
        latent, length = np.zeros((0, basis.shape[1])), np.zeros(0)
    return Space(features, idf, (basis * idf[:, None]).astype(np.float32), [r.item for r in rows], words,
                 [r.number for r in rows], latent.astype(np.float32), length.astype(np.float32), int(total))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence (bit-parallel rows, then traced back)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, [full]
    for w in b.tolist():
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    # rows[j] has a zero at i where the length with a[:i + 1] and b[:j] grows.
    out, i, j = [], len(a) - 1, len(b)
    while i >= 0 and j:
        if rows[j] >> i & 1:
            i -= 1
        elif not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append((i, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


def verdict(passage: np.ndarray, window: np.ndarray) -> tuple[float, bool]:
    """Share of the passage's words that the window holds in order, and whether it holds the answer in one piece."""
    n = len(passage)
    pairs = common_subsequence(passage, window)
    share = len(pairs) / n
    if pairs and pairs[-1][1] - pairs[0][1] >= 2 * n:
        places = np.array([j for _, j in pairs])
        share = max(np.searchsorted(places, places + 2 * n) - np.arange(len(places))) / n
    last = max(1, n // 4)
    answer, tail = passage[-last:], dict(pairs)
    end = tail.get(n - 1, -1)
    return share, bool(end >= last - 1 and (window[end - last + 1:end + 1] == answer).all())


def _blocks(bounds: np.ndarray):
    """Row and first word of every block of the texts, and the block after the last of its text."""
    count = -(-np.diff(bounds) // BLOCK)
    row = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return row, bounds[row] + BLOCK * (np.arange(len(row)) - (ends - count)[row]), ends[row]


def _search(space_sent, threshold: float, n_kept: int, item_type: pa.DataType, drop: bool = False):
    """Matches with the first ``n_kept`` columns; with ``drop`` those columns of the rows without a match."""
    def search(batches):
        space = space_sent.value
        lookup = _Lookup(space.features)
        size = np.array([len(w) for w in space.words], np.int64)
        scales, least = [], 0
        for most, blocks in SCALES:
            chosen = np.flatnonzero((size > least) & (size <= most))
            least = most
            if len(chosen):
                scales.append((chosen, space.latent[chosen].T.copy(), WEIGHT * space.length[chosen], blocks))
        scale, column = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)  # of each passage
        for k, (chosen, *_) in enumerate(scales):
            scale[chosen], column[chosen] = k, np.arange(len(chosen))
        seeds = _Seeds(space)
        weights = [Counter(w.tolist()) for w in space.words]
        vocabulary = [set(w) for w in weights]
        for b in batches:
            rows, found = [], []
            for lo, hi, bounds, codes in _texts(b, n_kept):
                row, first, end = _blocks(bounds)
                if not len(row):
                    continue
                at, place = lookup.find(codes)
                block = np.searchsorted(first, at, "right") - 1
                running = np.zeros((len(row) + 1, space.fold.shape[1]))
                turn = np.arange(len(at)) - np.searchsorted(block, block)
                for k in range(BLOCK):  # the k-th known word of every block; a block once at a time
                    now = np.flatnonzero(turn == k)
                    running[block[now] + 1] += space.fold[place[now]]
                np.cumsum(running, axis=0, out=running)
                seed, owner = seeds.find(codes, bounds)
                seed = np.searchsorted(first, seed, "right") - 1
                for number, (chosen, unit, weight, blocks) in enumerate(scales):
                    stop = np.minimum(np.arange(len(row)) + blocks, end)
                    latent = (running[stop] - running[:-1]).astype(np.float32)
                    along = latent @ unit
                    norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-6)
                    near = (along >= threshold * norm[:, None]) & (along >= weight)
                    mine = scale[owner] == number
                    for back in range(blocks):  # the windows that hold the seed's first word
                        at = np.maximum(seed[mine] - back, 0)
                        same = row[at] == row[seed[mine]]
                        near[at[same], column[owner[mine][same]]] = True
                    for w, c in zip(*np.nonzero(near)):
                        p, start = chosen[c], first[w]
                        window = codes[start:min(start + blocks * BLOCK, bounds[row[w] + 1])]
                        known = vocabulary[p]
                        # Each word of the subsequence is shared; a word may stand for its repetitions.
                        if sum(weights[p][x] for x in known.intersection(window.tolist())) < WEAK_SHARE * size[p]:
                            continue
                        share, answer = verdict(space.words[p], window)
                        if share >= SHARE or (share >= WEAK_SHARE and answer):
                            rows.append(lo + row[w])
                            found.append((space.items[p], space.numbers[p], int(start - bounds[row[w]]),
                                          float(along[w, c] / norm[w]), share, answer))
            if drop:
                clean = np.ones(b.num_rows, bool)
                clean[rows] = False
                yield b.select(b.schema.names[:n_kept]).filter(pa.array(clean))
                continue
            take = pa.array(rows, pa.int64())
            columns = list(zip(*found)) if found else [[]] * 6
            kinds = [item_type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [*[c.take(take) for c in b.columns[:n_kept]], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                [*b.schema.names[:n_kept], "item_id", "passage", "first_word", "cosine", "share", "answer"])

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", threshold: float = COSINE, space: Space | None = None) -> DataFrame:
    """Windows of documents that hold a benchmark passage, word by word or with some words changed.

    One row per document id and item, the best window: passage, first_word, cosine, share (of the passage's words in
    order) and answer (its last quarter is there in one piece). The cosine of a window that only a seed found may be below
    the threshold. Documents and items that are null or without words match nothing;
    a null id is an id. Repeated items each match. Only the id and the text are read of either table.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    space = space or build_space(docs, benchmark, item_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    item = benchmark.schema[item_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(space)
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        _search(sent, threshold, 1, to_arrow_type(item)),
        f"doc_id {kind}, " + FOUND.format(item=item.simpleString()))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        "share", "cosine", (-F.col("first_word")).alias("at"), (-F.col("passage")).alias("passage"),
        "answer")).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), "item_id", (-F.col("b.passage")).alias("passage"),
                       (-F.col("b.at")).alias("first_word"), "b.cosine", "b.share", "b.answer")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   threshold: float = COSINE) -> DataFrame:
    """The rows of ``docs``, with all columns, in which :func:`contaminated` finds nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(build_space(docs, benchmark, item_col, text_col))
    return docs.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(
        _search(sent, threshold, len(docs.columns), None, drop=True), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
