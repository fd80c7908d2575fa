"""BPE encoding with a minimal acyclic transducer as lexicon, and decoding.

Frequent words of the corpus are encoded once and compiled into an acyclic automaton in which equal suffixes share
states. Each arc carries the number of lexicon words that come before it in order, so the sum along a word's path is its
number, and a table gives the number's token ids. The automaton is a set of flat arrays in files that every task maps
into memory. All words of a batch walk it together, a byte at a time. Words outside the lexicon are merged exactly.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.plans.staging import stage

LEXICON_WORDS = 1 << 18
LEAST_COUNT = 3
SHIFT = 20  # ids have fewer bits
MASK = (1 << SHIFT) - 1
NO_RANK = 1 << 62
WIDTHS = (8, 16, 32, 64)  # longer words are merged one by one
MERGED_CELLS = 1 << 18
ARRAYS = ("first", "label", "target", "before", "final", "offset", "ids")


class Vocabulary:
    """A byte-level BPE file as the tokenizers library writes it."""

    def __init__(self, text: str, pattern: str):
        data = json.loads(text)
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        as_bytes = lambda s: bytes(self.byte_of[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in data["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        # A pair's rank and the id it becomes in one number, so that the smallest number is the lowest rank.
        self.ranks = {self.ids[as_bytes(a)] << SHIFT | self.ids[as_bytes(b)]: r << SHIFT | self.ids[as_bytes(a + b)]
                      for r, (a, b) in reversed(list(enumerate(merges)))}
        # The same pairs and all pairs of bytes as sorted rows and a table, for many words at a time.
        keys = sorted(self.ranks)
        self.pair_keys = np.array([-NO_RANK, *keys], np.int64)
        self.pair_values = np.array([NO_RANK, *(self.ranks[k] for k in keys)], np.int64)
        self.byte_ids = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.byte_pairs = self._found(self.byte_ids[:, None], self.byte_ids)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        by_id = {i: b for b, i in self.ids.items()} | {i: c.encode() for c, i in self.special.items()}
        self.pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.pattern = regex.compile(pattern)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None

    def words(self, text: str) -> list[str | int]:
        """Words of the pattern; special tokens as their ids."""
        if not self.split or not self.split.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.pattern.findall(text[at:m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the lowest ranked pair is merged first, the leftmost of equal ones. Long words go by a heap."""
        ids = [self.ids[word[i:i + 1]] for i in range(len(word))]
        if len(ids) > 64:
            return self._merge_long(ids)
        find = self.ranks.get
        pairs = [find(a << SHIFT | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == NO_RANK:
                break
            i = pairs.index(best)
            ids[i:i + 2] = [best & MASK]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = find(ids[i] << SHIFT | ids[i + 1], NO_RANK)
            if i:
                pairs[i - 1] = find(ids[i - 1] << SHIFT | ids[i], NO_RANK)
        return tuple(ids)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and id of each pair; the id -1, on either side, stands for none."""
        want = left << SHIFT | right
        at = np.searchsorted(self.pair_keys, want, "right") - 1
        return np.where(self.pair_keys[at] == want, self.pair_values[at], NO_RANK)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many words, each as :meth:`merge` gives them. Words of like length take their steps together."""
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in zip((0, *WIDTHS), WIDTHS):
            chosen = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(chosen), MERGED_CELLS // high):
                part = chosen[at:at + MERGED_CELLS // high]
                for k, ids in zip(part.tolist(), self._merged([words[k] for k in part], size[part], high)):
                    out[k] = ids
        for k in np.flatnonzero(size > WIDTHS[-1]).tolist():
            out[k] = array("I", self.merge(words[k])).tobytes()
        return out

    def _merged(self, words: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        n, place = len(words), np.arange(width + 1)
        held = place < size[:, None]  # the last cell of a row stays free: it is before the first and behind the last
        raw = np.zeros((n, width + 1), np.uint8)
        raw[held] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(held, self.byte_ids[raw], -1)
        if (ids[held] < 0).any():
            raise KeyError("a byte is not in the vocabulary")
        pairs = np.full((n, width + 1), NO_RANK)
        pairs[:, :-1] = np.where(held[:, 1:], self.byte_pairs[raw[:, :-1], raw[:, 1:]], NO_RANK)
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        rows = np.arange(n)
        while True:
            i = pairs[rows].argmin(axis=1)
            best = pairs[rows, i]
            on = best < NO_RANK
            rows, i, best = rows[on], i[on], best[on]
            if not len(rows):
                break
            new, j, h = best & MASK, after[rows, i], before[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j], pairs[rows, j] = new, -1, NO_RANK
            after[rows, i], before[rows, k] = k, i
            pairs[rows, i] = self._found(new, ids[rows, k])
            pairs[rows, h] = self._found(ids[rows, h], new)
        left = ids >= 0
        ends = (4 * np.cumsum(left.sum(axis=1))).tolist()
        packed = ids[left].astype("<u4").tobytes()
        return [packed[i:j] for i, j in zip([0, *ends], ends)]

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        import heapq

        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))

        def entry(i):
            j = after[i]
            r = self.ranks.get(ids[i] << SHIFT | ids[j]) if j >= 0 else None
            return None if r is None else (r, i, ids[i], ids[j])

        heap = [e for e in map(entry, range(len(ids) - 1)) if e]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r & MASK, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (e := entry(x)):
                    heapq.heappush(heap, e)
        return tuple(x for x in ids if x >= 0)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of the words, built in sorted order, as flat arrays.

    State s has the arcs first[s] to first[s + 1], sorted by label; ``before`` counts the state's words that come
    earlier. Word k's ids are ids[offset[k]:offset[k + 1]].
    """
    order = sorted(words)
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []
    path: list[list] = [[False, []]]  # of the last word: final, arcs [label, state]

    def close(depth: int):
        while len(path) > depth + 1:
            final, out = path.pop()
            key = (final, tuple(out))
            if key not in register:
                register[key] = len(finals)
                finals.append(final)
                arcs.append(key[1])
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    last = b""
    for word in order:
        common = len(os.path.commonprefix([last, word]))
        close(common)
        for b in word[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    finals.append(path[0][0])
    arcs.append(tuple(path[0][1]))
    n = len(arcs)
    below = np.zeros(n, np.int64)  # words from a state on; targets come before their sources
    label, target, before, first = [], [], [], np.zeros(n + 1, np.int64)
    for s in range(n):
        count = int(finals[s])
        for b, t in arcs[s]:
            label.append(b)
            target.append(t)
            before.append(count)
            count += below[t]
        below[s] = count
        first[s + 1] = len(label)
    return {"first": first.astype(np.int32), "label": np.array(label, np.uint8), "target": np.array(target, np.int32),
            "before": np.array(before, np.int32), "final": np.array(finals, bool),
            "offset": np.cumsum([0, *(len(words[w]) for w in order)]).astype(np.int32),
            "ids": np.array([i for w in order for i in words[w]], np.int32)}


MEMO_WORDS = 400_000


class Lexicon:
    """The automaton's arrays, mapped from files."""

    def __init__(self, prefix: str):
        a = {n: np.load(f"{prefix}-{n}.npy", mmap_mode="r") for n in ARRAYS}
        self.first, self.label, self.target = a["first"], a["label"], a["target"]
        self.before, self.final, self.offset, self.ids = a["before"], a["final"], a["offset"], a["ids"]
        self.root = len(self.first) - 2
        # Arcs in one sorted row: an arc is found by a binary search for state and label.
        states = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.arc = states * 256 + self.label

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for those outside the lexicon."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        out = np.full(len(words), -1, np.int64)
        live = np.arange(len(words))
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            done = size[live] == step
            ended = live[done]
            good = self.final[state[ended]]
            out[ended[good]] = total[ended[good]]
            live = live[~done]
            if not len(live) or not len(self.arc):
                break
            want = state[live] * 256 + data[start[live] + step]
            at = np.minimum(np.searchsorted(self.arc, want), len(self.arc) - 1)
            hit = self.arc[at] == want
            live, at = live[hit], at[hit]
            total[live] += self.before[at]
            state[live] = self.target[at]
            step += 1
        return out


def _word_counts(path: str, pattern: str, longest: int):
    def count(batches):
        vocabulary, counts = _vocabulary(path, pattern), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(vocabulary.words(text or ""))
                if len(counts) > 400_000:
                    yield _counted(counts, longest)
                    counts = Counter()
        yield _counted(counts, longest)

    return count


def _counted(counts: Counter, longest: int) -> pa.RecordBatch:
    """Special tokens and words that are too long for the lexicon are left out."""
    words = [w for w in counts if isinstance(w, str) and len(w) <= longest]
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def build_lexicon(docs: DataFrame, path: str, pattern: str, text_col: str = "text", max_words: int = LEXICON_WORDS,
                  longest: int = 64) -> str:
    """Count all words of all texts, compile the most frequent ones and send the files to every executor.

    Returns the prefix of the files' names. The lexicon's size is bounded by ``max_words`` and ``longest`` (bytes).
    """
    spark = docs.sparkSession
    counts = stage(docs.select(F.col(text_col).cast("string")).mapInArrow(
        _word_counts(path, pattern, longest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= LEAST_COUNT))
    # The least count that at most max_words words reach: one row a magnitude, then one a count within it.
    held = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("m")).count().collect()
    total, least = 0, LEAST_COUNT
    for m, n in sorted(((r.m, r["count"]) for r in held), reverse=True):
        if total + n > max_words:
            same = counts.filter(F.floor(F.log2("n")).cast("int") == m).groupBy("n").count().orderBy(F.desc("n"))
            least = 1 << (m + 1)
            for r in same.toLocalIterator():
                total += r["count"]
                if total > max_words:
                    break
                least = r.n
            break
        total += n
    rows = counts.filter((F.col("n") >= least) & (F.octet_length("word") <= longest)).collect()
    vocabulary = Vocabulary(_read(path), pattern)
    words = [r.word.encode() for r in rows]
    arrays = compile_lexicon({w: tuple(np.frombuffer(ids, "<u4").tolist())
                              for w, ids in zip(words, vocabulary.merge_all(words))})
    folder, name = tempfile.mkdtemp(prefix="lexicon-"), f"lexicon-{uuid.uuid4().hex}"
    for part, values in arrays.items():
        file = os.path.join(folder, f"{name}-{part}.npy")
        np.save(file, values)
        # The driver serves the file, so an executor that joins later gets it as well.
        spark.sparkContext.addFile(file)
    return name


class Encoder:
    """Ids of words, packed: the lexicon first, else merged. What was looked up lately is kept, ``MEMO_WORDS`` at most."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.packed, self.offset = lexicon.ids.astype("<u4").tobytes(), lexicon.offset.tolist()
        self.special = {i: np.uint32(i).tobytes() for i in vocabulary.special.values()}
        self.known: dict[str | int, bytes] = dict(self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.vocabulary.words(t or "") for t in texts]
        if len(self.known) > MEMO_WORDS:
            self.known = dict(self.special)
        fresh = list(set().union(*cut) - self.known.keys())
        encoded = [w.encode() for w in fresh]
        rare = []
        for w, k in zip(fresh, self.lexicon.numbers(encoded).tolist()):
            if k >= 0:
                self.known[w] = self.packed[4 * self.offset[k]:4 * self.offset[k + 1]]
            else:
                rare.append(w)
        self.known.update(zip(rare, self.vocabulary.merge_all([w.encode() for w in rare])))
        find = self.known.__getitem__
        return [b"".join(map(find, words)) for words in cut]

    def decode(self, rows: list[bytes]) -> list[str]:
        numbers = np.frombuffer(b"".join(rows), "<u4")
        pieces = list(map(self.vocabulary.pieces.__getitem__, numbers.tolist()))
        ends = np.cumsum([len(r) // 4 for r in rows]).tolist()
        return [b"".join(pieces[i:j]).decode("utf-8", "replace") for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(_read(path), pattern)


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str, prefix: str) -> Encoder:
    """A worker's encoder serves all its tasks of a run."""
    return Encoder(_vocabulary(path, pattern), Lexicon(prefix))


def _encode(path: str, pattern: str, lexicon_name: str, n_kept: int, packed: bool):
    def encode(batches):
        encoder = _encoder(path, pattern, os.path.join(SparkFiles.getRootDirectory(), lexicon_name))
        for b in batches:
            texts = b.column(n_kept).to_pylist()
            for lo in range(0, len(texts), 512):
                rows = encoder.encode(texts[lo:lo + 512])
                if packed:
                    ids = pa.array(rows, pa.binary())
                else:
                    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                part = b.slice(lo, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n_kept], ids, pa.array(encoder.decode(rows), pa.string())],
                    [*b.schema.names[:n_kept], "ids", "decoded"])

    return encode


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None,
               max_words: int = LEXICON_WORDS, packed: bool = False) -> DataFrame:
    """The ``keep`` columns (all by default), ids and the text decoded from them.

    ``path`` names a byte-level vocabulary file that every worker can read, ``pattern`` the expression that cuts words.
    With ``packed`` ids are little-endian unsigned 32-bit integers in a binary. A special token's string in a text becomes that token. A null or empty text has no ids and decodes to nothing. A
    kept column named like a result is refused.
    """
    keep = docs.columns if keep is None else keep
    if {"ids", "decoded"} & set(keep):
        raise ValueError("a kept column has the name of a result")
    name = build_lexicon(docs, path, pattern, text_col, max_words)
    chosen = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(_encode(path, pattern, name, len(keep), packed), ", ".join(
        [*fields, f"ids {'binary' if packed else 'array<int>'}", "decoded string"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                       keep=["doc_id"], packed=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
