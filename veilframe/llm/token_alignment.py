"""Alignment of two tokenizers on the bytes of a text.

Both token lists of a text end at byte offsets. Where both end, the text is cut into groups. The shorter list of ends
drives the search: each of its ends gallops through the longer list from the place its rank suggests, by doubling steps
and then by halving the step it stopped in. All ends of many texts gallop together. The common ends' ranks in the two
lists slice the groups, and differences of ranks give how many tokens of each side overlap.

Links between ids are counted by document over the whole corpus. The counts of the most frequent pairs, a bounded
number, go to every task; the links of all other pairs are joined to their counts by a shuffle.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from functools import lru_cache
from itertools import accumulate, chain, filterfalse

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.plans.staging import shared_folder, stage

BATCH_CHARS = 1 << 18
MEMO_CHUNKS = 1 << 18  # in each of two halves
JOINED = 64  # chunks encoded in one text
MEMO_CHARS = 64
LINKS = 1 << 21  # expanded at a time
WIDE = 1 << 14  # links of a group from which equal tokens are taken together first
FREQUENT_PAIRS = 1 << 20
# No token of either kind goes on over a space that follows something else than white space.
CUT = re.compile(r" (?<=\S )")
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others in order
    from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Sides:
    """Both tokenizers: ids of the texts, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        size = self.a.get_vocab_size()
        special = {t["id"]: t["content"] for t in json.loads(self.a.to_str())["added_tokens"]}
        self.a_bytes = [special[i].encode() if i in special else bytes(letters[c] for c in self.a.id_to_token(i) or "")
                        for i in range(size)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_lengths = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_lengths = np.array(list(map(len, self.b_bytes)), np.int64)
        # Names of the ids in a group: followed by another of their side, or by none.
        self.names = [f"{i}{mark}" for i in range(size) for mark in (",", "|")] + [
            f"{i}{mark}" for i in range(len(self.b_bytes)) for mark in (",", ";")]
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(t), np.uint8) for t in (self.a_bytes, self.b_bytes))
        self.a_starts, self.b_starts = (np.cumsum(n) - n for n in (self.a_lengths, self.b_lengths))
        self.marks = self._marks()
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Parts of the text that can be encoded one by one, each without the space before it."""
        if not text:
            return []
        chunks = CUT.split(" " + text)
        chunks[0] = chunks[0][1:]
        if len(chunks) > 1 and not chunks[-1]:  # a space at the end stays with its word
            chunks[-2:] = [chunks[-2] + " "]
        return chunks

    def _each(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        first = self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)
        second = self.b.encode(chunks, num_threads=1)
        return [(array("I", a.ids).tobytes(), array("I", b).tobytes()) for a, b in zip(first, second)]

    def _together(self, chunks: list[str]) -> list[tuple[bytes, bytes]] | None:
        """Ids of chunks that end in something else than white space: many are put in one text and cut apart where their
        bytes end; none if a side has no token end there."""
        texts = [" ".join(chunks[i:i + JOINED]) for i in range(0, len(chunks), JOINED)]
        bounds = np.cumsum([1 + (len(c) if c.isascii() else len(c.encode())) for c in chunks])
        sides = []
        for found, lengths in (
                ([e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)],
                 self.a_lengths), (self.b.encode(texts, num_threads=1), self.b_lengths)):
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, bounds)
            if not len(ends) or at[-1] != len(ends) - 1 or (ends[at] != bounds).any():
                return None
            cuts, raw = [0, *(4 * (at + 1)).tolist()], ids.astype("<u4").tobytes()
            sides.append([raw[i:j] for i, j in zip(cuts, cuts[1:])])
        return list(zip(*sides))

    def _encoded(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        plain = [c for c in chunks if c and not c[-1].isspace() and "\u2581" not in c]
        found = dict(zip(plain, self._together(plain) or self._each(plain))) if plain else {}
        others = [c for c in chunks if c not in found]
        return found | dict(zip(others, self._each(others))) if others else found

    def _marks(self) -> dict[str, tuple[bytes, bytes]]:
        """Ids of the marks that can be taken off the end of a word: ASCII signs that no token of either side joins to a
        letter before them."""
        joined = {b for t in (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
                  for a, b in zip(t, t[1:]) if a.isalpha()}
        out = {}
        for mark in map(chr, range(0x21, 0x7F)):
            a, b = self.a.token_to_id(mark), self.b.piece_to_id(mark)
            if not mark.isalnum() and mark not in joined and a is not None and self.b.id_to_piece(b) == mark:
                out[mark] = array("I", [a]).tobytes(), array("I", [b]).tobytes()
        return out

    def ids(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of both sides for each text."""
        if len(self.young) > MEMO_CHUNKS:
            self.old, self.young = self.young, {}
        young = self.young
        cut = [self._cut(t) for t in texts]
        missing = set(filterfalse(young.__contains__, chain.from_iterable(cut)))
        # What was used before stays; a word with a mark behind it is made of both. The byte-level side cuts between a
        # letter and a sign in any case.
        young |= {c: self.old[c] for c in missing if c in self.old}
        fresh = missing.difference(self.old)
        marked = [c for c in fresh if c[-1:] in self.marks and c[-2:-1].isalpha()]
        words = list(fresh.difference(marked) | {c[:-1] for c in marked if c[:-1] not in young})
        at = 0
        while at < len(words):
            n = max(1, sum(e <= BATCH_CHARS for e in accumulate(map(len, words[at:at + 4096]))))
            young |= self._encoded(words[at:at + n])
            at += n
        for c in marked:
            (a, b), (a_mark, b_mark) = young[c[:-1]], self.marks[c[-1]]
            young[c] = a + a_mark, b + b_mark
        out, find = [], young.__getitem__
        for chunks in cut:
            sides = list(zip(*map(find, chunks)))
            out.append((b"".join(sides[0]), b"".join(sides[1])) if sides else (b"", b""))
        for c in chain(marked, (c for c in words if len(c) > MEMO_CHARS)):
            young.pop(c, None)
        return out

    def spelled(self, ids: np.ndarray, side: str) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        table, starts, lengths = (self.a_flat, self.a_starts, self.a_lengths) if side == "a" else \
            (self.b_flat, self.b_starts, self.b_lengths)
        n = lengths[ids]
        return table[np.arange(n.sum()) + np.repeat(starts[ids] - np.cumsum(n) + n, n)]


def gallop(keys: np.ndarray, guess: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each key the first place in the rising ``ends`` that is not less, found from its guess by exponential and then
    binary search; ``len(ends)`` if there is none."""
    n = len(ends)
    low = np.full(len(keys), -1)  # before the place searched for
    high = np.full(len(keys), n)  # at it or behind
    at = np.clip(guess, 0, max(n - 1, 0))
    right = ends[at] < keys if n else np.zeros(len(keys), bool)
    low[right], high[~right] = at[right], at[~right]
    for going_right in (True, False):
        active, step = np.flatnonzero(right == going_right), 1
        while len(active) and n:
            reach = low[active] + step if going_right else high[active] - step
            reached = (reach >= 0) & (reach < n)
            active, reach = active[reached], reach[reached]
            less = ends[reach] < keys[active]
            low[active[less]], high[active[~less]] = reach[less], reach[~less]
            active, step = active[less == going_right], 2 * step
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        less = ends[middle] < keys[active]
        low[active[less]], high[active[~less]] = middle[less], middle[~less]
        active = active[high[active] - low[active] > 1]
    return high


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray,
                b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of the ends that both have. ``a_from`` and ``b_from`` tell where the texts begin (and, last,
    where they end) in the lists; the shorter list of each text drives the search in the longer."""
    a_n, b_n = np.diff(a_from), np.diff(b_from)
    drives = a_n <= b_n  # the a side does
    ranks = []
    for keys, key_from, key_n, ends, end_from, end_n, chosen in (
            (a_ends, a_from, a_n, b_ends, b_from, b_n, drives), (b_ends, b_from, b_n, a_ends, a_from, a_n, ~drives)):
        text = np.repeat(np.arange(len(key_n)), np.where(chosen, key_n, 0))
        place = np.arange(len(text)) - np.repeat(np.cumsum(np.where(chosen, key_n, 0)) - np.where(chosen, key_n, 0),
                                                 np.where(chosen, key_n, 0))
        rank = key_from[text] + place
        guess = end_from[text] + place * end_n[text] // np.maximum(key_n[text], 1)
        found = gallop(keys[rank], guess, ends)
        hit = found < len(ends)
        hit[hit] = ends[found[hit]] == keys[rank[hit]]
        ranks.append((rank[hit], found[hit]))
    a = np.concatenate([ranks[0][0], ranks[1][1]])
    b = np.concatenate([ranks[0][1], ranks[1][0]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _starts(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


@lru_cache(maxsize=1)
def _sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


def _group_names(sides: Sides, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray,
                 texts: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text. ``a_cut`` and ``b_cut`` are the ranks of the groups' last tokens, ``texts`` the
    number of groups of each text."""
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_last[a_cut], b_last[b_cut] = 1, 1
    p, q = np.diff(a_cut, prepend=-1), np.diff(b_cut, prepend=-1)
    # A token comes after the tokens of both sides in the groups before its own and those before it in its side.
    a_place = np.arange(len(a)) + np.repeat(np.cumsum(q) - q, p)
    b_place = np.arange(len(b)) + np.repeat(np.cumsum(p), q)
    mixed = np.empty(len(a) + len(b), np.int64)
    mixed[a_place] = 2 * a + a_last
    mixed[b_place] = 2 * (b + len(sides.a_bytes)) + b_last
    named = list(map(sides.names.__getitem__, mixed.tolist()))
    ends = _starts(p + q)[_starts(texts)].tolist()
    return ["".join(named[i:j])[:-1] for i, j in zip(ends, ends[1:])]


def _align(a_path: str, b_path: str, n_kept: int, names: list[str]):
    def align(batches):
        sides = _sides(a_path, b_path)
        for b in batches:
            texts = [t or "" for t in b.column(n_kept).to_pylist()]
            at = 0
            while at < len(texts):
                n = max(1, sum(e <= BATCH_CHARS for e in accumulate(map(len, texts[at:at + 1024]))))
                yield _aligned(sides, texts[at:at + n], b.slice(at, n).columns[:n_kept], names)
                at += n

    return align


def _faithful(sides: Sides, texts: list[str], found: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """The ids of the texts whose bytes both sides give back, nothing for the others."""
    raw = [(" " + t).encode() if t else b"" for t in texts]
    good = np.ones(len(texts), bool)
    for k, side in enumerate("ab"):
        ids = [np.frombuffer(f[k], "<u4") for f in found]
        lengths = sides.a_lengths if side == "a" else sides.b_lengths
        good &= np.array([int(lengths[i].sum()) == len(r) for i, r in zip(ids, raw)], bool)
        at = np.flatnonzero(good)
        if not len(at):
            break
        want = np.frombuffer(b"".join([raw[i] for i in at]), np.uint8)
        differs = _starts(sides.spelled(np.concatenate([ids[i] for i in at]), side) != want)
        good[at] = np.diff(differs[_starts([len(raw[i]) for i in at])]) == 0
    return [f if g else (b"", b"") for f, g in zip(found, good)]


def _aligned(sides: Sides, texts: list[str], kept: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    found = _faithful(sides, texts, sides.ids(texts))
    a_n, b_n = (np.array([len(f[k]) // 4 for f in found], np.int64) for k in (0, 1))
    a, b = (np.frombuffer(b"".join([f[k] for f in found]), "<u4").astype(np.int64) for k in (0, 1))
    a_from, b_from = _starts(a_n), _starts(b_n)
    a_ends, b_ends = np.cumsum(sides.a_lengths[a]), np.cumsum(sides.b_lengths[b])
    a_cut, b_cut = common_ends(a_ends, b_ends, a_from, b_from)
    groups = np.diff(np.searchsorted(a_cut, a_from))
    links = np.diff(a_cut, prepend=-1) * np.diff(b_cut, prepend=-1)
    n_links = np.diff(_starts(links)[_starts(groups)])
    named = _group_names(sides, a, b, a_cut, b_cut, groups)
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[a_cut], b_last[b_cut] = True, True
    lasts = [[np.packbits(last[i:j]).tobytes() for i, j in zip(start.tolist(), start[1:].tolist())]
             for last, start in ((a_last, a_from), (b_last, b_from))]
    return pa.RecordBatch.from_arrays([
        *kept, pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()),
        pa.array(lasts[0], pa.binary()), pa.array(lasts[1], pa.binary()), pa.array(a_n), pa.array(b_n), pa.array(groups),
        pa.array(n_links), pa.array(named, pa.string())],
        [*names, "a", "b", "a_last", "b_last", "n_a", "n_b", "n_groups", "n_links", "groups"])


def aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) of each row with the ids of both tokenizers (``a``, ``b``: little-endian
    unsigned 32-bit integers), one bit for each token that ends a group (``a_last``, ``b_last``, the first in the highest
    bit), n_a, n_b, n_groups, n_links (pairs of tokens that share a group) and ``groups``, the ids of the groups as text.

    ``a_path`` names a byte-level tokenizer file, which reads a space and the text, ``b_path`` a sentencepiece model, which
    puts that space itself; every worker can read both. Strings of special tokens are ordinary text. A null or empty text
    and one that a side does not give back byte by byte have no tokens. A kept column named like a result is refused.
    """
    keep = docs.columns if keep is None else keep
    if {"a", "b", "a_last", "b_last", "groups", *RESULTS[:4]} & set(keep):
        raise ValueError("a kept column has the name of a result")
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("t"))
    names = chosen.columns[:-1]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    found = chosen.mapInArrow(_align(a_path, b_path, len(keep), names), ", ".join(
        [*fields, "a binary", "b binary", "a_last binary", "b_last binary", "n_a long", "n_b long", "n_groups long",
         "n_links long", "groups string"]))
    return found.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], *found.columns[len(keep):])


def _last_places(bits: list[bytes], n: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).astype(bool)
    width = (n + 7) // 8 * 8
    keep = np.arange(len(flags)) - np.repeat(np.cumsum(width) - width, width) < np.repeat(n, width)
    return np.flatnonzero(flags[keep])


def _links(batch: pa.RecordBatch):
    """(row, id of a, id of b, times) of the links of a batch; rows are told by their place in it. A link may come in
    several parts."""
    a_raw, b_raw = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
    a_n, b_n = (np.array([len(r) // 4 for r in raw], np.int64) for raw in (a_raw, b_raw))
    a, b = (np.frombuffer(b"".join(raw), "<u4").astype(np.int64) for raw in (a_raw, b_raw))
    bits = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a_last", "b_last")]
    a_cut, b_cut = _last_places(bits[0], a_n), _last_places(bits[1], b_n)
    row = np.searchsorted(_starts(a_n), a_cut, side="right") - 1
    p, q = np.diff(a_cut, prepend=-1), np.diff(b_cut, prepend=-1)
    a_start, b_start = a_cut - p + 1, b_cut - q + 1
    wide = p * q > WIDE
    for g in np.flatnonzero(wide).tolist():
        ua, ma = np.unique(a[a_start[g]:a_cut[g] + 1], return_counts=True)
        ub, mb = np.unique(b[b_start[g]:b_cut[g] + 1], return_counts=True)
        slab = max(1, LINKS // len(ub))
        for lo in range(0, len(ua), slab):
            x, m = ua[lo:lo + slab], ma[lo:lo + slab]
            yield (np.full(len(x) * len(ub), row[g]), np.repeat(x, len(ub)), np.tile(ub, len(x)),
                   (m[:, None] * mb[None, :]).ravel())
    row, p, q, a_start, b_start = (v[~wide] for v in (row, p, q, a_start, b_start))
    sums = np.cumsum(p * q)
    lo = 0
    while lo < len(p):
        done = sums[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sums, done + LINKS, side="right")))
        n = (p * q)[lo:hi]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(q[lo:hi], n)
        yield (np.repeat(row[lo:hi], n), a[np.repeat(a_start[lo:hi], n) + inner // width],
               b[np.repeat(b_start[lo:hi], n) + inner % width], np.ones(len(inner), np.int64))
        lo = hi


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(back, np.concatenate(counts), len(unique)).astype(np.int64)


def _pieces(batches):
    """Rows of some BATCH_CHARS ids at a time."""
    for batch in batches:
        sizes = np.asarray(batch.column(batch.schema.get_field_index("n_a")))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_CHARS, side="right")))
            yield batch.slice(at, n)
            at += n


def _linked(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of the linked pairs of a batch, each pair once a row, in order."""
    held, times = [], []
    for row, x, y, n in _links(batch):
        keys = row << 2 * bits | x << bits | y
        order = None if (n == 1).all() else np.argsort(keys, kind="stable")
        keys, n = (np.sort(keys), None) if order is None else (keys[order], n[order])
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        held.append(keys[first])
        times.append(np.diff(np.r_[first, len(keys)]) if n is None else np.add.reduceat(n, first) if len(first) else first)
    keys, times = (held[0], times[0]) if len(held) == 1 else _counted(held, times) if held else (np.zeros(0, np.int64),) * 2
    return keys >> 2 * bits, keys & (1 << 2 * bits) - 1, times


def _pair_counts(bits: int):
    def count(batches):
        keys, counts, held = [], [], 0

        def written():
            unique, n = _counted(keys, counts)
            for lo in range(0, len(unique), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unique[lo:lo + (1 << 16)]), pa.array(n[lo:lo + (1 << 16)])], ["pair", "n"])

        for b in _pieces(batches):
            # A document counts once for a pair, however often it links it.
            unique, n = np.unique(_linked(b, bits)[1], return_counts=True)
            keys.append(unique)
            counts.append(n)
            held += len(unique)
            if held > 1 << 22:
                unique, n = _counted(keys, counts)
                if len(unique) > 1 << 21:
                    yield from written()
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [unique], [n], len(unique)
        if keys:
            yield from written()

    return count


def pair_counts(rows: DataFrame, bits: int) -> DataFrame:
    """pair (a's id, then b's in the last ``bits`` bits), n (documents that hold it linked) and best (no pair of the same a has more),
    from what ``aligned`` returns."""
    counts = stage(rows.select("a", "b", "a_last", "b_last", "n_a").mapInArrow(_pair_counts(bits), "pair long, n long").groupBy(
        "pair").agg(F.sum("n").alias("n")))
    most = counts.groupBy(F.shiftright("pair", bits).alias("a")).agg(F.max("n").alias("most"))  # one row for each id of a
    joined = counts.join(F.broadcast(most), F.shiftright("pair", bits) == F.col("a"))
    return stage(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _scored(sent, bits: int, names: list[str]):
    def score(batches):
        keys, counts, best = sent.value
        for b in _pieces(batches):
            row, pair, times = _linked(b, bits)
            at = np.searchsorted(keys, pair)
            at[at == len(keys)] = 0
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            sums, bests = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(sums, row[known], counts[at[known]] * times[known])
            np.add.at(bests, row[known], best[at[known]] * times[known])
            whole = [b.column(b.schema.get_field_index(c)) for c in names]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*whole, pa.array(bests), pa.array(sums), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                [*names, "n_best", "count_sum", "pair", "times"])
            if not known.all():
                row, pair, times = row[~known], pair[~known], times[~known]
                for lo in range(0, len(row), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    m = len(row[part])
                    yield pa.RecordBatch.from_arrays(
                        [whole[0].take(pa.array(row[part])), *(pa.nulls(m, c.type) for c in whole[1:]),
                         pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(pair[part]), pa.array(times[part])],
                        [*names, "n_best", "count_sum", "pair", "times"])

    return score


def link_scores(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None,
                frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """The ``keep`` columns of each row with n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of the
    same a exceeds in documents), count_sum (documents of the pair, over the links) and groups_sha256 (of ``groups`` of
    ``aligned``; empty without tokens).

    Every row counts as a document, equal rows and rows with null or equal ids too. A kept column named like a result is
    refused. At most ``frequent`` pairs with their counts go to every task; what is left is joined by pair, and no such
    pair is in more than one ``frequent``-th of all (document, pair) rows.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    if set(RESULTS) & set(keep):
        raise ValueError("a kept column has the name of a result")
    kept = [f"k{i}" for i in range(len(keep))]
    renamed = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text_col).alias("t"))
    found = aligned(renamed, a_path, b_path, "t", kept).withColumn(
        "groups_sha256", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))).drop("groups").withColumn(
        "row", F.monotonically_increasing_id())
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    found.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(found.schema).parquet(path)
    # Ids of both sides fit so many bits, and a batch's rows fit the rest of a long.
    bits = max(Tokenizer.from_file(a_path).get_vocab_size(),
               sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()).bit_length()
    counts = pair_counts(rows, bits)
    # The least size class of counts from which on at most ``frequent`` pairs are left, sixteen classes a doubling.
    size = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(size.alias("s")).count().collect(), key=lambda r: -r.s):
        total += r["count"]
        if total > frequent:
            break
        least = r.s
    top = counts.filter(size >= least) if least is not None else counts.limit(0)
    table = top.orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast((
        table.column("pair").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy().astype(np.int64)))
    names = ["row", *kept, *RESULTS[:4], "groups_sha256"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    scored = stage(rows.select("a", "b", "a_last", "b_last", *names).mapInArrow(
        _scored(sent, bits, names), f"{fields}, n_best long, count_sum long, pair long, times long"))
    rest = scored.filter(F.col("pair").isNotNull()).select("row", "pair", "times").join(counts, "pair").groupBy(
        "row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                   F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    more = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return scored.filter(F.col("pair").isNull()).join(rest, "row", "left").select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep)], *RESULTS[:4], (F.col("n_best") + more("more_best")).alias("n_best"),
        (F.col("count_sum") + more("more_sum")).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
