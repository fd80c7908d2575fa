"""Packing token ids of documents into windows of equal length, by best fit decreasing.

Each task packs its own rows in blocks of bounded size, so nothing is shuffled. A document longer than the window is cut
into full windows first. The rest go in by falling length, each into the open window that it leaves least room in; a
segment tree over the remaining room finds it. Windows that still have much room are closed by cutting the contents of
the emptiest; the one window left is taken up by the next block, and the task's last one is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from itertools import accumulate, chain, filterfalse
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BLOCK_TOKENS = 1 << 22
BATCH_CHARS = 1 << 21
ROOM_SHARE = 64  # a window may end with a room of one of so many parts
MEMO_CHUNKS = 1 << 19  # in each half
JOINED = 64  # chunks encoded in one text
MEMO_CHARS = 64
RESULTS = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")


class Piece(NamedTuple):
    doc: int
    start: int
    length: int


class OpenWindows:
    """Windows by their remaining room. A node of the tree holds the number of open windows below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.held = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, window: int, room: int) -> None:
        self.by_room[room].append(window)
        node = self.leaves + room
        while node:
            self.held[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a window of the least room that is ``need`` or more, with its room."""
        held, node = self.held, self.leaves + need
        while not held[node]:
            # Up until there is a subtree of larger rooms to the right.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not held[node]:
                node += 1
        room = node - self.leaves
        while node:
            held[node] -= 1
            node >>= 1
        return self.by_room[room].pop(), room


def best_fit(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Windows of pieces that are no longer than ``size``, by falling length, ties in the given order."""
    windows, tree = [], OpenWindows(size)
    for p in sorted(pieces, key=lambda p: -p.length):
        found = tree.tightest(p.length)
        if found:
            window, room = found
            windows[window].append(p)
        else:
            window, room = len(windows), size
            windows.append([p])
        if room > p.length:
            tree.put(window, room - p.length)
    return windows


def closed(windows: list[list[Piece]], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows with little room, and the pieces of the one that is left over (none if none is).

    The emptiest windows are given up and their pieces cut to fill the others, the fullest first.
    """
    fill = lambda w: sum(p.length for p in w)
    done = [w for w in windows if size - fill(w) <= size // ROOM_SHARE]
    ragged = sorted((w for w in windows if size - fill(w) > size // ROOM_SHARE), key=fill)
    spare: list[Piece] = []
    low = 0
    for high in range(len(ragged) - 1, -1, -1):
        if high < low:
            break
        taker = ragged[high]
        room = size - fill(taker)
        while room:
            if not spare:
                if low >= high:
                    break
                spare, low = ragged[low][::-1], low + 1
            p = spare.pop()
            taken = min(room, p.length)
            taker.append(Piece(p.doc, p.start, taken))
            room -= taken
            if taken < p.length:
                spare.append(Piece(p.doc, p.start + taken, p.length - taken))
        if room:
            return done, taker
        done.append(taker)
    return done, spare[::-1]


def in_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in sequences whose lengths are the powers of two in their sum, the largest first."""
    total = sum(p.length for p in pieces)
    out, rest = [], pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room, sequence = total & 1 << bit, []
        while room:
            p = rest.pop()
            taken = min(room, p.length)
            sequence.append(Piece(p.doc, p.start, taken))
            room -= taken
            if taken < p.length:
                rest.append(Piece(p.doc, p.start + taken, p.length - taken))
        if sequence:
            out.append(sequence)
    return out


class Ids:
    """Token ids as packed 32-bit integers.

    ``apart`` says that the tokenizer drops spaces and that nothing it does reaches across one. Then the runs between
    spaces are encoded one by one, and what they became is kept for a while, in two halves of ``MEMO_CHUNKS``. New ones are
    put in one text with a special token between them, if there is one that may stand anywhere.
    """

    def __init__(self, path: str, apart: bool):
        # A task has one core: threads of the library's own cost more CPU time than they save.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.apart = Tokenizer.from_file(path), apart
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items())
                 if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.between, self.mark = plain[0] if plain else (None, "")
        self.lower = '"Lowercase"' in self.tokenizer.to_str() and bool(self.mark)
        self.signs = self._signs() if apart else {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _signs(self) -> dict[str, bytes]:
        """Ids of the ASCII signs that are cut from a letter before them, whatever the letter."""
        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        signs = [c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()]
        letters = {c: ids(c) for c in map(chr, range(0x61, 0x7B))}
        return {s: array("I", alone).tobytes() for s in signs if (alone := ids(s)) and all(
            ids(c + s) == before + alone for c, before in letters.items())}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _together(self, chunks: list[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if self.mark[:1] not in c] if self.mark else []
        out = {}
        if plain:
            texts = [self.mark.join(plain[i:i + JOINED]) + self.mark for i in range(0, len(plain), JOINED)]
            ids = np.frombuffer(b"".join(self._encoded(texts)), "<u4")
            ends = (4 * np.flatnonzero(ids == self.between)).tolist()
            raw = ids.tobytes()
            out = {c: raw[i:j] for c, i, j in zip(plain, [0, *(e + 4 for e in ends)], ends, strict=False)}
        others = [c for c in chunks if c not in out]
        return out | dict(zip(others, self._encoded(others)))

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return self._encoded(texts)
        if len(self.young) > MEMO_CHUNKS:
            self.old, self.young = self.young, {}
        young = self.young
        cut = [(t.lower() if self.lower and t.isascii() and self.mark[:1] not in t else t).replace("\n", " ").split(" ")
               for t in texts]
        missing = set(filterfalse(young.__contains__, chain.from_iterable(cut)))
        # What was used before stays; a word with a sign behind it is made of both.
        young |= {c: self.old[c] for c in missing if c in self.old}
        fresh = missing.difference(self.old)
        signed = [c for c in fresh if c[-1:] in self.signs and c[-2:-1].isascii() and c[-2:-1].isalpha()]
        words = list(fresh.difference(signed) | {c[:-1] for c in signed if c[:-1] not in young})
        at = 0
        while at < len(words):
            n = max(1, sum(e <= BATCH_CHARS for e in accumulate(map(len, words[at:at + 4096]))))
            young |= self._together(words[at:at + n])
            at += n
        young |= {c: young[c[:-1]] + self.signs[c[-1]] for c in signed}
        out = [b"".join(map(young.__getitem__, chunks)) for chunks in cut]
        for c in words + signed:
            if len(c) > MEMO_CHARS:
                young.pop(c, None)
        return out


@lru_cache(maxsize=2)
def _ids(path: str, apart: bool) -> Ids:
    return Ids(path, apart)


def _packed(path: str, size: int, end: int | None, apart: bool, n_kept: int, names: list[str]):
    def pack(batches):
        encoder = _ids(path, apart)
        ending = b"" if end is None else np.uint32(end).tobytes()
        sequence = TaskContext.get().partitionId() << 33
        rows, ids, pieces, total = [], [], [], 0  # the block: kept columns, ids and pieces of each of its documents

        def written(sequences):
            nonlocal sequence
            doc, start, data, number, offset = [], [], [], [], []
            for s in sequences:
                at = 0
                for p in s:
                    doc.append(p.doc)
                    start.append(p.start)
                    data.append(ids[p.doc][4 * p.start:4 * (p.start + p.length)])
                    number.append(sequence)
                    offset.append(at)
                    at += p.length
                sequence += 1
            kept = pa.Table.from_batches(rows).combine_chunks()
            where = pa.array(doc, pa.int64())
            return pa.RecordBatch.from_arrays([
                *(c.combine_chunks().take(where) if c.num_chunks != 1 else c.chunk(0).take(where) for c in kept.columns),
                pa.array(start, pa.int64()), pa.array([len(d) // 4 for d in data], pa.int64()), pa.array(data, pa.binary()),
                pa.array([len(ids[d]) // 4 for d in doc], pa.int64()), pa.array(number, pa.int64()),
                pa.array(offset, pa.int64())], [*names, *RESULTS])

        def block(last: bool):
            nonlocal rows, ids, pieces, total
            full = [[p] for p in pieces if p.length == size]
            done, left = closed(best_fit([p for p in pieces if p.length < size], size), size)
            sequences = full + done + (in_powers(left) if last else [])
            for lo in range(0, len(sequences), 1024):
                yield written(sequences[lo:lo + 1024])
            if last:
                return
            held = sorted({p.doc for p in left})
            renamed = {d: i for i, d in enumerate(held)}
            table = pa.Table.from_batches(rows).take(pa.array(held, pa.int64()))
            rows = table.combine_chunks().to_batches() if held else []
            ids = [ids[d] for d in held]
            pieces = [Piece(renamed[p.doc], p.start, p.length) for p in left]
            total = sum(p.length for p in pieces)

        for b in batches:
            texts = [t or "" for t in b.column(n_kept).to_pylist()]
            at = 0
            while at < len(texts):
                n = max(1, sum(e <= BATCH_CHARS for e in accumulate(map(len, texts[at:at + 4096]))))
                for found in encoder.of(texts[at:at + n]):
                    found += ending
                    count, doc = len(found) // 4, len(ids)
                    ids.append(found)
                    pieces += [Piece(doc, s, min(size, count - s)) for s in range(0, count, size)]
                    total += count
                rows.append(pa.RecordBatch.from_arrays(b.slice(at, n).columns[:n_kept], names))
                at += n
                if total >= BLOCK_TOKENS:
                    yield from block(last=False)
        if pieces:
            yield from block(last=True)

    return pack


def packed(docs: DataFrame, path: str, size: int = 4096, end: int | None = None, text_col: str = "text",
           keep: list[str] | None = None, apart: bool = False) -> DataFrame:
    """One row for each piece: the ``keep`` columns (all by default) of its document, start (the document's ids before
    it), length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id and offset in the sequence.

    ``path`` names a tokenizer file that every worker can read; ``end`` is put after each document. A null text counts as
    empty; a document without any id has no piece. Every row is packed, equal rows and null ids too. The sum of a
    sequence is ``size``, or at most ``size // 64`` less, or a power of two: only the middle ones need padding. Sequence
    numbers are unique and the same on every run over the same files; they have gaps. A kept column named like a result
    is refused.
    """
    keep = docs.columns if keep is None else keep
    if set(RESULTS) & set(keep):
        raise ValueError("a kept column has the name of a result")
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("t"))
    names = chosen.columns[:-1]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    found = chosen.mapInArrow(_packed(path, size, end, apart, len(keep), names), ", ".join(
        [*fields, "start long", "length long", "ids binary", "doc_tokens long", "sequence_id long", "offset long"]))
    return found.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], *RESULTS)


def sequences(pieces: DataFrame, size: int = 4096, pad: int = 0) -> DataFrame:
    """sequence_id, ids (packed like those of the pieces, padded unless their number is a power of two), lengths of the
    pieces in order. A group is one sequence, so it never holds more than ``size`` ids."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "length"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    padding = F.unhex(F.repeat(F.lit(np.uint32(pad).tobytes().hex()), (F.lit(size) - n).cast("int")))
    return rows.select("sequence_id", F.when(F.bit_count(n) == 1, joined).otherwise(F.concat(joined, padding)).alias("ids"),
                       F.col("p.length").alias("lengths"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"),
                    size=4096, end=2, keep=["doc_id"], apart=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")
