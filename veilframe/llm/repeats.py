"""Stretches that also start in an earlier text: the distributed frame of the two substring operators.

A text is a row of symbols (words or bytes). Its windows of ``width`` symbols fall into runs that share a winnowed
anchor; equal windows have equal anchors. Three steps, each a shuffle of packed blobs:

1. Every run goes to the bucket of its anchor as (anchor, hash of the run, id, place). A run that an earlier text of
   the same batch holds is settled before the shuffle, so a run that many texts share costs one row a batch. Of equal
   runs all but the first text's are repeats. Anchors with several different runs stay open.
2. The first text of each open run sends the run's symbols to the anchor's bucket, where ``solve`` finds the windows
   that also start in an earlier text. A stretch that differs at one end is found here.
3. The texts take up their repeated windows; symbols covered by one are removed.

Buckets and slices number about one per 8 MB of text, so what a task holds at once does not grow with the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import rolling as R
from veilframe.plans.staging import stage

RUN = np.dtype([("a", "<u8"), ("c", "<u8"), ("d", "<i8"), ("s", "<i4"), ("n", "<i4")])
SPAN = np.dtype([("d", "<i8"), ("a", "<u8"), ("s", "<i4"), ("n", "<i4")])  # a: anchor of an open run, else 0
# Where ids are null or repeated, a row has a key of its own, r, by which it is found again; d is for comparison only.
KEYED_RUN = np.dtype([*RUN.descr, ("r", "<i8")])
KEYED_SPAN = np.dtype([*SPAN.descr, ("r", "<i8")])
SHARE_BYTES = 8 << 20
FLUSH_BYTES = 8 << 20
FLUSH_RUNS = 1 << 19
LAST = (1 << 63) - 1
BLOBS = "key long, blob binary"
RESULT = "n_symbols long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"

Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Symbols:
    """What a text is cut into. ``cut`` gives starts and ends of the symbols of some bytes, and their codes."""

    name: str
    cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    packed: np.dtype  # codes as sent to ``solve``
    joined: bool  # kept symbols are joined by one space
    gram: int


def _words(data, offsets):
    starts, ends = R.words(data, offsets)
    return starts, ends, R.word_codes(data, starts, ends)


def _bytes(data, offsets):
    at = np.arange(len(data))
    return at, at + 1, R.BYTE_CODES[data]


WORDS = Symbols("words", _words, np.dtype("<u8"), True, 12)
BYTES = Symbols("bytes", _bytes, np.dtype("u1"), False, 18)


def _blobs(kind: np.dtype, rows: np.ndarray, keys: np.ndarray):
    """One (key, bytes) pair per key."""
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    ends = np.append(edges[1:], len(keys))
    return keys[edges], [rows[i:j].tobytes() for i, j in zip(edges, ends)]


def _batch(keys, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(keys, np.int64)), pa.array(blobs, pa.binary())], ["key", "blob"])


def _slice_of(ids: np.ndarray, slices: int) -> np.ndarray:
    return (ids ^ ((ids.view(np.uint64) >> np.uint64(17)).astype(np.int64))) % slices


def _bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (R.mix(anchors) % np.uint64(buckets)).astype(np.int64)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """For sorted columns: where a new combination begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _settle(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of anchor, run and id; which of them an earlier text holds; where a new (anchor, run) begins."""
    runs = runs[np.lexsort((runs["d"], runs["c"], runs["a"]))]
    new = _first_of(runs["a"], runs["c"])
    least = runs["d"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(runs) else runs["d"]
    return runs, runs["d"] > least, new


def _row_key(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows["r" if "r" in rows.dtype.names else "d"])


def _spans(runs: np.ndarray, open_: bool) -> np.ndarray:
    out = np.zeros(len(runs), KEYED_SPAN if "r" in runs.dtype.names else SPAN)
    for f in {"d", "s", "n", "r"}.intersection(runs.dtype.names):
        out[f] = runs[f]
    if open_:
        out["a"] = runs["a"]
    return out


def _runs_of(ids: np.ndarray, keys: np.ndarray | None, data: np.ndarray, offsets: np.ndarray, sym: Symbols, width: int):
    """Yield RUN arrays, with the codes they refer to, of the given texts."""
    for lo, hi in R.slices(offsets):
        part = data[offsets[lo]:offsets[hi]]
        starts, _, codes = sym.cut(part, offsets[lo:hi + 1] - offsets[lo])
        owner = np.searchsorted(offsets[lo:hi + 1] - offsets[lo], starts, "right") - 1
        first = np.searchsorted(owner, np.arange(hi - lo))
        for at, end in R.pieces(len(codes), width):
            a, c, s, n = R.winnowed_runs(codes[at:end], owner[at:end], sym.gram, width)
            out = np.zeros(len(a), RUN if keys is None else KEYED_RUN)
            row = owner[at:end][s]
            if keys is not None:
                out["r"] = keys[lo + row]
            out["a"], out["c"], out["d"] = a, c, ids[lo + row]
            out["s"], out["n"] = s + at - first[row], n
            yield out


def _emit(sym: Symbols, width: int, buckets: int, slices: int, keyed: bool):
    def flush(found):
        joined = np.concatenate(found)
        found.clear()
        runs, repeated, _ = _settle(joined)
        del joined
        fresh, spans = runs[~repeated], _spans(runs[repeated], False)
        for rows, keys in ((fresh, _bucket_of(fresh["a"], buckets)),
                           (spans, -1 - _slice_of(_row_key(spans), slices))):
            if len(rows):
                yield _batch(*_blobs(rows.dtype, rows, keys))
        R.release()

    def emit(batches):
        found, size = [], 0
        for b in batches:
            data, offsets = R.texts(b.column(1))
            keys = b.column(2).to_numpy() if keyed else None
            # However many rows a batch has, and however long a text is, no more runs than these are held.
            for runs in _runs_of(b.column(0).to_numpy(), keys, data, offsets, sym, width):
                found.append(runs)
                size += len(runs)
                if size >= FLUSH_RUNS:
                    yield from flush(found)
                    size = 0
        if found:
            yield from flush(found)

    return emit


def _grouped(work):
    """A group function that leaves no freed memory with its worker."""
    def run(key, table):
        out = work(key, table)
        R.release()
        return out

    return run


def _cogrouped(work):
    def run(key, left, right):
        out = work(key, left, right)
        R.release()
        return out

    return run


def _first_texts(slices: int, keyed: bool):
    """Repeats among equal runs of a bucket, and the open runs; blobs of settled spans pass through."""

    def reduce(key, table):
        name = key[0].as_py()
        blobs = table.column("blob")
        if name < 0:
            return pa.table({"key": pa.array([-1 - name] * len(blobs), pa.int64()), "blob": blobs})
        runs, repeated, new = _settle(
            np.frombuffer(b"".join(x.as_py() for x in blobs), KEYED_RUN if keyed else RUN))
        anchor_new = _first_of(runs["a"])
        group = np.cumsum(anchor_new) - 1
        edges = np.flatnonzero(anchor_new)
        several = np.add.reduceat(new.astype(np.int64), edges) > 1
        firsts = np.where(repeated, runs["d"][edges][group], runs["d"])
        differ = np.minimum.reduceat(firsts, edges) != np.maximum.reduceat(firsts, edges)
        is_open = (several & differ)[group] & ~repeated
        spans = np.concatenate([_spans(runs[repeated], False), _spans(runs[is_open], True)])
        return pa.Table.from_batches([_batch(*_blobs(spans.dtype, spans, _slice_of(_row_key(spans), slices)))])

    return reduce


def _taken(table: pa.Table, keyed: bool) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column("blob")), KEYED_SPAN if keyed else SPAN)


def _located(keys, spans):
    """Row of each span's text, and the spans whose text is here."""
    if not len(keys):
        return np.zeros(0, np.int64), spans[:0]
    order = np.argsort(keys, kind="stable")
    own = _row_key(spans)
    at = np.minimum(np.searchsorted(keys[order], own), len(keys) - 1)
    here = keys[order][at] == own
    return order[at[here]], spans[here]


def _send_open(sym: Symbols, width: int, buckets: int, keyed: bool):
    def send(key, docs, blobs):
        spans = _taken(blobs, keyed)
        spans = spans[spans["a"] != 0]
        ids = docs.column("__r").to_numpy()
        keep = np.flatnonzero(np.isin(ids, _row_key(spans)))
        docs = docs.take(pa.array(keep))
        ids = ids[keep]
        data, offsets = R.texts(docs.column("__t"))
        keys, out = [], []
        for lo, hi in R.slices(offsets):
            part = data[offsets[lo]:offsets[hi]]
            starts, _, codes = sym.cut(part, offsets[lo:hi + 1] - offsets[lo])
            owner = np.searchsorted(offsets[lo:hi + 1] - offsets[lo], starts, "right") - 1
            bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
            row, mine = _located(ids[lo:hi], spans)
            at = bounds[row] + mine["s"]
            whole = at + mine["n"] + width - 1 <= bounds[row + 1]
            mine, at = mine[whole], at[whole]
            if not len(mine):
                continue
            bucket = _bucket_of(mine["a"], buckets)
            order = np.argsort(bucket, kind="stable")
            mine, at, bucket = mine[order], at[order], bucket[order]
            edges = np.append(np.flatnonzero(_first_of(bucket)), len(mine))
            symbols = codes if sym.packed.itemsize == 8 else part
            for i, j in zip(edges[:-1], edges[1:]):
                size = mine["n"][i:j] + width - 1
                stretch = np.repeat(at[i:j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                keys.append(bucket[i])
                out.append(np.int64(j - i).tobytes() + mine[i:j].tobytes()
                           + symbols[stretch].astype(sym.packed).tobytes())
        return pa.Table.from_batches([_batch(keys, out)])

    return send


def _solve_open(sym: Symbols, width: int, slices: int, solve: Solve, keyed: bool):
    kind = KEYED_SPAN if keyed else SPAN

    def reduce(key, table):
        spans, symbols = [], []
        for x in table.column("blob"):
            raw = x.as_py()
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            spans.append(np.frombuffer(raw, kind, n, 8))
            symbols.append(np.frombuffer(raw, sym.packed, -1, 8 + n * kind.itemsize))
        spans, symbols = np.concatenate(spans), np.concatenate(symbols)
        size = spans["n"].astype(np.int64) + width - 1
        starts = np.cumsum(size) - size
        repeated = solve(spans, symbols, starts, width)  # for each window of each stretch, in order
        stretch = np.repeat(np.arange(len(spans)), spans["n"])
        place = np.arange(len(stretch)) - np.repeat(np.cumsum(spans["n"]) - spans["n"], spans["n"])
        stretch, place = stretch[repeated], place[repeated]
        begins = np.ones(len(stretch), bool)
        begins[1:] = (stretch[1:] != stretch[:-1]) | (place[1:] != place[:-1] + 1)
        edges = np.flatnonzero(begins)
        out = np.zeros(len(edges), kind)
        for f in {"d", "r"}.intersection(kind.names):
            out[f] = spans[f][stretch[edges]]
        out["s"] = spans["s"][stretch[edges]] + place[edges]
        out["n"] = np.diff(np.append(edges, len(stretch)))
        return pa.Table.from_batches([_batch(*_blobs(kind, out, _slice_of(_row_key(out), slices)))])

    return reduce


def _removed(sym: Symbols, width: int, carry: list[str], schema: pa.Schema, keyed: bool):
    def take(key, docs, blobs):
        spans = _taken(blobs, keyed)
        spans = spans[spans["a"] == 0]
        ids = docs.column("__r").to_numpy()
        data, offsets = R.texts(docs.column("__t"))
        parts = []
        for lo, hi in R.slices(offsets):
            part = data[offsets[lo]:offsets[hi]]
            rel = offsets[lo:hi + 1] - offsets[lo]
            starts, ends, _ = sym.cut(part, offsets[lo:hi + 1] - offsets[lo])
            owner = np.searchsorted(rel, starts, "right") - 1
            bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
            row, mine = _located(ids[lo:hi], spans)
            at = bounds[row] + mine["s"]
            end = at + mine["n"] + width - 1
            ok = end <= bounds[row + 1]
            step = np.zeros(len(starts) + 1, np.int64)
            np.add.at(step, at[ok], 1)
            np.add.at(step, end[ok], -1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.diff(bounds)
            below = np.append(0, np.cumsum(gone))
            removed = below[bounds[1:]] - below[bounds[:-1]]
            begin = gone.copy()
            begin[1:] &= ~(gone[:-1] & (owner[1:] == owner[:-1]))
            stop = gone.copy()
            stop[:-1] &= ~(gone[1:] & (owner[1:] == owner[:-1]))
            first, last = np.flatnonzero(begin), np.flatnonzero(stop)
            per = np.append(0, np.cumsum(np.bincount(owner[first], minlength=hi - lo)))
            left = bounds[owner[first]] if len(first) else np.zeros(0, np.int64)
            edge = np.zeros(len(part) + 1, np.int8)
            here = np.flatnonzero(~gone)
            edge[starts[here]] += 1
            edge[ends[here]] -= 1
            keep = np.cumsum(edge[:-1]) > 0
            if sym.joined and len(here) > 1:
                more = ends[here[:-1]][owner[here[1:]] == owner[here[:-1]]]
                part = part.copy()
                part[more] = 0x20
                keep[more] = True
            cuts = np.append(0, np.cumsum(keep))[rel]
            kept = pa.Array.from_buffers(pa.large_binary(), hi - lo, [
                None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(part[keep].tobytes())])
            parts.append([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(
                pa.array(per, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(first - left, pa.int64()), pa.array(last + 1 - left, pa.int64())],
                    ["start", "end"])), kept.cast(pa.binary())])
        names = ["n_symbols", "n_removed", "spans", "kept"]
        columns = [docs.column(f"__c{i}") for i in range(len(carry))]
        results = [pa.chunked_array([p[i] for p in parts], schema.field(n).type) for i, n in enumerate(names)]
        return pa.Table.from_arrays([docs.column("__id"), *columns, *results], schema=schema)

    return take


def _next_prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def without_repeats(docs: DataFrame, sym: Symbols, solve: Solve, width: int = 50, id_col: str = "doc_id",
                    text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Remove each symbol covered by a window of ``width`` symbols that also starts in a text with a smaller id.

    One row per input row: the id, the ``carry`` columns, n_symbols, n_removed, spans (removed runs, in symbols, end
    exclusive) and kept (what stays; bytes of UTF-8). Windows are judged on the input. A null text is empty. Rows with a
    null id come after all others and are not compared with each other; rows with equal ids are not either. Where there
    are such rows, the texts are written down once with a key for each row. No other column is read, so their names do
    not matter; a ``carry`` column named like a result is refused.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    carry = list(carry or [])
    if set(carry) & {id_col, "n_symbols", "n_removed", "spans", "kept"}:
        raise ValueError("a carried column has the name of a result")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    total, most = docs.groupBy(key.alias("d")).agg(
        F.sum(F.octet_length(F.col(text_col))).alias("size"), F.count(F.lit(1)).alias("n")).agg(
        F.sum("size"), F.max("n")).first()
    total, keyed = total or 0, (most or 0) > 1
    slices = _next_prime(max(31, total // SHARE_BYTES))
    buckets = max(32, int(total // SHARE_BYTES))
    rows = docs.select(
        key.alias("__d"), F.col(text_col).cast("string").alias("__t"), F.col(id_col).alias("__id"),
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    own = F.col("__d")
    if keyed:
        rows, own = stage(rows.withColumn("__r", F.monotonically_increasing_id())), F.col("__r")
    by_key = rows.withColumn("__r", own).withColumn(
        "key", F.pmod(own.bitwiseXOR(F.shiftrightunsigned(own, 17)), F.lit(slices)).cast("long"))
    texts = rows.select("__d", "__t", *["__r"] * keyed)
    runs = texts.mapInArrow(_emit(sym, width, buckets, slices, keyed), BLOBS)
    settled = stage(runs.groupBy("key").applyInArrow(_grouped(_first_texts(slices, keyed)), BLOBS))
    by_slice = by_key.groupBy("key")  # the same exchange serves both steps that read the texts
    stretches = by_slice.cogroup(settled.groupBy("key")).applyInArrow(
        _cogrouped(_send_open(sym, width, buckets, keyed)), BLOBS)
    solved = stretches.groupBy("key").applyInArrow(_grouped(_solve_open(sym, width, slices, solve, keyed)), BLOBS)

    result = StructType.fromDDL(RESULT)
    schema = StructType([docs.schema[id_col], *[docs.schema[c] for c in carry], *result.fields])
    return by_slice.cogroup(settled.unionByName(solved).groupBy("key")).applyInArrow(
        _cogrouped(_removed(sym, width, carry, to_arrow_schema(schema), keyed)), schema)
