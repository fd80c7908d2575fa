"""N-gram Jaccard join with a token-group matrix.

A text is the set of its shingles (``shingle`` words, lower case). Equal sets are one node. Candidates share a token of
their prefixes: tokens are ordered from rare to frequent by a table of counts, then by hash, those in ``HOT_SHARE`` of all
texts last, and a set's first quarter must meet the first seventh of a smaller partner's. Then:

1. Short postings give their pairs; in a long one every node is paired with the least one. Pairs pass the bitmap bound
   below and are verified on the whole sets. Nodes linked so far form groups of similar documents.
2. Long postings that hold several groups go through the matrix: each group's token union is a bitmap (one bit per
   hashed token), and a query's overlap with the group is at most its size less its bits outside the union. Only groups
   that can reach the threshold are opened; their members are bounded one by one in the same way, then verified.

No pair of different groups that could link is left out: every bound is an upper bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import rolling as R
from veilframe.llm.components import components
from veilframe.llm.repeats import (
    FLUSH_BYTES,
    LAST,
    SHARE_BYTES,
    _batch,
    _blobs,
    _bucket_of,
    _first_of,
    _grouped,
    _next_prime,
    _slice_of,
)
from veilframe.plans.staging import BROADCAST_BYTES, stage

# A hot token is in this share of all texts at least, so there are at most (mean shingles per text) / HOT_SHARE of them,
# however many texts there are and wherever they lie. They only set the order, never the result.
HOT_SHARE = 1 / 100
HOT_LEAST = 16
# Texts are counted by token modulo BINS, which sets the order only. Tokens that unrelated texts share by chance grow with
# the texts, the chance meetings in a bin with their root only; so the first tokens of a set are rare ones at any size.
BINS = 1 << 22
BLOCKS = 512
MOST = (1 << 16) - 1
BITS = 2048
SHORT = 8
GROUP = 256
ENTRY = np.dtype([("t", "<u8"), ("v", "<i8"), ("n", "<i4"), ("r", "<i4")])
NODE = np.dtype([("d", "<i8"), ("v", "<i8"), ("n", "<i8"), ("bits", "u1", BITS // 8)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int):
    """Yield (lo, hi, row, token): the distinct shingle hashes of the texts, by row and token."""
    for lo, hi in R.slices(offsets):
        part = R.lower(data[offsets[lo]:offsets[hi]])
        rel = offsets[lo:hi + 1] - offsets[lo]
        starts, ends = R.words(part, rel)
        codes = R.word_codes(part, starts, ends)
        owner = np.searchsorted(rel, starts, "right") - 1
        first = np.searchsorted(owner, np.arange(hi - lo + 1))
        size = np.diff(first)
        count = np.where(size >= shingle, size - shingle + 1, np.minimum(size, 1))
        row = np.repeat(np.arange(hi - lo), count)
        at = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        token = R.stretch_hash(R.prefix(codes, R.RUN_BASE), R.RUN_BASE, at, at + np.minimum(size[row], shingle))
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        if len(row):
            keep = _first_of(row, token)
            row, token = row[keep], token[keep]
        yield lo, hi, row, token


def _nodes(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the rows' sets, and a hash of each set."""
    n = np.bincount(row, minlength=rows)
    at = np.cumsum(n) - n
    sums = np.append(np.uint64(0), np.cumsum(R.mix(token), dtype=np.uint64))
    return n, R.mix(sums[at + n] - sums[at] + n.astype(np.uint64)).view(np.int64)


def _hot_counts(shingle: int):
    """Tokens in the hot share of a batch, with their number of texts there."""

    def count(batches):
        def flush(tokens, texts):
            found, n = np.unique(np.concatenate(tokens), return_counts=True)
            keep = n >= max(HOT_LEAST, HOT_SHARE * texts)
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep])], ["t", "n"])

        tokens, texts, size = [], 0, 0
        for b in batches:
            data, offsets = R.texts(b.column(0))
            for _, _, _, token in shingle_sets(data, offsets, shingle):
                tokens.append(token)
            texts, size = texts + len(offsets) - 1, size + len(data)
            if size >= FLUSH_BYTES:
                yield flush(tokens, texts)
                tokens, texts, size = [], 0, 0
        if tokens:
            yield flush(tokens, texts)
        tokens = None
        R.release()

    return count


def hot_tokens_of(texts: DataFrame, shingle: int, n_texts: int) -> np.ndarray:
    """Tokens whose batch counts come to the hot share of all texts.

    A batch leaves out what is not hot there: less than the hot share of its texts, or ``HOT_LEAST``. So a token of
    little more than the hot share may be missed, one of less never comes in.
    """
    found = texts.select("__t").mapInArrow(_hot_counts(shingle), "t long, n long").groupBy("t").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= max(HOT_LEAST, HOT_SHARE * n_texts))
    return np.array([r.t for r in found.select("t").collect()], np.int64)


def _bin_counts(shingle: int):
    """Texts of the task by bin of their tokens, a row for each block of bins; low bytes, then high bytes."""

    def count(batches):
        bins = np.zeros(BINS, np.uint32)
        for b in batches:
            data, offsets = R.texts(b.column(0))
            for _, _, _, token in shingle_sets(data, offsets, shingle):
                np.add.at(bins, token % np.uint64(BINS), np.uint32(1))
        if bins.any():
            rows = np.minimum(bins, MOST).astype("<u2").reshape(BLOCKS, -1)
            yield _batch(np.arange(BLOCKS), [r.view("u1").reshape(-1, 2).T.tobytes() for r in rows])
        del bins
        R.release()

    return count


def _bin_sums(key, table):
    total = np.zeros(BINS // BLOCKS, np.uint32)
    for x in table.column("blob"):
        total += np.frombuffer(x.as_buffer(), np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
    return pa.table({"key": pa.array([key[0].as_py()], pa.int64()),
                     "blob": pa.array([np.minimum(total, MOST).astype("<u2").tobytes()], pa.binary())})


def token_counts_of(texts: DataFrame, shingle: int) -> np.ndarray:
    """Texts by bin of their tokens, at most ``MOST`` each. The driver gets ``BINS`` numbers, however many texts there
    are."""
    sums = texts.select("__t").mapInArrow(_bin_counts(shingle), "key long, blob binary").groupBy("key").applyInArrow(
        _bin_sums, "key long, blob binary")
    bins = np.zeros((BLOCKS, BINS // BLOCKS), np.uint16)
    for r in sums.collect():
        bins[r.key] = np.frombuffer(r.blob, "<u2")
    return bins.ravel()


def _ceil_share(n: np.ndarray, up: int, down: int) -> np.ndarray:
    return -(-n * up // down)


def _emit(shingle: int, percent: int, buckets: int, slices: int, hot_tokens, counts):
    def emit(batches):
        hot = np.sort(np.frombuffer(hot_tokens.value, np.uint64))
        often = np.frombuffer(counts.value, np.uint16)
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offsets = R.texts(b.column(1))
            nodes, entries = [], []
            for lo, hi, row, token in shingle_sets(data, offsets, shingle):
                out = np.zeros(hi - lo, NODE)
                out["d"] = ids[lo:hi]
                n, out["v"] = _nodes(row, token, hi - lo)
                out["n"] = n
                bits = np.zeros((hi - lo, BITS), bool)
                bits[row, (token % np.uint64(BITS)).astype(np.int64)] = True
                out["bits"] = np.packbits(bits, axis=1, bitorder="little")
                nodes.append(out)
                # One text of each set in the slice stands for all of them.
                _, which = np.unique(out["v"], return_index=True)
                chosen = np.zeros(hi - lo, bool)
                chosen[which] = True
                keep = chosen[row]
                row, token = row[keep], token[keep]
                late = often[token % np.uint64(BINS)].astype(np.int32)
                if len(hot):
                    late[hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token] = MOST + 1
                order = np.lexsort((token, late, row))
                row, token = row[order], token[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                size = n[row]
                query = place <= size - _ceil_share(size, percent, 100)
                index = place <= size - _ceil_share(size, 2 * percent, 100 + percent)
                one = np.zeros(query.sum(), ENTRY)
                one["t"], one["v"], one["n"] = token[query], out["v"][row[query]], size[query]
                one["r"] = index[query]
                entries.append(one)
            for kind, rows, of in ((NODE, nodes, lambda x: -1 - _slice_of(np.ascontiguousarray(x["d"]), slices)),
                                   (ENTRY, entries, lambda x: _bucket_of(x["t"], buckets))):
                if rows:
                    rows = np.concatenate(rows)
                    if len(rows):
                        yield _batch(*_blobs(kind, rows, of(rows)))
            nodes = entries = rows = None
            R.release()

    return emit


def _may_link(n1, r1, n2, r2, percent):
    """Sizes allow a link, and the smaller set (either, if equal) holds the token in its index prefix."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    role = np.where(n1 < n2, r1, np.where(n2 < n1, r2, r1 | r2)) > 0
    return role & (100 * small >= percent * large)


def _postings(percent: int):
    """Pairs of short postings, stars of long ones, and the long postings themselves."""

    def reduce(key, table):
        name = key[0].as_py()
        if name < 0:
            raw = table.column("blob")
            return pa.table({"kind": pa.array([0] * len(raw), pa.int32()), "blob": raw})
        e = np.frombuffer(b"".join(x.as_py() for x in table.column("blob")), ENTRY)
        e = e[np.lexsort((e["v"], e["t"]))]
        e = e[_first_of(e["t"], e["v"])]
        edges = np.flatnonzero(_first_of(e["t"]))
        size = np.diff(np.append(edges, len(e)))
        keep = np.repeat(size > 1, size)
        e = e[keep]
        size = size[size > 1]
        kinds, blobs = [], []
        if len(e):
            start = np.repeat(np.cumsum(size) - size, size)
            own = np.repeat(size, size)
            place = np.arange(len(e)) - start
            left, right = [], []
            for step in range(1, SHORT):
                other = np.flatnonzero((place + step < own) & ((own <= SHORT) | (place == 0)))
                left.append(other)
                right.append(other + step)
            far = np.flatnonzero((own > SHORT) & (place >= SHORT))
            left.append(start[far])
            right.append(far)
            left, right = np.concatenate(left), np.concatenate(right)
            ok = _may_link(e["n"][left], e["r"][left], e["n"][right], e["r"][right], percent)
            pairs = np.unique(np.stack([e["v"][left[ok]], e["v"][right[ok]]], 1), axis=0)
            if len(pairs):
                kinds.append(1)
                blobs.append(pairs.astype("<i8").tobytes())
            rest = e[own > SHORT]
            # Postings of the same nodes and roles say the same.
            if len(rest):
                heads = np.flatnonzero(_first_of(rest["t"]))
                mark = np.add.reduceat(R.mix(R.mix(rest["v"].view(np.uint64)) + rest["r"].astype(np.uint64)), heads)
                _, which = np.unique(mark, return_index=True)
                chosen = np.zeros(len(heads), bool)
                chosen[which] = True
                rest = rest[np.repeat(chosen, np.diff(np.append(heads, len(rest))))]
                kinds.append(2)
                blobs.append(rest.tobytes())
        return pa.table({"kind": pa.array(kinds, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return reduce


def _unpack(kind: np.dtype, names: dict[str, str], schema: str):
    """Rows of packed blobs. ``names``: column of the result by field of the blob."""

    def rows(batches):
        for b in batches:
            for x in b.column(0):
                got = np.frombuffer(x.as_py(), kind)
                columns = []
                for field in names:
                    values = np.ascontiguousarray(got[field])
                    if values.ndim > 1:
                        columns.append(pa.array([v.tobytes() for v in values], pa.binary()))
                    else:
                        columns.append(pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))
                yield pa.RecordBatch.from_arrays(columns, list(names.values()))
        b = x = got = columns = values = None
        R.release()

    return rows, schema


def _rows(blobs: DataFrame, of: int, kind: np.dtype, names: dict[str, str], schema: str) -> DataFrame:
    return blobs.filter(F.col("kind") == of).select("blob").mapInArrow(*_unpack(kind, names, schema))


def _outside(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits set on the left and not on the right (64-bit words)."""
    return np.bitwise_count(left & ~right).sum(-1, dtype=np.int64)


def _words_of(column, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint64).reshape(rows, BITS // 64)


def _both_at_most(n1, bits1, n2, bits2):
    """Upper bound of the intersections of two sets, from either side."""
    return np.minimum(n1 - _outside(bits1, bits2), n2 - _outside(bits2, bits1))


def _least_overlap(n1, n2, percent):
    """Smallest intersection i with 100 i >= percent (n1 + n2 - i)."""
    return _ceil_share(n1 + n2, percent, 100 + percent)


def _bound(percent: int):
    def keep(batches):
        for b in batches:
            n1, n2 = (b.column(c).to_numpy() for c in ("n1", "n2"))
            bits1, bits2 = (_words_of(b.column(c), b.num_rows) for c in ("bits1", "bits2"))
            ok = _both_at_most(n1, bits1, n2, bits2) >= _least_overlap(n1, n2, percent)
            yield b.select(["u", "v"]).filter(pa.array(ok))
        b = bits1 = bits2 = None
        R.release()

    return keep


def _bound_wide(percent: int):
    """The same on bitmaps that grow with the sets; the longer of two is folded to the other's length."""

    def folded(bits, length):
        bits = np.frombuffer(bits.as_buffer(), np.uint64)
        return np.bitwise_or.reduce(bits.reshape(-1, length), axis=0)

    def keep(batches):
        for b in batches:
            ok = []
            for x, y, n1, n2 in zip(b.column("wide1"), b.column("wide2"), b.column("n1").to_pylist(),
                                    b.column("n2").to_pylist()):
                length = min(len(x.as_buffer()), len(y.as_buffer())) // 8
                most = _both_at_most(n1, folded(x, length), n2, folded(y, length))
                ok.append(most >= _least_overlap(n1, n2, percent))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
        b = x = y = None
        R.release()

    return keep


def _matrix(percent: int, best: bool):
    """Pairs of one long posting that the group bounds and the pair bounds allow; with ``best`` the likeliest one of
    each query."""

    def reduce(key, table):
        table = table.sort_by([("component", "ascending"), ("v", "ascending")])
        comp, v, n, r = (table.column(c).to_numpy() for c in ("component", "v", "n", "r"))
        bits = _words_of(table.column("bits"), len(comp))
        top, partner = np.zeros(len(comp)), np.full(len(comp), -1, np.int64)
        out = []
        for i in range(0, len(comp), GROUP):
            j = min(len(comp), i + GROUP)
            # Rows of the matrix: the groups of this chunk, each with its members' union.
            heads = np.flatnonzero(_first_of(comp[i:j]))
            group = np.cumsum(_first_of(comp[i:j])) - 1
            unions = np.bitwise_or.reduceat(bits[i:j], heads, axis=0)
            least, most = np.minimum.reduceat(n[i:j], heads), np.maximum.reduceat(n[i:j], heads)
            for at in range(i, len(comp), GROUP):
                q = np.arange(at, min(len(comp), at + GROUP))
                size = n[q][:, None]
                opened = (100 * size >= percent * least) & (percent * size <= 100 * most) & (
                    comp[q][:, None] > comp[i + heads])
                a, g = np.nonzero(opened)
                reach = n[q[a]] - _outside(bits[q[a]], unions[g])
                opened[a, g] = reach >= _ceil_share(n[q[a]], percent, 100)
                a, m = np.nonzero(opened[:, group])
                a, m = q[a], i + m
                ok = _may_link(n[a], r[a], n[m], r[m], percent)
                a, m = a[ok], m[ok]
                both = _both_at_most(n[a], bits[a], n[m], bits[m])
                need = _least_overlap(n[a], n[m], percent)
                a, m, likely = a[both >= need], m[both >= need], (both / need)[both >= need]
                if best:
                    order = np.argsort(likely)
                    a, m, likely = a[order], m[order], likely[order]
                    better = likely > top[a]
                    # Of equal indices the last assignment, the likeliest, stays.
                    top[a[better]], partner[a[better]] = likely[better], m[better]
                else:
                    out.append(np.stack([v[m], v[a]], 1))
        if best:
            q = np.flatnonzero(partner >= 0)
            out = [np.stack([v[partner[q]], v[q]], 1)]
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return reduce


def _wide(token: np.ndarray) -> bytes:
    bits = np.zeros(max(BITS, 1 << int(4 * len(token)).bit_length()), np.uint8)
    bits[(token % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sets_of(shingle: int):
    """Packed sets of the texts whose set is the wanted node, and their bitmaps."""

    def take(batches):
        for b in batches:
            wanted = b.column(0).to_numpy()
            data, offsets = R.texts(b.column(1))
            nodes, sizes, wide, blobs = [], [], [], []
            for lo, hi, row, token in shingle_sets(data, offsets, shingle):
                n, found = _nodes(row, token, hi - lo)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                for k in np.flatnonzero(found == wanted[lo:hi]):
                    own = token[bounds[k]:bounds[k + 1]]
                    nodes.append(found[k])
                    sizes.append(n[k])
                    wide.append(_wide(own))
                    blobs.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()),
                 pa.array(blobs, pa.binary())], ["node", "n", "wide", "tokens"])
            wide = blobs = None
            R.release()

    return take


def _verify(percent: int):
    def keep(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("tokens1"), b.column("tokens2")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
        b = x = y = None
        R.release()

    return keep


def ngram_join(docs: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Groups of texts whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more, directly or by way of
    others. Exact.

    One row per input row: the id, n_shingles, component (the least id of the group). A text with fewer words than
    ``shingle`` is one shingle; texts that are null or without words link with nothing, not even with each other. Rows
    with a null id take part under no id: their component is null. Rows with equal ids are one document each; the
    component is the id's least. Other columns are not read.
    """
    spark = docs.sparkSession
    total, n_texts = docs.agg(F.sum(F.octet_length(F.col(text_col))), F.count(F.lit(1))).first()
    total = total or 0
    slices = _next_prime(max(31, total // SHARE_BYTES))
    buckets = max(32, int(total // SHARE_BYTES))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    texts = docs.select(key.alias("__d"), F.col(text_col).cast("string").alias("__t"))
    hot_tokens = spark.sparkContext.broadcast(hot_tokens_of(texts, shingle, n_texts).tobytes())
    counts = spark.sparkContext.broadcast(token_counts_of(texts, shingle).tobytes())

    found = stage(texts.mapInArrow(_emit(shingle, percent, buckets, slices, hot_tokens, counts),
                                   "key long, blob binary")
                  .groupBy("key").applyInArrow(_grouped(_postings(percent)), "kind int, blob binary"))
    members = _rows(found, 0, NODE, {"d": "d", "v": "node", "n": "n", "bits": "bits"},
                    "d long, node long, n long, bits binary")
    nodes = stage(members.filter("n > 0").groupBy("node").agg(
        F.min("d").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")))

    def bounded(pairs):
        one = nodes.select(F.col("node").alias("u"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
        two = nodes.select(F.col("node").alias("v"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
        return pairs.distinct().join(one, "u").join(two, "v").mapInArrow(_bound(percent), "u long, v long")

    sets = None

    def verified(pairs):
        nonlocal sets
        pairs = stage(pairs)
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select("node"), "node", "left_anti")
        wanted = stage(wanted.join(nodes.select("node", "rep"), "node"))
        # The wanted nodes are broadcast only where their measured number is small; else the texts are shuffled.
        small = wanted.count() * 2 * 8 <= BROADCAST_BYTES
        fresh = stage(texts.join(F.broadcast(wanted) if small else wanted, F.col("__d") == F.col("rep")).select(
            "node", "__t").mapInArrow(_sets_of(shingle), "node long, n long, wide binary, tokens binary"))
        sets = fresh if sets is None else sets.unionByName(fresh)

        def side(node, *columns):
            return sets.select(F.col("node").alias(node), *[F.col(c).alias(c + ("1" if node == "u" else "2"))
                                                            for c in columns])

        likely = stage(pairs.join(side("u", "n", "wide"), "u").join(side("v", "n", "wide"), "v").mapInArrow(
            _bound_wide(percent), "u long, v long"))
        # Whole sets travel for the pairs that are left only.
        few = F.broadcast(likely) if likely.count() * 2 * 8 <= BROADCAST_BYTES else likely
        return stage(side("u", "tokens").join(few, "u").join(side("v", "tokens").join(few, "v"), ["u", "v"]).mapInArrow(
            _verify(percent), "u long, v long").distinct())

    short = _rows(found, 1, np.dtype([("u", "<i8"), ("v", "<i8")]), {"u": "u", "v": "v"}, "u long, v long")
    links = verified(bounded(short))
    groups = components(links).withColumnRenamed("u", "v")
    # Long postings, first with each query's likeliest partner outside its group, then with all that are left.
    rest = stage(_rows(found, 2, ENTRY, {"t": "t", "v": "v", "n": "n", "r": "r"}, "t long, v long, n int, r int"))
    for best in (True, False):
        grouped = rest.join(groups, "v", "left").withColumn("component", F.coalesce("component", "v"))
        several = grouped.groupBy("t").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter(
            "a != b").select("t")
        rest = stage(grouped.join(several, "t", "left_semi"))
        if not rest.limit(1).count():
            break
        more = rest.join(nodes.select(F.col("node").alias("v"), "bits"), "v").withColumn("n", F.col("n").cast("long"))
        pairs = more.groupBy("t").applyInArrow(_grouped(_matrix(percent, best)), "u long, v long").distinct()
        links = links.unionByName(verified(pairs))
        groups = components(links).withColumnRenamed("u", "v")
        rest = rest.drop("component")
    # Components are named by nodes so far; name them by their least id.
    named = nodes.join(groups, F.col("node") == F.col("v"), "left").select(
        "node", "rep", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component"))
    ids = named.join(least, "c").select("node", "component")
    out = members.select("d", "node", "n").join(ids, "node", "left")
    return out.select(F.expr(f"nullif(d, {LAST})").cast(docs.schema[id_col].dataType).alias(id_col),
                      F.col("n").alias("n_shingles"), F.expr(f"nullif(if(n = 0, d, component), {LAST})").alias(
                          "component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("component", "component_id")
