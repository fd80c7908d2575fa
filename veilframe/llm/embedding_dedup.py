"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random lines. Two vectors collide on a line if one lies in the window around the
other; close vectors collide on nearly all lines. Pairs that collide on every driving line and on enough of the others
are verified by cosine. Windows and the count come from the threshold: the difference of two unit vectors at that cosine,
projected on a random line, is normal with a known spread, so the recall of each test is known.

Driving lines are sorted into cells; a vector looks, as a query, into every cell that its windows reach. Cells are cut
into blocks, so that a task holds at most one block of queries and one of vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.components import components
from veilframe.plans.staging import stage

COSINE = 0.98
LINES = 24  # counted lines
MISS = 1e-5  # chance that a pair at the threshold fails one of the tests
CELL = 2.0  # width of a cell; projections of random unit vectors on a line have a spread of 1
BLOCK = 2048
SEED = 11


def _spread(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def driving_window(cosine: float, lines: int) -> float:
    """Half window within which a pair at the threshold stays on all driving lines but for a chance of ``MISS``."""
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) * max(1, lines) > MISS else (low, mid)
    return high * _spread(cosine)


def least_collisions(half_window_in_spreads: float, lines: int) -> int:
    """Largest count that a pair at the threshold reaches but for a chance of ``MISS``."""
    p = math.erf(half_window_in_spreads / math.sqrt(2))
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p ** k * (1 - p) ** (lines - k)
        if below > MISS:
            return k
    return lines


def _directions(dimension: int, driving: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension, driving + LINES))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _cells(driving: int, window: float):
    """Each vector as data in its own cell, and as a query in each cell that its windows reach."""
    def deal(batches):
        for b in batches:
            size = np.asarray(b.column("embedding").value_lengths())
            for d in np.unique(size):
                part = b.filter(pa.array(size == d))
                line = _unit(_vectors(part.column("embedding"))) @ _directions(int(d), driving)[:, :driving]
                low, own, high = (np.floor((line + x) / CELL).astype(np.int64) for x in (-window, 0.0, window))
                rows, cells, query = [np.arange(len(line))], [own], [np.zeros(len(line), bool)]
                reach = np.prod(high - low + 1, axis=1) if driving else np.ones(len(line), np.int64)
                row = np.repeat(np.arange(len(line)), reach)
                left = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
                at = np.empty((len(row), driving), np.int64)
                for k in range(driving):
                    width = (high - low + 1)[row, k]
                    at[:, k] = low[row, k] + left % width
                    left = left // width
                rows, cells = np.concatenate([*rows, row]), np.concatenate([*cells, at])
                query = np.concatenate([*query, np.ones(len(row), bool)])
                names = [f"{d}:" + ",".join(map(str, c)) for c in cells.tolist()]
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("label"), pa.array(names, pa.string()), pa.array(query), taken.column("rep"),
                     taken.column("n"), taken.column("embedding")],
                    ["label", "cell", "query", "rep", "n", "embedding"])

    return deal


def _count(cosine: float, driving: int, window: float, narrow: float, least: int):
    def links(key, table):
        query = table.column("query").to_numpy()
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        whole = table.column("embedding").combine_chunks()
        unit = _unit(_vectors(whole))
        line = unit @ _directions(unit.shape[1], driving)
        q, x = np.flatnonzero(query), np.flatnonzero(~query)
        out_u, out_v = [], []
        for at in range(0, len(q), 256):
            some = q[at:at + 256]
            close = np.ones((len(some), len(x)), bool)
            for k in range(driving):
                close &= np.abs(line[some, k][:, None] - line[x, k]) <= window
            i, j = np.nonzero(close)
            i, j = some[i], x[j]
            i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
            hits = np.zeros(len(i), np.int64)
            for k in range(driving, line.shape[1]):
                hits += np.abs(line[i, k] - line[j, k]) <= narrow
            i, j = i[hits >= least], j[hits >= least]
            ok = np.zeros(len(i), bool)
            for s in range(0, len(i), 1 << 16):
                ok[s:s + (1 << 16)] = np.einsum("ij,ij->i", unit[i[s:s + (1 << 16)]], unit[j[s:s + (1 << 16)]]) >= cosine
            out_u.append(i[ok])
            out_v.append(j[ok])
        u, v = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_u, out_v))
        # Links per query; for the groups, a forest over the block instead of all its links.
        degree = np.bincount(u, n[v], len(rep)).astype(np.int64)
        root = rep.copy()
        while True:
            before = root.copy()
            np.minimum.at(root, u, root[v])
            np.minimum.at(root, v, root[u])
            if (before == root).all():
                break
        touched = np.unique(np.concatenate([u, v]))
        return pa.table({"u": pa.array(rep[touched]), "v": pa.array(root[touched]),
                         "links": pa.array(degree[touched])})

    return links


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label", driving: int | None = None) -> DataFrame:
    """Links of vectors with equal labels and a cosine of at least ``cosine``, and the groups they make.

    One row per input row: the id, n_links, component (least id reachable), kept (id is the component). Vectors that are
    null, empty, zero or hold null or non-finite numbers, and rows with a null label, link with nothing. Vectors of
    different lengths do not link. Equal vectors are one class and are counted, not paired. Ids are taken to be unique;
    rows with a null id get null results for the group. ``driving`` lines are chosen by the number of rows if not given.
    """
    item = F.col(vector_col)
    numbers = F.transform(item, lambda x: x.cast("double"))
    whole = (F.size(item) > 0) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(
        float("inf")))) & F.exists(numbers, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).alias("label"),
                          numbers.alias("embedding"), F.coalesce(whole, F.lit(False)).alias("whole"))
    good = rows.filter("whole AND label IS NOT NULL AND vec IS NOT NULL")
    classes = stage(good.groupBy("label", "embedding").agg(F.min("vec").alias("rep"), F.count(F.lit(1)).alias("n")))
    if driving is None:
        driving = min(6, max(1, round(math.log(max(1, classes.count()) / 500) / math.log(4))))
    window = driving_window(cosine, driving)
    least = least_collisions(2.0, LINES)
    label = rows.schema["label"].dataType.simpleString()

    dealt = classes.mapInArrow(_cells(driving, window), f"label {label}, cell string, query boolean, rep long, n long, "
                                                        "embedding array<double>")
    sizes = dealt.groupBy("label", "cell").agg(
        F.ceil(F.count_if(~F.col("query")) / BLOCK).cast("int").alias("x_blocks"),
        F.ceil(F.count_if(F.col("query")) / BLOCK).cast("int").alias("q_blocks")).filter("x_blocks > 0")
    # A row goes to its own block of its kind and to all blocks of the other.
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("x_blocks")).otherwise(
        F.col("q_blocks")) - 1))
    spread = dealt.join(sizes, ["label", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.when(
        F.col("query"), F.col("q_blocks")).otherwise(F.col("x_blocks"))).cast("int")).withColumn("other", other)
    placed = spread.withColumns({"q": F.when(F.col("query"), F.col("own")).otherwise(F.col("other")),
                                 "x": F.when(F.col("query"), F.col("other")).otherwise(F.col("own"))})
    found = stage(placed.select("label", "cell", "q", "x", "query", "rep", "n", "embedding").groupBy(
        "label", "cell", "q", "x").applyInArrow(
            _count(cosine, driving, window, 2.0 * _spread(cosine), least), "u long, v long, links long"))
    groups = components(found.select("u", "v"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    known = classes.select("rep", "n", "label", "embedding").join(
        links.withColumnRenamed("u", "rep"), "rep", "left").join(
        groups.withColumnRenamed("u", "rep"), "rep", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    linked = good.join(known, ["label", "embedding"]).select("vec", "n_links", "component")
    rest = rows.filter("NOT whole OR label IS NULL OR vec IS NULL").select(
        "vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    return linked.unionByName(rest).select(
        F.col("vec").alias(id_col), "n_links", "component", (F.col("vec") == F.col("component")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed(
        "component", "component_id")
