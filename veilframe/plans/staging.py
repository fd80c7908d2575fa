"""Shared building blocks of the distributed plans: written stages, joins on skewed keys, numbering without a
single-task window.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A lookup table is broadcast only below these measured sizes.
BROADCAST_BYTES = 8 << 20
BROADCAST_PER_SESSION = 2_000

# A key is hot when it holds more than this share of all rows, so there are fewer than 1 / share hot keys.
HOT_SHARE = 1 / 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="veilframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_STAGED: list[str] = []


def drop_staged(spark: SparkSession, since: int = 0) -> int:
    """Delete what :func:`stage` has written in this process (from the ``since``-th folder on); texts and values lie there
    in clear. Results that are not yet written or collected need it. Returns the number of folders deleted."""
    gone = 0
    while len(_STAGED) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


@contextmanager
def staged_run(spark: SparkSession):
    """Whatever is staged inside is deleted at the end, also after a failure. Write or collect results inside."""
    before = len(_STAGED)
    try:
        yield
    finally:
        drop_staged(spark, before)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of what is written inside as soon as it is written; else they stay until the
    driver's garbage collector happens to find them."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def stage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there, work before it runs once, its shuffle
    files go, lost executors cost nothing, and readers still prune columns and partitions."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    _STAGED.append(path)
    with _shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Nodes that keep a row's file and position, and nodes that give the same rows whenever they are read again.
_ROW_KEEPING = {"Project", "Filter", "SubqueryAlias", "RepartitionByExpression", "Repartition", "Sort", "LogicalRelation"}
_REPEATABLE = _ROW_KEEPING | {"Union", "Join", "Aggregate", "ResolvedHint", "LocalRelation"}


def _made_of(df: DataFrame, nodes: set[str]) -> bool:
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() not in nodes:
            return False
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def settled(df: DataFrame) -> bool:
    """Whether all that is left of a plan once unused columns are gone gives the same values again. A text scan does not
    count as such (it is fenced), so it is not run twice either."""
    return df._jdf.queryExecution().optimizedPlan().deterministic()


def repeatable(df: DataFrame) -> bool:
    """Whether a DataFrame may be read twice: files, joins, projections, and no text scan."""
    return _made_of(df, _REPEATABLE) and settled(df)


def with_file_place(df: DataFrame) -> DataFrame | None:
    """``df`` with ``__file`` and ``__place``, the file a row is from and its position there; None where these do not tell
    rows apart: for other sources than Parquet files, and behind anything that repeats or joins rows."""
    if "_metadata" in df.columns or not _made_of(df, _ROW_KEEPING):
        return None
    try:
        return df.withColumns({"__file": F.col("_metadata.file_path"), "__place": F.col("_metadata.row_index")})
    except AnalysisException:
        return None


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined to ``table``, which is unique on ``keys``; right whatever the skew of ``rows``.

    Hot keys are found by a pre-aggregated count. By the definition of hot there are at most ``1 / HOT_SHARE`` of
    them, so their part of the table is broadcast; the other keys are joined by shuffle.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counts = stage(counts)
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot_keys = counts.filter(F.col("__n") > max(total * HOT_SHARE, 1_000)).select(*keys)
    hot = stage(F.broadcast(hot_keys).join(table, keys, "left").withColumn("__hot", F.lit(True)))
    values = [c for c in table.columns if c not in keys]
    if not hot.limit(1).count():
        return rows.join(table, keys, "left")
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot", *values).join(table, keys, "left")
    return marked.filter(F.col("__hot").isNotNull()).drop("__hot").unionByName(cold.select(*rows.columns, *values))


def in_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """Cut rows into consecutive blocks of the given order (column ``block``) and write them down.

    Rows with equal ``order`` share a block. A group that holds most rows is spread over many blocks, so nothing
    below runs a window over a whole group.
    """
    return stage(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("block", F.spark_partition_id()))


def block_offsets(blocks: DataFrame, group: list[str], amount: Column) -> DataFrame:
    """Per group and block: total of ``amount`` in the group's earlier blocks (one row per block, few per group)."""
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*group, "block").agg(F.sum(amount).alias("__total"))
    return totals.select(*group, "block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("offset"))


def next_after(rows: DataFrame, marks: DataFrame, on: list[str], at: str, value: Column, out: str,
               same_time: bool) -> DataFrame:
    """``rows`` with ``out``: ``value`` of the first row of ``marks`` that has the same ``on`` and a later ``at``
    (``same_time``: or an equal one); NULL if there is none. Both inputs have the columns ``on`` and ``at``.

    Both are put in one order and cut into blocks; what lies beyond a block's end is carried in from one row a block.
    So a key with most rows or most marks is spread over many tasks, and no row meets more than one mark. Marks of one
    key at one time are settled by the least value.
    """
    columns, keys = rows.columns, [f"__k{i}" for i in range(len(on))]
    key = [F.col(c).alias(k) for c, k in zip(on, keys)]
    kind = marks.select(value.alias("m")).schema["m"].dataType
    side = 0 if same_time else 1
    left = rows.select(*key, F.col(at).alias("__at"), F.lit(side).alias("__side"), F.lit(None).cast(kind).alias("__mark"),
                       F.struct(*columns).alias("__row"))
    right = marks.select(*key, F.col(at).alias("__at"), F.lit(1 - side).alias("__side"), value.alias("__mark")).groupBy(
        *keys, "__at", "__side").agg(F.min("__mark").alias("__mark")).withColumn(
        "__row", F.lit(None).cast(left.schema["__row"].dataType))
    blocks = in_blocks(left.unionByName(right), [*keys, "__at", "__side"])
    ahead = Window.partitionBy(*keys, "block").orderBy("__at", "__side").rowsBetween(1, Window.unboundedFollowing)
    firsts = blocks.filter(F.col("__row").isNull()).groupBy(*keys, "block").agg(F.min_by("__mark", "__at").alias("__first"))
    firsts = blocks.select(*keys, "block").distinct().join(firsts, [*keys, "block"], "left")
    beyond = Window.partitionBy(*keys).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select(*keys, "block", F.first("__first", ignorenulls=True).over(beyond).alias("__carried"))
    found = blocks.withColumn("__next", F.first("__mark", ignorenulls=True).over(ahead)).filter(
        F.col("__row").isNotNull())
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "block"]]
    joined = found.alias("f").join(carried.alias("c"), _all(same))
    return joined.select(*[F.col(f"f.__row.{c}").alias(c) for c in columns],
                         F.coalesce("f.__next", "c.__carried").alias(out))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
