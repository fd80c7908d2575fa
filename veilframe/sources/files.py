"""Readers and writers: text tables, labelled corpora, policy rows, the vault and its encrypted snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.placeholders import parse_placeholder
from veilframe.operators.expiry import SPELL_SCHEMA, spell_session
from veilframe.operators.mask import VAULT_SCHEMA
from veilframe.operators.sessions import without_sessions
from veilframe.plans.staging import stage

CORPUS_SCHEMA = "text string, expected array<struct<type:string,value:string>>"


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def _delete(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


class VaultStorageError(RuntimeError):
    """The vault cannot be read or written; masking without it could not be undone."""


# Inputs below this size per core are worth one shuffle to use all cores; larger ones come in enough splits.
SPREAD_BYTES_PER_CORE = 64 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a small input out over all cores, by hash of ``keys``. A text scan is bound by CPU, and a small file is
    one task however many cores wait. Inputs of real size are left as their files split them: nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * SPREAD_BYTES_PER_CORE else df


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A table of texts; ``fmt`` is any Spark source (parquet, json, csv, orc, text)."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.withColumnRenamed("value", "text") if fmt == "text" else df


def read_corpus(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Labelled items (``text``, ``expected``) from JSON. Use one item per line for files beyond a single task."""
    return spark.read.schema(CORPUS_SCHEMA).option("multiLine", multi_line).json(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.select("text", "expected").write.mode("overwrite").json(path)


class VaultTable:
    """The vault as a parquet table, partitioned by the batch that wrote an entry and a hash of its session, and beside it a
    table of counters: the highest number and place, by session, type and batch.

    Batch -1 holds entries written outside a stream. Writing a batch again replaces that batch only. Readers that name
    their sessions read those sessions' buckets only, and numbering reads counters, so the work of a batch follows its own
    sessions and not the history. ``buckets`` should be some times the number of sessions of a batch.
    """

    BUCKET = "session_bucket"
    COUNTERS = "session_id string, type string, issued bigint, last bigint, entries bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.counters_path = f"{path.rstrip('/')}_counters"

    def exists(self) -> bool:
        return _exists(self.spark, self.path)

    def _bucket(self, session: str = "session_id") -> Column:
        return F.pmod(F.hash(F.col(session)), F.lit(self.buckets))

    def buckets_of(self, sessions: DataFrame) -> list[int]:
        """Buckets of the sessions in column ``session_id``; at most as many values as there are buckets."""
        named = sessions.filter(F.col("session_id").isNotNull())
        return sorted(r.b for r in named.select(self._bucket().alias("b")).distinct().collect())

    def _rows(self, path: str | None = None, schema: str = VAULT_SCHEMA) -> DataFrame:
        schema = f"{schema}, batch_id bigint, {self.BUCKET} int"
        path = path or self.path
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _chosen(self, rows: DataFrame, before_batch: int | None, sessions: DataFrame | None) -> DataFrame:
        if before_batch is not None:
            rows = rows.filter(F.col("batch_id") < before_batch)
        if sessions is not None:
            rows = rows.filter(F.col(self.BUCKET).isin(self.buckets_of(sessions))).join(
                sessions.select("session_id").distinct(), "session_id", "left_semi")
        return rows.drop("batch_id", self.BUCKET)

    def entries(self, before_batch: int | None = None, sessions: DataFrame | None = None) -> DataFrame:
        """All entries, or those from before a batch, or of some sessions only; an absent vault is empty."""
        return self._chosen(self._rows(), before_batch, sessions)

    def counters(self, before_batch: int | None = None, sessions: DataFrame | None = None) -> DataFrame:
        """``session_id, type, issued, last``: the highest number and the highest place of each session and type."""
        rows = self._chosen(self._rows(self.counters_path, self.COUNTERS), before_batch, sessions)
        return rows.groupBy("session_id", "type").agg(F.max("issued").alias("issued"), F.max("last").alias("last"))

    def _write(self, rows: DataFrame, mode: str, overwrite: str = "static") -> None:
        """Entries, then their counters. Counters that are missing after a failure between the two come with the batch's
        replay."""
        entries = stage(rows.withColumn(self.BUCKET, self._bucket()))
        token = parse_placeholder(F.col("placeholder"))
        counted = entries.groupBy("session_id", token["type"].alias("type"), "batch_id", self.BUCKET).agg(
            F.max(token["num"]).alias("issued"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("entries"))
        try:
            for table, path in ((counted, self.counters_path), (entries, self.path)):
                table.write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy(
                    "batch_id", self.BUCKET).parquet(path)
        except Exception as exc:
            raise VaultStorageError(f"vault write failed: {exc}") from exc

    def append(self, entries: DataFrame) -> None:
        """Add entries. Raises :class:`VaultStorageError` if they cannot be stored: publish nothing then."""
        self._write(entries.withColumn("batch_id", F.lit(-1).cast("bigint")), "append")

    def put_batch(self, entries: DataFrame, batch_id: int) -> None:
        """Store the entries of one stream batch; the same batch again gives the same partitions."""
        self._write(entries.withColumn("batch_id", F.lit(batch_id).cast("bigint")), "overwrite", "dynamic")

    def rewrite(self, entries: DataFrame) -> None:
        """Replace all entries, as after moving sessions. The new state is written down first, so the table may be its own
        source. Entries lose their batch: do this while no stream is writing."""
        self._write(entries.withColumn("batch_id", F.lit(-1).cast("bigint")), "overwrite")

    def forget(self, sessions: DataFrame) -> int:
        """Delete the entries of the given sessions (column ``session_id``). Only their buckets are read and written; the
        others' files stay as they are. Each bucket is replaced as a whole or not at all. Returns the buckets touched."""
        touched = self.buckets_of(sessions)
        if not touched or not self.exists():
            return 0
        for path, schema in ((self.path, VAULT_SCHEMA), (self.counters_path, self.COUNTERS)):
            rows = self._rows(path, schema).filter(F.col(self.BUCKET).isin(touched))
            parts = {tuple(r) for r in rows.select("batch_id", self.BUCKET).distinct().collect()}  # folders of the table
            left = stage(without_sessions(rows, sessions))
            full = {tuple(r) for r in left.select("batch_id", self.BUCKET).distinct().collect()}
            left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "batch_id", self.BUCKET).parquet(path)
            for batch, bucket in sorted(parts - full):
                _delete(self.spark, f"{path}/batch_id={batch}/{self.BUCKET}={bucket}")
        return len(touched)

    def clear(self) -> None:
        """Forget all entries. Only this table: an encrypted snapshot is cleared by its own ``clear``."""
        self.rewrite(self.spark.createDataFrame([], VAULT_SCHEMA))


class ActivityTable:
    """When sessions were last active: the spells that each batch met. A batch that is written again replaces its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def spells(self, before_batch: int | None = None) -> DataFrame:
        schema = f"{SPELL_SCHEMA}, batch_id bigint"
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema).drop("batch_id")
        rows = self.spark.read.schema(schema).parquet(self.path)
        if before_batch is not None:
            rows = rows.filter(F.col("batch_id") < before_batch)
        return rows.groupBy("session_id", "spell").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))

    def put_batch(self, found: DataFrame, batch_id: int) -> None:
        found.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path)

    def ended(self, idle_seconds: int, upto_batch: int, delay_seconds: int = 0) -> DataFrame:
        """Sessions of the vault (column ``session_id``) whose spell is over by the watermark: the latest time of the
        batches so far less ``delay_seconds``."""
        found = self.spells(upto_batch + 1)
        mark = found.agg(F.max("last_at").alias("mark"))
        idle = F.unix_micros("mark") - F.unix_micros("last_at") - delay_seconds * 1_000_000
        return found.crossJoin(F.broadcast(mark)).filter(idle > idle_seconds * 1_000_000).select(
            spell_session(F.col("session_id"), F.col("spell")).alias("session_id"))


class SnapshotTable:
    """The encrypted vault snapshot: absent until the first save, gone after ``clear``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return _exists(self.spark, self.path)

    def save(self, encrypted: DataFrame) -> None:
        encrypted.write.mode("overwrite").parquet(self.path)

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self.exists() else None

    def clear(self) -> None:
        _delete(self.spark, self.path)
