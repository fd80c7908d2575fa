"""Sessions that end, batches that read their own sessions only, hot sessions, and nothing left behind."""

import os
import re
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.operators import expiry, mask, sessions
from veilframe.operators.scan import scan
from veilframe.plans import staging
from veilframe.sources import files
from veilframe.streaming import messages

NET = ScanConfig(("EMAIL", "IP_ADDRESS"))
START = datetime(2024, 1, 1)
SCHEMA = "session string, at timestamp, text string"


def talk():
    """(session, minute, address)"""
    return [("a", 0, "x"), ("a", 10, "y"), ("a", 200, "x"), ("b", 5, "x"), ("b", 65, "z"), ("b", 126, "z"), ("c", 300, "q"),
            (None, 1, "n"), (None, 500, "n"), ("d", None, "w")]


def rows(items):
    return [(s, None if m is None else START + timedelta(minutes=m), f"mail {v}@mail.test") for s, m, v in items]


def test_spells(spark):
    df = spark.createDataFrame(rows(talk()), SCHEMA)
    spelled = expiry.mask_in_spells(scan(df, "text", NET), "session", "at", 3600)
    got = sorted((r.session_id, r.original.split("@")[0], r.placeholder) for r in spelled.masked.entries.collect())
    assert got == [("a#1", "x", "[EMAIL_1]"), ("a#1", "y", "[EMAIL_2]"), ("a#2", "x", "[EMAIL_1]"), ("b#1", "x", "[EMAIL_1]"),
                   ("b#1", "z", "[EMAIL_2]"), ("b#2", "z", "[EMAIL_1]"), ("c#1", "q", "[EMAIL_1]"), ("d#0", "w", "[EMAIL_1]"),
                   ("unknown#1", "n", "[EMAIL_1]"), ("unknown#2", "n", "[EMAIL_1]")]
    open_ = expiry.alive(spelled.found, F.lit(START + timedelta(minutes=500)), 12_000)
    assert {(r.session_id, r.spell) for r in open_.collect()} == {("unknown", 2), ("c", 1)}
    assert expiry.mask_in_spells(scan(df.limit(0), "text", NET), "session", "at", 60).masked.entries.count() == 0
    back = mask.restore(spelled.masked.rows, spelled.masked.entries, "vault_session")
    assert back.filter("restored <> text").count() == 0


def test_expiring_stream(spark, tmp_path):
    """Batches in the order of time give the spells of one batch; ended spells leave the vault; a replay changes nothing."""
    items = [t for t in talk() if t[1] is not None]
    for lo, hi in ((0, 60), (60, 150), (150, 1000)):
        spark.createDataFrame(rows([t for t in items if lo <= t[1] < hi]), SCHEMA).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, activity = files.VaultTable(spark, str(tmp_path / "vault")), files.ActivityTable(spark, str(tmp_path / "activity"))
    published = {}

    def publish(out, batch):
        published[batch] = sorted((r.vault_session, r.masked) for r in out.collect())

    messages.mask_stream_expiring(scan(stream, "text", NET), store, activity, "session", "at", 3600, str(tmp_path / "state"),
                                  publish).trigger(availableNow=True).start().awaitTermination()
    whole = expiry.mask_in_spells(scan(spark.createDataFrame(rows(items), SCHEMA), "text", NET), "session", "at", 3600)
    assert sorted(x for p in published.values() for x in p) == sorted(
        (r.vault_session, r.masked) for r in whole.masked.rows.collect())
    # By the watermark of the batch before the last (minute 126) the spells that ended at minutes 1, 10 and 65 are over.
    assert {r.session_id for r in store.entries().collect()} == {"a#2", "b#2", "c#1", "unknown#2"}
    before = sorted(store.entries().collect())
    last = spark.createDataFrame(rows([t for t in items if t[1] >= 150]), SCHEMA)
    mine = expiry.latest(activity.spells(2))
    open_ = mine.select(expiry.spell_session(F.col("session_id"), F.col("spell")).alias("session_id"))
    again = expiry.mask_in_spells(scan(last, "text", NET), "session", "at", 3600, None, store.entries(2, open_),
                                  store.counters(2, open_), mine)
    assert sorted((r.vault_session, r.masked) for r in again.masked.rows.collect()) == published[2]
    store.put_batch(again.masked.entries, 2)
    assert sorted(store.entries().collect()) == before


def entries(spark, sessions_, per=4):
    return spark.createDataFrame([(s, i + 1, f"{s}{i}", f"[EMAIL_{i + 1}]", "EMAIL") for s in sessions_ for i in range(per)],
                                 mask.VAULT_SCHEMA)


def test_reads_own_buckets_only(spark, tmp_path):
    store = files.VaultTable(spark, str(tmp_path / "vault"), buckets=32)
    names = [f"s{i}" for i in range(40)]
    store.put_batch(entries(spark, names), 0)
    store.put_batch(entries(spark, names[:3], 2), 1)
    mine = spark.createDataFrame([("s7",)], "session_id string")
    found = store.entries(2, mine)
    assert found.count() == 4
    (bucket,) = store.buckets_of(mine)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = store.entries(2, mine)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = next(f for f in re.findall(r"PartitionFilters: \[(.*?)\], Push", plan, re.S) if "session_bucket" in f)
    assert re.search(rf"session_bucket#\d+ (=|IN \() ?{bucket}\b", filters) and "batch_id" in filters
    assert {(r.session_id, r.issued, r.last) for r in store.counters(2, mine).collect()} == {("s7", 4, 4)}
    assert {r.issued for r in store.counters(0).collect()} == set()


def test_forget_touches_its_buckets_only(spark, tmp_path):
    store = files.VaultTable(spark, str(tmp_path / "vault"), buckets=32)
    names = [f"s{i}" for i in range(40)]
    store.append(entries(spark, names))
    gone = spark.createDataFrame([("s7",), ("s8",), (None,)], "session_id string")
    touched = {f"session_bucket={b}" for b in store.buckets_of(gone.filter("session_id is not null"))}

    def stamps():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(store.path) for f in fs
                if f.endswith(".parquet")}

    before = stamps()
    store.forget(gone)
    assert {r.session_id for r in store.entries().collect()} == set(names) - {"s7", "s8"}
    after = stamps()
    assert all(p in after for p in before if not any(t + os.sep in p for t in touched))
    assert store.counters().filter("session_id = 's7'").count() == 0 and store.counters().count() == 38
    store.forget(spark.createDataFrame([(n,) for n in names], "session_id string"))
    assert store.entries().count() == 0


def test_hot_session_is_spread(spark, monkeypatch):
    """90 % of the entries in one session, and more sessions to forget than are broadcast."""
    monkeypatch.setattr(sessions, "BROADCAST_BYTES", -1)
    n = 20_000
    vault = spark.range(n).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("session_id"), "id")
    names = spark.createDataFrame([("s10",), ("s20",), ("other",)], "session_id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = staging.stage(sessions.forget(vault, names).withColumn("part", F.spark_partition_id()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert left.count() == n - 2
    sizes = [r["count"] for r in left.filter("session_id = 'hot'").groupBy("part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < n / 2


def staged(spark):
    folder = staging.shared_folder(spark).removeprefix("file:")
    return {d for d in os.listdir(folder) if d.startswith("stage-")}, folder


def test_masking_writes_few_texts_and_leaves_nothing(spark, tmp_path):
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.md5(F.concat("id", F.lit("-"), k))), " ")
    docs = spark.range(4000).select("id", F.lit("s").alias("session"), F.concat(noise, F.when(
        F.col("id") % 200 == 0, F.concat(F.lit(" u"), "id", F.lit("@mail.test"))).otherwise("")).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    source = spark.read.parquet(str(tmp_path / "docs"))
    size = sum(os.path.getsize(tmp_path / "docs" / f) for f in os.listdir(tmp_path / "docs"))
    before, folder = staged(spark)
    with staging.staged_run(spark):
        m = mask.mask(scan(source, "text", NET), "session", ["id"])
        m.rows.write.parquet(str(tmp_path / "masked"))
        m.entries.write.parquet(str(tmp_path / "entries"))
        masked = spark.read.parquet(str(tmp_path / "masked"))
        back = mask.restore(masked, spark.read.parquet(str(tmp_path / "entries")), "session")
        assert back.filter("restored <> text").count() == 0 and back.count() == 4000
        texts = [d for d in staged(spark)[0] - before]
        written = sum(os.path.getsize(os.path.join(d, f)) for t in texts for d, _, fs in os.walk(os.path.join(folder, t))
                      for f in fs if f.endswith(".parquet"))
    assert masked.filter("masked <> text").count() == 20 and staged(spark)[0] == before
    assert texts and written < size * 0.05
    rows = spark.read.parquet(str(tmp_path / "docs")).join(masked.select("id", "masked"), "id")
    assert rows.filter("id % 200 <> 0 and masked <> text").count() == 0


def test_repeated_rows_keep_their_number(spark, tmp_path):
    """Rows behind a generator are not told apart by file and place: all are kept all the same."""
    spark.createDataFrame([(1, "a@b.com"), (2, "plain")], "id int, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "text", F.when(F.col("k") == 1, F.col("text")).otherwise("plain"))
    assert staging.with_file_place(df) is None
    rows_ = mask.mask(scan(df, "text", NET), "k", ["id"]).rows.collect()
    assert sorted(r.masked for r in rows_) == ["[EMAIL_1]", "plain", "plain", "plain"]


def test_batches_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """Each of the five batches is a run of the stream over what came since, in as many files as there are tasks."""
    from unittest.mock import MagicMock

    from veilframe.plans import queries

    monkeypatch.setattr(queries, "VaultTable", MagicMock())
    spark.range(1_000).selectExpr("id AS doc_id", "'s' AS source", "'none' AS text").repartition(4).write.parquet(
        str(tmp_path / "documents.parquet"))
    seen = []

    def run(stream, vault, folder):
        read = spark.read.parquet(f"{folder}/in")
        seen.append((read.count(), read.agg(F.max("doc_id")).first()[0], len(read.inputFiles())))
        return MagicMock()

    queries._many_batches(spark, str(tmp_path), run)
    assert seen == [(200 * i, 200 * i - 1, 4 * i) for i in range(1, 6)]


def test_only_the_messages_of_some_spells(spark):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 09:00:00"), (3, None, "2024-01-01 09:00:00"), (4, "a", None)]
    said = spark.createDataFrame(rows, "id long, s string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    times = expiry.times_in_spells(said, "s", "ts", 3600)
    every = {r.id: r.vault_session for r in expiry.in_spells(said, "s", "ts", times).collect()}
    assert every == {1: "a#1", 2: "a#2", 3: "unknown#1", 4: "a#0"}
    some = {r.id: r.vault_session for r in expiry.in_spells(said, "s", "ts", times.filter("spell = 2"), only=True).collect()}
    assert some == {2: "a#2"}
