"""Scan, guard, masking and restore on streams of messages.

Scanning and guarding are narrow and run on a stream as they do on a table. Masking needs the session's vault: each
micro-batch goes through the batch operator against the stored vault, so one busy session is spread over tasks like in
batch. Entries are stored before the masked rows are published, under the batch's id: a batch that is replayed after
a failure sees the same earlier entries and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilframe.config import ScanConfig
from veilframe.operators.expiry import latest, mask_in_spells, spell_session
from veilframe.operators.guard import guard
from veilframe.operators.mask import UNKNOWN_SESSION, mask, restore
from veilframe.operators.scan import scan
from veilframe.operators.send import decide, settled_send
from veilframe.plans.staging import stage
from veilframe.sources.files import ActivityTable, VaultTable


def scan_stream(stream: DataFrame, text_col: str = "text", cfg: ScanConfig | None = None) -> DataFrame:
    return scan(stream, text_col, cfg)


def guard_stream(stream: DataFrame, text_col: str = "text", cfg: ScanConfig | None = None) -> DataFrame:
    """Scanned messages with the guard's decision in ``action``."""
    return guard(scan(stream, text_col, cfg))


def route(guarded: DataFrame, clean_path: str, held_path: str, checkpoint: str) -> DataStreamWriter:
    """Write passed and held messages to two tables; a replayed batch overwrites its own part of each."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.filter(F.col("action") == "pass").write.mode("overwrite").parquet(f"{clean_path}/batch_id={batch_id}")
            batch.filter(F.col("action") != "pass").write.mode("overwrite").parquet(f"{held_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return guarded.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


def known(vault: VaultTable, batch: DataFrame, batch_id: int, session: str) -> dict[str, DataFrame]:
    """What earlier batches stored for this batch's sessions: their entries and counters, read from their buckets."""
    sessions = stage(batch.select(F.coalesce(F.col(session).cast("string"), F.lit(UNKNOWN_SESSION)).alias(
        "session_id")).distinct())
    return {"vault": vault.entries(batch_id, sessions), "counters": vault.counters(batch_id, sessions)}


def mask_stream(scanned: DataFrame, vault: VaultTable, session: str, order: list[str], checkpoint: str,
                publish: Callable[[DataFrame, int], None], text_col: str = "text",
                style: str = "square") -> DataStreamWriter:
    """Mask a scanned stream. ``publish(rows, batch_id)`` receives each masked batch after its entries are stored."""
    def run(batch: DataFrame, batch_id: int) -> None:
        masked = mask(batch, session, order, text_col=text_col, style=style, **known(vault, batch, batch_id, session))
        vault.put_batch(masked.entries, batch_id)
        publish(masked.rows, batch_id)

    return scanned.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def mask_stream_expiring(scanned: DataFrame, vault: VaultTable, activity: ActivityTable, session: str, at: str,
                         idle_seconds: int, checkpoint: str, publish: Callable[[DataFrame, int], None],
                         order: list[str] | None = None, delay_seconds: int = 0, text_col: str = "text",
                         style: str = "square") -> DataStreamWriter:
    """:func:`mask_stream` with sessions that end after ``idle_seconds`` without a message, by the time of the messages in
    ``at``. Published rows have ``vault_session``.

    What is kept for each session is its last spell, in ``activity``; there is no state processor, so a busy session is
    many tasks as ever. After each batch the entries of spells that are over by the watermark (the latest time seen less
    ``delay_seconds``) are deleted from the vault; a message that comes later still opens a new spell, unless it is older
    than its session's last one. A replayed batch gives the same rows.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        last = latest(activity.spells(batch_id))
        marked = batch.select(F.coalesce(F.col(session).cast("string"), F.lit(UNKNOWN_SESSION)).alias("session_id"))
        mine = stage(last.join(marked.distinct(), "session_id", "left_semi"))
        open_ = mine.select(spell_session(F.col("session_id"), F.col("spell")).alias("session_id"))
        spelled = mask_in_spells(batch, session, at, idle_seconds, order, vault.entries(batch_id, open_),
                                 vault.counters(batch_id, open_), mine, text_col, style)
        activity.put_batch(spelled.found, batch_id)
        vault.put_batch(spelled.masked.entries, batch_id)
        publish(spelled.masked.rows, batch_id)
        if batch_id:
            # A batch may be replayed: what was over before it began is not read by it.
            vault.forget(activity.ended(idle_seconds, batch_id - 1, delay_seconds))

    return scanned.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def guard_send_stream(stream: DataFrame, vault: VaultTable, session: str, order: list[str], checkpoint: str,
                      publish: Callable[[DataFrame, int], None], text_col: str = "text", cfg: ScanConfig | None = None,
                      style: str = "square", **policy) -> DataStreamWriter:
    """:func:`veilframe.operators.send.guard_send` on a stream of messages with their sender's choice. The decision is part
    of the stream; each batch is masked against the vault, its entries are stored, then ``publish(rows, batch_id)``
    receives it. ``rows`` has ``action`` and ``sent``; the leaks prevented are the rows whose action is ``mask``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        sent = settled_send(batch, session, order, text_col=text_col, style=style,
                            **known(vault, batch, batch_id, session))
        vault.put_batch(sent.entries, batch_id)
        publish(sent.rows, batch_id)

    return decide(stream, text_col, cfg, **policy).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def restore_stream(stream: DataFrame, vault: VaultTable, session: str, key: list[str], checkpoint: str,
                   publish: Callable[[DataFrame, int], None], text_col: str = "masked") -> DataStreamWriter:
    """Restore a stream against the vault as it stands when each batch runs."""
    def run(batch: DataFrame, batch_id: int) -> None:
        publish(restore(batch, vault.entries(), session, key, text_col), batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def leak_counter(decided: DataFrame, action: str = "action") -> DataFrame:
    """Running number of masked messages; write it with output mode ``complete`` or ``update``."""
    return decided.groupBy().agg(F.count_if(F.col(action) == "mask").alias("leaks_prevented"))
