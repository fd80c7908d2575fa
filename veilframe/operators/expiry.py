"""Sessions that end when nothing was said in them for a while.

A message that comes more than the idle time after the one before it in its session opens a new *spell*. Each spell has
placeholders of its own; those of a spell that has ended are neither used nor restored again. Spells are found from the
distinct times of each session, block by block, so that no session is one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.mask import UNKNOWN_SESSION, Masked, mask
from veilframe.plans.staging import block_offsets, in_blocks, stage

SPELL_SCHEMA = "session_id string, spell bigint, first_at timestamp, last_at timestamp"


def spell_session(session: Column, spell: Column) -> Column:
    """The vault's session of a spell."""
    return F.concat(session, F.lit("#"), spell.cast("string"))


def _session(session: str) -> Column:
    return F.coalesce(F.col(session).cast("string"), F.lit(UNKNOWN_SESSION))


def times_in_spells(messages: DataFrame, session: str, at: str, idle_seconds: int,
                    known: DataFrame | None = None) -> DataFrame:
    """``session_id, at, spell`` of the distinct times of the messages; spells count from 1 in each session.

    ``known`` (``session_id, spell, last_at``, one row a session) is what went before; times before its ``last_at`` belong
    to its spell. Messages without a time are left out.
    """
    moments = messages.select(_session(session).alias("session_id"), F.col(at).cast("timestamp").alias("at")).filter(
        "at IS NOT NULL").distinct()
    blocks = in_blocks(moments, ["session_id", "at"])
    local = Window.partitionBy("session_id", "block").orderBy("at")
    ends = blocks.groupBy("session_id", "block").agg(F.max("at").alias("end"))
    carried = ends.select("session_id", "block", F.max("end").over(
        Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = blocks.withColumn("before", F.lag("at").over(local)).join(carried, ["session_id", "block"])
    before = F.coalesce("before", "carried")
    if known is not None:
        rows = rows.join(known.select("session_id", F.col("spell").alias("old"), "last_at"), "session_id", "left")
        before = F.greatest(before, F.col("last_at"))
    else:
        rows = rows.withColumn("old", F.lit(None).cast("bigint"))
    opens = before.isNull() | (F.unix_micros("at") - F.unix_micros(before) > idle_seconds * 1_000_000)
    marked = stage(rows.select("session_id", "at", "block", "old", opens.cast("bigint").alias("opens")))
    running = F.sum("opens").over(local.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(block_offsets(marked, ["session_id"], F.col("opens")), ["session_id", "block"]).select(
        "session_id", "at", (F.coalesce("old", F.lit(0)) + F.col("offset") + running).cast("bigint").alias("spell"))


def spells(times: DataFrame) -> DataFrame:
    """``session_id, spell, first_at, last_at`` from :func:`times_in_spells`."""
    return times.groupBy("session_id", "spell").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def latest(found: DataFrame) -> DataFrame:
    """The last spell of each session: ``session_id, spell, last_at``."""
    return found.groupBy("session_id").agg(F.max("spell").alias("spell"), F.max("last_at").alias("last_at"))


def alive(found: DataFrame, now: Column, idle_seconds: int) -> DataFrame:
    """Spells that have not ended by ``now``: the last of their session, and idle no longer than allowed."""
    return latest(found).filter(F.unix_micros(now) - F.unix_micros("last_at") <= idle_seconds * 1_000_000)


def in_spells(messages: DataFrame, session: str, at: str, times: DataFrame, only: bool = False) -> DataFrame:
    """The messages with ``vault_session``, the session of their spell, from :func:`times_in_spells`. Those whose time is
    not in ``times`` get the spell 0, or with ``only`` are left out: so a scan reads the messages of some spells alone."""
    named = messages.withColumns({"__session_id": _session(session), "__at": F.col(at).cast("timestamp")})
    keyed = times.select(F.col("session_id").alias("__session_id"), F.col("at").alias("__at"), "spell")
    return named.join(keyed, ["__session_id", "__at"], "inner" if only else "left").withColumn(
        "vault_session", spell_session(F.col("__session_id"), F.coalesce("spell", F.lit(0)))).select(
        *messages.columns, "vault_session")


@dataclass(frozen=True)
class Spelled:
    """Masked rows and entries (sessions are those of the spells) and the spells of the messages."""

    masked: Masked
    found: DataFrame


def mask_in_spells(scanned: DataFrame, session: str, at: str, idle_seconds: int, order: list[str] | None = None,
                   vault: DataFrame | None = None, counters: DataFrame | None = None, known: DataFrame | None = None,
                   text_col: str = "text", style: str = "square") -> Spelled:
    """:func:`veilframe.operators.mask.mask` with sessions that end after ``idle_seconds`` without a message.

    Rows come with ``vault_session``, the session of their spell, under which they are restored. Messages without a time
    get the spell 0, which never meets the others. ``order`` is by time unless given.
    """
    times = stage(times_in_spells(scanned, session, at, idle_seconds, known))
    masked = mask(in_spells(scanned, session, at, times), "vault_session", order or [at], vault, text_col, style, counters=counters)
    return Spelled(masked, stage(spells(times)))
