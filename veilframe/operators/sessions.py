"""Sessions of the vault: ids, summaries, forgetting, moving entries between sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.plans.staging import BROADCAST_BYTES, in_blocks, stage

SALTS = 64


# Scheme, optional user, host (a bracketed address as it is), optional port. Java's parser refuses addresses that every
# browser takes: blanks, braces or | in the path, _ in the host.
_AUTHORITY = r"(?s)^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\s]+)(?::[0-9]*)?"
# What a browser writes as %XX in a path: controls, blank, " < > ^ ` { } and all beyond ASCII.
_ESCAPED = r'[^!$-;=@-\]_a-z|~%&\[]'


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, _AUTHORITY + "(?:[/?#].*)?$", 1))
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """Path of a URL as a browser writes it, ``/`` if it has none; NULL for a text that is no URL."""
    path = F.regexp_extract(url, _AUTHORITY + "(/[^?#]*)?", 2)
    written = F.array_join(F.transform(F.split(path, ""), lambda c: F.when(
        c.rlike(_ESCAPED), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    path = F.when(path.rlike(_ESCAPED), written).otherwise(path)
    return F.when(url_host(url).isNotNull(), F.when(path == "", F.lit("/")).otherwise(path))


def session_id(tab: Column, url: Column) -> Column:
    """``tab_host/path``; query and fragment do not count, a bad URL gives ``tab_unknown``."""
    place = F.concat(url_host(url), url_path(url))
    return F.concat(tab.cast("string"), F.lit("_"), F.coalesce(place, F.lit("unknown")))


def session_summary(vault: DataFrame) -> DataFrame:
    """One row per session: host, path, number of entries and ``MAP<type, count>``; no originals, no placeholders.

    Counted in two steps: a session of any size shrinks to its few types before it meets in one task.
    """
    by_type = vault.groupBy("session_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    grouped = by_type.groupBy("session_id").agg(
        F.sum("n").alias("count"), F.min("first").alias("first"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    place = F.regexp_extract("session_id", "^[^_]*_(.*)$", 1)
    place = F.when(F.contains("session_id", F.lit("_")), place).otherwise(F.col("session_id"))
    path = F.regexp_extract(place, "^[^/]*(/.*)$", 1)
    return grouped.select(
        "session_id", F.substring_index(place, "/", 1).alias("host"),
        F.when(path == "", F.lit("/")).otherwise(path).alias("path"), "count", "types")


def recent_sessions(vault: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` sessions of the summary, by session id."""
    return session_summary(vault).orderBy("session_id").limit(n)


def without_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rows`` of other sessions than the given ones (column ``session_id``).

    Few sessions are broadcast after their number was counted. Many are joined by session and a salt: each is repeated
    once a salt, and a row takes one by its place, so one session with most rows is spread over ``SALTS`` tasks.
    """
    names = stage(sessions.filter("session_id IS NOT NULL").select("session_id").distinct())
    if (names.agg(F.sum(F.octet_length("session_id") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(names), "session_id", "left_anti").select(*rows.columns)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    salted = names.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(salted, ["session_id", "__salt"], "left_anti").select(*rows.columns)


def forget(vault: DataFrame, sessions: DataFrame) -> DataFrame:
    """The vault without the given sessions (column ``session_id``)."""
    return without_sessions(vault, sessions)


def migrate_sessions(vault: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move the entries of ``from_session`` to ``to_session`` (columns of ``moves``).

    An entry moves if neither its placeholder nor its value is taken in the target; the others are dropped with the
    source. Gives the new vault and a report ``from_session, to_session, migrated, dropped``. Within one call a
    session may be a source once and a target once and not both; do chains call by call, in order.
    """
    moves = stage(moves.select("from_session", "to_session").distinct())
    real = moves.filter("from_session <> to_session")
    clash = real.select(F.explode(F.array("from_session", "to_session")).alias("s")) \
        .groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if clash.limit(1).count():
        raise ValueError("a session may take part in one move per call")

    # Few moves, many entries: the moves are the build side; Spark broadcasts them if their size allows.
    leaving = vault.join(real.withColumnRenamed("from_session", "session_id"), "session_id")
    staying = vault.join(real.select(F.col("from_session").alias("session_id")), "session_id", "left_anti")
    target = staying.select(F.col("session_id").alias("to_session"), "original", "placeholder")
    movable = leaving.join(target.select("to_session", "placeholder"), ["to_session", "placeholder"], "left_anti") \
        .join(target.select("to_session", "original"), ["to_session", "original"], "left_anti")
    last = staying.groupBy(F.col("session_id").alias("to_session")).agg(F.max("seq").alias("last"))
    moved = movable.join(last, "to_session", "left").select(
        F.col("to_session").alias("session_id"), (F.col("seq") + F.coalesce("last", F.lit(0))).alias("seq"),
        "original", "placeholder", "type")
    sizes = leaving.groupBy("to_session").agg(F.count(F.lit(1)).alias("had"))
    went = movable.groupBy("to_session").agg(F.count(F.lit(1)).alias("migrated"))
    report = moves.join(
        sizes.join(went, "to_session", "left").withColumn("hit", F.lit(True)), "to_session", "left").select(
        "from_session", "to_session",
        F.when(F.col("from_session") == F.col("to_session"), F.lit(0)).otherwise(
            F.coalesce("migrated", F.lit(0))).cast("bigint").alias("migrated"),
        F.when(F.col("from_session") == F.col("to_session"), F.lit(0)).otherwise(
            F.coalesce("had", F.lit(0)) - F.coalesce("migrated", F.lit(0))).cast("bigint").alias("dropped"))
    return staying.select(*vault.columns).unionByName(moved.select(*vault.columns)), report


def navigation_moves(visits: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Session moves implied by a page history (``tab_id, ts, url``): when a tab leaves a draft page, the draft's
    entries follow. ``draft_paths`` come from the site of the host, or are ``/``.

    The previous URL of a tab is found block by block, so one busy tab is spread over many tasks.
    """
    from veilframe.sources.catalog import site_of

    blocks = in_blocks(visits.select("tab_id", "ts", "url"), ["tab_id", "ts"])
    local = Window.partitionBy("tab_id", "block").orderBy("ts")
    last = blocks.groupBy("tab_id", "block").agg(F.max_by("url", "ts").alias("last_url"))
    carried = last.select("tab_id", "block", F.lag("last_url").over(
        Window.partitionBy("tab_id").orderBy("block")).alias("carried"))
    steps = blocks.withColumn("before", F.lag("url").over(local)) \
        .withColumn("first", F.row_number().over(local) == 1) \
        .join(carried, ["tab_id", "block"]) \
        .withColumn("previous", F.when(F.col("first"), F.col("carried")).otherwise(F.col("before"))) \
        .filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("url")))
    drafts = F.coalesce(site_of(url_host(F.col("previous")))["draft_paths"], F.array(F.lit("/")))
    return steps.filter(F.array_contains(drafts, url_path(F.col("previous")))).select(
        "tab_id", "ts", session_id(F.col("tab_id"), F.col("previous")).alias("from_session"),
        session_id(F.col("tab_id"), F.col("url")).alias("to_session"))
