"""Moving vault entries along a page history, move after move.

A move empties a session at a time: what is in it goes to another session, which may itself be emptied later. The time a
session spends up to a move is a *stay*. The stay of the session moved to, at that time, is its parent; so stays form a
forest, and its roots are the sessions as they stand in the end. An entry begins in the stay of its session in which it
was made and goes up to the root, unless an entry that came before it to one of these stays has its value or its
placeholder: then it is dropped there.

The forest is resolved by as-of joins and pointer doubling. Only entries that share a value or a placeholder with another
one of the same root can meet a rival. Small trees of these are replayed one a group; in large ones they go up level by
level, all trees of a level at once.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.plans.staging import block_offsets, in_blocks, next_after, stage

CREATED = "created"
REPLAY_ROWS = 20_000


def _no_stay() -> Column:
    return F.lit(None).cast("bigint")


def stays(moves: DataFrame, at: str = "ts") -> DataFrame:
    """The stays that end, from moves ``from_session, to_session`` and their time ``at``: stay, from_session, to_session,
    at, parent (NULL where the parent has no end), depth (moves up to the root), root (a session) and arrived (time of the
    last of these moves).

    Moves to the same session, and moves without a session or a time, are none. Of several moves of one session at one
    time the one to the least session counts. The number of rounds is the logarithm of the longest chain.
    """
    real = moves.filter((F.col("from_session") != F.col("to_session")) & F.col(at).isNotNull()).groupBy(
        "from_session", F.col(at).alias("at")).agg(F.min("to_session").alias("to_session"))
    ended = stage(real.withColumn("stay", F.monotonically_increasing_id()))
    linked = next_after(
        ended.withColumn("session", F.col("to_session")), _departures(ended), ["session"], "at", F.col("stay"), "parent",
        same_time=False).drop("session")
    state = stage(linked.withColumns({
        "jump": F.col("parent"), "depth": F.lit(1), "root": F.col("to_session"), "arrived": F.col("at")}))
    while state.filter("jump IS NOT NULL").limit(1).count():
        ahead = state.select(F.col("stay").alias("jump"), F.col("jump").alias("beyond"), F.col("depth").alias("more"),
                             F.col("root").alias("end"), F.col("arrived").alias("later"))
        state = stage(state.join(ahead, "jump", "left").select(
            *ended.columns, "parent", F.col("beyond").alias("jump"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("end", "root").alias("root"),
            F.coalesce("later", "arrived").alias("arrived")))
    return state.drop("jump")


def _departures(ended: DataFrame) -> DataFrame:
    return ended.select(F.col("from_session").alias("session"), "at", "stay")


def _below(ended: DataFrame, own: DataFrame) -> DataFrame:
    """Sums of ``own`` (stay, n) over each stay and all stays below it, by doubling the reach."""
    state = stage(ended.select("stay", F.col("parent").alias("jump")).join(own, "stay", "left").select(
        "stay", "jump", F.coalesce("n", F.lit(0)).alias("n")))
    while state.filter("jump IS NOT NULL").limit(1).count():
        lower = state.filter("jump IS NOT NULL").groupBy(F.col("jump").alias("stay")).agg(F.sum("n").alias("lower"))
        ahead = state.select(F.col("stay").alias("jump"), F.col("jump").alias("beyond"))
        state = stage(state.join(lower, "stay", "left").join(ahead, "jump", "left").select(
            "stay", F.col("beyond").alias("jump"), (F.col("n") + F.coalesce("lower", F.lit(0))).alias("n")))
    return state.select("stay", "n")


def _survivors(rows: DataFrame) -> DataFrame:
    """The rows that remain when those of each ``place`` come in the order of ``rank`` and one that finds its value or its
    placeholder taken goes. A row that is the first of its place with its value and with its placeholder stays; those it
    shuts out leave; the others are tried again."""
    rows, kept = stage(rows), None
    while True:
        firsts = rows
        for key in ("original", "placeholder"):
            least = rows.groupBy("place", key).agg(F.min("rank").alias("least"))
            firsts = firsts.join(least, ["place", key]).filter(F.col("rank") == F.col("least")).drop("least")
        won = stage(firsts.select(*rows.columns))
        kept = won if kept is None else kept.unionByName(won)
        for key in ("original", "placeholder"):
            rows = rows.join(won.select("place", key), ["place", key], "left_anti")
        rows = stage(rows.select(*won.columns))
        if not rows.limit(1).count():
            return kept


def _contest(rivals: DataFrame, ended: DataFrame) -> DataFrame:
    """Entries that are dropped: entry, stay (in which; NULL for a root) and via (the stay whose end brought it there; NULL
    for one made there).

    ``rivals``: entry, original, placeholder, stay, depth, root, created, seq.
    """
    def placed(rows: DataFrame, arrived: Column, made: bool) -> DataFrame:
        # Arrivals come before entries made at the same time; those of one move were together before.
        return rows.withColumns({
            "place": F.when(F.col("stay").isNull(), F.struct(F.col("root"), _no_stay().alias("stay"))).otherwise(
                F.struct(F.lit(None).cast("string").alias("root"), F.col("stay"))),
            "rank": F.struct(arrived.alias("at"), F.lit(made).alias("made"), "created", "seq", "entry")})

    live = stage(placed(rivals.withColumn("via", _no_stay()), F.col("created"), True))
    upwards = ended.select("stay", "at", "parent")
    lost = None
    for depth in range(live.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = live.filter(F.col("depth") == depth)
        left = _survivors(here)
        gone = here.join(left.select("entry"), "entry", "left_anti").select("entry", "stay", "via")
        lost = gone if lost is None else lost.unionByName(gone)
        if depth:
            up = left.drop("via", "place", "rank").join(upwards, "stay").withColumns({
                "via": F.col("stay"), "stay": F.col("parent"), "depth": F.col("depth") - 1})
            up = placed(up, F.col("at"), False)
            live = stage(live.filter(F.col("depth") < depth).unionByName(up.select(*live.columns)))
    return stage(lost)


def _order(value):
    """A key that sorts a value as Spark does: nulls first, structs field by field."""
    if value is None:
        return (0,)
    return (1, *map(_order, value.values())) if isinstance(value, dict) else (1, value)


def _replay(rivals: pa.Table, ended: pa.Table) -> pa.Table:
    """:func:`_contest` for one root: its stays in the order of their ends."""
    waiting, lost = defaultdict(list), []
    for r in rivals.to_pylist():
        made = _order(r["created"])
        waiting[r["stay"]].append(((made, True, made, _order(r["seq"]), r["entry"]), r, None))

    def left(place):
        values, tokens, kept = set(), set(), []
        for rank, r, via in sorted(waiting.pop(place, []), key=lambda x: x[0]):
            value, token = r["original"], r["placeholder"]
            if (value is not None and value in values) or (token is not None and token in tokens):
                lost.append((r["entry"], place, via))
            else:
                values.add(value)
                tokens.add(token)
                kept.append((rank, r))
        return kept

    for at, stay, parent in sorted((_order(s["at"]), s["stay"], s["parent"]) for s in ended.to_pylist()
                                   if s["stay"] is not None) if len(rivals) else ():
        waiting[parent] += [((at, False, *rank[2:]), r, stay) for rank, r in left(stay)]
    left(None)
    columns = list(zip(*lost)) or [[], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["entry", "stay", "via"])


def _dropped(rivals: DataFrame, ended: DataFrame) -> DataFrame:
    """What :func:`_contest` gives. A root of at most ``REPLAY_ROWS`` rivals and stays is replayed in one go, all such roots
    at once; larger ones, however large, go up level by level over all tasks."""
    counted = rivals.select("root").unionByName(ended.select("root")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = stage(counted.filter(F.col("n") > REPLAY_ROWS).select("root"))  # fewer than one in REPLAY_ROWS
    small = [x.join(F.broadcast(large), "root", "left_anti") for x in (rivals, ended.select("root", "stay", "at", "parent"))]
    lost = small[0].groupBy("root").cogroup(small[1].groupBy("root")).applyInArrow(
        _replay, "entry long, stay long, via long")
    if large.limit(1).count():
        lost = lost.unionByName(_contest(rivals.join(F.broadcast(large), "root", "left_semi"), ended))
    return stage(lost)


def _renumbered(entries: DataFrame) -> DataFrame:
    """``seq`` from 1 by time of arrival, then of creation, in each session; a large session is spread over blocks."""
    order = ["arrived", "made", "created", "seq", "entry"]
    blocks = in_blocks(entries, ["session_id", *order])
    within = Window.partitionBy("session_id", "block").orderBy(*order)
    return blocks.join(block_offsets(blocks, ["session_id"], F.lit(1)), ["session_id", "block"]).withColumn(
        "seq", (F.col("offset") + F.row_number().over(within)).cast("bigint"))


def follow_moves(vault: DataFrame, moves: DataFrame, at: str = "ts",
                 created: str = CREATED) -> tuple[DataFrame, DataFrame]:
    """The vault after all ``moves`` (``from_session, to_session`` and their time ``at``) in the order of time, and a
    report ``from_session, to_session, <at>, migrated, dropped``, one row for each move that counts (see :func:`stays`).

    ``vault`` has the entries' columns and ``created``, of the same type as ``at``. An entry made at the time of a move of
    its session goes with it; one that arrives at such a time does not. Entries come to a session in the order of their
    arrival, those made there after those that arrive at the same time; what is left is settled by ``seq``. One that finds
    its value or its placeholder taken is dropped. Entries without a time of creation stay where they are and come first.
    Sessions that no move leads to in the end keep their ``seq``; the others are numbered anew by arrival.
    """
    ended = stays(moves, at)
    made = stage(vault.withColumnRenamed(created, "created").withColumn("entry", F.monotonically_increasing_id()))
    began = next_after(
        made.withColumns({"session": F.col("session_id"), "at": F.col("created")}), _departures(ended), ["session"], "at",
        F.col("stay"), "stay", same_time=True).withColumn("stay", F.when(F.col("created").isNotNull(), F.col("stay")))
    roots = ended.select("root").distinct().withColumn("reached", F.lit(True))
    entries = began.join(ended.select("stay", "depth", "root", "arrived"), "stay", "left").select(
        *made.columns, "stay", F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("root", "session_id").alias("root"), F.coalesce("arrived", "created").alias("arrived"),
        F.col("depth").isNull().alias("made"))
    entries = stage(entries.join(roots, "root", "left"))

    # Who can meet a rival, from counts by root and value and by root and placeholder.
    moving = entries.filter("reached")
    for key in ("original", "placeholder"):
        shared = moving.groupBy("root", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            "root", key, F.lit(True).alias(f"same_{key}"))
        moving = moving.join(shared, ["root", key], "left")
    moving = stage(moving)
    contested = F.coalesce("same_original", "same_placeholder", F.lit(False))
    lost = _dropped(moving.filter(contested).select(
        "entry", "original", "placeholder", "stay", "depth", "root", "created", "seq"), ended)

    kept = moving.join(lost.select("entry"), "entry", "left_anti").withColumn("session_id", F.col("root"))
    columns = [c if c != created else F.col("created").alias(created) for c in vault.columns]
    after = entries.filter("reached IS NULL").select(*columns).unionByName(_renumbered(kept).select(*columns))

    starts = moving.filter("stay IS NOT NULL").groupBy("stay").agg(F.count(F.lit(1)).alias("n"))
    ends = lost.filter("stay IS NOT NULL").groupBy("stay").agg((-F.count(F.lit(1))).alias("n"))
    had = _below(ended, starts.unionByName(ends).groupBy("stay").agg(F.sum("n").alias("n")))
    refused = lost.filter("via IS NOT NULL").groupBy(F.col("via").alias("stay")).agg(F.count(F.lit(1)).alias("dropped"))
    dropped = F.coalesce("dropped", F.lit(0)).cast("bigint")
    report = ended.join(had, "stay").join(refused, "stay", "left").select(
        "from_session", "to_session", F.col("at").alias(at), (F.col("n") - dropped).cast("bigint").alias("migrated"),
        dropped.alias("dropped"))
    return after, report
