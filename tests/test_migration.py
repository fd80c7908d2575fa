"""Entries that follow a page history, against a replay event by event."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import migration
from veilframe.plans.staging import stage

SCHEMA = "session_id string, seq bigint, original string, placeholder string, type string, created int"


def replay(vault, moves):
    """Sessions after the moves, as lists in order, and {(from, at): (migrated, dropped)}."""
    first = {}
    for a, b, t in moves:
        if a is not None and b is not None and t is not None and a != b:
            first[a, t] = min(first.get((a, t), b), b)
    state, report = {}, {}

    def put(session, entries):
        held, n = state.setdefault(session, []), 0
        for e in entries:
            if all(e[2] != x[2] and e[3] != x[3] for x in held):
                held.append(e)
                n += 1
        return n

    for e in sorted((e for e in vault if e[5] is None), key=lambda e: e[1]):
        state.setdefault(e[0] + "*", []).append(e)  # stays for good
    for t in sorted({t for _, t in first} | {e[5] for e in vault if e[5] is not None}):
        # An arrival at this time is not sent on by a move at the same time, an entry made now is.
        taken = {a: state.pop(a, []) for a, at in sorted(first) if at == t}
        fresh = {}
        for e in sorted((e for e in vault if e[5] == t), key=lambda e: e[1]):
            fresh.setdefault(e[0], []).append(e)
        for a, held in taken.items():
            state[a] = held
            put(a, fresh.pop(a, []))
            taken[a] = state.pop(a)
        arrivals = {}
        for a, held in taken.items():
            arrivals.setdefault(first[a, t], []).append((a, held))
        for b, groups in arrivals.items():
            assert len(groups) == 1, "the test's moves give a target one arrival at a time"
            n = put(b, groups[0][1])
            report[groups[0][0], t] = (n, len(groups[0][1]) - n)
        for a, entries in fresh.items():
            put(a, entries)
    return state, report


def compare(spark, vault, moves):
    v = spark.createDataFrame(vault, SCHEMA)
    m = spark.createDataFrame(moves, "from_session string, to_session string, ts int")
    after, report = migration.follow_moves(v, m)
    state, told = replay(vault, moves)
    want = sorted((s.rstrip("*"), e[2], e[3]) for s, held in state.items() for e in held)
    rows = after.collect()
    assert sorted((r.session_id, r.original, r.placeholder) for r in rows) == want
    assert {(r.from_session, r.ts): (r.migrated, r.dropped) for r in report.collect()} == told
    return rows


def test_chain_reused_draft_and_conflicts(spark):
    vault = [("/", 1, "a", "[E_1]", "E", 1), ("/", 2, "b", "[E_2]", "E", 2), ("/new", 1, "b", "[E_1]", "E", 3),
             ("/c/1", 1, "c", "[E_2]", "E", 4), ("/", 1, "a", "[E_1]", "E", 20), ("/", 2, "d", "[E_9]", "E", 21),
             ("/x", 5, "z", "[E_1]", "E", 2), ("/x", 7, "y", "[E_2]", "E", None)]
    moves = [("/", "/new", 10), ("/new", "/c/1", 11), ("/", "/c/1", 25), ("/c/9", "/c/10", 3), ("/q", "/q", 3), (None, "/a", 4)]
    rows = compare(spark, vault, moves)
    assert {r.session_id for r in rows} == {"/c/1", "/x"}
    assert [r.original for r in sorted((r for r in rows if r.session_id == "/c/1"), key=lambda r: r.seq)] == ["c", "b", "d"]
    assert {r.seq for r in rows if r.session_id == "/x"} == {5, 7}


@pytest.mark.parametrize("seed, rows", [(0, 20_000), (1, 20_000), (2, 0), (3, 60)])
def test_random_histories(spark, monkeypatch, seed, rows):
    """Two drafts that are left again and again, and chats that are met again: long chains and nested conflicts; all trees
    replayed one a group, all level by level, or some either way."""
    monkeypatch.setattr(migration, "REPLAY_ROWS", rows)
    rng = random.Random(seed)
    vault, moves = [], []
    for tab in range(12):
        place, held = "/", {}  # what was made in a session since it was last left is told apart, as by masking
        for t in range(0, 60, 2):
            for k in range(rng.randint(0, 2)):
                value, token = f"v{rng.randint(0, 8)}", f"[E_{rng.randint(1, 8)}]"
                if not {value, token} & held.setdefault(place, set()):
                    held[place] |= {value, token}
                    vault.append((f"{tab}{place}", k, value, token, "E", t))
            target = rng.choice(["/", "/new", "/c1", "/c2"])
            if place in ("/", "/new") and target != place:
                moves.append((f"{tab}{place}", f"{tab}{target}", t + 1))
                held.pop(place, None)
            place = target
    compare(spark, vault, moves)


def test_edges(spark):
    v = spark.createDataFrame([("a", 1, "x", "[E_1]", "E", 1)], SCHEMA)
    m = spark.createDataFrame([("a", "b", 1)], "from_session string, to_session string, ts int")
    after, report = migration.follow_moves(v, m)
    assert [(r.session_id, r.seq, r.created) for r in after.collect()] == [("b", 1, 1)]
    assert [tuple(r) for r in report.collect()] == [("a", "b", 1, 1, 0)]
    after, report = migration.follow_moves(v, m.limit(0))
    assert [r.session_id for r in after.collect()] == ["a"] and report.count() == 0
    assert migration.follow_moves(v.limit(0), m)[0].count() == 0
    renamed = v.withColumnRenamed("created", "made_at")
    assert migration.follow_moves(renamed, m, created="made_at")[0].columns == renamed.columns


def test_hot_session_spreads(spark):
    """A session with nearly all entries is cut into blocks: no task of the last stage holds it."""
    n = 20_000
    v = spark.range(n).select(
        F.lit("a").alias("session_id"), F.col("id").alias("seq"), F.concat(F.lit("v"), "id").alias("original"),
        F.concat(F.lit("[E_"), F.col("id").cast("string"), F.lit("]")).alias("placeholder"), F.lit("E").alias("type"),
        F.col("id").cast("int").alias("created"))
    m = spark.createDataFrame([("a", "b", n)], "from_session string, to_session string, ts int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        after = stage(migration.follow_moves(v, m)[0].withColumn("part", F.spark_partition_id()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = after.groupBy("part").count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < n / 2
    assert after.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first()[:] == (1, n, n)
