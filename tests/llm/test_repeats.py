"""Substring and suffix-array dedup against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import repeats
from veilframe.llm.substring_dedup import substring_dedup
from veilframe.llm.suffix_dedup import by_suffix_array, suffix_dedup
from veilframe.llm.suffix_groups import suffix_arrays
from veilframe.plans.staging import stage

SCHEMA = "doc_id long, text string, key string, blob string, n_symbols long"


def brute(rows, split, join, width):
    """(id, n, removed, spans, kept) of each row."""
    cut = [(d if d is not None else 1 << 62, split(t or "")) for d, t in rows]
    first = {}
    for d, s in cut:
        for i in range(len(s) - width + 1):
            k = tuple(s[i:i + width])
            first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), (e, s) in zip(rows, cut):
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if first[tuple(s[i:i + width])] < e:
                gone[i:i + width] = [True] * width
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(s), sum(gone), spans, join([x for x, g in zip(s, gone) if not g])))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_symbols, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "я", "x" * 40]
    text = lambda n: rng.choice([" ", "\n", "\t\t"]).join(rng.choice(vocabulary) for _ in range(n))
    common = text(60)
    rows = [(i, text(rng.randint(0, 200))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(60 + i, text(20) + " " + common + " " + text(rng.randint(0, 30))) for i in range(30)]
    for i in range(30):  # copies with edits
        words = rows[i][1].split()
        for _ in range(3):
            if words:
                words[rng.randrange(len(words))] = "edit"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "   \n"), (203, "a " * 300), (204, "a " * 300), (205, "z" * 400),
             (206, "z" * 400), (207, rows[3][1] + rows[3][1]), (None, rows[60][1]), (None, rows[60][1]),
             (210, "long " + "lorem ipsum dolor " * 4000), (211, "lorem ipsum dolor " * 4000)]
    rows += [rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", "b", 7) for d, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("flush", [repeats.FLUSH_BYTES, 2_000])
def test_words_equal_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(repeats, "FLUSH_BYTES", flush)
    rows = corpus()
    want = brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), lambda s: " ".join(s).encode(), 50)
    assert result(substring_dedup(frame(spark, rows))) == want


def test_bytes_equal_brute_force(spark):
    rows = corpus(8)
    assert result(suffix_dedup(frame(spark, rows))) == brute(rows, lambda t: list(t.encode()), bytes, 50)


@pytest.mark.parametrize("shared", [None, 7])
def test_different_texts_under_one_id(spark, shared):
    rng = random.Random(4)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    first = text(150)
    near = first.split()
    near[70] = "edit"
    rows = [(1, first), (shared, first), (shared, text(200)), (shared, " ".join(near)), (shared, text(150)),
            (9, text(90)), (9, text(60) + " " + first), (shared, first)]
    want = brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), lambda s: " ".join(s).encode(), 50)
    assert result(substring_dedup(frame(spark, rows))) == want
    want = brute(rows, lambda t: list(t.encode()), bytes, 50)
    assert result(suffix_dedup(frame(spark, rows))) == want


def test_spans_and_carried_columns(spark):
    df = frame(spark, [(1, "x " * 60), (2, "start " + "x " * 60 + "end")])
    rows = {r.doc_id: r for r in substring_dedup(df, carry=["key", "blob"]).collect()}
    assert [tuple(s) for s in rows[2].spans] == [(1, 61)] and rows[2].kept == b"start end" and rows[2].key == "k"
    with pytest.raises(ValueError):
        substring_dedup(df, carry=["n_symbols"])


def test_empty_table(spark):
    assert substring_dedup(frame(spark, []).limit(0)).count() == 0
    assert suffix_dedup(frame(spark, []).limit(0)).count() == 0


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(1)
    for _ in range(150):
        texts = [rng.integers(0, rng.integers(1, 5), rng.integers(1, 40)) for _ in range(rng.integers(1, 6))]
        texts.append(np.zeros(30, int))
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        array = suffix_arrays(np.concatenate(texts), starts, sizes)
        for t, s, n in zip(texts, starts, sizes):
            assert (array[s:s + n] - s).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_long_anchor_groups_are_solved_alike(monkeypatch):
    rng = np.random.default_rng(2)
    pool = rng.integers(97, 99, (6, 80)).astype(np.uint8)
    spans = np.zeros(40, repeats.SPAN)
    spans["d"], spans["a"], spans["n"] = rng.integers(0, 9, 40), rng.integers(1, 4, 40), 31
    data = np.concatenate([pool[k] for k in rng.integers(0, 6, 40)])
    starts = np.arange(40) * 80
    by_array = by_suffix_array(spans, data, starts, 50)
    monkeypatch.setattr("veilframe.llm.suffix_dedup.ARRAY_SYMBOLS", 10)
    assert by_array.any() and (by_array == by_suffix_array(spans, data, starts, 50)).all()


@pytest.mark.parametrize("most", [100, 1_000, 1 << 20])
def test_arrays_decide_every_window_without_hashes(monkeypatch, most):
    """All stretches of short and long anchors go through suffix arrays; no hash settles a window or leaves it out."""
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 256, (30, 90)).astype(np.uint8)
    pool[10:20, 20:] = pool[:10, 20:]  # differ at one end only
    pool[20:, :60] = pool[:10, 7:67]  # the same bytes at another place
    stretches, spans = [], np.zeros(150, repeats.SPAN)
    for k in range(len(spans)):
        spans[k] = (rng.integers(0, 40), rng.choice([5, 5, 5, 6, 7 + k]), 0, rng.integers(1, 34))
        stretches.append(pool[rng.integers(0, 30)][:spans["n"][k] + 49])
    data = np.concatenate(stretches)
    starts = np.cumsum([0] + [len(x) for x in stretches[:-1]])
    least, windows = {}, []
    for s, x in zip(spans, stretches):
        for i in range(s["n"]):
            windows.append((s["a"], x[i:i + 50].tobytes(), s["d"]))
            least[windows[-1][:2]] = min(s["d"], least.get(windows[-1][:2], 99))
    given = []
    monkeypatch.setattr("veilframe.llm.suffix_dedup.ARRAY_SYMBOLS", most)
    monkeypatch.setattr("veilframe.llm.suffix_dedup.suffix_arrays",
                        lambda symbols, *rest: given.append(len(symbols)) or suffix_arrays(symbols, *rest))
    monkeypatch.setattr("veilframe.llm.rolling.stretch_hash", lambda prefixed, base, starts, ends: np.zeros(
        len(starts), np.uint64))
    got = by_suffix_array(spans, data, starts, 50)
    want = [d > least[a, w] for a, w, d in windows]
    assert got.tolist() == want and any(want) and not all(want)
    assert sum(given) == (spans["n"] + 50).sum()
    assert len(by_suffix_array(spans[:0], data[:0], starts[:0], 50)) == 0


def test_written_stages_leave_no_shuffle_files(spark):
    """The runs' shuffle is larger than the texts; it must not lie there while the later steps write theirs."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {n for n in re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" "))}
    before = names()
    made = stage(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count())
    assert made.count() == 7
    deadline = time.time() + 20
    while (left := len(names() - before)) > 1 and time.time() < deadline:
        time.sleep(0.5)
    assert left <= 1  # that of the count
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_one_large_batch_is_settled_in_parts(monkeypatch):
    """What the first step holds does not grow with the rows of an Arrow batch or the length of a text."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 300_000, np.uint8)).decode() for _ in range(4)] + ["ab" * 400_000]
    held, settle = [], repeats._settle
    monkeypatch.setattr(repeats, "_settle", lambda runs: held.append(len(runs)) or settle(runs))
    monkeypatch.setattr(repeats, "FLUSH_RUNS", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["d", "t"])
    out = list(repeats._emit(repeats.BYTES, 50, 4, 5, False)([batch]))
    assert len(held) >= 4 and out and max(held) < sum(held) / 3
