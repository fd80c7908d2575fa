"""N-gram join against brute force."""

import random
import re

import pytest

from veilframe.llm import ngram_join as nj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows, percent=75):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, copies=30):
    """Groups of near copies whose edits differ, texts that share a passage, short texts, copies."""
    rng = random.Random(seed)
    text = lambda n: [f"W{rng.randrange(4000)}" for _ in range(n)]
    passage, rows = text(60), []
    for _ in range(groups):
        base = text(rng.randint(20, 120))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 22))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(900)}"
            rows.append(own)
    rows += [passage + text(rng.randint(5, 40)) for _ in range(60)]
    rows += [text(rng.randint(1, 8)) for _ in range(30)] + [["one", "two"]] * 3 + [["ONE", "Two"]]
    rows = [(i, rng.choice([" ", "\n "]).join(w)) for i, w in enumerate(rows)]
    rows += [(5000 + i, rows[i * 7][1]) for i in range(20)]
    rows += [(9000, None), (9001, ""), (9002, " \t"), (9003, "long " * 30_000), (9004, "long " * 30_001)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows],
                                 "doc_id long, text string, node string, component long, t long").repartition(4)


@pytest.mark.parametrize("seed,short", [(1, 8), (2, 2)])
def test_equal_to_brute_force(spark, monkeypatch, seed, short):
    monkeypatch.setattr(nj, "SHORT", short)
    monkeypatch.setattr(nj, "GROUP", 7)
    rows = corpus(seed)
    got = sorted((r.doc_id, r.n_shingles, r.component) for r in nj.ngram_join(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_other_threshold_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST_BYTES", 0)
    rows = corpus(5, groups=4, copies=15)
    got = sorted((r.doc_id, r.n_shingles, r.component) for r in nj.ngram_join(frame(spark, rows), 60).collect())
    assert got == brute(rows, 60)


def test_nulls_repeats_and_empty(spark):
    text = "a b c d e f g"
    rows = [(3, text), (3, text), (None, text), (None, None), (1, "x"), (2, "X"), (7, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in nj.ngram_join(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 0, None), (1, 1, 1), (2, 1, 1), (7, 0, 7)],
                         key=repr)
    assert nj.ngram_join(frame(spark, []).limit(0)).count() == 0


def test_hot_tokens_are_a_share_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(nj, "FLUSH_BYTES", 4_000)
    group = lambda k: " ".join(f"g{k}w{j}" for j in range(8))
    rows = [(k, f"{group(k)} own{k}x{i} of the same line in every text") for k in range(120) for i in range(20)]
    texts = spark.createDataFrame(rows, "k long, __t string").repartitionByRange(4, "k")
    hot = nj.hot_tokens_of(texts, 5, len(rows))
    # Each batch holds a few groups only, whose tokens are frequent there; only the line's are so in all texts.
    assert len(hot) == 3


def test_first_tokens_are_rare_ones(spark):
    """Lines that a few unrelated texts share do not make candidates of them."""
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(12))
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    rows = [(i, f"{own(i)} {line(i % 40)}") for i in range(240)]
    texts = spark.createDataFrame(rows, "__d long, __t string").repartition(4)
    counts = nj.token_counts_of(texts, 5)
    assert counts.sum() == sum(len(s) for s in sets_of(rows))
    none = spark.sparkContext.broadcast(b"")

    def several(order):
        emit = nj._emit(5, 75, 32, 31, none, spark.sparkContext.broadcast(order.tobytes()))
        found = texts.mapInArrow(emit, "key long, blob binary").filter("key >= 0").groupBy("key").applyInArrow(
            nj._postings(75), "kind int, blob binary")
        return sum(len(r.blob) // 16 for r in found.filter("kind = 1").collect())

    # Without counts (all equal) the order is by hash alone.
    assert several(counts * 0) > 500 and several(counts) == 0
