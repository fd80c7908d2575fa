"""Decontamination, embeddings, URLs and shards."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import decontam, embedding_dedup as ed, sharding, url_filter as uf

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pairs = decontam.common_subsequence(np.array(a), np.array(b))
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_finds_every_verbatim_item(spark):
    docs = {r.doc_id: " " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: " " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for i, k in items.items() for d, t in docs.items() if k in t}
    rows = decontam.query(spark, SF).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in rows}
    # Whatever else is found shares most of the item's words.
    for r in rows:
        item = words(items[r.item_id])
        assert len(set(item) & set(docs[r.doc_id].split())) >= 0.5 * len(set(item))


@pytest.mark.parametrize("every", [6, 4])
def test_paraphrases_and_clean_texts(spark, every):
    """With every fourth word changed no four words in a row are left: only the latent search can find the passage."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ado", "eri", "ula", "ono", "ith", "art", "ews")]
    text = lambda n: [rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(n)]
    bench = [text(rng.randint(20, 150)) for _ in range(20)]
    rows, leaked = [], set()
    for i in range(60):
        body = text(rng.randint(50, 400))
        if i % 3 == 0:
            item = list(bench[i % 20])
            for k in range(0, len(item), every):
                item[k] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = item
            leaked.add(i)
        rows.append((i, " ".join(body).upper() + ".", "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(bench)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()}
    assert {d for d, _ in found} == leaked and all((d, d % 20) in found for d in leaked)
    kept = decontam.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60)) - leaked


def test_decontam_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, item), (3, item), (3, item), (4, "other words " * 20_000)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(3, 1), (3, None), (None, 1), (None, None)], key=repr)
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.decontaminated(docs, bench.limit(0)).count() == 6


def test_large_benchmark_loses_no_verbatim_copy(spark):
    rng = random.Random(11)
    docs = [words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = [d for d in docs if len(d) >= 80]
    bench = []
    while len(bench) < 900:  # far more passages than the latent space has directions
        d, n = rng.choice(docs), rng.randint(15, 59)
        at = rng.randrange(len(d) - n)
        bench.append(d[at:at + n])
    rows = []
    for i, item in enumerate(bench):
        body = rng.choice(docs)[:300]
        at = rng.randrange(len(body))
        rows.append((i, " ".join(body[:at] + item + body[at:])))
    pasted = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(bench)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(pasted, benchmark).collect()}
    assert [i for i in range(900) if (i, i) not in found] == []
    short = spark.createDataFrame([(1, "quux zyzzyva"), (2, "the of")], "item_id long, text string")
    texts = spark.createDataFrame([(k, "the words of the " + "quux zyzzyva " * (k == 3) + "of the of")
                                   for k in range(40)], "doc_id long, text string")
    assert (3, 1) in {(r.doc_id, r.item_id) for r in decontam.contaminated(texts, short).collect()}


def brute_links(rows, cosine):
    links, parent = {}, {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i, (a, u, m) in enumerate(rows):
        for b, v, n in rows[:i]:
            if m == n and m is not None and usable(u) and usable(v) and len(u) == len(v):
                x, y = np.array(u, float), np.array(v, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {a: (links.get(a, 0), find(a)) for a, _, _ in rows}


@pytest.mark.parametrize("driving", [1, 3])
def test_embeddings_equal_brute_force(spark, driving, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 37)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(30):
        centre = rng.standard_normal(16)
        for _ in range(8):
            rows.append(((centre + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.12, 0.2])).tolist(), i % 3))
    rows += [([0.0] * 16, 1), (None, 1), ([], 1), ([float("nan")] * 16, 1), ([1.0] * 15 + [None], 1),
             (rows[0][0], None), (rows[0][0][:8], 0), ([2 * x for x in rows[0][0]], rows[0][1])]
    rows = [(i, v, m) for i, (v, m) in enumerate(rows)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), v, m, "x") for i, v, m in rows],
                               "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: (r.n_links, r.component) for r in ed.embedding_dedup(df, driving=driving).collect()}
    assert got == brute_links(rows, 0.98)
    assert ed.embedding_dedup(df.limit(0)).count() == 0


def test_recall_is_calibrated():
    rng = np.random.default_rng(3)
    window = ed.driving_window(0.98, 4) / ed._spread(0.98)
    least = ed.least_collisions(2.0, ed.LINES)
    z = np.abs(rng.standard_normal((200_000, 4 + ed.LINES)))
    found = (z[:, :4] <= window).all(1) & ((z[:, 4:] <= 2.0).sum(1) >= least)
    assert found.mean() > 0.9995 and least > ed.LINES // 2


URLS = ["http://www.Example.com/en/1?x", "https://example.com/en/2", "http://a.example.com/fr/1", "http://x.net/es/",
        "http://x.net/fr", "http://x.net/fr/#t", "http://notcom/en/", "http://com/", "https://com", "nothing", None, "",
        "a://b://c/d", "http://ŞCOM.com/É?q", "http://h?/en/", "x://WWW.EXAMPLE.COM/en/\nnext", "http://best-casino.org/1",
        "http://gardens.org/en/3", "http://" + "long" * 20_000 + ".org/"]


def verdict_of(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    at = cut.start() if cut else len(rest)
    host = rest[:at].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.split(r"[?#]", rest[at:])[0]
    fits = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def test_urls(spark):
    model = uf.train(uf.labelled_urls(spark))
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], None)],
                               "page_id long, url string, score_ string")
    rows = uf.url_filter(df, uf.RULES, model).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule = verdict_of(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        want = rule.verdict if rule else "block" if r.score > 0 else "allow"
        assert r.verdict == want
    by_url = {r.url: r.verdict for r in rows}
    assert by_url["http://best-casino.org/1"] == "block" and by_url["http://gardens.org/en/3"] == "allow"
    assert by_url[None] == by_url[""] == "allow"
    assert uf.url_filter(df.limit(0), uf.RULES, model).count() == 0
    with pytest.raises(ValueError):
        uf.url_filter(df.withColumnRenamed("score_", "score"), uf.RULES, model)


def test_url_model_separates_its_table_and_leaves_most_pages(spark):
    model = uf.train(uf.labelled_urls(spark))
    scored = uf.url_filter(uf.labelled_urls(spark), (), model).collect()
    assert all((r.verdict == "block") == bool(r.label) for r in scored)
    one = uf.train(uf.labelled_urls(spark).filter("label = 0"))
    assert one.bias < 0 and uf.train(uf.labelled_urls(spark).limit(0)).bias < 0
    pages = uf.query(spark, SF)
    bad = F.regexp_like("host", F.lit("casino|pills|bets|adult|spam"))
    judged = pages.filter("rule IS NULL").groupBy(bad.alias("bad"), "verdict").count().collect()
    share = {b: sum(r["count"] for r in judged if r.bad == b and r.verdict == "block") / max(
        1, sum(r["count"] for r in judged if r.bad == b)) for b in (True, False)}
    assert share[True] > 0.8 and share[False] < 0.1


def test_url_plan_is_native(spark):
    plan = uf.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(sharding.query(spark, SF).collect(), key=lambda r: (r.shard, r.slot))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.doc_id for r in rows] == sorted(texts)
    sums, at = {}, {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.slot == at.get(r.shard, 0)
        at[r.shard] = r.slot + 1
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
    share, largest = sum(sums.values()) / 40, max(r["size"] for r in rows)
    assert set(sums) == set(range(40)) and all(abs(v - share) <= largest for v in sums.values())


def test_shard_edges(spark, tmp_path):
    df = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "x" * 100_000, "c"), (2, "y", None)] + [
        (5, "same", "s")] * 200, "doc_id long, text string, __size string")
    rows = sharding.byte_shards(df, 3, keep=["__size"]).collect()
    assert len(rows) == 204 and sum(r["size"] for r in rows) == 100_001 + 800 + 16 * 204
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.byte_shards(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.byte_shards(df.withColumnRenamed("__size", "slot"), 3, keep=["slot"])
    sharding.write_shards(df, 3, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 204
