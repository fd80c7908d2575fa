"""Token alignment against the libraries on whole texts and a plain count of links."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilframe.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """By doc: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha), from whole-text encodings and sets of ends."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    sides = ta.Sides(A, B)
    docs, counts = [], Counter()
    for t in texts:
        groups = []
        if t:
            a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
            raw = (" " + t).encode()
            if b"".join(sides.a_bytes[i] for i in a) == raw == b"".join(sides.b_bytes[i] for i in b):
                ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in
                        ((sides.a_bytes, a), (sides.b_bytes, b))]
                low = [0, 0]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    high = [ends[0].index(e, low[0]) + 1, ends[1].index(e, low[1]) + 1]
                    groups.append((a[low[0]:high[0]], b[low[1]:high[1]]))
                    low = high
        docs.append(groups)
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
                    sum(counts[e] == most[e[0]] for e in links), sum(counts[e] for e in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def values(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def hard_texts():
    rng = random.Random(6)
    letters = "ab1 2  \n\t\x1c\x85\xa0'sét中я🙂!.▁\x00́�"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return rows + [None, "", " ", "  ", "a", " a", "a ", "a  ", "  a  b ", "\n a\n", "<|endoftext|> <s> </s><unk>", "<0x41>",
                   "x" * 3000, "ab12" * 2000, "中文字符" * 500, "2023-11-09 12345678901234", "don't  we'll", "same", "same",
                   "ⓐ" * 300, "a▁b", "🙂" * 200, "word " * 3000]


@pytest.mark.parametrize("frequent", [1 << 20, 50, 0])
def test_hard_texts(spark, frequent):
    texts = hard_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_best string")
    got = {r.doc_id: values(r) for r in ta.link_scores(df, A, B, keep=["doc_id"], frequent=frequent).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == want[i], repr(t)


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: values(r) for r in ta.query(spark, SF).collect()}
    want = brute([r.text for r in table])
    assert got == {r.doc_id: w for r, w in zip(table, want)}


def test_edges(spark):
    df = spark.createDataFrame([(None, "one"), (None, "one"), (1, None)], "doc_id long, text string")
    rows = ta.link_scores(df.withColumnRenamed("text", "t"), A, B, "t").collect()
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in rows) == [(0, 1, 2), (0, 1, 2), (1, 0, 0)]
    assert ta.link_scores(df.limit(0), A, B).count() == 0
    with pytest.raises(ValueError):
        ta.link_scores(df.withColumnRenamed("doc_id", "n_a"), A, B)


@pytest.mark.parametrize("seed", range(6))
def test_gallop_equals_linear_search(seed):
    rng = np.random.default_rng(seed)
    ends = np.unique(rng.integers(0, 500, rng.integers(0, 200)))
    keys = rng.integers(-5, 510, 300)
    guess = rng.integers(-3, len(ends) + 3, 300)
    assert ta.gallop(keys, guess, ends).tolist() == [int((ends < k).sum()) for k in keys]


def test_wide_groups_are_not_expanded(spark, monkeypatch):
    """Links of a group with many tokens of both sides are counted by distinct ids."""
    texts = hard_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = ta.aligned(df, A, B, keep=["doc_id"]).toArrow().to_batches()

    def counted():
        out = Counter()
        for k, b in enumerate(rows):
            for row, x, y, times in ta._links(b):
                for key in zip(row.tolist(), x.tolist(), y.tolist(), times.tolist()):
                    out[k, *key[:3]] += key[3]
        return out

    plain = counted()
    monkeypatch.setattr(ta, "WIDE", 1)
    monkeypatch.setattr(ta, "LINKS", 3)
    assert counted() == plain
