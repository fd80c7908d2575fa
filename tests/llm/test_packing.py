"""Packing against the tokenizers library, a plain best fit and the laws of the result."""

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilframe.llm import packing
from veilframe.llm.packing import Piece

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def laws(rows, size=4096):
    """Each document's pieces cover it once, sequences have no gaps; returns the share of padding."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for found in docs.values():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert {r.doc_tokens for r in found} == {at}
    padding = total = 0
    for found in seqs.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        total += at
        if at & (at - 1):
            padding += size - at
    return padding / max(total, 1)


def test_query_holds_the_library_ids(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = Tokenizer.from_file(PATH)
    ids = {d: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4") for d, t in texts.items()}
    rows = packing.query(spark, SF).collect()
    assert laws(rows) < 0.01
    assert {r.doc_id: r.doc_tokens for r in rows} == {d: len(i) for d, i in ids.items()}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())


def hard_texts():
    rng = random.Random(5)
    letters = "abΣςσ  \n\t\r\x0b\x1c\x85'sét中я🙂1!.  ́İß\x00�"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return rows + ["", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "don't WE'LL I 'M", "x" * 5000,
                   "ab" * 9000, " ́a", "ΟΔΟΣ ΟΔΟΣ", "a\n\nb", "word " * 20_000, "中文" * 4000]


def test_chunks_equal_whole_texts():
    texts, library = hard_texts(), Tokenizer.from_file(PATH)
    found = packing.Ids(PATH, True)
    for _ in range(2):
        for t, got in zip(texts, found.of(texts)):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert packing.Ids(PATH, False).of(texts) == found.of(texts)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "same"), (3, "same"), (4, "word " * 30_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k0 string")
    got = packing.packed(df, PATH, size=64, end=2, apart=True).collect()
    assert sum(r.length for r in got) == 1 + 1 + 3 + 2 + 2 + 30_001
    assert {r.k0 for r in got} == {"x"} and max(r.length for r in got) == 64
    assert packing.packed(df.limit(0), PATH).count() == 0
    assert packing.packed(df.filter("text = ''"), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df.withColumnRenamed("k0", "offset"), PATH)


def test_sequences_are_padded(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.packed(df, PATH, size=1000, end=2, keep=["doc_id"], apart=True)
    total = {}
    for r in pieces.collect():
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    found = packing.sequences(pieces, 1000, pad=7).collect()
    assert len(found) == len(total)
    for r in found:
        n = total[r.sequence_id]
        ids = np.frombuffer(r.ids, "<u4")
        assert sum(r.lengths) == n and len(ids) == (n if n & (n - 1) == 0 else 1000) and (ids[n:] == 7).all()


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_equals_plain_search(seed):
    rng, size = random.Random(seed), rng_size(seed)
    pieces = [Piece(i, 0, rng.randint(1, size)) for i in range(rng.randint(0, 200))]
    rooms, count = [], 0
    for p in sorted(pieces, key=lambda p: -p.length):
        fits = [r for r in rooms if r >= p.length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - p.length)
        else:
            rooms.append(size - p.length)
            count += 1
    windows = packing.best_fit(pieces, size)
    assert len(windows) == count and sorted(size - sum(p.length for p in w) for w in windows) == sorted(rooms)
    done, left = packing.closed(windows, size)
    assert all(0 <= size - sum(p.length for p in w) <= size // 64 for w in done)
    powers = packing.in_powers(left)
    assert all(n & (n - 1) == 0 for n in (sum(p.length for p in w) for w in powers))
    cover = sorted(p for w in done + powers for p in w)
    for a, b in zip(cover, cover[1:]):
        assert b.start == (a.start + a.length if a.doc == b.doc else 0)
    assert sum(p.length for p in cover) == sum(p.length for p in pieces)


def rng_size(seed):
    return (1, 2, 7, 64, 100, 1000, 4096, 4096)[seed]


def test_equal_lengths_over_half_leave_no_padding():
    done, left = packing.closed(packing.best_fit([Piece(i, 0, 2100) for i in range(1000)], 4096), 4096)
    assert sum(4096 - sum(p.length for p in w) for w in done) <= len(done) * 64 and sum(p.length for p in left) < 4096


def test_a_tokenizer_starts_no_threads_of_its_own():
    code = """
import os, public_tokenizers
from veilframe.llm.packing import Ids
ids = Ids(public_tokenizers.path("word_bpe_49k.json"), True)
before = len(os.listdir("/proc/self/task"))
ids.of([" ".join(f"word{i}x{j}" for j in range(400)) for i in range(40)])
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    env["PYTHONPATH"] = os.pathsep.join(p for p in sys.path if p)
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout == "0\n"
