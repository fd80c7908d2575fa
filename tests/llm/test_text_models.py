"""Toxicity, language model and BPE: held-out accuracy, brute force and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilframe.llm import bpe, lm_score, toxicity

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxicity_held_out(spark):
    """On the larger table: the smaller one has six toxic texts in the fold."""
    larger = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    rows = toxicity.query(spark, larger).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_equals_plain_search(spark):
    """Scores of all texts and of hard ones against one search of each term in each folded text."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learned = toxicity.learned_from(docs(spark), labels)
    terms = learned.terms | {"scum": 2.5, "scumbag": 1.5, "bag": 0.5}
    lexicon = toxicity.Lexicon(terms, (*learned.exceptions, "bag of flour", "scum line"), learned.function)
    hard = ["5cum 5CUMBAG bag", "a bag of flour, a bag", "scum line scum", "scum" * 50, "\u0455\u0441um!", "", None, "İ scum",
            "bag " * 3000, "scums bags xbag", "scum-bag scum_bag scum2"]
    df = docs(spark).select("text").unionByName(spark.createDataFrame([(t,) for t in hard], "text string"))
    a, b, c = lexicon.function
    for r in toxicity.toxicity(df, lexicon).collect():
        plain = (r.text or "").lower()
        folded = plain.translate(toxicity.FOLD)

        def places(word, folded=folded, plain=plain):
            at = folded.find(word)
            while at >= 0:
                end = at + len(word)
                if not (at and plain[at - 1].isalpha()) and not (end < len(plain) and plain[end].isalpha()):
                    yield at, end
                at = folded.find(word, at + 1)

        excused = [p for phrase in lexicon.exceptions for p in places(phrase)]
        weights = [w for term, w in terms.items() for s, e in places(term) if not any(x <= s and e <= y for x, y in excused)]
        total, words = sum(weights), len((r.text or "").split())
        assert r.n_terms == len(weights) and r.weight == pytest.approx(total)
        odds = a + b * np.log1p(total) + c * np.log1p(100 * total / max(words, 1))
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-12)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 5.0, toxicity.fold("trash"): 4.0},
                               (toxicity.fold("trash can"),))
    m = toxicity.Matcher(lexicon)
    assert [x[2] for x in m.matches("You 1D10T, іdіоt! 1diot$$$")] == [5.0, 5.0, 5.0]
    assert not m.matches("idiotic trashy") and not m.matches("a trash can")
    assert len(m.matches("trash, a trash can")) == 1
    assert toxicity.Lexicon.from_json(lexicon.to_json()) == lexicon


def test_longer_texts_score_lower():
    m = toxicity.Matcher(toxicity.Lexicon({"scum": 5.0}))
    short, long = (m.features("scum " + "word " * n) for n in (5, 5000))
    scores = m.scores(np.array([short[0], long[0]]), np.array([short[2], long[2]]))
    assert scores[0] > scores[1]


def test_toxicity_edges(spark):
    lexicon = toxicity.Lexicon({"scum": 5.0})
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "scum " * 50_000, None), (2, "", "b")],
                               "doc_id long, text string, __x string")
    rows = toxicity.toxicity(df, lexicon).collect()
    assert sorted(r.n_terms for r in rows) == [0, 0, 0, 50_000] and df.columns == list(rows[0].asDict())[:3]
    assert len({r.score for r in rows if not r.n_terms}) == 1
    assert toxicity.toxicity(df.limit(0), lexicon).count() == 0
    with pytest.raises(ValueError):
        toxicity.toxicity(df.withColumnRenamed("__x", "score"), lexicon)
    empty = toxicity.learn(spark.createDataFrame([], "text string, toxic int"))
    assert not empty.terms and toxicity.Matcher(empty).matches("anything") == []


def hard_texts():
    rng = random.Random(4)
    letters = "ab  \n\t'tsé中я🙂1!.\u00a0\u2003\u0301İ\x00\x7f\ufffd"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return rows + ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "don't we'll  I'M", "x" * 3000,
                   "  " * 500, "ab" * 5000, "\n\n\n a", "é" * 200, "unseenword" * 3]


def test_bpe_equals_library(spark):
    rows = hard_texts()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(rows)] + [(None, None, "n")],
                               "doc_id long, text string, __text2 string").repartition(3)
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(rows):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids, t
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False) == t
    assert got[None].ids == [] and got[None].decoded == ""
    packed = bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN, keep=["doc_id"], max_words=3, packed=True).collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == got[r.doc_id].ids for r in packed)
    assert bpe.bpe_encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.bpe_encode(df.withColumnRenamed("__text2", "ids"), PATH, public_tokenizers.PATTERN)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): (len(w), i) for i, w in enumerate(["taps", "tops", "tap", "top", "xaps", "é", "a"])}
    arrays = bpe.compile_lexicon(words)
    # Suffixes are shared: after t and x the states of "aps" and "ops" meet.
    assert len(arrays["first"]) - 1 == 9
    for name, values in arrays.items():
        np.save(tmp_path / f"x-{name}.npy", values)
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    order = sorted(words)
    assert lexicon.numbers([*order, b"ta", b"tapsx", b"", b"q"]).tolist() == [*range(len(order)), -1, -1, -1, -1]
    assert [tuple(lexicon.ids[lexicon.offset[k]:lexicon.offset[k + 1]]) for k in range(len(order))] == \
        [words[w] for w in order]


def test_long_words_merge_alike():
    v = bpe.Vocabulary(open(PATH, encoding="utf-8").read(), public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(30):
        word = "".join(rng.choice("abcdeinrst") for _ in range(60)).encode()
        assert v.merge(word) == v._merge_long([v.ids[word[i:i + 1]] for i in range(len(word))])


def test_lm_scores_follow_the_network(spark):
    df = docs(spark)
    words = lm_score.count_words(df, vocabulary=500)
    network = lm_score.fit(df, words)
    got = {r.doc_id: r for r in lm_score.lm_score(df, keep=["doc_id"], words=words, network=network).collect()}
    rows = df.filter("doc_id < 12").collect()
    from veilframe.llm import rolling as R
    for r in rows:
        data = R.lower(np.frombuffer(r.text.encode(), np.uint8))
        codes = R.word_codes(data, *R.words(data))
        group, share = words.look_up(codes)
        total = 0.0
        for i in range(len(group)):
            around = [group[j] if 0 <= j < len(group) else lm_score.EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
            _, p = network.forward(np.array(around)[:, None])
            total += np.log(p[0, group[i]]) + share[i]
        assert got[r.doc_id].n_tokens == len(codes) and abs(got[r.doc_id].log_likelihood - total) < 1e-2 * len(codes)
    # Better than the classes' shares alone, and than the same words in disorder.
    shuffled = spark.createDataFrame(
        [(r.doc_id, " ".join(random.Random(1).sample(r.text.split(), len(r.text.split())))) for r in df.collect()],
        "doc_id long, text string")
    other = lm_score.lm_score(shuffled, keep=["doc_id"], words=words, network=network)
    assert sum(r.log_likelihood for r in other.collect()) < sum(r.log_likelihood for r in got.values())


def test_lm_word_shares(spark):
    words = lm_score.count_words(docs(spark), vocabulary=100)
    for g in range(lm_score.OWN + lm_score.SHARED):
        own = np.exp(words.share[words.group == g])
        assert not len(own) or abs(own.sum() - 1) < 1e-9
    # Mean of the conditional probabilities over the rare kinds is at most one as well.
    assert (words.rare_share <= 0).all()


def test_lm_words_beyond_the_vocabulary_keep_their_counts(spark):
    from veilframe.llm import rolling as R
    rare = {f"rare{i}": 1 + i % 7 for i in range(60)}
    texts = ["the of " * 40] * 5 + [f"the {w} of" for w, n in rare.items() for _ in range(n)]
    # Planted texts of words of their own, some of them twice: only the counts tell these apart.
    planted = {k: " ".join(f"p{k}x{i}" for i in range(40)) for k in range(20)}
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + [(k, t) for k, t in planted.items()] + [
        (100 + k, t) for k, t in planted.items() if k % 2]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    words = lm_score.count_words(df, vocabulary=2)
    assert len(words.known) == 2
    codes = {}
    for w in [*rare, *" ".join(planted.values()).split(), "never"]:
        data = np.frombuffer(w.encode(), np.uint8)
        codes[w] = R.word_codes(data, *R.words(data))
    order = list(codes)
    group, share = words.look_up(np.concatenate([codes[w] for w in order]))
    counts = rare | {w: 1 + k % 2 for k, t in planted.items() for w in t.split()} | {"never": 1}
    total = np.bincount(group, [counts[w] if w != "never" else 0 for w in order], lm_score.CLASSES)
    assert np.allclose(np.exp(share) * (total[group] + 1), [counts[w] for w in order])
    got = {r.doc_id: r.log_likelihood for r in lm_score.lm_score(df, keep=["doc_id"], words=words).collect()}
    assert len(got) == len(rows)
    once, twice = [got[k] for k in planted if not k % 2], [got[k] for k in planted if k % 2]
    assert min(twice) > max(once) and all(abs(got[k] - got[100 + k]) < 0.01 for k in planted if k % 2)


def test_lm_keeps_columns_of_any_type(spark):
    df = spark.sql("SELECT 1 AS id, 'one two' AS text, timestamp '2024-01-01 05:00:00' AS at, map('a', 1) AS m")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert lm_score.lm_score(df).select("id", "text", "at", "m").collect() == df.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_lm_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "one", None), (None, "x y " * 20_000, ""),
                                (3, "one", None)], "doc_id long, text string, word string")
    rows = lm_score.lm_score(df).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 1, 40_000]
    assert all(r.log_likelihood == 0 and r.mean_log_prob is None for r in rows if not r.n_tokens)
    assert all(np.isfinite(r.log_likelihood) for r in rows)
    assert lm_score.lm_score(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lm_score.lm_score(df.withColumnRenamed("word", "n_tokens"))


def test_words_merged_together_equal_words_merged_alone():
    vocabulary = bpe.Vocabulary(bpe._read(PATH), public_tokenizers.PATTERN)
    rng = random.Random(5)
    words = [b"", b"a", b"aa" * 32, b"a" * 65, b"the" * 400, bytes(range(256)), "é中\U0001f600".encode()] + [
        bytes(rng.choices(b"aeinorst the", k=rng.randint(1, 70))) for _ in range(3000)] + [
        rng.randbytes(rng.choice((1, 2, 7, 8, 9, 16, 17, 64))) for _ in range(500)]
    found = vocabulary.merge_all(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [list(vocabulary.merge(w)) for w in words]
