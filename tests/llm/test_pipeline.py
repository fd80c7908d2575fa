"""The stages of the pipeline against brute force, each on its own input; the registered names."""

import public_tokenizers
from pyspark.sql import functions as F
from test_ngram_join import brute as brute_groups
from test_repeats import brute as brute_repeats
from test_search import words
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as cp
from veilframe.llm import toxicity
from veilframe.plans.staging import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    steps = dict(cp.STAGES)
    assert list(steps) == ["toxicity", "ngram_join", "suffix_dedup", "decontam", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    documents = [(r.doc_id, r.text) for r in docs.collect()]

    kept = stage(steps["toxicity"](spark, docs, SF))
    lexicon = toxicity.learned_from(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.toxicity(docs, lexicon).filter("score >= 0.5").collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in documents} - bad and kept.columns == docs.columns

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    unique = stage(steps["ngram_join"](spark, kept, SF))
    assert {r.doc_id for r in unique.collect()} == {d for d, _, c in brute_groups(rows) if d == c}
    assert unique.columns == docs.columns

    rows = [(r.doc_id, r.text) for r in unique.collect()]
    cut = stage(steps["suffix_dedup"](spark, unique, SF))
    want = {r[0]: r[4] for r in brute_repeats(rows, lambda t: list(t.encode()), bytes, 50)}
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == set(want) and cut.columns == docs.columns
    for d, r in got.items():
        clean = want[d].decode("utf-8", "ignore")
        assert r.text.replace("�", "") == clean.replace("�", "") and r.n_chars == len(r.text)

    clean = stage(steps["decontam"](spark, cut, SF))
    items = [" " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    for d, r in got.items():
        text = " " + " ".join(words(r.text)) + " "
        if any(k in text for k in items):
            assert d not in left
        elif not any(len(set(k.split()) & set(text.split())) >= 0.5 * len(set(k.split())) for k in items):
            assert d in left

    encoded = steps["bpe"](spark, clean, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in encoded} == left
    assert all(r.ids == library.encode(got[r.doc_id].text, add_special_tokens=False).ids for r in encoded)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in cp.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_and_clashing_columns_pass_all_stages(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", None, "x"), (2, "", None, "s", 0, "x"), (None, "some text", "en", None, 9, None),
         (3, "word " * 30_000, "en", "s", 1, "y"), (3, "word " * 30_000, "en", "s", 1, "y")],
        "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, step in cp.STAGES:
        docs = stage(step(spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} == {1, 2, None, 3}


def test_one_row_of_each_group_stays(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    rows = [(1, text("a")), (2, text("b")), (2, text("b")), (None, text("c")), (None, text("c") + " more"),
            (None, text("a")), (3, text("a")), (3, text("d")), (None, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = [(r.doc_id, (r.text or "")[:3]) for r in cp.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(left, key=repr) == sorted([(1, "aw0"), (2, "bw0"), (None, "cw0"), (3, "dw0"), (None, ""), (4, ""),
                                             (None, "")], key=repr)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_learning_leaves_fold_zero_out(spark):
    docs = spark.createDataFrame([(i, "vile" if i % 2 else "fine") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    held = labels.filter(toxicity.fold_number(F.col("doc_id")) == 0).select("doc_id")
    flipped = labels.join(held, "doc_id", "left_anti").unionByName(
        labels.join(held, "doc_id").withColumn("toxic", 1 - F.col("toxic")))
    assert toxicity.learned_from(docs, labels) == toxicity.learned_from(docs, flipped)
