import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilframe.functions import checksums as ck
from veilframe.functions import placeholders as ph
from veilframe.functions import spans as sp
from veilframe.functions import textforms as tf

VECTORS = [
    ("luhn", "79927398713", True), ("luhn", "79927398714", False), ("luhn", "2200123456789019", True),
    ("luhn", "2200123456789010", False), ("snils", "112-233-445 95", True), ("snils", "11223344595", True),
    ("snils", "123-456-789 64", True), ("snils", "001-001-001 00", False), ("snils", "112-233-445 96", False),
    ("snils", "123-456-789 65", False), ("inn", "7712345671", True), ("inn", "7712345672", False),
    ("inn", "771234567859", True), ("inn", "771234567850", False), ("inn", "77123", False),
    ("ogrn", "1207700012343", True), ("ogrn", "1207700012344", False), ("ogrn", "312770001234569", True),
    ("ogrn", "312770001234560", False), ("routing", "123456780", True), ("routing", "123456781", False),
    ("routing", "000000000", False), ("routing", "12345678", False), ("iban", "DE89370400440532013000", True),
    ("iban", "GB82WEST12345698765432", True), ("iban", "GB82 WEST 1234 5698 7654 32", True),
    ("iban", "de12500105170648489890", True), ("iban", "DE61370400440532013000", False),
    ("iban", "GB82WEST12345698765433", False), ("iban", "DE00370400440532013000", False),
]
RULES = {"luhn": ck.valid_luhn, "snils": ck.valid_snils, "inn": ck.valid_inn, "ogrn": ck.valid_ogrn,
         "routing": ck.valid_routing, "iban": ck.valid_iban}


def test_checksum_vectors(spark):
    df = spark.createDataFrame(VECTORS, "rule string, value string, valid boolean")
    got = df.select("rule", "value", "valid", *[f(F.col("value")).alias("r_" + n) for n, f in RULES.items()]).collect()
    wrong = [(r["rule"], r["value"]) for r in got if r["r_" + r["rule"]] != r["valid"]]
    assert wrong == []


def test_bank_account_key(spark):
    accounts = [("4070281050000000123" + str(d), "044525999") for d in range(10)]
    df = spark.createDataFrame(accounts + [("123", "044525999"), (accounts[0][0], "04452599")], "acc string, bik string")
    valid = [r[0] for r in df.select(ck.valid_bank_account(F.col("acc"), F.col("bik"))).collect()]
    assert sum(valid[:10]) == 1 and valid[10:] == [False, False]
    assert accounts[valid.index(True)][0] == "40702810500000001236"


def plain_normal_form(text):
    out, origin = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c):
            if not "̀" <= x <= "ͯ":
                out.append(x)
                origin.append(i)
    return "".join(out), origin


def test_normalisation_matches_plain_model(spark):
    rnd = random.Random(7)
    pool = list("ab1 Жй") + list("́̀½…ﬁ４é̈́\U0001f600㍿ﷺ가한 \U0001d7d9﷐")
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", tf.normalize_with_map(F.col("t")))
    df = df.withColumn("o", F.when(F.length("n.text") > 0, F.transform(
        F.sequence(F.lit(0), F.length("n.text") - 1), lambda p: F.when(F.col("n.shifts").isNull(), p).otherwise(
            tf.source_offset(F.col("n.shifts"), p)))).otherwise(F.array().cast("array<int>")))
    for r in df.collect():
        text, origin = plain_normal_form(r.t)
        assert (r.n.text, r.o) == (text.replace("﷐", "�"), origin), repr(r.t)


def test_common_blocks_hold_no_changed_character():
    src, _, other = tf._compat_tables()
    changed = set(map(ord, src)) | set(map(ord, other))
    for first, last in tf.COMMON_BLOCKS:
        assert not changed & set(range(first, last + 1))


def test_folding_and_script_counts(spark):
    df = spark.createDataFrame([("АКIA test@exаmple",)], "t string")
    r = df.select(tf.fold_lookalikes(F.col("t")), tf.fold_lookalikes(tf.fold_lookalikes(F.col("t")), "ru"),
                  tf.cyrillic_letters(F.col("t")), tf.latin_letters(F.col("t"))).first()
    assert r[0] == "AKIA test@example" and r[2:] == (3, 12)
    with pytest.raises(ValueError):
        tf.fold_lookalikes(F.col("t"), "fr")


def test_entropy(spark):
    r = spark.createDataFrame([("aabb", "abcd", "")], "a string, b string, c string").select(
        *[tf.entropy(F.col(c)) for c in "abc"]).first()
    assert math.isclose(r[0], 1) and math.isclose(r[1], 2) and r[2] == 0


def test_spans_positions_and_long_arrays(spark):
    texts = ["x a@b.c \U0001f600 d@e.f", "", "none", "﷐a@b.c﷑", "a@b.c " * 1500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", sp.find_spans(F.col("t"), "[a-z]@[a-z][.][a-z]").alias("s"))
    for r in df.collect():
        assert all(r.t[s.start:s.end] == s.match for s in r.s)
        assert len(r.s) == r.t.count("@")


def test_running_folds_cross_block_borders(spark):
    rnd = random.Random(3)
    values = [[rnd.randint(-9, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 2000)]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>").select(
        "v", sp.running_sum(F.col("v")).alias("s"), sp.running_max(F.col("v")).alias("m"))
    for r in df.collect():
        assert r.s == [sum(r.v[:i + 1]) for i in range(len(r.v))]
        assert r.m == [max([0, *r.v[:i + 1]]) for i in range(len(r.v))]


def test_placeholders_and_instruction(spark):
    tokens = ["[PERSON_1]", "{{RU_INN_12}}", "«SECRET_KV_3»", "[person_1]", "[PERSON_]", "PERSON_4", "[A_1"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select(ph.parse_placeholder(F.col("t")).alias("p"))
    assert [r.p and (r.p.type, r.p.num) for r in df.collect()] == [
        ("PERSON", 1), ("RU_INN", 12), ("SECRET_KV", 3), None, None, ("PERSON", 4), ("A", 1)]
    text = "Привет, [PERSON_1]!"
    once = ph.append_instruction(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(
        once, ph.append_instruction(once), ph.strip_instruction(once), ph.strip_instruction(F.col("t"))).first()
    assert r[0] == r[1] != text and r[2] == text and r[3] == text
    with pytest.raises(ValueError):
        ph.format_placeholder(F.lit("A"), F.lit(1), "round")


def test_reading_out_of_long_texts(spark):
    text = "".join(chr(0x430 + i % 32) for i in range(70_000))
    starts = [0, 1, 4095, 4096, 4097, 8191, 30_000, 69_990]
    spans = [(s, s + 10) for s in starts] + [(s, s + 1) for s in range(40_000, 40_200, 2)] + [(50_000, 60_000)]
    df = spark.createDataFrame([(text, sorted(spans))], "t string, s array<struct<start:int,end:int>>")
    df = df.withColumn("c", sp.chunked(F.col("t"), F.col("s")))
    r = df.select("s", F.transform("s", lambda x: sp.read_out(
        F.col("t"), F.col("c"), x["start"], x["end"] - x["start"])).alias("v"), F.col("c.size").alias("size")).first()
    assert r.size == 4096 and r.v == [text[x.start:x.end] for x in r.s]
    disjoint = [(s, s + 5) for s in range(0, 69_000, 500)]
    df = spark.createDataFrame([(text, disjoint)], "t string, s array<struct<start:int,end:int>>")
    want, last = "", 0
    for s, e in disjoint:
        want, last = want + text[last:s] + "#", e
    assert df.select(sp.rewrite(F.col("t"), F.col("s"), lambda x, i: F.lit("#"))).first()[0] == want + text[last:]
