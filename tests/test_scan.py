"""Detection cases by type: what must be found, with which confidence, and what must stay silent."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe.config import DEFAULT_TYPES, KNOWN_TYPES, ScanConfig
from veilframe.operators import evaluate, generate
from veilframe.operators.detectors import Rule
from veilframe.operators.scan import explode_detections, scan, scan_selection, type_counts

# text, type, value (None: not to be found), confidence (None: any)
CASES = [
    ("drop a line to test@example.com by noon", "EMAIL", "test@example.com", "high"),
    ("ящик test@exаmple.com", "EMAIL", "test@exаmple.com", "high"),
    ("a@b.com1x@d.org", "EMAIL", "1x@d.org", "high"),
    ("desk +7 (999) 123-45-67", "PHONE", "+7 (999) 123-45-67", "high"),
    ("диспетчер 8 916 123 45 67", "PHONE", "8 916 123 45 67", "high"),
    ("факс 8-916-123-45-67", "PHONE", "8-916-123-45-67", "high"),
    ("8(916)1234567", "PHONE", "8(916)1234567", "high"),
    ("reception +1 (212) 555-0143", "PHONE", "+1 (212) 555-0143", "high"),
    ("office +44 (20) 7946 0958", "PHONE", "+44 (20) 7946 0958", "high"),
    ("позиция 81234567890 в ящике", "PHONE", "81234567890", "medium"),
    ("партия 12345678901234567890 здесь", "PHONE", None, None),
    ("карта 4123456789011", "CARD", "4123456789011", "high"),
    ("карта: 4111 1111 1111 1111", "CARD", "4111 1111 1111 1111", "high"),
    ("значение 2200123456789019 там", "CARD", "2200123456789019", "medium"),
    ("бирка 4123456789011", "CARD", None, None),
    ("Card: ４１１１１１１１１１１１１１１１", "CARD", "４１１１１１１１１１１１１１１１", "high"),
    ("бирка 0000000000000000", "CARD", None, None),
    ("СНИЛС 11223344595", "RU_SNILS", "11223344595", "high"),
    ("запись 112-233-445 95", "RU_SNILS", "112-233-445 95", "high"),
    ("запись 11223344595", "RU_SNILS", None, None),
    ("в графе ИНН 7712345671", "RU_INN", "7712345671", "high"),
    ("ИНН7712345671", "RU_INN", "7712345671", "high"),
    ("посылка 7712345671 едет", "RU_INN", None, None),
    ("строка 771234567859 в таблице", "RU_INN", "771234567859", "medium"),
    ("ОГРН 1207700012343", "RU_OGRN", "1207700012343", "high"),
    ("ящик 1207700012343 вскрыт", "RU_OGRN", None, None),
    ("паспорт 1234 567890 выдан", "RU_PASSPORT", "1234 567890", "medium"),
    ("паспорт 1234 567890 выдан", "RU_DRIVER_LICENSE", None, None),
    ("в/у 12 34 567890 выдано ГИБДД", "RU_DRIVER_LICENSE", "12 34 567890", "medium"),
    ("водительское удостоверение 1234 567890", "RU_DRIVER_LICENSE", "1234 567890", "medium"),
    ("место 12 34 567890 на схеме", "RU_DRIVER_LICENSE", None, None),
    ("полис ОМС 7800000123456789", "RU_OMS", "7800000123456789", "high"),
    ("БИК 044525225 банка", "RU_BIK", "044525225", "high"),
    ("лот 044525225 продан", "RU_BIK", None, None),
    ("КПП 770101001", "RU_KPP", "770101001", "medium"),
    ("лот 770101001 снят", "RU_KPP", None, None),
    ("р/с 40702810500000001236 в банке, БИК 044525999", "RU_BANK_ACCOUNT", "40702810500000001236", "high"),
    ("расчётный счёт 40702810500000001236 уточняется", "RU_BANK_ACCOUNT", "40702810500000001236", "medium"),
    ("сумма 40702810500000001236 в таблице", "RU_BANK_ACCOUNT", None, None),
    ("routing number 123456780", "US_ROUTING", "123456780", "high"),
    ("лот 123456780 снят", "US_ROUTING", None, None),
    ("SWIFT NORDUS33KLM of the branch", "SWIFT_BIC", "NORDUS33KLM", "high"),
    ("shelf NORDUS33KLM there", "SWIFT_BIC", None, None),
    ("account number 000123456789", "US_BANK_ACCOUNT", "000123456789", "medium"),
    ("shelf 000123456789 moved", "US_BANK_ACCOUNT", None, None),
    ("DUNS 15-048-3782", "US_DUNS", "15-048-3782", "medium"),
    ("shelf 150483782 moved", "US_DUNS", None, None),
    ("IBAN DE12500105170648489890", "IBAN", "DE12500105170648489890", "high"),
    ("GB82 WEST 1234 5698 7654 32", "IBAN", "GB82 WEST 1234 5698 7654 32", "high"),
    ("SSN: 123-45-6789", "US_SSN", "123-45-6789", "high"),
    ("SSN: 000-12-3456", "US_SSN", None, None), ("SSN: 666-12-3456", "US_SSN", None, None),
    ("SSN: 901-12-3456", "US_SSN", None, None), ("SSN: 123-00-4567", "US_SSN", None, None),
    ("SSN: 123-45-0000", "US_SSN", None, None),
    ("EIN 12-3456789 is printed", "US_EIN", "12-3456789", "medium"),
    ("shelf 12-3456789 moved", "US_EIN", None, None),
    ("Driver's license D1234567 was lost", "US_DRIVER_LICENSE", "D1234567", "medium"),
    ("his driver license number is lost", "US_DRIVER_LICENSE", "number", "medium"),
    ("Medicare MBI 1EG4TE5MK73", "US_MEDICARE", "1EG4TE5MK73", "medium"),
    ("Medicare 1EG4-TE5-MK73 was renewed", "US_MEDICARE", "1EG4-TE5-MK73", "medium"),
    ("shelf 1EG4TE5MK73 moved", "US_MEDICARE", None, None),
    ("узел 192.168.10.42 молчит", "IP_ADDRESS", "192.168.10.42", "medium"),
    ("узел 300.400.500.600", "IP_ADDRESS", None, None),
    ("2001:0db8:85a3:0000:0000:8a2e:0370:7334 молчит", "IP_ADDRESS", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "medium"),
    ("узел 2001:db8::1 молчит", "IP_ADDRESS", "2001:db8::1", "medium"),
    ("узел fe80::1ff:fe23:4567:890a молчит", "IP_ADDRESS", "fe80::1ff:fe23:4567:890a", "medium"),
    ("узел ::1 молчит", "IP_ADDRESS", "::1", "medium"),
    ("MAC 01:23:45:67:89:ab на корпусе", "IP_ADDRESS", None, None),
    ("старт 12:34:56 утром", "IP_ADDRESS", None, None),
    ('API_KEY: "lm_demo_73QxTr5N8VJ2poiuytrewq0987"', "SECRET_KV", "lm_demo_73QxTr5N8VJ2poiuytrewq0987", "high"),
    ("пароль=Gr4niteHarbor77", "SECRET_KV", "Gr4niteHarbor77", "high"),
    ("ПАРОЛЬ: Gr4niteHarbor77", "SECRET_KV", "Gr4niteHarbor77", "high"),
    ("ключ АКIAIOSFODNN7EXAMPLE потерян", "SECRET_AWS", "АКIAIOSFODNN7EXAMPLE", "high"),
    ("ключ f47ac10b58cc4372a5670e02b2c3d479 на обороте", "SECRET_ENTROPY", "f47ac10b58cc4372a5670e02b2c3d479", "medium"),
    ("commit a94a8fe5ccb19ba61c4c0873d391e987982fbbd3", "SECRET_ENTROPY", None, None),
    ("Хеш md5 5d41402abc4b2a76b9719d911017c592.", "SECRET_ENTROPY", None, None),
    ("Зимой Иванов Иван Иванович уехал", "PERSON", "Иванов Иван Иванович", "high"),
    ("вручено Иванову Ивану Ивановичу на складе", "PERSON", "Иванову Ивану Ивановичу", "high"),
    ("книга Марии Петровой вернулась", "PERSON", "Марии Петровой", "high"),
    ("на имя Сергея Кузнецова записана", "PERSON", "Сергея Кузнецова", "high"),
    ("отдай Саше Иванову ключи", "PERSON", "Саше Иванову", "high"),
    ("дежурит Волков Андрей сегодня", "PERSON", "Волков Андрей", "high"),
    ("звонила Ольга утром", "PERSON", "Ольга", "medium"),
    ("протокол: Петров А.С., секретарь", "PERSON", "Петров А.С.", "high"),
    ("проверил А.Б. Кузнецов дважды", "PERSON", "А.Б. Кузнецов", "high"),
    ("Обращение подготовил Тимербулатов без реквизитов", "PERSON", None, None),
    ("ask Dr. John Smith first", "PERSON", "Dr. John Smith", "high"),
    ("painted by John Smith in spring", "PERSON", "John Smith", "medium"),
    ("a harbour in New York at night", "PERSON", None, None),
    ("at Synthetic Data LLC", "PERSON", None, None),
    ("rain fell. John Smith slept", "PERSON", None, None),
    ("дата рождения 01.02.1985", "DATE_OF_BIRTH", "01.02.1985", "high"),
    ("выставка 15.03.2024 в музее", "DATE_OF_BIRTH", "15.03.2024", "medium"),
    ("", "EMAIL", None, None), ("   ", "EMAIL", None, None), (None, "EMAIL", None, None),
]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [(i, c[0]) for i, c in enumerate(CASES)]
    cfg = ScanConfig((*DEFAULT_TYPES, "DATE_OF_BIRTH"))
    rows = scan(spark.createDataFrame(texts, "i int, text string"), "text", cfg).collect()
    return {r.i: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{CASES[i][1]}-{i}")
def test_case(scanned, i):
    _, type_, value, confidence = CASES[i]
    hits = [d for d in scanned[i].detections if d.type == type_]
    if value is None:
        assert hits == []
        return
    match = [d for d in hits if d.value == value]
    assert match, [(d.type, d.value) for d in scanned[i].detections]
    assert confidence is None or match[0].confidence == confidence


def test_offsets_are_disjoint_and_name_their_value(scanned):
    for r in scanned.values():
        last = 0
        for d in r.detections:
            assert d.start >= last and r.text[d.start:d.end] == d.value
            last = d.end


def test_longest_span_and_priority_win(scanned):
    by_text = {r.text: r.detections for r in scanned.values()}
    assert len(by_text["в графе ИНН 7712345671"]) == 1
    assert [d.type for d in by_text["полис ОМС 7800000123456789"]] == ["RU_OMS"]


def test_config_prunes_types_languages_and_levels(spark):
    df = spark.createDataFrame([("API_KEY=abcdefgh12345 test@example.com Иван and John Smith",)], "text string")

    def types(**kw):
        return [d.type for d in scan(df, "text", ScanConfig(**kw)).first().detections]

    assert types(enabled_types=["EMAIL"]) == ["EMAIL"]
    assert types(enabled_types=["SECRET_KV"]) == ["SECRET_KV"]
    assert types(enabled_types=["SECRET_JWT"]) == []
    assert types(enabled_types=["PERSON"], language="en") == ["PERSON"]
    assert types(enabled_types=["PERSON"], min_confidence="high") == []
    assert types(enabled_types=[]) == []
    assert "DATE_OF_BIRTH" not in DEFAULT_TYPES and len(KNOWN_TYPES) == len(DEFAULT_TYPES) + 1
    with pytest.raises(ValueError):
        ScanConfig(min_confidence="ultra")


def test_expanding_characters_keep_source_offsets(spark):
    text = "½…ﬁ mail test@example.com … и ИНН 7712345671"
    found = scan(spark.createDataFrame([(text,)], "text string")).first().detections
    assert [(d.type, text[d.start:d.end]) for d in found] == [("EMAIL", "test@example.com"), ("RU_INN", "7712345671")]
    assert all(text[d.start:d.end] == d.value for d in found)


def test_user_rule(spark):
    badge = Rule("BADGE", r"(?<![A-Z])BX-[0-9]{4}", cue="badge", reach=15, confidence="high", needs_digits=False)
    df = spark.createDataFrame([("badge BX-1234 ok",), ("code BX-1234 only",)], "text string")
    cfg = ScanConfig(("EMAIL",), extra=(badge,))
    assert [[d.value for d in r.detections] for r in scan(df, "text", cfg).collect()] == [["BX-1234"], []]


def test_selection_falls_back_to_the_whole_text(spark):
    df = spark.createDataFrame([("just words",), ("a test@example.com",), ("  ",)], "text string")
    got = [[(d.type, d.value) for d in r.detections] for r in scan_selection(df).collect()]
    assert got == [[("MASKED", "just words")], [("EMAIL", "test@example.com")], []]


def test_many_hits_in_one_text(spark):
    text = " ".join(f"user{i}@example.com" for i in range(3000))
    r = scan(spark.createDataFrame([(text,)], "text string"), "text", ScanConfig(("EMAIL",))).select(
        "text", "detections", type_counts(F.col("detections")).alias("n")).first()
    assert r.n == {"EMAIL": 3000} and all(r.text[d.start:d.end] == d.value for d in r.detections)


def test_scan_is_narrow(spark):
    df = spark.range(10).select(F.concat(F.lit("x@y.com "), F.col("id")).alias("text"))
    plan = scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_generated_texts_meet_the_quality_gate(spark):
    corpus = generate.labelled_corpus(spark.range(160), "id")
    cfg = ScanConfig(("EMAIL", "PHONE", "CARD", "RU_SNILS", "RU_INN", "RU_OGRN", "RU_PASSPORT", "RU_OMS", "IBAN",
                      "US_SSN", "IP_ADDRESS", "PERSON", "SECRET"))
    scanned = scan(corpus, "text", cfg).cache()
    q = evaluate.passes_gate(evaluate.quality(evaluate.matches(scanned, "item_id"))).first()
    assert q.passed and q.expected == q.matched == q.detected
    assert evaluate.loud_negatives(scanned).count() == 0
    assert explode_detections(scanned, ["item_id"]).count() == q.detected + q.persons_matched


# Hashes of these ids would hold eleven digits from 8 on, a telephone number by the rule.
PHONE_LIKE = "id IN (3211, 6379, 12731, 14476, 15451, 17596)"


def test_hash_traps_stay_silent(spark):
    traps = generate.labelled_corpus(spark.range(18_000).filter(PHONE_LIKE), "id", "hard")
    scanned = scan(traps, "text", ScanConfig(("PHONE", "CARD", "SECRET")))
    assert scanned.count() == 6 and evaluate.loud_negatives(scanned).count() == 0
    assert evaluate.by_type(evaluate.matches(scanned, "item_id")).count() == 0


def test_hash_traps_leave_the_precision_alone(spark):
    some = spark.range(18_000).filter(PHONE_LIKE + " OR id IN (7, 8)")
    scanned = scan(generate.labelled_corpus(some, "id", "hard"), "text", ScanConfig(("PHONE", "EMAIL", "SECRET")))
    q = evaluate.quality(evaluate.matches(scanned, "item_id")).first()
    assert (q.expected, q.detected, q.matched, q.precision) == (2, 2, 2, 1.0)


def test_user_rules_run_ungated_and_on_any_length(spark):
    own = (Rule("BADGE", r"BX-[0-9]{4}"), Rule("FOUR", lengths=(4,)), Rule("LONG", lengths=(24,)))
    df = spark.createDataFrame([("desk BX-1204 then",), ("gate 1204",), ("1" * 24,), ("1" * 23,)], "text string")
    rows = explode_detections(scan(df, "text", ScanConfig(("EMAIL",), extra=own)), ["text"]).collect()
    assert sorted((r.type, r.value) for r in rows) == [("BADGE", "BX-1204"), ("FOUR", "1204"), ("LONG", "1" * 24)]


def test_where_reaches_the_files(spark, tmp_path):
    """A condition on other columns is pushed to the files and to their partitions; it does not stop at the scan."""
    rows = [(i, "a@b.com" if i % 2 else "none", f"p{i % 3}") for i in range(30)]
    spark.createDataFrame(rows, "id int, text string, part string").write.partitionBy("part").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = scan(table, "text", ScanConfig(("EMAIL",)), where="id > 20 AND part = 'p1'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(id,20\)", plan)
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = p1", plan)
    assert sorted(r.id for r in found.collect()) == [22, 25, 28]
    assert scan(table, "text", ScanConfig(("EMAIL",)), where=F.col("id") < 0).count() == 0
