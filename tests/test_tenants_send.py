"""Many tenants in one scan, and the way from guard to send, against one scan or step at a time."""

import pytest
from pyspark.sql import functions as F

from veilframe.config import DEFAULT_TYPES, ScanConfig
from veilframe.functions.placeholders import INSTRUCTION
from veilframe.operators import mask, policy, send, tenants
from veilframe.operators.detectors import Rule
from veilframe.operators.scan import scan
from veilframe.sources import files
from veilframe.streaming import messages

TEXTS = (
    "mail ann.lee@example.com, card 4556737586899855, call +1 (212) 555-0187", "Анна Петрова, ИНН 7707083893, тел. +7 916 123-45-67",
    "Dr. Paul Green met Иван Сидоров at 10.20.30.40", "token=abcdEFGH1234 and 4556737586899855 12.03.1985", "nothing", None, "",
    "born 12.03.1985, DL D1234567", "Иван Сидоров")
POLICIES = {
    "a": (["EMAIL"], None, None), "b": (None, "high", None), "c": (["PERSON"], None, "ru"), "d": (["PERSON", "IP_ADDRESS"], "low", "en"),
    "e": (["CARD", "RU_INN"], "low", None), "f": ([], None, None), "g": (["DATE_OF_BIRTH", "SECRET"], None, None),
    "h": (["SECRET_KV"], None, "auto")}
NET = ScanConfig(("EMAIL", "IP_ADDRESS"))


def policies(spark, rows=POLICIES):
    return spark.createDataFrame([(t, *p) for t, p in rows.items()],
                                 "tenant string, enabled_types array<string>, min_confidence string, language string")


def mixed(spark):
    names = [*POLICIES, "unknown", None]
    return spark.createDataFrame([(f"{t} {i}", t, x) for t in names for i, x in enumerate(TEXTS)],
                                 "id string, tenant string, text string")


@pytest.mark.parametrize("small", [True, False])
def test_equals_one_scan_per_policy(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(tenants, "BROADCAST_BYTES", -1)
    rules = (Rule("OWN", "nothing"),)
    got = {r.id: r.detections for r in tenants.scan_by_policy(mixed(spark), policies(spark), "tenant", extra=rules).collect()}
    assert len(got) == len(TEXTS) * (len(POLICIES) + 2)
    for t in (*POLICIES, "unknown"):
        types, confidence, language = POLICIES.get(t, (None, None, None))
        cfg = ScanConfig(tuple(types if types is not None else DEFAULT_TYPES), confidence or "medium", language or "auto", rules)
        one = scan(mixed(spark).filter(F.col("tenant") == t), "text", cfg).collect()
        assert {r.id: r.detections for r in one} == {i: d for i, d in got.items() if i.startswith(f"{t} ")}, t
    assert {i.split()[1]: d for i, d in got.items() if i.startswith("None ")} == {
        i.split()[1]: d for i, d in got.items() if i.startswith("unknown ")}


def test_policy_edges(spark):
    twice = policies(spark).unionByName(policies(spark, {"a": (["IP_ADDRESS"], None, None), None: (["EMAIL"], None, None)}))
    rows = tenants.scan_by_policy(mixed(spark).withColumn("enabled_types", F.lit(1)), twice, "tenant")
    assert rows.count() == mixed(spark).count() and rows.columns == ["id", "tenant", "text", "enabled_types", "detections"]
    assert tenants.scan_by_policy(mixed(spark).limit(0), policies(spark), "tenant").count() == 0
    none = tenants.scan_by_policy(mixed(spark), policies(spark).limit(0), "tenant").collect()
    assert sum(len(r.detections) for r in none if r.tenant == "a") == sum(len(r.detections) for r in none if r.tenant == "b")


def outbox(spark):
    rows = [(1, "s", "write a@b.com", "mask"), (2, "s", "write c@d.com and a@b.com", "mask"), (3, "s", "x@y.com", "send"),
            (4, "s", "p@q.com", "drop"), (5, "s", "m@n.com", None), (6, "s", "hello", "mask"), (7, None, "a@b.com", "mask"),
            (8, "s", f"z@z.com {INSTRUCTION}", "mask"), (9, "s", None, "mask")]
    return spark.createDataFrame(rows, "no int, session string, text string, choice string")


def test_guard_send(spark):
    sent = send.guard_send(outbox(spark), "session", ["no"], cfg=NET)
    told = "\n\n" + INSTRUCTION
    assert {r.no: (r.action, r.sent) for r in sent.rows.collect()} == {
        1: ("mask", "write [EMAIL_1]" + told), 2: ("mask", "write [EMAIL_2] and [EMAIL_1]" + told), 3: ("pass", "x@y.com"),
        4: ("drop", None), 5: ("hold", None), 6: ("pass", "hello"), 7: ("mask", "[EMAIL_1]" + told),
        8: ("mask", f"[EMAIL_3] {INSTRUCTION}"), 9: ("pass", None)}
    assert sent.leaks.first()[0] == 4 and sent.entries.count() == 4
    again = send.guard_send(outbox(spark), "session", ["no"], vault=sent.entries, cfg=NET)
    assert again.entries.count() == 0
    assert send.guard_send(outbox(spark).limit(0), "session", ["no"], cfg=NET).leaks.first()[0] == 0


def test_guard_send_by_policy(spark):
    raw = [("a", '{"guardEnabled": false}'), ("b", '{"guardDisabledSites": ["claude"], "instructionEnabled": false}')]
    rules = policy.sanitize_policies(spark.createDataFrame(raw, "tenant string, policy_json string"))
    rows = [("a", "https://poe.com/", "a@b.com"), ("b", "https://claude.ai/x", "a@b.com"), ("b", "https://poe.com/", "a@b.com"),
            ("c", "https://claude.ai/x", "a@b.com"), (None, None, "a@b.com")]
    df = spark.createDataFrame([(*r, "mask", i) for i, r in enumerate(rows)],
                               "tenant string, url string, text string, choice string, no int")
    sent = send.guard_send(df, "tenant", ["no"], policies=rules, tenant="tenant", url_col="url").rows.collect()
    assert [(r.action, r.sent.startswith("["), INSTRUCTION in r.sent) for r in sorted(sent, key=lambda r: r.no)] == [
        ("pass", False, False), ("pass", False, False), ("mask", True, False), ("mask", True, True), ("mask", True, True)]


def test_guard_send_stream_equals_batch(spark, tmp_path):
    df = outbox(spark)
    for part in range(3):
        df.filter(F.pmod("no", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = files.VaultTable(spark, str(tmp_path / "vault"))
    messages.guard_send_stream(
        stream, store, "session", ["no"], str(tmp_path / "state"),
        lambda rows, b: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/batch_id={b}")), cfg=NET).trigger(
        availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    want = {r.no: r.action for r in send.guard_send(df, "session", ["no"], cfg=NET).rows.collect()}
    assert {r.no: r.action for r in out.collect()} == want
    back = mask.restore(out.filter("action = 'mask'"), store.entries(), "session", text_col="sent", strip=True).collect()
    texts = {r.no: r.text for r in df.collect()}
    assert all(r.restored == texts[r.no].replace(INSTRUCTION, "").rstrip() for r in back) and len(back) == 4
