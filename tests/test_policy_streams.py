import json

from pyspark.sql import functions as F

from veilframe import config
from veilframe.operators import guard, mask, policy
from veilframe.operators.scan import scan
from veilframe.sources import catalog, files
from veilframe.streaming import messages

NET = config.ScanConfig(("EMAIL", "IP_ADDRESS"))


def test_sites(spark):
    hosts = {"giga.chat": "gigachat", "eu.chat.deepseek.com": "deepseek", "claude.ai": "claude", "grok.com": "grok",
             "notgrok.com": None, "grok.company.test": None, "claude.ai.mirror.test": None, "": None, None: None}
    df = catalog.match_site(spark.createDataFrame([(h,) for h in hosts], "host string"))
    assert {r.host: r.site for r in df.collect()} == hosts
    assert catalog.sites(spark).count() == 9


def test_catalogue_and_groups(spark):
    types = config.pii_types(spark)
    assert types.count() == 25 and types.filter("not default_on").count() == 1
    assert config.pii_groups(spark).count() == 6
    grouped = types.select("group", policy.group_of(F.col("type")).alias("g"))
    assert grouped.filter("`group` <> g or g is null").count() == 0
    assert spark.range(1).select(policy.group_of(F.lit("SECRET_AWS"))).first()[0] == "tech"


def test_policies(spark):
    raw = {"enabledTypes": ["IBAN", None, "PLANET"], "minConfidence": "extreme", "language": "en", "guardEnabled": 1,
           "instructionEnabled": False, "guardDisabledSites": [True, "grok"], "placeholderStyle": "guillemet", "colour": "red"}
    rows = [("a", json.dumps(raw)), ("b", "null"), ("c", '"text"'), ("d", "[7]"), ("e", "{half"), ("f", None),
            ("g", '{"guardEnabled": false, "enabledTypes": []}')]
    df = policy.sanitize_policies(spark.createDataFrame(rows, "tenant string, policy_json string"))
    got = {r.tenant: r for r in df.collect()}
    a = got["a"]
    assert (a.enabled_types, a.min_confidence, a.language, a.guard_enabled) == (["IBAN"], None, "en", None)
    assert (a.instruction_enabled, a.guard_disabled_sites, a.placeholder_style) == (False, ["grok"], "guillemet")
    names = [name for _, name, _, _ in policy.FIELDS]
    for t in "bcdef":
        assert all(got[t][n] is None for n in names)
    full = {r.tenant: r for r in policy.with_defaults(df).collect()}
    assert full["g"].enabled_types == [] and full["g"].guard_enabled is False and full["g"].language == "auto"
    assert policy.scan_config(full["b"]) == config.ScanConfig()
    again = policy.sanitize_policies(policy.policies_to_json(policy.with_defaults(df)).select("tenant", "policy_json"))
    assert sorted(again.drop("policy_json").collect()) == sorted(policy.with_defaults(df).drop("policy_json").collect())
    merged = policy.merge(policy.with_defaults(df), df.filter("tenant = 'a'").withColumn("tenant", F.lit("b")), "tenant")
    assert merged.filter("tenant = 'b'").first().language == "en"


def test_guard(spark):
    df = spark.createDataFrame(
        [("t", "https://claude.ai/x", "a@b.com", "mask"), ("t", "https://poe.com/x", "a@b.com", "send"),
         ("u", "https://poe.com/x", "a@b.com", "mask"), ("t", "https://poe.com/x", "hello", None),
         ("t", "https://poe.com/x", "c@d.com", "drop")], "tenant string, url string, text string, choice string")
    rules = spark.createDataFrame([("t", True, ["claude"]), ("u", False, [])],
                                  "tenant string, guard_enabled boolean, guard_disabled_sites array<string>")
    held = guard.guard_urls(scan(df, "text", NET), rules)
    assert {(r.tenant, r.url, r.text): r.action for r in held.collect()} == {
        ("t", "https://claude.ai/x", "a@b.com"): "pass", ("t", "https://poe.com/x", "a@b.com"): "hold",
        ("u", "https://poe.com/x", "a@b.com"): "pass", ("t", "https://poe.com/x", "hello"): "pass",
        ("t", "https://poe.com/x", "c@d.com"): "hold"}
    done = guard.settle(guard.guard(scan(df, "text", NET)))
    assert done.filter("action = 'drop'").count() == 1
    assert guard.leaks_prevented(done).first()[0] == 2
    sent = guard.outgoing(done.withColumn("masked", F.lit("[EMAIL_1]")))
    assert sorted(r.sent for r in sent.collect()) == ["[EMAIL_1]", "[EMAIL_1]", "a@b.com", "hello"]


def messages_in(spark, tmp_path):
    rows = [(s, i, f"hi user{i % 5}@example.com from {s}" if i % 3 else "nothing here") for i in range(30)
            for s in ("s1", "s2")]
    for part in range(3):
        spark.createDataFrame(
            [r for r in rows if r[1] // 10 == part], "session string, no int, text string"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "session string, no int, text string"
    table = spark.createDataFrame(rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return table, stream


def test_stream_equals_batch(spark, tmp_path):
    table, stream = messages_in(spark, tmp_path)
    store = files.VaultTable(spark, str(tmp_path / "vault"))
    query = messages.mask_stream(
        messages.scan_stream(stream, "text", NET), store, "session", ["no"], str(tmp_path / "state"),
        lambda rows, b: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/batch_id={b}"))).trigger(
        availableNow=True).start()
    query.awaitTermination()
    batch = mask.mask(scan(table, "text", NET), "session", ["no"])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == table.count()
    back = mask.restore(out, store.entries(), "session", ["no"])
    assert back.filter("restored <> text").count() == 0
    assert store.entries().count() == batch.entries.count() == store.entries().select(
        "session_id", "placeholder").distinct().count()
    # A replayed batch issues the same placeholders.
    replay = mask.mask(scan(table.filter("no >= 20"), "text", NET), "session", ["no"], store.entries(before_batch=2))
    assert replay.entries.count() == store.entries().count() - store.entries(before_batch=2).count()


def test_guard_routes_and_counts(spark, tmp_path):
    table, stream = messages_in(spark, tmp_path)
    guarded = messages.guard_stream(stream, "text", NET)
    messages.route(guarded, str(tmp_path / "clean"), str(tmp_path / "held"), str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 20
    assert spark.read.parquet(str(tmp_path / "held")).count() == 40
    counter = messages.leak_counter(guarded.withColumn("action", F.when(F.col("action") == "hold", "mask")))
    query = counter.writeStream.outputMode("complete").format("memory").queryName("leaks").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("leaks").first()[0] == 40


def test_readers(spark, tmp_path):
    corpus = spark.createDataFrame([("a", [("EMAIL", "x")]), ("b", [])], files.CORPUS_SCHEMA)
    files.write_corpus(corpus, str(tmp_path / "corpus"))
    back = files.read_corpus(spark, str(tmp_path / "corpus"), multi_line=False)
    assert sorted(back.collect()) == sorted(corpus.collect())
    (tmp_path / "one.json").write_text('[{"text": "a",\n "expected": [{"type": "EMAIL", "value": "x"}]}]')
    assert files.read_corpus(spark, str(tmp_path / "one.json")).first().expected[0].value == "x"
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert files.read_texts(spark, str(tmp_path / "t.txt"), "text").columns == ["text"]
