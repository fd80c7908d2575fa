"""The registered queries: each reads whole tables and gives flat, comparable rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import DEFAULT_TYPES, ScanConfig
from veilframe.functions import checksums as ck
from veilframe.functions import placeholders as ph
from veilframe.functions import textforms as tf
from veilframe.operators import (
    crypt,
    evaluate,
    expiry,
    generate,
    guard,
    mask,
    migration,
    policy,
    send,
    sessions,
    tenants,
)
from veilframe.operators.detectors import Rule
from veilframe.operators.scan import explode_detections, scan, scan_selection, type_counts
from veilframe.plans.staging import shared_folder, stage
from veilframe.sources import files
from veilframe.sources.catalog import match_site
from veilframe.sources.files import VaultTable, spread

CORPUS_TYPES = (
    "EMAIL", "PHONE", "CARD", "RU_SNILS", "RU_INN", "RU_OGRN", "RU_PASSPORT", "RU_OMS", "IBAN", "US_SSN", "IP_ADDRESS",
    "PERSON", "SECRET",
)
CORPUS = ScanConfig(CORPUS_TYPES)
NET = ScanConfig(("EMAIL", "IP_ADDRESS"))
FULL_WIDTH_FROM = "0123456789abcdefghijklmnopqrstuvwxyz"
FULL_WIDTH_TO = "".join(chr(ord(c) + 0xFEE0) for c in FULL_WIDTH_FROM)
HOSTS = ("giga.chat", "grok.com", "eu.chat.deepseek.com", "gemini.google.com", "grok.company.test", "notgrok.com",
         "claude.ai.mirror.test", "perplexity.ai", "alice.yandex.ru.test")


KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn"), "customer": ("c_custkey",),
        "orders": ("o_orderkey",)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, *KEYS[name]) if name in KEYS else df


def _spans(spark, sf, cfg, confidence=False):
    cols = ["type", "start", "end", "value"] + (["confidence"] if confidence else [])
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = explode_detections(scan(docs, "text", cfg), ["doc_id"])
    return found.select("doc_id", *[F.col(c).alias("stop" if c == "end" else c) for c in cols])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which kinds of personal data each source holds, and in how many documents."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    found = explode_detections(scan(docs, "text"), ["source", "doc_id"])
    return found.groupBy("source", "type").agg(
        F.count(F.lit(1)).alias("detections"), F.count_distinct("doc_id").alias("documents"))


def scan_phone(spark, sf):
    return _spans(spark, sf, ScanConfig(("PHONE",))).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


def scan_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return explode_detections(scan(pages, "html", NET), ["page_id"]).select(
        "page_id", "type", "start", F.col("end").alias("stop"), "value")


def chips(spark, sf):
    docs = scan(table(spark, sf, "documents").select("doc_id", "text"), "text", NET)
    counts = docs.select("doc_id", F.size("detections").alias("total"), type_counts(F.col("detections")).alias("m"))
    return counts.filter("total > 0").select("doc_id", "total", *[
        F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0)).alias(n) for t, n in
        (("EMAIL", "emails"), ("IP_ADDRESS", "ips"))])


def counts_by(column, spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", column, "text")
    found = explode_detections(scan(docs, "text", NET), [column, "doc_id"])
    return found.groupBy(column, "type").agg(
        F.count(F.lit(1)).alias("detections"), F.count_distinct("doc_id").alias("documents"))


def _numbers(spark, sf):
    """Digit strings made from order keys; the check digits are valid as often as chance has it."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", *[
        F.substring(F.lpad((key * m + 7).cast("string"), w, pad), 1, w).alias(n) for n, w, m, pad in (
            ("d9", 9, 7919, "1"), ("d10", 10, 104729, "7"), ("d11", 11, 1299709, "2"), ("d12", 12, 15485863, "5"),
            ("d13", 13, 32452843, "1"), ("d15", 15, 49979687, "3"), ("d16", 16, 67867967, "4"),
            ("d20", 20, 86028121, "40702"))])


def check_digits(spark, sf):
    n = _numbers(spark, sf)
    return n.select(
        "o_orderkey", ck.valid_luhn(F.col("d16")).alias("luhn"), ck.valid_snils(F.col("d11")).alias("snils"),
        ck.valid_inn(F.col("d10")).alias("inn10"), ck.valid_inn(F.col("d12")).alias("inn12"),
        ck.valid_ogrn(F.col("d13")).alias("ogrn13"), ck.valid_ogrn(F.col("d15")).alias("ogrn15"),
        ck.valid_routing(F.col("d9")).alias("routing"),
        ck.valid_iban(F.concat(F.lit("DE"), F.col("d20"))).alias("iban"),
        ck.valid_bank_account(F.col("d20"), F.concat(F.lit("04"), F.substring("d9", 1, 7))).alias("account"))


def generated(spark, sf, name="customer", key="c_custkey"):
    return generate.labelled_corpus(table(spark, sf, name).select(key), key)


def fold(target, spark, sf):
    return generated(spark, sf).select("item_id", tf.fold_lookalikes(F.col("text"), target).alias("folded"))


def script_counts(spark, sf):
    return generated(spark, sf).select(
        "item_id", tf.cyrillic_letters(F.col("text")).alias("cyrillic"), tf.latin_letters(F.col("text")).alias("latin"))


def normalize_fullwidth(spark, sf):
    wide = table(spark, sf, "documents").select(
        "doc_id", F.translate("text", FULL_WIDTH_FROM, FULL_WIDTH_TO).alias("text"))
    return wide.select("doc_id", F.md5(tf.normalize(F.col("text"))).alias("digest"))


def scan_fullwidth(spark, sf):
    """Spans found in full-width text carry the original characters."""
    wide = table(spark, sf, "documents").select(
        "doc_id", F.translate("text", FULL_WIDTH_FROM, FULL_WIDTH_TO).alias("text"))
    return explode_detections(scan(wide, "text", NET), ["doc_id"]).select(
        "doc_id", "type", "start", F.col("end").alias("stop"), "value")


EXPANDING = (("fi", "\ufb01"), ("...", "\u2026"), ("e", "e\u0301"))


def scan_expanding(spark, sf):
    """Texts in which a ligature and an ellipsis stand for several characters and each ``e`` carries a mark: normalising
    changes lengths everywhere, and spans carry the original characters."""
    text = F.col("text")
    for plain, shown in EXPANDING:
        text = F.replace(text, F.lit(plain), F.lit(shown))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return explode_detections(scan(docs, "text", NET), ["doc_id"]).select(
        "doc_id", "type", "start", F.col("end").alias("stop"), "value")


def entropy(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(tf.entropy(
        F.concat("c_name", F.md5(F.col("c_custkey").cast("string")))), 6).alias("bits"))


def placeholders(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", F.upper("c_mktsegment").alias("kind"))
    style = F.pmod("c_custkey", F.lit(4))
    token = F.when(style == 0, ph.format_placeholder(F.col("kind"), F.col("c_custkey"), "square")) \
        .when(style == 1, ph.format_placeholder(F.col("kind"), F.col("c_custkey"), "curly")) \
        .when(style == 2, ph.format_placeholder(F.col("kind"), F.col("c_custkey"), "guillemet")) \
        .otherwise(F.concat(F.lit("["), F.lower("kind"), F.lit("]")))
    parsed = t.withColumn("token", token).withColumn("p", ph.parse_placeholder(F.col("token")))
    return parsed.select("c_custkey", "token", F.col("p.type").alias("type"), F.col("p.num").alias("num"))


def instruction(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    once = ph.append_instruction(F.col("text"))
    return t.select(
        "conv_id", "turn", F.md5(once).alias("appended"), F.md5(ph.append_instruction(once)).alias("twice"),
        F.md5(ph.strip_instruction(once)).alias("stripped"))


def _masked(spark, sf, **options):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mask.mask(scan(docs, "text", NET), "source", ["doc_id"], **options)


def mask_documents(spark, sf):
    return _masked(spark, sf).rows.select("doc_id", F.md5("masked").alias("digest"))


def mask_documents_by_value(spark, sf):
    return _masked(spark, sf, small_vault=False).rows.select("doc_id", F.md5("masked").alias("digest"))


def vault_entries(spark, sf):
    return _masked(spark, sf).entries


def vault_continued(spark, sf):
    """A second pass over the masked vault's sessions adds nothing and numbers nothing twice."""
    first = _masked(spark, sf)
    again = _masked(spark, sf, vault=first.entries)
    return first.entries.unionByName(again.entries)


def restore_documents(spark, sf, small=None):
    m = _masked(spark, sf)
    back = mask.restore(m.rows, m.entries, "source", ["doc_id"], small_vault=small)
    return back.select("doc_id", F.md5("restored").alias("digest"), F.size("missing").alias("missing"))


def restore_elsewhere(spark, sf):
    """Another session's vault restores nothing and reports every placeholder."""
    m = _masked(spark, sf)
    moved = m.rows.withColumn("source", F.concat(F.lit("other_"), "source"))
    back = mask.restore(moved, m.entries, "source", ["doc_id"])
    return back.select("doc_id", F.md5("restored").alias("digest"), F.array_join(
        "missing", " ").alias("missing"))


def _masked_without_session(spark, sf, **options):
    """Every third document has no session."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.when(
        F.pmod("doc_id", F.lit(3)) != 0, F.col("source")).alias("source"))
    return mask.mask(scan(docs, "text", NET), "source", ["doc_id"], **options)


def mask_null_session(spark, sf, small=None):
    return _masked_without_session(spark, sf, small_vault=small).rows.select("doc_id", F.md5("masked").alias("digest"))


def restore_null_session(spark, sf, small=None):
    m = _masked_without_session(spark, sf, small_vault=small)
    back = mask.restore(m.rows, m.entries, "source", small_vault=small)
    return back.select("doc_id", F.md5("restored").alias("digest"), F.size("missing").alias("missing"))


def restore_repeated_keys(spark, sf, small=None):
    """Two documents of a source share each place in the order; no value gets another's placeholder."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text", F.expr("doc_id div 40").alias("place"))
    m = mask.mask(scan(docs, "text", NET), "source", ["place"], small_vault=small)
    back = mask.restore(m.rows, m.entries, "source", small_vault=small)
    return back.select("doc_id", F.md5("restored").alias("digest"), F.size("missing").alias("missing"))


def scan_user_rules(spark, sf):
    """A user's own rules: few digits, and digit runs of unusual lengths."""
    key = F.col("o_orderkey")
    texts = table(spark, sf, "orders").select("o_orderkey", F.concat(
        F.lit("room "), F.lpad(F.pmod(key, F.lit(10_000)).cast("string"), 4, "0"), F.lit(", batch "),
        F.lpad((key * 7919).cast("string"), 24, "3"), F.lit(", tag LK-"),
        F.substring(F.translate(F.hex(key * 104729), "0123456789", "GHIJKLMNOP"), 1, 3)).alias("text"))
    own = (Rule("TAG", r"LK-[A-P]{1,3}"), Rule("ROOM", lengths=(4,)), Rule("BATCH", lengths=(24,)))
    return explode_detections(scan(texts, "text", ScanConfig(("EMAIL",), extra=own)), ["o_orderkey"]).select(
        "o_orderkey", "type", "start", F.col("end").alias("stop"), "value")


def session_ids_odd(spark, sf):
    """Addresses that browsers take and strict parsers refuse."""
    n = F.col("page_id").cast("string")
    forms = F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in (
        ("https://chat_room.test/a b/", "?q=1"), ("https://Chat.test/x|y/", "#t"), ("https://chat.test/{id}/", ""),
        ("https://user@chat.test:8443/é/", "?a b"), ("no address ", ""), ("https://chat.test?n=", ""))])
    return table(spark, sf, "pages").select("page_id", sessions.session_id(F.lit(7), F.get(
        forms, F.pmod("page_id", F.lit(6)).cast("int"))).alias("session_id"))


def residue_check(spark, sf):
    m = _masked(spark, sf)
    back = mask.restore(m.rows, m.entries, "source", ["doc_id"])
    left = evaluate.residue(back)
    return left.agg(F.count(F.lit(1)).alias("residue"))


def session_summary(spark, sf):
    s = sessions.session_summary(_masked(spark, sf).entries)
    return s.select("session_id", "host", "path", "count", *[
        F.coalesce(F.try_element_at("types", F.lit(t)), F.lit(0)).alias(n) for t, n in
        (("EMAIL", "emails"), ("IP_ADDRESS", "ips"))])


def recent_sessions(spark, sf):
    return sessions.recent_sessions(_masked(spark, sf).entries).select("session_id", "count")


def session_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", sessions.session_id(
        F.pmod("page_id", F.lit(7)), F.col("url")).alias("session_id"))


def _moves(spark, sf):
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return table(spark, sf, "documents").select("source").distinct().filter(n % 2 == 0).select(
        F.col("source").alias("from_session"), F.concat(F.lit("src"), (n + 1).cast("string")).alias("to_session"))


def vault_migrate(spark, sf):
    moved, _ = sessions.migrate_sessions(_masked(spark, sf).entries, _moves(spark, sf))
    return moved.select("session_id", "original", "placeholder", "type")


def vault_migrate_report(spark, sf):
    return sessions.migrate_sessions(_masked(spark, sf).entries, _moves(spark, sf))[1]


def vault_forget(spark, sf):
    gone = _moves(spark, sf).select(F.col("from_session").alias("session_id"))
    return sessions.forget(_masked(spark, sf).entries, gone).select("session_id", "seq", "placeholder")


def navigation(spark, sf):
    return sessions.navigation_moves(_visits(spark, sf)).select(
        F.col("ts.event_id").alias("event_id"), "from_session", "to_session")


def _visits(spark, sf):
    """A page history from the events: two kinds of draft pages, and chats; its place in time is one number."""
    kind, n = F.pmod("event_id", F.lit(3)), F.pmod("event_id", F.lit(50)).cast("string")
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("tab_id"), F.struct("ts", "event_id").alias("ts"),
        F.when(kind == 0, F.lit("https://chatgpt.com/")).when(kind == 1, F.concat(
            F.lit("https://claude.ai/chat/"), n)).otherwise(F.lit("https://claude.ai/new?x=1")).alias("url"))


def _migrated(spark, sf):
    """Each visit leaves an entry in its session; then the moves of the whole history are followed."""
    visits = _visits(spark, sf)
    entries = visits.select(
        sessions.session_id(F.col("tab_id"), F.col("url")).alias("session_id"), F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.pmod("event_id", F.lit(7)).cast("string"), F.lit("@mail.test")).alias("original"),
        F.concat(F.lit("[EMAIL_"), F.col("event_id").cast("string"), F.lit("]")).alias("placeholder"),
        F.lit("EMAIL").alias("type"), F.col("ts").alias("created"))
    return migration.follow_moves(entries, sessions.navigation_moves(visits))


def _folder(spark):
    return f"{shared_folder(spark)}/query-{spark.range(1).select(F.expr('uuid()')).first()[0]}"


def policies_roundtrip(spark, sf):
    """Settings out to JSON and in again."""
    full = policy.with_defaults(policy.sanitize_policies(_policies(spark, sf)))
    again = policy.sanitize_policies(policy.policies_to_json(full).select("tenant", "policy_json"))
    return again.select("tenant", F.size("enabled_types").alias("n_types"), "min_confidence", "guard_enabled",
                        "placeholder_style", "instruction_enabled", "language")


def corpus_roundtrip(spark, sf):
    """The labelled texts written as JSON and read again, one row a label."""
    path = f"{_folder(spark)}/corpus"
    files.write_corpus(generated(spark, sf), path)
    return files.read_corpus(spark, path, multi_line=False).select(
        F.md5("text").alias("digest"), F.explode("expected").alias("x")).select("digest", "x.type", "x.value")


def scan_two_views(spark, sf):
    """Keys that only one view of the text shows: a Latin word with a Cyrillic letter, and a Cyrillic word."""
    value = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 24)
    texts = table(spark, sf, "orders").select("o_orderkey", F.when(
        F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit("set \u0430pi_key: "), value)).otherwise(
        F.concat(F.lit("вход: пароль="), value)).alias("text"))
    return explode_detections(scan(texts, "text", ScanConfig(("SECRET",))), ["o_orderkey"]).select(
        "o_orderkey", "type", "start", F.col("end").alias("stop"), "value")


def scan_languages(spark, sf):
    """Names under each language setting."""
    out = None
    for language in ("ru", "en"):
        found = explode_detections(scan(generated(spark, sf), "text", ScanConfig(("PERSON",), language=language)), ["item_id"])
        rows = found.select("item_id", F.lit(language).alias("language"), "start", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def mask_pasted_tokens(spark, sf):
    """Every third text begins with a placeholder someone pasted; new numbers continue behind it."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.when(
        F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("[EMAIL_4] "), "text")).otherwise(F.col("text")).alias("text"))
    return mask.mask(scan(docs, "text", NET), "source", ["doc_id"]).entries.select("session_id", "original", "placeholder")


def snapshot_roundtrip(spark, sf):
    """The vault sealed, stored, found, opened and deleted."""
    snapshot = files.SnapshotTable(spark, f"{_folder(spark)}/snapshot")
    before = snapshot.exists()
    snapshot.save(crypt.encrypt_vault(_masked(spark, sf).entries, "correct horse battery staple"))
    stored = snapshot.exists()
    entries = stage(crypt.decrypt_vault(snapshot.read(), "correct horse battery staple"))
    snapshot.clear()
    return entries.select("*", F.lit(before).alias("before"), F.lit(stored).alias("stored"),
                          F.lit(snapshot.exists()).alias("left"))


def vault_cleared(spark, sf):
    """Everything forgotten at once; what was stored stays readable until then."""
    store = VaultTable(spark, f"{_folder(spark)}/vault")
    store.append(_masked(spark, sf).entries)
    stored = store.entries().count()
    store.clear()
    return store.entries().agg(F.lit(stored).cast("bigint").alias("stored"), F.count(F.lit(1)).alias("left"))


IDLE_SECONDS = 6 * 3600


def _messages(spark, sf):
    """A message of each event; its writer names one of five addresses."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("session"), "ts", F.concat(
            F.lit("write to u"), F.col("user_id").cast("string"), F.lit("."), F.pmod("event_id", F.lit(5)).cast("string"),
            F.lit("@mail.test")).alias("text"))


def vault_expired(spark, sf):
    """Entries of the sessions that are still alive at the last event, six idle hours allowed. The times of all messages
    tell which these are; only their messages are scanned and masked."""
    messages = _messages(spark, sf)
    times = stage(expiry.times_in_spells(messages, "session", "ts", IDLE_SECONDS))
    found = stage(expiry.spells(times))
    now = found.agg(F.max("last_at").alias("now")).first()["now"]
    open_ = expiry.alive(found, F.lit(now), IDLE_SECONDS).select("session_id", "spell")
    rows = expiry.in_spells(messages, "session", "ts", times.join(open_, ["session_id", "spell"], "left_semi"), only=True)
    return mask.mask(scan(rows, "text", NET), "vault_session", ["ts", "event_id"]).entries.select(
        "session_id", "seq", "original", "placeholder")


def navigation_migrated(spark, sf):
    return _migrated(spark, sf)[0].select("session_id", "original", "placeholder", "type")


def navigation_migrated_report(spark, sf):
    return _migrated(spark, sf)[1].select(
        F.col("ts.event_id").alias("event_id"), "from_session", "to_session", "migrated", "dropped")


def site_match(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.when(
        F.pmod("page_id", F.lit(10)) == 9, sessions.url_host(F.col("url"))).otherwise(
        F.get(F.array(*map(F.lit, HOSTS)), F.pmod("page_id", F.lit(10)).cast("int"))).alias("host"))
    return match_site(pages)


def guard_actions(spark, sf):
    docs = scan(table(spark, sf, "documents").select("lang", "text"), "text", NET)
    return guard.guard(docs).groupBy("lang", "action").agg(F.count(F.lit(1)).alias("n"))


def _policies(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(key.alias("tenant"), F.when(F.pmod(key, F.lit(5)) == 0, F.lit(
        '{"enabledTypes":["IBAN",null,"PLANET"],"minConfidence":"extreme","language":"en","guardEnabled":1,'
        '"instructionEnabled":false,"guardDisabledSites":[true,"grok"],"placeholderStyle":"guillemet","colour":"red"}'))
        .when(F.pmod(key, F.lit(5)) == 1, F.lit('{"enabledTypes":["US_SSN","CARD"],"guardEnabled":false}'))
        .when(F.pmod(key, F.lit(5)) == 2, F.lit("[7]"))
        .when(F.pmod(key, F.lit(5)) == 3, F.lit("{half"))
        .otherwise(F.lit('{"minConfidence":"high","placeholderStyle":"curly"}')).alias("policy_json"))


def policies_sanitized(spark, sf):
    p = policy.sanitize_policies(_policies(spark, sf))
    return p.select("tenant", F.array_join("enabled_types", ",").alias("types"), "min_confidence", "language",
                    "guard_enabled", "instruction_enabled", F.array_join("guard_disabled_sites", ",").alias("off"),
                    "placeholder_style")


def policies_effective(spark, sf):
    p = policy.with_defaults(policy.sanitize_policies(_policies(spark, sf)))
    return p.select("tenant", F.size("enabled_types").alias("n_types"), "min_confidence", "guard_enabled",
                    "placeholder_style", guard.guard_active(
                        F.lit("grok"), F.col("guard_enabled"), F.col("guard_disabled_sites")).alias("grok_guarded"))


TENANT_POLICIES = (
    '{"enabledTypes":["EMAIL","IP_ADDRESS"],"guardEnabled":false}', '{"enabledTypes":["PHONE","CARD"],"minConfidence":"low"}',
    '{"minConfidence":"high","guardDisabledSites":["claude"]}', '{"enabledTypes":["PERSON","SECRET","EMAIL"],"language":"ru"}',
    '{"enabledTypes":["PERSON","IP_ADDRESS"],"language":"en","instructionEnabled":false}')


def _tenant_policies(spark, sf):
    """A policy for five of six sources; the others go by the defaults."""
    n = F.pmod(F.regexp_extract("source", "([0-9]+)$", 1).cast("int"), F.lit(6))
    raw = table(spark, sf, "documents").select("source").distinct().select(
        "source", F.get(F.array(*map(F.lit, TENANT_POLICIES)), n).alias("policy_json"))
    return policy.sanitize_policies(raw.filter("policy_json IS NOT NULL"))


def scan_by_policy(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    found = explode_detections(tenants.scan_by_policy(docs, _tenant_policies(spark, sf), "source"), ["doc_id"])
    return found.select("doc_id", "type", "start", F.col("end").alias("stop"), "value", "confidence")


def _choices(docs):
    return docs.withColumn("choice", F.get(F.array(*map(F.lit, ("mask", "send", "drop"))), F.pmod(
        "doc_id", F.lit(4)).cast("int")))


def guard_send(spark, sf):
    """What leaves of each document, by its sender's choice; every fourth has none."""
    docs = _choices(table(spark, sf, "documents").select("doc_id", "source", "text"))
    sent = send.guard_send(docs, "source", ["doc_id"], cfg=NET)
    return sent.rows.select("doc_id", "action", F.md5("sent").alias("digest"))


def guard_send_leaks(spark, sf):
    docs = _choices(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return send.guard_send(docs, "source", ["doc_id"], cfg=NET).leaks


def guard_send_by_policy(spark, sf):
    """Guarded by each source's policy on a site; counted by source and action."""
    docs = _choices(table(spark, sf, "documents").select("doc_id", "source", "text", F.when(
        F.pmod("doc_id", F.lit(2)) == 0, F.lit("https://claude.ai/new")).otherwise(F.lit("https://poe.com/")).alias("url")))
    sent = send.guard_send(docs, "source", ["doc_id"], policies=_tenant_policies(spark, sf), tenant="source", url_col="url")
    return sent.rows.groupBy("source", "action").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.contains("sent", F.lit(ph.INSTRUCTION))).alias("instructed"))


def leak_count(spark, sf):
    docs = guard.guard(scan(table(spark, sf, "documents").select("doc_id", "text"), "text", NET))
    choice = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("mask")).when(
        F.pmod("doc_id", F.lit(3)) == 1, F.lit("send")).otherwise(F.lit("drop"))
    return guard.leaks_prevented(guard.settle(docs.withColumn("choice", choice)))


def generated_scan(spark, sf):
    found = explode_detections(scan(generated(spark, sf), "text", CORPUS), ["item_id"])
    return found.select("item_id", "type", "start", F.col("end").alias("stop"), "value")


def generated_business_scan(spark, sf):
    cfg = ScanConfig((*DEFAULT_TYPES, "DATE_OF_BIRTH"))
    texts = generate.labelled_corpus(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "business")
    return explode_detections(scan(texts, "text", cfg), ["item_id"]).select(
        "item_id", "type", "start", F.col("end").alias("stop"), "value", "confidence")


def generated_labels(spark, sf):
    return generated(spark, sf, "orders", "o_orderkey").select(
        "item_id", F.md5("text").alias("digest"), F.size("expected").alias("n_expected"))


def corpus_quality(spark, sf):
    scanned = stage(scan(generated(spark, sf), "text", CORPUS))
    return evaluate.passes_gate(evaluate.quality(evaluate.matches(scanned, "item_id"))).select(
        "expected", "detected", "matched", "persons_expected", "persons_matched", "precision", "recall",
        "person_recall", "passed")


def _hard_matches(spark, sf):
    texts = generate.labelled_corpus(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "hard")
    return evaluate.matches(stage(scan(texts, "text", CORPUS)), "item_id")


def hard_corpus_quality(spark, sf):
    """Texts that the rules miss, mistake or must leave alone: precision and recall stay below 1 and fail the gate."""
    return evaluate.passes_gate(evaluate.quality(_hard_matches(spark, sf))).select(
        "expected", "detected", "matched", "persons_expected", "persons_matched", "precision", "recall",
        "person_recall", "passed")


def hard_corpus_by_type(spark, sf):
    return evaluate.by_type(_hard_matches(spark, sf))


def silent_negatives(spark, sf):
    scanned = scan(generated(spark, sf).filter(F.size("expected") == 0), "text", CORPUS)
    return scanned.select("item_id", F.size("detections").alias("detections"))


def group_rollup(spark, sf):
    found = explode_detections(scan(generated(spark, sf), "text", CORPUS), ["item_id"])
    return found.groupBy(policy.group_of(F.col("type")).alias("type_group")).agg(F.count(F.lit(1)).alias("n"))


def selection(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return explode_detections(scan_selection(t, "text", NET), ["conv_id", "turn"]).select(
        "conv_id", "turn", "type", "start", F.col("end").alias("stop"))


def highlight(spark, sf):
    docs = scan(table(spark, sf, "documents").select("doc_id", "text"), "text", NET)
    return docs.select("doc_id", F.md5(mask.highlight(F.col("text"), F.col("detections"))).alias("digest"))


def encrypt_roundtrip(spark, sf):
    entries = _masked(spark, sf).entries
    sealed = stage(crypt.encrypt_vault(entries, "correct horse battery staple"))
    return crypt.decrypt_vault(sealed, "correct horse battery staple")


def scan_all(spark, sf):
    return _spans(spark, sf, ScanConfig(min_confidence="low"), confidence=True)


def scan_persons(spark, sf):
    return _spans(spark, sf, ScanConfig(("PERSON",)))


def scan_secrets(spark, sf):
    return _spans(spark, sf, ScanConfig(("SECRET",)))


def _document_stream(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]").select("doc_id", "source", "lang", "text")


def stream_guard(spark, sf):
    """Guard routing as a stream, to its end, then the two tables it wrote."""
    from veilframe.streaming.messages import guard_stream, route

    folder = f"{shared_folder(spark)}/stream-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    guarded = guard_stream(_document_stream(spark, sf), "text", NET)
    route(guarded, f"{folder}/clean", f"{folder}/held", f"{folder}/state").trigger(
        availableNow=True).start().awaitTermination()
    schema = guarded.schema
    both = spark.read.schema(schema).parquet(f"{folder}/clean").unionByName(
        spark.read.schema(schema).parquet(f"{folder}/held"))
    return both.groupBy("lang", "action").agg(F.count(F.lit(1)).alias("n"))


def stream_guard_send(spark, sf):
    """Guard to send as a stream, to its end, then the messages it published."""
    from veilframe.streaming.messages import guard_send_stream

    folder = f"{shared_folder(spark)}/stream-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    guard_send_stream(
        _choices(_document_stream(spark, sf)), VaultTable(spark, f"{folder}/vault"), "source", ["doc_id"], f"{folder}/state",
        lambda rows, batch: rows.select("doc_id", "action", "sent").write.mode("overwrite").parquet(
            f"{folder}/sent/batch_id={batch}"), cfg=NET).trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.schema("doc_id bigint, action string, sent string").parquet(f"{folder}/sent")
    return sent.select("doc_id", "action", F.md5("sent").alias("digest"))


def stream_mask(spark, sf):
    """Masking as a stream, to its end, then the vault it wrote."""
    from veilframe.streaming.messages import mask_stream, scan_stream

    folder = f"{shared_folder(spark)}/stream-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    vault = VaultTable(spark, f"{folder}/vault")
    mask_stream(
        scan_stream(_document_stream(spark, sf), "text", NET), vault, "source", ["doc_id"], f"{folder}/state",
        lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/masked/batch_id={batch}"),
    ).trigger(availableNow=True).start().awaitTermination()
    return vault.entries()


def _many_batches(spark, sf, run):
    """Documents dealt to five batches by their number, written and read by all tasks; the vault the stream wrote. Each time
    the stream goes on from its checkpoint and takes what has come as one batch."""
    folder = f"{shared_folder(spark)}/stream-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    step = (docs.agg(F.max("doc_id")).first()[0] or 0) // 5 + 1
    vault = VaultTable(spark, f"{folder}/vault", buckets=64)
    for i in range(5):
        docs.filter((F.col("doc_id") >= i * step) & (F.col("doc_id") < (i + 1) * step)).write.mode("append").parquet(
            f"{folder}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
        run(stream, vault, folder).trigger(availableNow=True).start().awaitTermination()
    return vault.entries()


def stream_mask_many(spark, sf):
    """Masking as a stream of several batches numbers as one batch does."""
    from veilframe.streaming.messages import mask_stream, scan_stream

    return _many_batches(spark, sf, lambda stream, vault, folder: mask_stream(
        scan_stream(stream, "text", NET), vault, "source", ["doc_id"], f"{folder}/state",
        lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/masked/batch_id={batch}")))


QUERIES = {
    "type_counts_by_source_full": flagship,
    "scan_email": lambda s, d: _spans(s, d, ScanConfig(("EMAIL",)), confidence=True),
    "scan_ip": lambda s, d: _spans(s, d, ScanConfig(("IP_ADDRESS",))),
    "scan_card": lambda s, d: _spans(s, d, ScanConfig(("CARD",), "low"), confidence=True),
    "scan_phone": scan_phone,
    "scan_pages": scan_pages,
    "scan_persons": scan_persons,
    "scan_secrets": scan_secrets,
    "scan_all_types": scan_all,
    "scan_fullwidth": scan_fullwidth,
    "scan_expanding": scan_expanding,
    "type_counts": chips,
    "counts_by_source": partial(counts_by, "source"),
    "counts_by_lang": partial(counts_by, "lang"),
    "check_digits": check_digits,
    "fold_to_latin": partial(fold, "en"),
    "fold_to_cyrillic": partial(fold, "ru"),
    "script_counts": script_counts,
    "normalize_fullwidth": normalize_fullwidth,
    "entropy": entropy,
    "placeholder_parse": placeholders,
    "instruction": instruction,
    "mask_documents": mask_documents,
    "mask_documents_by_value": mask_documents_by_value,
    "vault_entries": vault_entries,
    "vault_continued": vault_continued,
    "restore_documents": restore_documents,
    "restore_documents_by_value": partial(restore_documents, small=False),
    "restore_elsewhere": restore_elsewhere,
    "mask_null_session": mask_null_session,
    "mask_null_session_by_value": partial(mask_null_session, small=False),
    "restore_null_session": restore_null_session,
    "restore_null_session_by_value": partial(restore_null_session, small=False),
    "restore_repeated_keys": restore_repeated_keys,
    "restore_repeated_keys_by_value": partial(restore_repeated_keys, small=False),
    "scan_user_rules": scan_user_rules,
    "session_ids_odd": session_ids_odd,
    "residue_check": residue_check,
    "session_summary": session_summary,
    "recent_sessions": recent_sessions,
    "session_ids": session_ids,
    "vault_migrate": vault_migrate,
    "vault_migrate_report": vault_migrate_report,
    "vault_forget": vault_forget,
    "navigation_moves": navigation,
    "policies_roundtrip": policies_roundtrip,
    "corpus_roundtrip": corpus_roundtrip,
    "scan_two_views": scan_two_views,
    "scan_languages": scan_languages,
    "mask_pasted_tokens": mask_pasted_tokens,
    "snapshot_roundtrip": snapshot_roundtrip,
    "vault_cleared": vault_cleared,
    "vault_expired": vault_expired,
    "navigation_migrated": navigation_migrated,
    "navigation_migrated_report": navigation_migrated_report,
    "site_match": site_match,
    "scan_by_policy": scan_by_policy,
    "guard_send": guard_send,
    "guard_send_leaks": guard_send_leaks,
    "guard_send_by_policy": guard_send_by_policy,
    "stream_guard_send": stream_guard_send,
    "guard_actions": guard_actions,
    "leak_count": leak_count,
    "policies_sanitized": policies_sanitized,
    "policies_effective": policies_effective,
    "generated_labels": generated_labels,
    "generated_scan": generated_scan,
    "generated_business_scan": generated_business_scan,
    "corpus_quality": corpus_quality,
    "hard_corpus_quality": hard_corpus_quality,
    "hard_corpus_by_type": hard_corpus_by_type,
    "silent_negatives": silent_negatives,
    "group_rollup": group_rollup,
    "scan_selection": selection,
    "highlight": highlight,
    "encrypt_roundtrip": encrypt_roundtrip,
    "stream_guard": stream_guard,
    "stream_mask": stream_mask,
    "stream_mask_many": stream_mask_many,
}
