import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.functions.placeholders import STYLES
from veilframe.operators import crypt, evaluate, mask, sessions
from veilframe.operators.mask import VAULT_SCHEMA
from veilframe.operators.resolve import DETECTION_TYPE
from veilframe.operators.scan import scan
from veilframe.plans import staging
from veilframe.sources.files import SnapshotTable, VaultStorageError, VaultTable

SCHEMA = f"session string, seq_no int, text string, detections {DETECTION_TYPE}"
TOKEN = re.compile(r"\[[A-Z_]+_\d+\]|\{\{[A-Z_]+_\d+\}\}|«[A-Z_]+_\d+»")


def random_docs(n, seed, sessions_=("a", "b")):
    """Texts of words, values and pasted placeholder tokens, with the values' spans."""
    rnd = random.Random(seed)
    docs = []
    for i in range(n):
        text, found = "", []
        for _ in range(rnd.randint(0, 9)):
            roll = rnd.random()
            if roll < 0.55:
                kind = rnd.choice(("PERSON", "EMAIL", "RU_INN"))
                value = f"<{rnd.randint(1, 12)}>" if rnd.random() < 0.7 else f"<{kind}{rnd.randint(1, 40)}>"
                found.append((kind, len(text), len(text) + len(value), value, "high", "format"))
                text += value
            elif roll < 0.65:
                left, right = rnd.choice(list(STYLES.values()))
                text += f"{left}{rnd.choice(('PERSON', 'EMAIL'))}_{rnd.randint(1, 30)}{right}"
            else:
                text += rnd.choice(("слово", "word", "."))
            text += " "
        # One session holds most documents.
        docs.append((sessions_[0] if rnd.random() < 0.8 else rnd.choice(sessions_), i, text, found))
    return docs


def reader(docs, vault=None, style="square"):
    """The rule, one document after the other. Changes ``vault`` ({session: {value: (placeholder, type)}})."""
    vault = {} if vault is None else vault
    left, right = STYLES[style]
    masked = {}
    for session, no, text, found in sorted(docs, key=lambda d: d[1]):
        entries = vault.setdefault(session, {})
        high = {}
        for token in [p for p, _ in entries.values()] + (TOKEN.findall(text) if found else []):
            kind, num = token.strip("[]{}«»").rsplit("_", 1)
            high[kind] = max(high.get(kind, 0), int(num))
        for kind, _, _, value, *_ in found:
            if value not in entries:
                high[kind] = high.get(kind, 0) + 1
                entries[value] = (f"{left}{kind}_{high[kind]}{right}", kind)
        for _, start, end, value, *_ in reversed(found):
            text = text[:start] + entries[value][0] + text[end:]
        masked[no] = text
    return masked, vault


@pytest.mark.parametrize("small", [True, False])
def test_numbering_equals_reading_one_by_one(spark, small):
    docs = random_docs(150, 11)
    first, second = docs[:90], docs[90:]
    want, vault = reader(first)
    m = mask.mask(spark.createDataFrame(first, SCHEMA), "session", ["seq_no"], small_vault=small)
    assert {r.seq_no: r.masked for r in m.rows.collect()} == want
    assert {(r.session_id, r.original): (r.placeholder, r.type) for r in m.entries.collect()} == {
        (s, v): e for s, entries in vault.items() for v, e in entries.items()}
    order = [(r.session_id, r.seq) for r in m.entries.orderBy("session_id", "seq").collect()]
    for s, entries in vault.items():
        assert [q for x, q in order if x == s] == list(range(1, len(entries) + 1))
        assert list(entries) == [r.original for r in m.entries.filter(F.col("session_id") == s).orderBy("seq").collect()]

    # A later batch in another style continues the counters.
    want2, vault2 = reader(second, vault, "curly")
    m2 = mask.mask(spark.createDataFrame(second, SCHEMA), "session", ["seq_no"], m.entries, style="curly",
                   small_vault=small)
    assert {r.seq_no: r.masked for r in m2.rows.collect()} == want2
    both = m.entries.unionByName(m2.entries)
    assert both.count() == sum(map(len, vault2.values())) == both.select("session_id", "placeholder").distinct().count()


def test_hot_values_take_the_broadcast_branch(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    table = rows.select("k").distinct().filter("k <> 'k9'").withColumn("v", F.concat(F.lit("v"), "k"))
    got = staging.lookup(rows, table, ["k"])
    assert got.count() == 5000 and got.filter("v <> concat('v', k)").count() == 0
    assert [r.k for r in got.filter("v is null").collect()] == ["k9"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


@pytest.mark.parametrize("small", [True, False])
def test_restore_and_isolation(spark, small):
    docs = random_docs(60, 5)
    frame = spark.createDataFrame(docs, SCHEMA)
    m = mask.mask(frame, "session", ["seq_no"], small_vault=small)
    back = mask.restore(m.rows, m.entries, "session", ["seq_no"], small_vault=small).collect()
    issued = {(r.session_id, r.placeholder): r.original for r in m.entries.collect()}
    for r in back:
        # A pasted token that another document made real is restored as well.
        want = TOKEN.sub(lambda t, r=r: issued.get((r.session, t[0]), t[0]), r.masked)
        unknown = [t for t in reversed(TOKEN.findall(r.masked)) if (r.session, t) not in issued]
        assert r.restored == want and r.missing == list(dict.fromkeys(unknown))
    other = m.rows.withColumn("session", F.lit("zzz"))
    for r in mask.restore(other, m.entries, "session", ["seq_no"], small_vault=small).collect():
        assert r.restored == r.masked and set(r.missing) == set(TOKEN.findall(r.masked))


def test_round_trip_of_scanned_texts(spark):
    entities = ["nora.quill7@post.example", "+7 (916) 123-45-67", "123-456-789 64", "ИНН 7712345671", "ОГРН 1207700012343",
                "карта 2200 1234 5678 9019", "IBAN DE12500105170648489890", "192.168.10.42", "Иванов Иван Иванович",
                "Саше Иванову", "Dr. John Smith", "паспорт 4510 123456 выдан", "пароль=Gr4niteHarbor77"]
    rnd = random.Random(2)
    texts = [(f"s{i % 7}", i, " ".join(
        rnd.choice(entities) if rnd.random() < 0.4 else rnd.choice(("договор", "подписан", "вчера,", "офис.", "без"))
        for _ in range(rnd.randint(3, 12)))) for i in range(120)]
    scanned = scan(spark.createDataFrame(texts, "session string, no int, text string"))
    m = mask.mask(scanned, "session", ["no"])
    back = mask.restore(mask.with_instruction(m.rows), m.entries, "session", ["no"], strip=True)
    assert evaluate.residue(back).count() == 0
    assert back.filter(F.size("missing") > 0).count() == 0 and back.count() == 120


def test_highlight_escapes_everything(spark):
    text = "<b>&\"'x</b> a@b.com <i>"
    df = scan(spark.createDataFrame([(text,)], "text string")).select(mask.highlight(F.col("text"), F.col("detections")))
    assert df.first()[0] == ("&lt;b&gt;&amp;&quot;&#39;x&lt;/b&gt; <span class=\"highlight\">a@b.com</span> &lt;i&gt;")


VAULT = [("5_chatgpt.com/", 1, "v1", "[PERSON_1]", "PERSON"), ("5_chatgpt.com/", 2, "v2", "[EMAIL_1]", "EMAIL"),
         ("5_chatgpt.com/", 3, "v3", "[EMAIL_2]", "EMAIL"), ("5_chatgpt.com/c/1", 1, "w1", "[PERSON_1]", "PERSON"),
         ("5_chatgpt.com/c/1", 2, "v2", "[EMAIL_9]", "EMAIL"), ("plain", 1, "z", "[PERSON_1]", "PERSON")]


def test_session_operators(spark):
    vault = spark.createDataFrame(VAULT, VAULT_SCHEMA)
    moves = spark.createDataFrame([("5_chatgpt.com/", "5_chatgpt.com/c/1"), ("none", "plain"), ("plain", "plain")],
                                  "from_session string, to_session string")
    moved, report = sessions.migrate_sessions(vault, moves)
    left = {(r.session_id, r.original): r.placeholder for r in moved.collect()}
    assert left == {("5_chatgpt.com/c/1", "w1"): "[PERSON_1]", ("5_chatgpt.com/c/1", "v2"): "[EMAIL_9]",
                    ("5_chatgpt.com/c/1", "v3"): "[EMAIL_2]", ("plain", "z"): "[PERSON_1]"}
    assert {(r.from_session, r.migrated, r.dropped) for r in report.collect()} == {
        ("5_chatgpt.com/", 1, 2), ("none", 0, 0), ("plain", 0, 0)}
    summary = {r.session_id: r for r in sessions.session_summary(vault).collect()}
    s = summary["5_chatgpt.com/"]
    assert (s.host, s.path, s["count"], s.types) == ("chatgpt.com", "/", 3, {"PERSON": 1, "EMAIL": 2})
    assert (summary["5_chatgpt.com/c/1"].path, summary["plain"].host, summary["plain"].path) == ("/c/1", "plain", "/")
    gone = spark.createDataFrame([("plain",)], "session_id string")
    assert sessions.forget(vault, gone).count() == 5
    with pytest.raises(ValueError):
        sessions.migrate_sessions(vault, spark.createDataFrame(
            [("a", "b"), ("b", "c")], "from_session string, to_session string"))


def test_session_ids_and_navigation(spark):
    urls = ["https://ChatGPT.com/c/1?x=1#f", "https://chatgpt.com", "https://chatgpt.com/", "not a url", None]
    ids = spark.createDataFrame([(u,) for u in urls], "url string").select(
        sessions.session_id(F.lit(3), F.col("url"))).collect()
    assert [r[0] for r in ids] == ["3_chatgpt.com/c/1", "3_chatgpt.com/", "3_chatgpt.com/", "3_unknown", "3_unknown"]
    visits = [(1, 1, "https://chatgpt.com/"), (1, 2, "https://chatgpt.com/c/a"), (1, 3, "https://chatgpt.com/c/b"),
              (2, 1, "https://claude.ai/new"), (2, 2, "https://claude.ai/chat/x"), (3, 1, "https://poe.com/"),
              (3, 2, "https://poe.com/a"), (4, 1, "https://other.example/"), (4, 2, "https://other.example/b")]
    moves = sessions.navigation_moves(spark.createDataFrame(visits, "tab_id int, ts int, url string")).collect()
    assert {(r.from_session, r.to_session) for r in moves} == {
        ("1_chatgpt.com/", "1_chatgpt.com/c/a"), ("2_claude.ai/new", "2_claude.ai/chat/x"),
        ("4_other.example/", "4_other.example/b")}


def test_encrypted_snapshot(spark, tmp_path):
    vault = spark.createDataFrame(VAULT, VAULT_SCHEMA)
    store = SnapshotTable(spark, str(tmp_path / "snapshot"))
    assert not store.exists() and store.read() is None
    store.save(crypt.encrypt_vault(vault, "amber-gate"))
    assert store.exists()
    shown = str(store.read().collect())
    names = {r.session_id for r in vault.collect()}
    assert not any(n in shown for n in names) and store.read().select("session_key").distinct().count() == len(names)
    one = sorted(names)[0]
    some = crypt.decrypt_vault(crypt.sealed_sessions(store.read(), "amber-gate", [one, "none"]), "amber-gate").collect()
    assert sorted(some) == sorted(r for r in vault.collect() if r.session_id == one)
    assert "PERSON" not in shown and "original" not in shown
    opened = crypt.decrypt_vault(store.read(), "amber-gate")
    assert sorted(opened.collect()) == sorted(vault.collect()) and crypt.session_count(opened) == 3
    with pytest.raises(crypt.WrongPassphrase):
        crypt.decrypt_vault(store.read(), "other-gate")
    store.clear()
    assert not store.exists()


def test_vault_table(spark, tmp_path):
    vault = spark.createDataFrame(VAULT, VAULT_SCHEMA)
    store = VaultTable(spark, str(tmp_path / "vault"))
    assert store.entries().count() == 0
    store.append(vault.filter("session_id = 'plain'"))
    store.put_batch(vault.filter("session_id <> 'plain'"), 4)
    store.put_batch(vault.filter("session_id <> 'plain'"), 4)
    assert sorted(store.entries().collect()) == sorted(vault.collect())
    assert store.entries(before_batch=4).count() == 1
    store.rewrite(sessions.forget(store.entries(), spark.createDataFrame([("plain",)], "session_id string")))
    assert store.entries().count() == 5
    store.clear()
    assert store.entries().count() == 0
    broken = tmp_path / "file"
    broken.write_text("")
    with pytest.raises(VaultStorageError):
        VaultTable(spark, str(broken / "vault")).append(vault)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        staging.shared_folder(Session())


@pytest.mark.parametrize("small", [None, False])
def test_masking_fails_closed(spark, small):
    rows = [(None, 1, "mail a@b.com"), (None, None, "mail c@d.com"), ("s", None, "e@f.org"), ("s", 1, "e@f.org, g@h.org"),
            ("s", 1, "i@j.org"), ("s", 2, None)]
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows],
                               "session string, no int, text string, session_id string, start int")
    m = mask.mask(scan(df, "text", ScanConfig(("EMAIL",))), "session", ["no"], small_vault=small)
    got = m.rows.collect()
    assert len(got) == len(rows) and not any("@" in (r.masked or "") for r in got)
    assert all(r.session_id == "mine" and r.start == 7 for r in got)
    entries = m.entries.collect()
    assert len({(r.session_id, r.placeholder) for r in entries}) == len(entries) == 5
    back = mask.restore(m.rows, m.entries, "session", small_vault=small).collect()
    assert sorted(((r.text, r.restored) for r in back), key=repr) == sorted(((r[2], r[2]) for r in rows), key=repr)


@pytest.mark.parametrize("small", [None, False])
def test_unscanned_texts_and_ambiguous_entries(spark, small):
    df = scan(spark.createDataFrame([("s", 1, "a@b.com"), ("s", 2, "x")], "session string, no int, text string"), "text",
              ScanConfig(("EMAIL",)))
    unscanned = df.withColumn("detections", F.when(F.col("no") == 1, F.col("detections")))
    rows = {r.no: r.masked for r in mask.mask(unscanned, "session", ["no"], small_vault=small).rows.collect()}
    assert rows == {1: "[EMAIL_1]", 2: None}
    vault = spark.createDataFrame([("s", 1, "a@b.com", "[EMAIL_1]", "EMAIL"), ("s", 2, "c@d.com", "[EMAIL_1]", "EMAIL"),
                                   ("s", 3, "e@f.com", "[EMAIL_2]", "EMAIL")], mask.VAULT_SCHEMA)
    texts = spark.createDataFrame([("s", "to [EMAIL_1] and [EMAIL_2]")], "session string, masked string")
    r = mask.restore(texts, vault, "session", small_vault=small).first()
    assert r.restored == "to [EMAIL_1] and e@f.com" and r.missing == ["[EMAIL_1]"]
