"""SQL for DuckDB that gives the same rows as the registered queries, written from the rules and not from the Spark
plans: positions by summing split pieces, check digits by list arithmetic, masking by windows.
"""

from __future__ import annotations

from veilframe.functions.placeholders import INSTRUCTION
from veilframe.operators import generate as g
from veilframe.operators.persons import NOT_NAMES
from veilframe.plans.queries import EXPANDING, FULL_WIDTH_FROM, FULL_WIDTH_TO, HOSTS
from veilframe.sources.catalog import SITES

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
NET = f"(?:{EMAIL})|(?:{IPV4})"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
CARD_CUE = "(?i)карт|card|visa|master|мир|amex|maestro|плат[её]ж|оплат|сч[её]т"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans(source: str, keys: str, text: str, regex: str) -> str:
    """Rows ``keys, start, stop, value`` of all matches."""
    return f"""
      SELECT {keys}, {text} AS body, v AS value,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INT) AS start,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
          + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS INT) AS stop
      FROM (SELECT *, unnest(ms) AS v, unnest(range(1, len(ms) + 1)) AS i
            FROM (SELECT *, regexp_extract_all({text}, {quote(regex)}) AS ms,
                         regexp_split_to_array({text}, {quote(regex)}) AS gaps FROM {source})
            WHERE len(ms) > 0)"""


def weighted(text: str, weights, mod: int | None = None) -> str:
    term = f"substr({text}, i, 1)::INT * {list(weights)}[i]"
    term = f"({term}) % {mod}" if mod else term
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: {term}))"


def luhn_total(text: str, closed: bool) -> str:
    """Luhn sum; ``closed`` says the text already ends in its check digit."""
    even = 0 if closed else 1
    return f"""list_sum(list_transform(range(1, length({text}) + 1), lambda i:
      CASE WHEN (length({text}) - i) % 2 = {1 - even} THEN
        CASE WHEN substr({text}, i, 1)::INT >= 5 THEN substr({text}, i, 1)::INT * 2 - 9
             ELSE substr({text}, i, 1)::INT * 2 END
      ELSE substr({text}, i, 1)::INT END))"""


TYPE = "CASE WHEN contains(value, '@') THEN 'EMAIL' ELSE 'IP_ADDRESS' END"
NET_SPANS = f"net AS (SELECT *, {TYPE} AS type FROM ({spans('documents', 'doc_id, source, lang', 'text', NET)}))"

# Placeholders: first sightings per source and value, numbered per source and type in reading order.
VAULT = f"""{NET_SPANS},
  firsts AS (SELECT source, value, type, doc_id, start FROM net
             QUALIFY row_number() OVER (PARTITION BY source, value ORDER BY doc_id, start) = 1),
  vault AS (SELECT source AS session_id,
              row_number() OVER (PARTITION BY source ORDER BY doc_id, start) AS seq, value AS original,
              '[' || type || '_' || row_number() OVER (PARTITION BY source, type ORDER BY doc_id, start) || ']'
                AS placeholder, type
            FROM firsts)"""
MASKED = f"""{VAULT},
  new AS (SELECT doc_id, list(placeholder ORDER BY start) AS ps, list(value ORDER BY start) AS vs
          FROM net JOIN vault ON net.source = vault.session_id AND net.value = vault.original GROUP BY doc_id),
  masked AS (SELECT d.doc_id, d.source, d.text, ps,
     CASE WHEN ps IS NULL THEN text ELSE
       list_aggregate(list_transform(range(1, len(ps) + 2), lambda i:
         regexp_split_to_array(text, {quote(NET)})[i] || coalesce(ps[i], '')), 'string_agg', '') END AS masked
     FROM documents d LEFT JOIN new USING (doc_id))"""


NULL_SESSION = f"""WITH docs0 AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END
  AS source FROM documents), {MASKED.replace('documents', 'docs0')} SELECT doc_id, md5(masked) AS digest FROM masked"""
ROUND_TRIP = "SELECT doc_id, md5(text) AS digest, 0 AS missing FROM documents"


# --- the synthetic texts, rebuilt from the row ids ---

def h(salt: str) -> str:
    return f"md5(id || ':{salt}')"


def digits(salt: str, n: int) -> str:
    return f"substr(translate({h(salt)}, 'abcdef', '012345'), 1, {n})"


def number(salt: str, below: int) -> str:
    return f"(('0x' || substr({h(salt)}, 1, 6))::INT % {below})"


def pick(salt: str, values) -> str:
    return f"([{', '.join(map(quote, values))}])[{number(salt, len(values))} + 1]"


def opaque(salt: str, n: int) -> str:
    one = " || ".join(f"replace(to_base64(unhex({h(salt + p)})), '=', '')" for p in "ab")
    return f"substr({one}, 1, {n})"


def jwt_part(salt: str, n: int) -> str:
    return f"translate({opaque(salt, n)}, '+/', '-_')"


BODIES = {
    "inn10_b": f"'52' || {digits('inn', 7)}",
    "inn12_b": f"'52' || {digits('inn', 8)}",
    "snils_b": f"'1' || {digits('snils', 8)}",
    "ogrn13_b": f"'1' || ({number('ogrny', 16)} + 10) || '52' || {digits('ogrn', 7)}",
    "ogrn15_b": f"'3' || ({number('ogrny', 16)} + 10) || '52' || {digits('ogrn', 9)}",
    "card_b": f"{pick('cardp', g.CARD_PREFIXES)} || {digits('card', 11)}",
    "oms_b": f"'52' || {digits('oms', 13)}",
    "de_b": digits("iban", 18),
    "gb_b": digits("iban", 14),
    "tel": digits("tel", 9),
}
INN10, INN12A, INN12B = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
VALUES = {
    "inn10": f"inn10_b || ({weighted('inn10_b', INN10)} % 11 % 10)",
    "inn12_a": f"inn12_b || ({weighted('inn12_b', INN12A)} % 11 % 10)",
    "snils": "substr(snils_b, 1, 3) || '-' || substr(snils_b, 4, 3) || '-' || substr(snils_b, 7, 3) || ' ' || "
             f"lpad(({weighted('snils_b', SNILS)} % 101 % 100)::VARCHAR, 2, '0')",
    "ogrn13": "ogrn13_b || (ogrn13_b::BIGINT % 11 % 10)",
    "ogrn15": "ogrn15_b || (ogrn15_b::BIGINT % 13 % 10)",
    "card": f"card_b || ((10 - {luhn_total('card_b', False)} % 10) % 10)",
    "oms": f"oms_b || ((10 - {luhn_total('oms_b', False)} % 10) % 10)",
    "iban_de": "'DE' || lpad((98 - (de_b || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || de_b",
    "iban_gb": "'GB' || lpad((98 - ('17102114' || gb_b || '161100')::HUGEINT % 97)::VARCHAR, 2, '0') || 'HALE' || gb_b",
    "phone": f"""([
        '+79' || tel,
        '8 (9' || substr(tel, 1, 2) || ') ' || substr(tel, 3, 3) || ' ' || substr(tel, 6, 2) || ' ' || substr(tel, 8, 2),
        '+7 9' || substr(tel, 1, 2) || ' ' || substr(tel, 3, 3) || '-' || substr(tel, 6, 2) || '-' || substr(tel, 8, 2),
        '8 (831) ' || substr(tel, 3, 3) || '-' || substr(tel, 6, 2) || '-' || substr(tel, 8, 2)
      ])[{number('telf', 4)} + 1]""",
    "ssn": f"lpad(({number('ssna', 665)} + 1)::VARCHAR, 3, '0') || '-' || lpad(({number('ssng', 99)} + 1)::VARCHAR, 2, '0')"
           f" || '-' || lpad(({number('ssns', 9999)} + 1)::VARCHAR, 4, '0')",
    "ip": f"CASE WHEN {number('ip', 2)} = 0 THEN '172.20.' || {number('ipa', 254)} || '.' || {number('ipb', 254)} ELSE '203.' "
          f"|| {number('ipa', 254)} || '.' || {number('ipb', 254)} || '.' || {number('ipc', 254)} END",
    "mail": f"{pick('mailn', g.MAIL_NAMES)} || '.' || {pick('mails', g.MAIL_SURNAMES)} || ({number('mail', 90)} + 10)"
            f" || '@' || {pick('mailh', g.MAIL_HOSTS)}",
    "fio": pick("fio", g.FULL_NAMES),
    "fio_to": pick("fio", g.FULL_NAMES_DECLINED),
    "pair": pick("pair", g.PAIRS),
    "titled": pick("title", g.TITLED),
    "passport": f"{digits('series', 4)} || ' ' || {digits('passport', 6)}",
    "key40": opaque("key", 40),
    "key24": opaque("key", 24),
    "jwt": f"'eyJ' || {jwt_part('jwth', 21)} || '.eyJ' || {jwt_part('jwtp', 38)} || '.' || {jwt_part('jwts', 40)}",
    "hexes": "[" + ", ".join(h(f"hex{i}") for i in range(8)) + "]",
}
BITS = """list_sum(list_transform(list_distinct(str_split(s, '')), lambda c:
  -((length(s) - length(replace(s, c, '')))::DOUBLE / length(s)) *
   log2((length(s) - length(replace(s, c, '')))::DOUBLE / length(s))))"""
LATER = {
    "inn12": f"inn12_a || ({weighted('inn12_a', INN12B)} % 11 % 10)",
    "card4": "substr(card, 1, 4) || ' ' || substr(card, 5, 4) || ' ' || substr(card, 9, 4) || ' ' || substr(card, 13, 4)",
    "hex": f"coalesce(list_filter(hexes, lambda s: {BITS} > {g.HEX_MARGIN})[1], hexes[1])",
    "bad_snils": "left(snils, length(snils) - 1) || ((right(snils, 1)::INT + 5) % 10)",
}
LAST = {"bad_inn": "left(inn12, 11) || ((right(inn12, 1)::INT + 5) % 10)"}
TEMPLATES = (
    ("'Смету составил(а) ' || fio || ', ИНН ' || inn12 || ', СНИЛС ' || snils || '.'",
     (("PERSON", "fio"), ("RU_INN", "inn12"), ("RU_SNILS", "snils"))),
    ("'Пропуск оформлен на имя ' || fio_to || ', паспорт ' || passport || ', срок действия один год.'",
     (("PERSON", "fio_to"), ("RU_PASSPORT", "passport"))),
    ("'По вопросам доставки отвечает ' || pair || ', тел. ' || phone || ', почта ' || mail || '.'",
     (("PERSON", "pair"), ("PHONE", "phone"), ("EMAIL", "mail"))),
    ("'The library card belongs to ' || titled || ', SSN ' || ssn || ', renewed in spring.'",
     (("PERSON", "titled"), ("US_SSN", "ssn"))),
    ("'В регистратуре записан полис ОМС ' || oms || ', СНИЛС ' || snils || ', приём во вторник.'",
     (("RU_OMS", "oms"), ("RU_SNILS", "snils"))),
    ("'Поставщик бумаги, ОГРН ' || ogrn13 || ', ИНН ' || inn10 || ', работает с понедельника.'",
     (("RU_OGRN", "ogrn13"), ("RU_INN", "inn10"))),
    ("'Мастерская по ремонту часов: ОГРНИП ' || ogrn15 || ', ИНН ' || inn12 || '.'",
     (("RU_OGRN", "ogrn15"), ("RU_INN", "inn12"))),
    ("'За билеты рассчитались: карта ' || card4 || ', остаток ушёл на IBAN ' || iban_de || '.'",
     (("CARD", "card4"), ("IBAN", "iban_de"))),
    ("'Абонемент продлён, карта ' || card || ' привязана к кабинету.'", (("CARD", "card"),)),
    ("'Стипендия поступит на IBAN ' || iban_gb || ' в среду.'", (("IBAN", "iban_gb"),)),
    ("'Рассылку открыл адресат ' || mail || ' через узел ' || ip || '.'",
     (("EMAIL", "mail"), ("IP_ADDRESS", "ip"))),
    ("""'В настройках робота стоит api_key="' || key40 || '", шлюз ' || ip || '.'""", (("SECRET_KV", "key40"), ("IP_ADDRESS", "ip"))),
    ("'Отладочный вывод содержит токен ' || jwt || ', ниже строка token=' || key24 || ' и время запуска.'",
     (("SECRET_JWT", "jwt"), ("SECRET_KV", "key24"))),
    ("'Резервная копия подписана строкой ' || hex || ' и убрана в архив.'", (("SECRET_ENTROPY", "hex"),)),
    ("'ИНН ' || bad_inn || ' набран с опечаткой.'", ()),
    ("'В анкете неверный СНИЛС ' || bad_snils || ', её вернули на доработку.'", ()),
)


def corpus(source: str = "customer", key: str = "c_custkey") -> str:
    """CTEs ``gen(id, text)`` and ``labels(id, type, value)``."""
    def add(columns: dict) -> str:
        return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())

    text = " ".join(f"WHEN {i} THEN {body}" for i, (body, _) in enumerate(TEMPLATES))
    labels = " ".join(
        f"WHEN {i} THEN [" + ", ".join(f"{{'type': '{t}', 'value': {v}}}" for t, v in found) + "]"
        for i, (_, found) in enumerate(TEMPLATES) if found)
    return f"""
      g0 AS (SELECT {key} AS id FROM {source}), g1 AS (SELECT *, {add(BODIES)} FROM g0),
      g2 AS (SELECT *, {add(VALUES)} FROM g1), g3 AS (SELECT *, {add(LATER)} FROM g2),
      g4 AS (SELECT *, {add(LAST)} FROM g3),
      gen AS (SELECT id, CASE id % {len(TEMPLATES)} {text} END AS text,
                     CASE id % {len(TEMPLATES)} {labels} ELSE [] END AS ls FROM g4),
      labels AS (SELECT id, text, unnest(ls).type AS type, unnest(ls).value AS value FROM gen)"""


def business() -> str:
    """CTE ``labels(id, text, type, value, confidence)`` of the business texts."""
    t9 = f"(1 * 3 + {weighted('aba_b', (0, 7, 1, 3, 7, 1, 3, 7))})"
    bodies = {
        "acc_b": f"'40703810' || {digits('acc', 11)}", "bik": f"'042202' || {digits('bik', 3)}",
        "aba_b": f"'1' || {digits('aba', 7)}", "inn10_b": BODIES["inn10_b"],
    }
    birth = f"lpad(({number('day', 28)} + 1)::VARCHAR, 2, '0') || '.' || lpad(({number('month', 12)} + 1)::VARCHAR, 2, '0')" \
            f" || '.19' || {digits('year', 2)}"
    values = {
        "full_b": "right(bik, 3) || acc_b || '0'", "inn10": VALUES["inn10"], "kpp": f"'5203' || {digits('kpp', 5)}",
        "aba": f"aba_b || ((10 - {t9} % 10) % 10)", "us_acc": f"'00' || {digits('acc', 12)}",
        "bic": pick("bic", g.BICS), "duns": " || '-' || ".join((digits("u1", 2), digits("u2", 3), digits("u3", 4))),
        "ein": f"{digits('e1', 2)} || '-' || {digits('e2', 7)}", "dl": f"'D' || {digits('dl', 7)}",
        "mbi": f"'1EG' || {digits('m1', 1)} || '-TE' || {digits('m2', 1)} || '-MK' || {digits('m3', 2)}", "birth": birth,
        "rdl": f"{digits('r1', 2)} || ' ' || {digits('r2', 2)} || ' ' || {digits('r3', 6)}",
        "aws": f"'AKIA' || upper(substr({h('aws')}, 1, 16))", "ip6": f"'2001:db8::' || substr({h('ip6')}, 1, 4)",
        "tel": f"'+1 (' || {digits('p1', 3)} || ') ' || {digits('p2', 3)} || '-' || {digits('p3', 4)}",
        "initials": pick("initials", g.INITIALS),
    }
    later = {"acc": f"acc_b || ((10 - {weighted('full_b', ((7, 1, 3) * 8)[:23], 10)} % 10) % 10)"}
    texts = (
        ("'р/с ' || acc || ' для взносов, БИК ' || bik", (("RU_BANK_ACCOUNT", "acc", "high"), ("RU_BIK", "bik", "high"))),
        ("'ИНН ' || inn10 || ', КПП ' || kpp", (("RU_INN", "inn10", "high"), ("RU_KPP", "kpp", "medium"))),
        ("'routing number ' || aba || ' was printed on the cheque'", (("US_ROUTING", "aba", "high"),)),
        ("'account number ' || us_acc || ' is closed since May'", (("US_BANK_ACCOUNT", "us_acc", "medium"),)),
        ("'SWIFT ' || bic || ' of the branch'", (("SWIFT_BIC", "bic", "high"),)),
        ("'DUNS ' || duns", (("US_DUNS", "duns", "medium"),)),
        ("'EIN ' || ein || ' stands on the invoice'", (("US_EIN", "ein", "medium"),)),
        ("'Driver''s license ' || dl || ' expires next year'", (("US_DRIVER_LICENSE", "dl", "medium"),)),
        ("'Medicare ' || mbi || ' was renewed'", (("US_MEDICARE", "mbi", "medium"),)),
        ("'дата рождения ' || birth", (("DATE_OF_BIRTH", "birth", "high"),)),
        ("'водительское удостоверение ' || rdl", (("RU_DRIVER_LICENSE", "rdl", "medium"),)),
        ("'в черновике лежит ' || aws || ' без пояснений'", (("SECRET_AWS", "aws", "high"),)),
        ("'метеостанция ' || ip6 || ' отвечает'", (("IP_ADDRESS", "ip6", "medium"),)),
        ("'call ' || tel || ' now'", (("PHONE", "tel", "high"),)),
        (f"'полка ' || {digits('plain', 9)} || ' пуста'", ()),
        ("'Протокол вела ' || initials || ', копия у секретаря.'", (("PERSON", "initials", "high"),)),
    )

    def add(columns: dict) -> str:
        return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())

    text = " ".join(f"WHEN {i} THEN {body}" for i, (body, _) in enumerate(texts))
    labels = " ".join(
        f"WHEN {i} THEN [" + ", ".join(
            f"{{'type': '{t}', 'value': {v}, 'confidence': '{c}'}}" for t, v, c in found) + "]"
        for i, (_, found) in enumerate(texts) if found)
    return f"""
      b0 AS (SELECT c_custkey AS id FROM customer), b1 AS (SELECT *, {add(bodies)} FROM b0),
      b2 AS (SELECT *, {add(values)} FROM b1), b3 AS (SELECT *, {add(later)} FROM b2),
      gen AS (SELECT id, CASE id % 16 {text} END AS text, CASE id % 16 {labels} ELSE [] END AS ls FROM b3),
      labels AS (SELECT id, text, unnest(ls).type AS type, unnest(ls).value AS value,
                        unnest(ls).confidence AS confidence FROM gen)"""


def net_roll(column: str) -> str:
    return f"WITH {NET_SPANS} SELECT {column}, type, count(*) AS detections, count(DISTINCT doc_id) AS documents " \
           "FROM net GROUP BY ALL"


PHONE_RU = r"(?:\+7|8)[\s-]?\(?[0-9]{3}\)?[\s-]?[0-9]{3}[\s-]?[0-9]{2}[\s-]?[0-9]{2}"
PHONE_INTL = r"\+[0-9](?:[\s()-]*[0-9]){7,14}"
GROUPS = {
    "identity": ("PERSON", "EMAIL", "PHONE"), "ru": ("RU_INN", "RU_SNILS", "RU_OGRN", "RU_PASSPORT", "RU_OMS"),
    "us": ("US_SSN",), "financial": ("CARD", "IBAN"),
}
# Capitalised pairs; a word right after a sentence end is consumed first, as it cannot begin a pair.
PAIRS = r"[.!?]\s[A-Z][a-z]+|\b[A-Z][a-z]+\s[A-Z][a-z]+\b"
KEY_VALUE = r"(?i)(?:api[_-]?key|secret|token|password|passwd|pwd|пароль)\s*[:=]\s*[\"']?[A-Za-z0-9+/_\-]{8,}"
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"
NEAR = "substr(body, greatest(start - {0}, 0) + 1, stop + {0} - greatest(start - {0}, 0))"
STOP = ", ".join(map(quote, dict.fromkeys(NOT_NAMES)))
PERSON_ROWS = f"""SELECT * FROM ({spans('documents', 'doc_id, source', 'text', PAIRS)})
    WHERE NOT regexp_matches(value, '^[.!?]') AND regexp_extract(value, '^[A-Za-z]+') NOT IN ({STOP})
      AND regexp_extract(value, '[A-Za-z]+$') NOT IN ({STOP})"""
SECRET_ROWS = f"""SELECT doc_id, source, 'SECRET_KV' AS type, stop - length(v) AS start, stop, v AS value, 'high' AS confidence
    FROM (SELECT *, regexp_extract(value, '[:=]\\s*["'']?([A-Za-z0-9+/_\\-]{{8,}})$', 1) AS v
          FROM ({spans('documents', 'doc_id, source', 'text', KEY_VALUE)}))
    UNION ALL
    SELECT doc_id, source, 'SECRET_ENTROPY', start, stop, value, 'medium' FROM (SELECT *, value AS s
      FROM ({spans('documents', 'doc_id, source', 'text', OPAQUE)})) o
    WHERE (regexp_matches(s, '^[0-9a-fA-F]+$') AND {BITS} > 3.3 OR regexp_matches(s, '[a-z]')
        AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[0-9]') AND {BITS} > 4.2)
      AND NOT regexp_matches({NEAR.format(20)}, '(?i)commit|\\bsha|hash|хеш|md5')
      AND NOT EXISTS (SELECT 1 FROM ({spans('documents', 'doc_id', 'text', KEY_VALUE)}) k
                      WHERE k.doc_id = o.doc_id AND k.start < o.stop AND o.start < k.stop)"""


def card_rows(source: str) -> str:
    return f"""SELECT doc_id, source, 'CARD' AS type, start, stop, value,
        CASE WHEN regexp_matches(value, '[ -]') OR regexp_matches({NEAR.format(30)}, '{CARD_CUE}') THEN 'high'
          WHEN length(d) = 16 THEN 'medium' ELSE 'low' END AS confidence
      FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({spans(source, 'doc_id, source', 'text', CARD)}))
      WHERE {luhn_total('d', True)} % 10 = 0 AND length(replace(d, left(d, 1), '')) > 0"""


def phone_rows() -> str:
    def one(regex: str, before: str) -> str:
        return f"""SELECT doc_id, source, start + position(v IN value) - 1 AS start, v AS value FROM (
          SELECT *, regexp_extract(value, '({regex})', 1) AS v FROM
            ({spans('documents', 'doc_id, source', 'text', f'(?:^|{before})' + regex + '(?:[^0-9]|$)')}))"""

    return f"""SELECT DISTINCT doc_id, source, 'PHONE' AS type, start, start + length(value) AS stop, value,
        CASE WHEN regexp_matches(value, '^\\+|[\\s()-]') THEN 'high' ELSE 'medium' END AS confidence
      FROM ({one(PHONE_RU, '[^0-9]')} UNION ALL {one(PHONE_INTL, '[^0-9+]')})"""


ALL_ROWS = f"""every_row AS (
    SELECT doc_id, source, 'EMAIL' AS type, start, stop, value, 'high' AS confidence
      FROM ({spans('documents', 'doc_id, source', 'text', EMAIL)})
    UNION ALL SELECT doc_id, source, 'IP_ADDRESS', start, stop, value, 'medium'
      FROM ({spans('documents', 'doc_id, source', 'text', IPV4)})
    UNION ALL {card_rows('documents')} UNION ALL {phone_rows()} UNION ALL {SECRET_ROWS}
    UNION ALL SELECT doc_id, source, 'PERSON', start, stop, value, 'medium' FROM ({PERSON_ROWS}))"""


def contest(where: str) -> str:
    """Where two rows overlap the longer one stays; no more than two ever meet in these documents."""
    return f"""SELECT * FROM every_row a WHERE {where.format('a')} AND NOT EXISTS (SELECT 1 FROM every_row b
      WHERE {where.format('b')} AND a.doc_id = b.doc_id AND a.start < b.stop AND b.start < a.stop
        AND b.stop - b.start > a.stop - a.start)"""


group_case = " ".join(f"WHEN type IN ({', '.join(map(quote, ts))}) THEN '{name}'" for name, ts in GROUPS.items())
site_case = " ".join(
    "WHEN " + " OR ".join(f"host = '{m}' OR ends_with(host, '.{m}')" for m in hosts) + f" THEN '{name}'"
    for name, hosts, _ in SITES)
ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), " \
          "'''', '&#39;')"
POLICY_ROWS = "(SELECT c_custkey AS tenant, c_custkey % 5 AS k FROM customer)"
MOVES = """moves AS (SELECT DISTINCT source AS f, 'src' || (regexp_extract(source, '([0-9]+)$', 1)::INT + 1) AS t
             FROM documents WHERE regexp_extract(source, '([0-9]+)$', 1)::INT % 2 = 0)"""
MOVED = f"""{VAULT}, {MOVES},
  leaving AS (SELECT vault.*, f, t FROM vault JOIN moves ON session_id = f),
  movable AS (SELECT * FROM leaving l WHERE NOT EXISTS (SELECT 1 FROM vault v WHERE v.session_id = l.t
                AND (v.placeholder = l.placeholder OR v.original = l.original)))"""
URL = """CASE event_id % 3 WHEN 0 THEN 'https://chatgpt.com/' WHEN 1 THEN 'https://claude.ai/chat/' || (event_id % 50)
         ELSE 'https://claude.ai/new?x=1' END"""
PLACE = "regexp_extract({0}, '^https://([^?]*)', 1)"
# The history in one numbered time; every visit leaves an entry. A walk climbs from an entry's session along the moves; its
# path lists when it came where, the last place first. Made somewhere counts as later than arriving there at that time.
HISTORY = f"""RECURSIVE seen AS (SELECT event_id, user_id || '_' || {PLACE.format('url')} AS session,
      {PLACE.format('url')} AS place, row_number() OVER (ORDER BY ts, event_id) AS tick, user_id, url
    FROM (SELECT event_id, user_id, ts, {URL} AS url FROM events)),
  steps AS (SELECT *, lag(session) OVER w AS f, lag(place) OVER w AS p, lag(url) OVER w AS u FROM seen
            WINDOW w AS (PARTITION BY user_id ORDER BY tick)),
  moves AS (SELECT event_id, f, session AS t, tick FROM steps
            WHERE u <> url AND f <> session AND p IN ('chatgpt.com/', 'claude.ai/new', 'claude.ai/')),
  up AS (SELECT m.*, n.tick AS parent FROM moves m ASOF LEFT JOIN moves n ON m.t = n.f AND m.tick < n.tick),
  walk AS (SELECT e.event_id, e.session AS place, n.tick AS stay, 'u' || (e.event_id % 7) || '@mail.test' AS original,
             [2 * e.tick + 1] AS path FROM seen e ASOF LEFT JOIN moves n ON e.session = n.f AND e.tick <= n.tick
           UNION ALL SELECT w.event_id, m.t, m.parent, w.original, list_prepend(2 * m.tick, w.path)
           FROM walk w JOIN up m ON m.tick = w.stay),
  live AS (SELECT *, row_number() OVER (PARTITION BY coalesce('stay ' || stay, place), original ORDER BY path) = 1
             OR stay IS NULL AND place NOT IN (SELECT t FROM up WHERE parent IS NULL) AS alive FROM walk)"""
WIDE = "wide AS (SELECT doc_id, translate(text, '{0}', '{1}') AS shown, text FROM documents)".format(
    FULL_WIDTH_FROM, FULL_WIDTH_TO)
NUMBERS = ", ".join(
    f"substr(lpad((o_orderkey * {m} + 7)::VARCHAR, greatest({w}, length((o_orderkey * {m} + 7)::VARCHAR))::INT, '{pad}'), 1, {w})"
    f" AS {n}" for n, w, m, pad in (
        ("d9", 9, 7919, "1"), ("d10", 10, 104729, "7"), ("d11", 11, 1299709, "2"), ("d12", 12, 15485863, "5"),
        ("d13", 13, 32452843, "1"), ("d15", 15, 49979687, "3"), ("d16", 16, 67867967, "4"),
        ("d20", 20, 86028121, "40702")))

TENANT = "regexp_extract({0}.source, '([0-9]+)$', 1)::INT % 6"
ALLOWED = f"""CASE {TENANT} WHEN 0 THEN {{0}}.type IN ('EMAIL', 'IP_ADDRESS') AND {{0}}.confidence <> 'low'
    WHEN 1 THEN {{0}}.type IN ('PHONE', 'CARD') WHEN 2 THEN {{0}}.confidence = 'high'
    WHEN 3 THEN ({{0}}.type = 'EMAIL' OR {{0}}.type LIKE 'SECRET%') AND {{0}}.confidence <> 'low'
    WHEN 4 THEN {{0}}.type IN ('PERSON', 'IP_ADDRESS') AND {{0}}.confidence <> 'low' ELSE {{0}}.confidence <> 'low' END"""
CHOICE = "CASE doc_id % 4 WHEN 0 THEN 'mask' WHEN 1 THEN 'pass' WHEN 2 THEN 'drop' ELSE 'hold' END"
GUARD_SEND = f"""WITH {MASKED.replace(NET_SPANS, NET_SPANS.replace('net AS', 'all_net AS', 1) + ', net AS (SELECT * FROM '
        'all_net WHERE doc_id % 4 = 0)', 1)},
  acts AS (SELECT *, CASE WHEN doc_id NOT IN (SELECT doc_id FROM all_net) THEN 'pass' ELSE {CHOICE} END AS action FROM masked)
  SELECT doc_id, action, md5(CASE action WHEN 'mask' THEN masked || chr(10) || chr(10) || '{INSTRUCTION}'
    WHEN 'pass' THEN text END) AS digest FROM acts"""

SHOWN = "{0}"
for plain, shown in EXPANDING:
    SHOWN = f"replace({SHOWN}, '{plain}', '{shown}')"
# Characters before a place, as shown: one less where the place is inside a ligature, whose first letter stands alone then.
BEFORE = "length(" + SHOWN.format("substr(body, 1, {0})") + ") - (substr(body, {0}, 2) = 'fi')::INT"

# What each template of the hard texts is labelled with, and what the rules find in it.
HARD = """hard AS (SELECT unnest([{'k': 0, 't': 'RU_PASSPORT', 'e': 1, 'd': 0}, {'k': 1, 't': 'IBAN', 'e': 1, 'd': 0},
    {'k': 2, 't': 'PHONE', 'e': 1, 'd': 0}, {'k': 3, 't': 'PERSON', 'e': 1, 'd': 0}, {'k': 4, 't': 'PERSON', 'e': 1, 'd': 0},
    {'k': 5, 't': 'PERSON', 'e': 1, 'd': 0}, {'k': 6, 't': 'PERSON', 'e': 1, 'd': 1}, {'k': 7, 't': 'SECRET_KV', 'e': 1, 'd': 1},
    {'k': 8, 't': 'EMAIL', 'e': 1, 'd': 1}, {'k': 9, 't': 'CARD', 'e': 0, 'd': 1}], recursive := true)),
  found AS (SELECT hard.* FROM customer JOIN hard ON c_custkey % 16 = k)"""

ORACLES = {
    "scan_email": f"SELECT doc_id, 'EMAIL' AS type, start, stop, value, 'high' AS confidence FROM "
                  f"({spans('documents', 'doc_id', 'text', EMAIL)})",
    "scan_ip": f"SELECT doc_id, 'IP_ADDRESS' AS type, start, stop, value FROM "
               f"({spans('documents', 'doc_id', 'text', IPV4)})",
    "scan_card": f"SELECT * EXCLUDE source FROM ({card_rows('documents')})",
    "scan_phone": f"SELECT doc_id, value, count(*) AS n FROM ({phone_rows()}) GROUP BY ALL",
    "scan_persons": f"SELECT doc_id, 'PERSON' AS type, start, stop, value FROM ({PERSON_ROWS})",
    "scan_secrets": f"SELECT * EXCLUDE (source, confidence) FROM ({SECRET_ROWS})",
    "scan_all_types": f"WITH {ALL_ROWS} SELECT * EXCLUDE source FROM ({contest('true')})",
    "type_counts_by_source_full": f"""WITH {ALL_ROWS} SELECT source, type, count(*) AS detections,
        count(DISTINCT doc_id) AS documents FROM ({contest("{0}.confidence <> 'low'")}) GROUP BY ALL""",
    "scan_pages": f"SELECT page_id, {TYPE} AS type, start, stop, value FROM ({spans('pages', 'page_id', 'html', NET)})",
    "scan_fullwidth": f"""WITH {WIDE} SELECT doc_id, {TYPE} AS type, start, stop,
        substr(shown, start + 1, stop - start) AS value FROM ({spans('wide', 'doc_id, shown', 'text', NET)})""",
    "scan_expanding": f"""SELECT doc_id, type, start, stop, substr(shown, start + 1, stop - start) AS value FROM (
        SELECT doc_id, {TYPE} AS type, {SHOWN.format('body')} AS shown, ({BEFORE.format('start')})::INT AS start,
          ({BEFORE.format('(stop - 1)')} + 1)::INT AS stop FROM ({spans('documents', 'doc_id', 'text', NET)}))""",
    "type_counts": f"""WITH {NET_SPANS} SELECT doc_id, count(*) AS total, count(*) FILTER (type = 'EMAIL') AS emails,
        count(*) FILTER (type = 'IP_ADDRESS') AS ips FROM net GROUP BY doc_id""",
    "counts_by_source": net_roll("source"),
    "counts_by_lang": net_roll("lang"),
    "check_digits": f"""SELECT o_orderkey, {luhn_total('d16', True)} % 10 = 0 AS luhn,
        left(d11, 9)::INT > 1001998 AND {weighted('d11', SNILS)} % 101 % 100 = right(d11, 2)::INT AS snils,
        {weighted('d10', INN10)} % 11 % 10 = right(d10, 1)::INT AS inn10,
        {weighted('d12', INN12A)} % 11 % 10 = substr(d12, 11, 1)::INT
          AND {weighted('d12', INN12B)} % 11 % 10 = right(d12, 1)::INT AS inn12,
        left(d13, 12)::BIGINT % 11 % 10 = right(d13, 1)::INT AS ogrn13,
        left(d15, 14)::BIGINT % 13 % 10 = right(d15, 1)::INT AS ogrn15,
        {weighted('d9', (3, 7, 1) * 3)} % 10 = 0 AND {weighted('d9', (3, 7, 1) * 3)} > 0 AS routing,
        (substr(d20, 3) || '1314' || left(d20, 2))::HUGEINT % 97 = 1 AS iban,
        {weighted('full_key', ((7, 1, 3) * 8)[:23], 10)} % 10 = 0 AS account
      FROM (SELECT *, CASE WHEN starts_with(d20, '301') THEN '0' || substr('04' || left(d9, 7), 5, 2)
                           ELSE right('04' || left(d9, 7), 3) END || d20 AS full_key
            FROM (SELECT o_orderkey, {NUMBERS} FROM orders))""",
    "fold_to_latin": f"WITH {corpus()} SELECT id AS item_id, translate(text, 'аеорсхукАВЕКМНОРСТХ', "
                     "'aeopcxykABEKMHOPCTX') AS folded FROM gen",
    "fold_to_cyrillic": f"WITH {corpus()} SELECT id AS item_id, translate(text, 'aeopcxykABEKMHOPCTX', "
                        "'аеорсхукАВЕКМНОРСТХ') AS folded FROM gen",
    "script_counts": f"""WITH {corpus()} SELECT id AS item_id,
        length(regexp_replace(text, '[^а-яёА-ЯЁ]', '', 'g')) AS cyrillic,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM gen""",
    "normalize_fullwidth": "SELECT doc_id, md5(text) AS digest FROM documents",
    "entropy": f"""SELECT c_custkey, round({BITS}, 6) AS bits FROM
        (SELECT c_custkey, c_name || md5(c_custkey::VARCHAR) AS s FROM customer)""",
    "placeholder_parse": """SELECT c_custkey, token, CASE WHEN k < 3 THEN kind END AS type,
        CASE WHEN k < 3 THEN c_custkey END AS num FROM (
          SELECT c_custkey, upper(c_mktsegment) AS kind, c_custkey % 4 AS k,
            CASE c_custkey % 4 WHEN 0 THEN '[' || upper(c_mktsegment) || '_' || c_custkey || ']'
              WHEN 1 THEN '{{' || upper(c_mktsegment) || '_' || c_custkey || '}}'
              WHEN 2 THEN '«' || upper(c_mktsegment) || '_' || c_custkey || '»'
              ELSE '[' || lower(c_mktsegment) || ']' END AS token FROM customer)""",
    "instruction": f"""SELECT conv_id, turn, md5(text || chr(10) || chr(10) || '{INSTRUCTION}') AS appended,
        md5(text || chr(10) || chr(10) || '{INSTRUCTION}') AS twice,
        md5(rtrim(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)))
          AS stripped FROM conversations""",
    "mask_documents": f"WITH {MASKED} SELECT doc_id, md5(masked) AS digest FROM masked",
    "mask_null_session": NULL_SESSION,
    "mask_null_session_by_value": NULL_SESSION,
    "restore_null_session": ROUND_TRIP,
    "restore_null_session_by_value": ROUND_TRIP,
    "restore_repeated_keys": ROUND_TRIP,
    "restore_repeated_keys_by_value": ROUND_TRIP,
    "scan_user_rules": """WITH t AS (SELECT o_orderkey, lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS room,
          lpad((o_orderkey * 7919)::VARCHAR, 24, '3') AS batch,
          'LK-' || substr(translate(printf('%X', o_orderkey * 104729), '0123456789', 'GHIJKLMNOP'), 1, 3) AS tag
          FROM orders),
        x AS (SELECT *, 'room ' || room || ', batch ' || batch || ', tag ' || tag AS text FROM t),
        u AS (SELECT o_orderkey, text, unnest([{'type': 'ROOM', 'value': room, 'start': 5},
          {'type': 'BATCH', 'value': batch, 'start': 17}, {'type': 'TAG', 'value': tag, 'start': 47}], recursive := true)
          FROM x)
        SELECT o_orderkey, type, start, start + length(value) AS stop, value FROM u""",
    "session_ids_odd": """SELECT page_id, '7_' || CASE page_id % 6 WHEN 0 THEN 'chat_room.test/a%20b/' || page_id
        WHEN 1 THEN 'chat.test/x|y/' || page_id WHEN 2 THEN 'chat.test/%7Bid%7D/' || page_id
        WHEN 3 THEN 'chat.test/%C3%A9/' || page_id WHEN 4 THEN 'unknown' ELSE 'chat.test/' END AS session_id FROM pages""",
    "vault_entries": f"WITH {VAULT} SELECT * FROM vault",
    "restore_documents": "SELECT doc_id, md5(text) AS digest, 0 AS missing FROM documents",
    "restore_elsewhere": f"""WITH {MASKED} SELECT doc_id, md5(masked) AS digest,
        coalesce(list_aggregate(list_filter(list_reverse(ps), lambda x, i:
          list_position(list_reverse(ps), x) = i), 'string_agg', ' '), '') AS missing FROM masked""",
    "residue_check": f"""WITH {MASKED}, left_over AS (SELECT DISTINCT doc_id FROM masked JOIN net USING (doc_id)
        WHERE contains(masked, value)) SELECT count(*) AS residue FROM left_over""",
    "session_summary": f"""WITH {VAULT} SELECT session_id, session_id AS host, '/' AS path, count(*) AS count,
        count(*) FILTER (type = 'EMAIL') AS emails, count(*) FILTER (type = 'IP_ADDRESS') AS ips
        FROM vault GROUP BY session_id""",
    "recent_sessions": f"WITH {VAULT} SELECT session_id, count(*) AS count FROM vault GROUP BY 1 ORDER BY 1 LIMIT 5",
    "session_ids": """SELECT page_id, (page_id % 7) || '_' || lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) ||
        CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) = '' THEN '/'
             ELSE regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) END AS session_id FROM pages""",
    "vault_migrate": f"""WITH {MOVED} SELECT session_id, original, placeholder, type FROM vault
        WHERE session_id NOT IN (SELECT f FROM moves)
        UNION ALL SELECT t, original, placeholder, type FROM movable""",
    "vault_migrate_report": f"""WITH {MOVED} SELECT f AS from_session, t AS to_session,
        (SELECT count(*) FROM movable m WHERE m.f = moves.f) AS migrated,
        (SELECT count(*) FROM leaving l WHERE l.f = moves.f) - (SELECT count(*) FROM movable m WHERE m.f = moves.f)
          AS dropped FROM moves""",
    "vault_forget": f"""WITH {VAULT}, {MOVES} SELECT session_id, seq, placeholder FROM vault
        WHERE session_id NOT IN (SELECT f FROM moves)""",
    "navigation_moves": f"""SELECT event_id, user_id || '_' || {PLACE.format('previous')} AS from_session,
        user_id || '_' || {PLACE.format('url')} AS to_session
      FROM (SELECT *, lag(url) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous
            FROM (SELECT event_id, user_id, ts, {URL} AS url FROM events))
      WHERE previous <> url AND {PLACE.format('previous')} IN ('chatgpt.com/', 'claude.ai/new', 'claude.ai/')""",
    "policies_roundtrip": f"""SELECT tenant, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 24 END AS n_types,
        CASE k WHEN 4 THEN 'high' ELSE 'medium' END AS min_confidence, k <> 1 AS guard_enabled,
        CASE k WHEN 4 THEN 'curly' WHEN 0 THEN 'guillemet' ELSE 'square' END AS placeholder_style, k <> 0 AS instruction_enabled,
        CASE k WHEN 0 THEN 'en' ELSE 'auto' END AS language FROM {POLICY_ROWS}""",
    "corpus_roundtrip": f"WITH {corpus()} SELECT md5(text) AS digest, type, value FROM labels",
    "scan_two_views": """WITH t AS (SELECT o_orderkey, left(md5(o_orderkey::VARCHAR), 24) AS value,
        13 AS start FROM orders)
        SELECT o_orderkey, 'SECRET_KV' AS type, start, start + 24 AS stop, value FROM t""",
    "scan_languages": f"""WITH {corpus()} SELECT id AS item_id, CASE WHEN regexp_matches(value, '[А-Яа-яЁё]') THEN 'ru'
        ELSE 'en' END AS language, instr(text, value) - 1 AS start, value FROM labels WHERE type = 'PERSON'""",
    "mask_pasted_tokens": f"""WITH {NET_SPANS},
        f AS (SELECT source, value, type, doc_id, start FROM net
          QUALIFY row_number() OVER (PARTITION BY source, value ORDER BY doc_id, start) = 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY doc_id, start) AS rn,
          row_number() OVER (PARTITION BY source, type, doc_id ORDER BY start) AS k FROM f),
        lifted AS (SELECT *, max(CASE WHEN type = 'EMAIL' AND doc_id % 3 = 0 THEN 4 ELSE 0 END - (rn - k)) OVER (
          PARTITION BY source, type ORDER BY doc_id RANGE UNBOUNDED PRECEDING) AS lift FROM n)
        SELECT source AS session_id, value AS original, '[' || type || '_' || (rn + greatest(lift, 0)) || ']' AS placeholder
        FROM lifted""",
    "snapshot_roundtrip": f"WITH {VAULT} SELECT *, false AS before, true AS stored, false AS left FROM vault",
    "vault_cleared": f"WITH {VAULT} SELECT count(*) AS stored, 0 AS left FROM vault",
    "vault_expired": """WITH m AS (SELECT event_id, ts, user_id::VARCHAR AS s,
          'u' || user_id || '.' || (event_id % 5) || '@mail.test' AS original FROM events),
        g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true) AS opens FROM m
              WINDOW w AS (PARTITION BY s ORDER BY ts)),
        p AS (SELECT *, sum(opens::INT) OVER (PARTITION BY s ORDER BY ts) AS spell FROM g),
        open AS (SELECT s, max(spell) AS spell FROM p GROUP BY s HAVING max(ts) >= (SELECT max(ts) FROM p) - INTERVAL 6 HOUR),
        f AS (SELECT s, spell, original, min((ts, event_id)) AS first FROM p JOIN open USING (s, spell) GROUP BY ALL)
        SELECT s || '#' || spell AS session_id, row_number() OVER (PARTITION BY s ORDER BY first) AS seq, original,
          '[EMAIL_' || row_number() OVER (PARTITION BY s ORDER BY first) || ']' AS placeholder FROM f""",
    "navigation_migrated": f"""WITH {HISTORY} SELECT place AS session_id, original, '[EMAIL_' || event_id || ']' AS placeholder,
        'EMAIL' AS type FROM live WHERE stay IS NULL AND alive""",
    "navigation_migrated_report": f"""WITH {HISTORY},
        gone AS (SELECT stay, count(*) AS had, count(*) FILTER (EXISTS (SELECT 1 FROM live b WHERE b.event_id = a.event_id
          AND b.path[1] = 2 * a.stay AND b.alive)) AS went FROM live a WHERE stay IS NOT NULL AND alive GROUP BY stay)
        SELECT event_id, f AS from_session, t AS to_session, coalesce(went, 0) AS migrated,
          coalesce(had - went, 0) AS dropped FROM moves LEFT JOIN gone ON gone.stay = moves.tick""",
    "scan_by_policy": f"""WITH {ALL_ROWS} SELECT * EXCLUDE source FROM ({contest(ALLOWED)})""",
    "guard_send": GUARD_SEND,
    "stream_guard_send": GUARD_SEND,
    "guard_send_leaks": f"WITH {NET_SPANS} SELECT count(DISTINCT doc_id) AS leaks_prevented FROM net WHERE doc_id % 4 = 0",
    "guard_send_by_policy": f"""WITH {ALL_ROWS}, hits AS (SELECT DISTINCT doc_id FROM ({contest(ALLOWED)})),
        rows AS (SELECT source, {TENANT.format('documents')} AS k, CASE WHEN doc_id NOT IN (SELECT doc_id FROM hits)
            OR {TENANT.format('documents')} = 0 OR {TENANT.format('documents')} = 2 AND doc_id % 2 = 0 THEN 'pass'
          ELSE {CHOICE} END AS action FROM documents)
        SELECT source, action, count(*) AS n, count(*) FILTER (action = 'mask' AND k <> 4) AS instructed FROM rows
        GROUP BY ALL""",
    "site_match": f"""SELECT page_id, host, CASE {site_case} END AS site FROM (SELECT page_id,
        CASE WHEN page_id % 10 = 9 THEN lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))
             ELSE ({list(HOSTS)})[page_id % 10 + 1] END AS host FROM pages)""",
    "guard_actions": f"""WITH {NET_SPANS} SELECT lang, CASE WHEN doc_id IN (SELECT doc_id FROM net) THEN 'hold'
        ELSE 'pass' END AS action, count(*) AS n FROM documents GROUP BY ALL""",
    "leak_count": f"""WITH {NET_SPANS} SELECT count(DISTINCT doc_id) AS leaks_prevented FROM net WHERE doc_id % 3 = 0""",
    "policies_sanitized": f"""SELECT tenant, CASE k WHEN 0 THEN 'IBAN' WHEN 1 THEN 'US_SSN,CARD' END AS types,
        CASE k WHEN 4 THEN 'high' END AS min_confidence, CASE k WHEN 0 THEN 'en' END AS language,
        CASE k WHEN 1 THEN false END AS guard_enabled, CASE k WHEN 0 THEN false END AS instruction_enabled,
        CASE k WHEN 0 THEN 'grok' END AS off,
        CASE k WHEN 0 THEN 'guillemet' WHEN 4 THEN 'curly' END AS placeholder_style FROM {POLICY_ROWS}""",
    "policies_effective": f"""SELECT tenant, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 24 END AS n_types,
        CASE k WHEN 4 THEN 'high' ELSE 'medium' END AS min_confidence, k <> 1 AS guard_enabled,
        CASE k WHEN 4 THEN 'curly' WHEN 0 THEN 'guillemet' ELSE 'square' END AS placeholder_style, k NOT IN (0, 1) AS grok_guarded
        FROM {POLICY_ROWS}""",
    "generated_labels": f"""WITH {corpus('orders', 'o_orderkey')} SELECT id AS item_id, md5(text) AS digest,
        len(ls) AS n_expected FROM gen""",
    "generated_scan": f"""WITH {corpus()} SELECT id AS item_id, type, instr(text, value) - 1 AS start,
        instr(text, value) - 1 + length(value) AS stop, value FROM labels""",
    "generated_business_scan": f"""WITH {business()} SELECT id AS item_id, type, instr(text, value) - 1 AS start,
        instr(text, value) - 1 + length(value) AS stop, value, confidence FROM labels""",
    "corpus_quality": f"""WITH {corpus()}, n AS (SELECT count(*) FILTER (type <> 'PERSON') AS s,
        count(*) FILTER (type = 'PERSON') AS p FROM labels)
        SELECT s AS expected, s AS detected, s AS matched, p AS persons_expected, p AS persons_matched,
          1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS person_recall, true AS passed FROM n""",
    "hard_corpus_quality": f"""WITH {HARD}, n AS (SELECT sum(e) FILTER (t <> 'PERSON') AS expected,
        sum(d) FILTER (t <> 'PERSON') AS detected, sum(e * d) FILTER (t <> 'PERSON') AS matched,
        sum(e) FILTER (t = 'PERSON') AS persons_expected, sum(e * d) FILTER (t = 'PERSON') AS persons_matched FROM found)
        SELECT * REPLACE (expected::BIGINT AS expected, detected::BIGINT AS detected, matched::BIGINT AS matched,
            persons_expected::BIGINT AS persons_expected, persons_matched::BIGINT AS persons_matched),
          matched::DOUBLE / detected AS precision, matched::DOUBLE / expected AS recall,
          persons_matched::DOUBLE / persons_expected AS person_recall, false AS passed FROM n""",
    "hard_corpus_by_type": f"""WITH {HARD}, n AS (SELECT t AS type, sum(e)::BIGINT AS expected, sum(d)::BIGINT AS detected,
        sum(e * d)::BIGINT AS matched FROM found GROUP BY t) SELECT *, matched / nullif(detected, 0)::DOUBLE AS precision,
        matched / nullif(expected, 0)::DOUBLE AS recall FROM n""",
    "silent_negatives": "SELECT c_custkey AS item_id, 0 AS detections FROM customer WHERE c_custkey % 16 >= 14",
    "group_rollup": f"""WITH {corpus()} SELECT CASE {group_case} ELSE 'tech' END AS type_group, count(*) AS n
        FROM labels GROUP BY 1""",
    "scan_selection": f"""SELECT conv_id, turn, 'MASKED' AS type, 0 AS start, length(text) AS stop FROM conversations
        WHERE NOT regexp_matches(text, {quote(NET)}) AND trim(text) <> ''
        UNION ALL SELECT conv_id, turn, {TYPE}, start, stop FROM ({spans('conversations', 'conv_id, turn', 'text', NET)})""",
    "highlight": f"""WITH {NET_SPANS}, vs AS (SELECT doc_id, list(value ORDER BY start) AS vs FROM net GROUP BY 1)
        SELECT doc_id, md5(CASE WHEN vs IS NULL THEN {ESCAPED.format('text')} ELSE
          list_aggregate(list_transform(range(1, len(vs) + 2), lambda i:
            {ESCAPED.format(f"regexp_split_to_array(text, {quote(NET)})[i]")} || coalesce(
              '<span class="highlight">' || {ESCAPED.format('vs[i]')} || '</span>', '')), 'string_agg', '') END) AS digest
        FROM documents LEFT JOIN vs USING (doc_id)""",
}
ORACLES["mask_documents_by_value"] = ORACLES["mask_documents"]
ORACLES["restore_documents_by_value"] = ORACLES["restore_documents"]
for name in ("vault_continued", "encrypt_roundtrip", "stream_mask", "stream_mask_many"):
    ORACLES[name] = ORACLES["vault_entries"]
ORACLES["stream_guard"] = ORACLES["guard_actions"]
