"""Detection rules for structured identifiers, as a table of patterns, cues and check-digit tests.

A rule either brings its own pattern or filters the isolated digit runs that one shared pass finds. JavaScript's
``\\b`` looks at ASCII word characters only, so it is spelled out as lookarounds here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.config import RANKS, ScanConfig
from veilframe.functions import checksums
from veilframe.functions.spans import around, bracket, no_pieces
from veilframe.functions.textforms import WIDE_SPACE

CANDIDATE_TYPE = (
    "array<struct<start:int,shorter:int,ord:int,end:int,prio:int,rank:int,type:string,validator:string>>"
)


def each(ranges: str) -> str:
    """Spell out character ranges. The regex engine tests single characters with one table lookup, but a class of
    several ranges range by range."""
    chars = re.sub("(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), ranges)
    return "".join("\\" + c if c in "-]^[\\&" else c for c in chars)


WORD = each("A-Za-z0-9_")
B = rf"(?<![{WORD}])"  # word boundary before a word character
E = rf"(?![{WORD}])"  # word boundary after a word character
S = rf"\s{WIDE_SPACE}"  # white space, for use inside a class

# Six digits with at most one blank or hyphen between them: what every number rule needs somewhere.
DENSE_DIGITS = rf"(?:[0-9][{S}-]?){{5}}[0-9]"
DIGIT_RUNS = rf"{B}[0-9]{{6,20}}{E}"

# Patterns and cue words of the detectors.
LOCAL = each("a-zA-Z0-9._%+") + r"\-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}"
PHONE_RU = rf"(?<![0-9])(?:\+7|8)[{S}-]?\(?[0-9]{{3}}\)?[{S}-]?[0-9]{{3}}[{S}-]?[0-9]{{2}}[{S}-]?[0-9]{{2}}(?![0-9])"
PHONE_INTL = rf"(?<![0-9+])\+[0-9](?:[{S}()-]*[0-9]){{7,14}}(?![0-9])"
CARD = rf"{B}(?:[0-9][ -]?){{12,18}}[0-9]{E}"
CARD_CUE = "карт|card|visa|master|мир|amex|maestro|плат[её]ж|оплат|сч[её]т"
SNILS_GROUPED = rf"{B}[0-9]{{3}}-[0-9]{{3}}-[0-9]{{3}}[ -]?[0-9]{{2}}{E}"
PASSPORT = rf"{B}[0-9]{{4}}[ ]?[0-9]{{6}}{E}"
ACCOUNT_CUE = "сч[её]т|р/с|к/с|расч[её]тн|корреспондент|account"
BIK = rf"{B}04[0-9]{{7}}{E}"
ROUTING_CUE = rf"routing|{B}ABA{E}|{B}RTN{E}|transit"
SWIFT = rf"{B}[A-Z]{{4}}[A-Z]{{2}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?{E}"
US_ACCOUNT_CUE = rf"account[{S}]*(?:no\.?|number|#)|{B}acct{E}|checking|savings"
DUNS_GROUPED = rf"{B}[0-9]{{2}}-[0-9]{{3}}-[0-9]{{4}}{E}"
DUNS_CUE = rf"{B}DUNS{E}|D-U-N-S"
IBAN = rf"{B}[A-Z]{{2}}[0-9]{{2}}(?:[ -]?[A-Z0-9]){{11,30}}{E}"
SSN = r"(?<![0-9])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])"
EIN = rf"{B}[0-9]{{2}}-[0-9]{{7}}{E}"
EIN_CUE = rf"{B}EIN{E}|employer identification|tax[{S}-]?id|{B}IRS{E}"
US_LICENSE_WORD = rf"(?:{B}DL{E}|driver'?s?[{S}]+licen[sc]e)"
US_LICENSE = rf"(?i)({US_LICENSE_WORD}[{S}:#№]*)([A-Z0-9]{{5,13}}){E}"
MBI_LETTER = "[ACDEFGHJKMNPQRTUVWXY]"
MBI_ANY = "[ACDEFGHJKMNPQRTUVWXY0-9]"
MEDICARE = (
    rf"{B}[1-9]{MBI_LETTER}{MBI_ANY}[0-9]-?{MBI_LETTER}{MBI_ANY}[0-9]-?{MBI_LETTER}{MBI_LETTER}[0-9][0-9]{E}"
)
BIRTH_DATE = (
    r"(?<![0-9])(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}(?![0-9])"
)
BIRTH_CUE = rf"рожден|г\.[{S}]?р|д\.[{S}]?р|birth|born"
RU_LICENSE = rf"{B}[0-9]{{2}}[ ]?[0-9]{{2}}[ ]?[0-9]{{6}}{E}|{B}[0-9]{{4}}[ ]?[0-9]{{6}}{E}"
RU_LICENSE_CUE = "водительс|удостоверен|в[/.]у|driver|licen[sc]e"
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"{B}(?:{OCTET}\.){{3}}{OCTET}{E}"


def _ipv6() -> str:
    """Full form, then each split of up to seven groups around a double colon, longest head first."""
    g = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{g}:){{7}}{g}", f"(?:{g}:){{1,7}}:"]
    forms += [f"(?:{g}:){{1,{head}}}(?::{g}){{1,{7 - head}}}" for head in range(6, 0, -1)]
    forms += [f":(?:(?::{g}){{1,7}}|:)"]
    return f"(?<![0-9A-Fa-f:])(?:{'|'.join(forms)})(?![0-9A-Fa-f:])"


IPV6 = _ipv6()
IPV4_HINT = r"[0-9]\.[0-9]{1,3}\.[0-9]"
IPV6_HINT = "::|:[0-9A-Fa-f]{1,4}:"


def any_case(words: str) -> str:
    """Case-blind alternatives. Latin letters match Latin letters only; Cyrillic ones need Unicode case folding."""
    if words.isascii():
        return "(?i)" + words
    return "|".join(f"(?i:{w})" if w.isascii() else f"(?iu:{w})" for w in words.split("|"))


@dataclass(frozen=True)
class Views:
    """Columns the rules read; all are materialised below the rule stage."""

    plain: Column
    folded: Column
    ascii: Column
    cyrillic: Column
    lower: Column
    dense: Column
    runs: Column
    chunks: Column


@dataclass(frozen=True)
class Hit:
    """One candidate match, with access to the text around it."""

    text: Column
    start: Column
    end: Column
    match: Column
    chunks: Column | None = None

    def near(self, radius: int) -> Column:
        return around(self.text, self.start, self.end, radius, self.chunks)

    def cued(self, words: str, radius: int) -> Column:
        return self.near(radius).rlike(any_case(words))


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``pattern`` is searched in the ``folded`` or the plain view; without it the rule takes the isolated digit runs
    of the given ``lengths``. ``check`` sees a :class:`Hit` and keeps or drops it. ``cue``/``reach`` name words
    required within that many characters. ``confidence`` is a level or a function from hit to rank column.
    ``tail`` says that the pattern is two groups and the span is the second. ``hint`` is a cheap necessary pattern
    (or test of the text); ``if_folded`` runs the rule only on texts that folding changes; ``words`` are lower-case substrings, one of which the lower-cased plain text must hold. ``needs_digits`` runs the rule only on texts with six dense digits
    (built-in rules unless they say otherwise; a user's rule only if it asks). ``ord`` orders rules with equal spans.
    """

    type: str
    pattern: str | None = None
    lengths: tuple[int, ...] = ()
    folded: bool = False
    check: Callable[[Hit], Column] | None = None
    cue: str | None = None
    reach: int = 0
    confidence: str | Callable[[Hit], Column] = "medium"
    validator: str | Callable[[Column], Column] = "format"
    priority: int | Callable[[Column], Column] = 0
    tail: bool = False
    hint: str | Callable[[Column], Column] | None = None
    if_folded: bool = False
    words: tuple[str, ...] = ()
    needs_digits: bool | None = None
    ord: int = 0


def _rank(level: str) -> Column:
    return F.lit(RANKS[level])


def _high_if(condition: Column, otherwise: Column | str) -> Column:
    return F.when(condition, _rank("high")).otherwise(_rank(otherwise) if isinstance(otherwise, str) else otherwise)


def _card_digits(h: Hit) -> Column:
    return checksums.digits_of(h.match)


def _account_ok(h: Hit) -> Column:
    bik = F.regexp_extract(h.near(80), f"({BIK})", 1)
    return checksums.valid_bank_account(h.match, bik)


# Order is the tie order of equal spans.
RULES: tuple[Rule, ...] = (
    Rule("EMAIL", EMAIL, folded=True, confidence="high", words=("@",), needs_digits=False),
    Rule("PHONE", PHONE_RU, confidence=lambda h: _high_if(
        h.match.rlike(rf"^\+|[{S}()-]"), "medium")),
    Rule("PHONE", PHONE_INTL, confidence="high", words=("+",), needs_digits=False),
    Rule("CARD", CARD, validator="checksum", priority=10,
         check=lambda h: checksums.valid_luhn(_card_digits(h)) & ~_card_digits(h).rlike(r"^(.)\1+$"),
         confidence=lambda h: _high_if(
             h.match.rlike("[ -]") | h.cued(CARD_CUE, 30),
             F.when(F.length(_card_digits(h)) == 16, _rank("medium")).otherwise(_rank("low")))),
    Rule("RU_SNILS", SNILS_GROUPED, validator="checksum", priority=20, confidence="high",
         check=lambda h: checksums.valid_snils(h.match)),
    Rule("RU_SNILS", lengths=(11,), cue="СНИЛС", words=("снилс",), reach=30, validator="checksum", priority=20, confidence="high",
         check=lambda h: checksums.valid_snils(h.match)),
    Rule("RU_INN", lengths=(10, 12), validator="checksum", priority=20, check=lambda h: checksums.valid_inn(h.match),
         confidence=lambda h: _high_if(
             h.cued("ИНН", 30), F.when(F.length(h.match) == 12, _rank("medium")).otherwise(_rank("low")))),
    Rule("RU_OGRN", lengths=(13, 15), validator="checksum", priority=20,
         check=lambda h: checksums.valid_ogrn(h.match), confidence=lambda h: _high_if(h.cued("ОГРН", 30), "low")),
    Rule("RU_PASSPORT", PASSPORT, cue="паспорт|серия|выдан", words=("паспорт", "серия", "выдан"), reach=40, priority=20),
    Rule("RU_OMS", lengths=(16,), validator="checksum", check=lambda h: checksums.valid_luhn(h.match),
         priority=lambda rank: F.when(rank == RANKS["high"], F.lit(20)).otherwise(F.lit(0)),
         confidence=lambda h: _high_if(h.cued("полис|ОМС", 30), "medium")),
    Rule("RU_BIK", lengths=(9,), cue="БИК", words=("бик",), reach=20, confidence="high",
         check=lambda h: F.startswith(h.match, F.lit("04"))),
    Rule("RU_BANK_ACCOUNT", lengths=(20,), cue=ACCOUNT_CUE, reach=40,
         words=("сч", "р/с", "к/с", "расч", "корреспондент", "account"),
         confidence=lambda h: _high_if(_account_ok(h), "medium"),
         validator=lambda rank: F.when(rank == RANKS["high"], F.lit("checksum")).otherwise(F.lit("format"))),
    Rule("RU_KPP", lengths=(9,), cue="КПП", words=("кпп",), reach=20),
    Rule("US_ROUTING", lengths=(9,), validator="checksum", check=lambda h: checksums.valid_routing(h.match),
         confidence=lambda h: _high_if(h.cued(ROUTING_CUE, 30), "low")),
    Rule("SWIFT_BIC", SWIFT, folded=True, cue=rf"swift|{B}BIC{E}", reach=20, confidence="high", needs_digits=False,
         hint="[A-Z]{6}[A-Z0-9]{2}"),
    Rule("US_BANK_ACCOUNT", lengths=tuple(range(6, 18)), cue=US_ACCOUNT_CUE, reach=30,
         words=("account", "acct", "checking", "savings")),
    Rule("US_DUNS", DUNS_GROUPED, cue=DUNS_CUE, words=("duns", "d-u-n-s"), reach=20),
    Rule("US_DUNS", lengths=(9,), cue=DUNS_CUE, words=("duns", "d-u-n-s"), reach=20),
    Rule("IBAN", IBAN, folded=True, validator="checksum", priority=20, confidence="high",
         check=lambda h: checksums.valid_iban(h.match), hint="[A-Z]{2}[0-9]{2}", needs_digits=False),
    Rule("US_SSN", SSN, confidence="high"),
    Rule("US_EIN", EIN, cue=EIN_CUE, words=("ein", "employer", "tax", "irs"), reach=30),
    Rule("US_DRIVER_LICENSE", US_LICENSE, tail=True, words=("dl", "driver"), needs_digits=False),
    Rule("US_MEDICARE", MEDICARE, cue=rf"medicare|{B}MBI{E}|insurance", reach=30, needs_digits=False,
         words=("medicare", "mbi", "insurance")),
    Rule("DATE_OF_BIRTH", BIRTH_DATE, needs_digits=False,
         confidence=lambda h: _high_if(h.cued(BIRTH_CUE, 40), "medium")),
    Rule("RU_DRIVER_LICENSE", RU_LICENSE, cue=RU_LICENSE_CUE, reach=40,
         words=("водительс", "удостоверен", "в/у", "в.у", "driver", "licen")),
    Rule("IP_ADDRESS", IPV4, hint=IPV4_HINT, needs_digits=False),
    Rule("IP_ADDRESS", IPV6, words=(":",), hint=IPV6_HINT, needs_digits=False),
)


def no_candidates() -> Column:
    return F.array().cast(CANDIDATE_TYPE)


def own_kind(type_: str) -> int:
    return 100 if type_ == "PERSON" else 300 if type_.startswith("SECRET") else 200


def candidate(start: Column, end: Column, ord_: Column, type_: Column, rank: Column, validator: Column,
              prio: Column) -> Column:
    return F.struct(
        start.alias("start"), (start - end).alias("shorter"), ord_.alias("ord"), end.alias("end"),
        prio.alias("prio"), rank.alias("rank"), type_.alias("type"), validator.alias("validator"))


def _gate(rule: Rule, views: Views) -> Column | None:
    """Cheap condition a text must meet for the rule to find anything in it."""
    text = views.folded if rule.folded else views.plain
    parts = []
    if rule.if_folded:
        parts.append(views.cyrillic)
    if rule.needs_digits or rule.lengths:
        parts.append(views.dense)
    if rule.words:
        if not any(w.isascii() for w in rule.words):
            parts.append(~views.ascii)
        parts.append(reduce(or_, [F.contains(views.lower, F.lit(w)) for w in rule.words]))
    if callable(rule.hint):
        parts.append(rule.hint(text))
    elif rule.hint:
        parts.append(F.contains(text, F.lit(rule.hint)) if rule.hint.isalnum() else text.rlike(rule.hint))
    return reduce(and_, parts) if parts else None


def pieces(rule: Rule, views: Views) -> Column:
    """Bracketed text of one rule; a text that fails the gate counts as one without a match."""
    text = views.folded if rule.folded else views.plain
    found = bracket(text, rule.pattern, rule.tail) if rule.pattern else views.runs
    gate = _gate(rule, views)
    return found if gate is None else F.when(gate, found).otherwise(no_pieces())


def _graded(rule: Rule, h: Hit) -> Column:
    """Rank of a hit, NULL if the rule drops it."""
    tests = []
    if rule.lengths:
        tests.append(F.length(h.match).isin(*rule.lengths))
    if rule.check:
        tests.append(rule.check(h))
    if rule.cue:
        tests.append(h.cued(rule.cue, rule.reach))
    rank = _rank(rule.confidence) if isinstance(rule.confidence, str) else rule.confidence(h)
    return F.when(reduce(and_, tests), rank) if tests else rank


def _case(key: Column, branches: list[tuple[int, Column]], default: Column | None = None) -> Column:
    out = None
    for value, result in branches:
        out = F.when(key == value, result) if out is None else out.when(key == value, result)
    if out is None:
        return default if default is not None else F.lit(None)
    return out if default is None else out.otherwise(default)


def _constants(values: list) -> Column:
    return F.expr(f"array({', '.join('NULL' if v is None else repr(v) for v in values)})")


def candidates(rules: list[Rule], views: Views, hits: Column) -> Column:
    """Candidates from placed hits. ``hits`` is a column of structs with ``rule`` (index), ``start``, ``end`` and
    ``match``; one pass over it applies every rule's tests."""

    def grade(h: Column) -> Column:
        def branch(i: int, rule: Rule):
            text = views.folded if rule.folded else views.plain
            chunks = None if rule.folded else views.chunks
            return i, _graded(rule, Hit(text, h["start"], h["end"], h["match"], chunks))

        return F.struct(h["rule"].alias("rule"), h["start"].alias("start"), h["end"].alias("end"), _case(
            h["rule"], [branch(i, r) for i, r in enumerate(rules)]).cast("int").alias("rank"))

    def emit(g: Column) -> Column:
        def of(values: list) -> Column:
            return F.get(_constants(values), g["rule"])

        validator = _case(g["rule"], [(i, r.validator(g["rank"])) for i, r in enumerate(rules) if callable(r.validator)],
                          of([r.validator if isinstance(r.validator, str) else None for r in rules]))
        own = _case(g["rule"], [(i, r.priority(g["rank"])) for i, r in enumerate(rules) if callable(r.priority)],
                    of([0 if callable(r.priority) else r.priority for r in rules]))
        kind = F.when(validator == "checksum", F.lit(400)).otherwise(of([own_kind(r.type) for r in rules]))
        return candidate(g["start"], g["end"], of([r.ord for r in rules]), of([r.type for r in rules]), g["rank"],
                         validator, kind + own)

    graded = F.filter(F.transform(hits, grade), lambda g: g["rank"].isNotNull())
    return F.transform(graded, emit)


def enabled_rules(cfg: ScanConfig) -> list[Rule]:
    """Structured rules of the enabled types, then the user's, in tie order."""
    kept = [replace(rule, ord=i, needs_digits=rule.needs_digits is not False) for i, rule in enumerate(RULES)
            if cfg.wants(rule.type)]
    return kept + [replace(_own_pattern(rule), ord=200 + i) for i, rule in enumerate(cfg.extra)]


def _own_pattern(rule: Rule) -> Rule:
    """A user's rule on digit runs has a pattern of its own: the shared runs are those the built-in rules need."""
    if rule.pattern or not rule.lengths:
        return rule
    runs = "|".join(f"[0-9]{{{n}}}" for n in rule.lengths)
    return replace(rule, pattern=rf"{B}(?:{runs}){E}", lengths=())


def reachable(rules: list[Rule], min_rank: int) -> list[Rule]:
    """Rules that can reach the minimum confidence; the others leave the plan."""
    return [r for r in rules if not isinstance(r.confidence, str) or RANKS[r.confidence] >= min_rank]
