"""Secret detection. These four rules are this library's own design: they are built to give the expected labels
on known examples, not taken from a published rule set.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.functions.textforms import entropy
from veilframe.operators.detectors import B, E, S, Hit, Rule, each

FIRST_ORD = 100

JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,}"
AWS = rf"{B}AKIA[0-9A-Z]{{16}}{E}"
KEY_WORDS = "api[_-]?key|secret|token|password|passwd|pwd|(?iu:пароль)"
KEY_HINT = rf"[:=][{S}]*[\"']?[A-Za-z0-9+/_\-]{{8}}"
KEY_VALUE = (
    rf"(?i)((?:{KEY_WORDS})[{S}]*[:=][{S}]*[\"']?)([A-Za-z0-9+/_\-]{{8,}})"
)
OPAQUE = each("A-Za-z0-9+/_") + r"\-"
OPAQUE_RUN = rf"(?<![{OPAQUE}])[{OPAQUE}]{{32,}}"
HASH_CUE = rf"commit|{B}sha|hash|хеш|md5"
HEX_BITS = 3.3
MIXED_BITS = 4.2


def _has_long_run(text: Column) -> Column:
    """A run of 32: at the text's start, or after a character that cannot be part of one."""
    return F.substring(text, 1, 32).rlike(f"^[{OPAQUE}]{{32}}") | text.rlike(f"[^{OPAQUE}][{OPAQUE}]{{32}}")


def _random_looking(h: Hit) -> Column:
    all_hex = h.match.rlike("^[0-9a-fA-F]+$") & (entropy(h.match) > HEX_BITS)
    mixed = h.match.rlike("[a-z]") & h.match.rlike("[A-Z]") & h.match.rlike("[0-9]") & (entropy(h.match) > MIXED_BITS)
    return (all_hex | mixed) & ~h.cued(HASH_CUE, 20)


SECRET_RULES = (
    Rule("SECRET_JWT", JWT, confidence="high", hint="eyJ", needs_digits=False),
    Rule("SECRET_AWS", AWS, confidence="high", hint="AKIA", needs_digits=False),
    Rule("SECRET_KV", KEY_VALUE, tail=True, confidence="high", hint=KEY_HINT, needs_digits=False),
    Rule("SECRET_ENTROPY", OPAQUE_RUN, confidence="medium", validator="heuristic", check=_random_looking, hint=_has_long_run,
         needs_digits=False),
)


def secret_rules(cfg: ScanConfig) -> list[Rule]:
    """Enabled secret rules over both views: key patterns need folded letters, a Cyrillic key word the plain ones."""
    return [
        replace(rule, folded=folded, if_folded=folded, ord=FIRST_ORD + i)
        for folded in (False, True) for i, rule in enumerate(SECRET_RULES) if rule.type in cfg.secret_types
    ]
