"""Policies: scan and guard settings as JSON rows, checked field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import DEFAULT_TYPES, KNOWN_TYPES, LANGUAGES, PII_TYPES, RANKS, ScanConfig
from veilframe.functions.placeholders import STYLES

# JSON key, column, kind, and allowed values or default.
FIELDS = (
    ("enabledTypes", "enabled_types", "types", list(DEFAULT_TYPES)),
    ("minConfidence", "min_confidence", tuple(RANKS), "medium"),
    ("language", "language", LANGUAGES, "auto"),
    ("guardEnabled", "guard_enabled", "flag", True),
    ("guardDisabledSites", "guard_disabled_sites", "texts", []),
    ("instructionEnabled", "instruction_enabled", "flag", True),
    ("placeholderStyle", "placeholder_style", tuple(STYLES), "square"),
    ("uiLanguage", "ui_language", LANGUAGES, "auto"),
)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _texts(value: Column) -> Column:
    items = F.when(F.startswith(_kind(value), F.lit("ARRAY<")), F.try_variant_get(value, "$", "array<variant>"))
    return F.filter(F.transform(items, _text), lambda x: x.isNotNull())


def sanitize_policies(df: DataFrame, json_col: str = "policy_json") -> DataFrame:
    """Add one column per setting, NULL where the JSON lacks it or holds a value of the wrong kind. Unknown types and
    non-text list items are dropped; anything but an object gives NULLs only."""
    parsed = F.try_parse_json(json_col)
    work = df.withColumn("__v", F.when(F.startswith(_kind(parsed), F.lit("OBJECT<")), parsed))
    columns = {}
    for key, name, kind, _ in FIELDS:
        value = F.try_variant_get("__v", f"$.{key}", "variant")
        if kind == "flag":
            columns[name] = F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        elif kind == "types":
            columns[name] = F.filter(_texts(value), lambda x: x.isin(*KNOWN_TYPES))
        elif kind == "texts":
            columns[name] = _texts(value)
        else:
            text = _text(value)
            columns[name] = F.when(text.isin(*kind), text)
    return work.withColumns(columns).drop("__v")


def with_defaults(policies: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Fill the settings a policy leaves open (all of them, or those named)."""
    out = policies
    for _, name, kind, default in FIELDS:
        if names is not None and name not in names:
            continue
        if isinstance(default, list):
            value = F.array(*map(F.lit, default)).cast("array<string>")
        else:
            value = F.lit(default)
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def merge(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Settings of ``base`` overridden by those ``patch`` sets."""
    names = [name for _, name, _, _ in FIELDS]
    p = patch.select(key, *[F.col(n).alias("p_" + n) for n in names])
    return base.join(p, key, "left").select(
        *[c for c in base.columns if c not in names], *[F.coalesce("p_" + n, n).alias(n) for n in names])


def policies_to_json(policies: DataFrame, out: str = "policy_json") -> DataFrame:
    """Settings columns back to one JSON text per row; settings that are NULL are left out."""
    return policies.withColumn(out, F.to_json(F.struct(*[F.col(name).alias(key) for key, name, _, _ in FIELDS])))


def scan_config(row) -> ScanConfig:
    """Scan settings of one collected policy row."""
    return ScanConfig(tuple(row["enabled_types"]), row["min_confidence"], row["language"])


def group_of(type_: Column) -> Column:
    """Display group of a type; every ``SECRET_*`` belongs to ``SECRET``."""
    umbrella = F.when(F.startswith(type_, F.lit("SECRET_")), F.lit("SECRET")).otherwise(type_)
    groups: dict[str, list[str]] = {}
    for name, group, *_ in PII_TYPES:
        groups.setdefault(group, []).append(name)
    out = None
    for group, names in groups.items():
        out = F.when(umbrella.isin(*names), group) if out is None else out.when(umbrella.isin(*names), group)
    return out
