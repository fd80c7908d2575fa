"""Scanning texts of many tenants at once, each under its own policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import DEFAULT_TYPES, RANKS, ScanConfig
from veilframe.operators.persons import EN_PAIR_ORD, EN_TITLE_ORD, RU_INITIALS_ORD, RU_ORD
from veilframe.operators.policy import with_defaults
from veilframe.operators.scan import scan
from veilframe.plans.staging import BROADCAST_BYTES, lookup, stage

TYPES, RANK, LANGUAGE = "__policy_types", "__policy_rank", "__policy_language"
PERSON_ORDS = {"ru": (RU_INITIALS_ORD, RU_ORD), "en": (EN_TITLE_ORD, EN_PAIR_ORD)}


def _rank_of(confidence: Column) -> Column:
    out = F.lit(None).cast("int")
    for level, rank in RANKS.items():
        out = F.when(confidence == level, F.lit(rank)).otherwise(out)
    return out


def _allowed(own: tuple[str, ...]):
    """What a row's policy lets through: its types (``SECRET`` stands for all of them), its confidence, its language. Rules
    of the caller (``own`` types) need the confidence only."""

    def allowed(c: Column) -> Column:
        types = F.col(TYPES)
        named = F.array_contains(types, c["type"]) | c["type"].isin(*own) | (
            F.startswith(c["type"], F.lit("SECRET_")) & F.array_contains(types, F.lit("SECRET")))
        spoken = F.when(F.col(LANGUAGE) == "ru", ~c["ord"].isin(*PERSON_ORDS["en"])).when(
            F.col(LANGUAGE) == "en", ~c["ord"].isin(*PERSON_ORDS["ru"])).otherwise(F.lit(True))
        return named & (c["rank"] >= F.col(RANK)) & ((c["type"] != "PERSON") | spoken)

    return allowed


def with_policy(df: DataFrame, policies: DataFrame, tenant: str, columns: list[str]) -> DataFrame:
    """``df`` left-joined to its tenants' ``columns``. The policies are broadcast after their size was measured; beyond
    that only hot tenants are, and rows without a tenant never meet in one task."""
    table = stage(policies.filter(F.col(tenant).isNotNull()).groupBy(tenant).agg(
        F.min(F.struct(*columns)).alias("__policy")).select(tenant, "__policy.*"))
    size = table.agg(F.sum(F.length(F.to_json(F.struct(*table.columns)))).alias("b")).first()["b"] or 0
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(table), tenant, "left").select(*df.columns, *columns)
    known = lookup(df.filter(F.col(tenant).isNotNull()), table, [tenant]).select(*df.columns, *columns)
    unknown = df.filter(F.col(tenant).isNull()).select("*", *[
        F.lit(None).cast(table.schema[c].dataType).alias(c) for c in columns])
    return known.unionByName(unknown)


def scan_by_policy(df: DataFrame, policies: DataFrame, tenant: str, text_col: str = "text", out: str = "detections",
                   extra: tuple = ()) -> DataFrame:
    """Scan every row under the policy of its ``tenant``: the rows that :func:`scan` gives under that tenant's settings.

    ``policies`` has ``tenant``, ``enabled_types``, ``min_confidence`` and ``language`` (as ``sanitize_policies`` gives
    them); NULL settings, and rows without a tenant or of a tenant without a policy, get the defaults. Of several policies
    of a tenant the least counts. All rows go through one plan, whose rules are those that any policy asks for; a row's
    types, confidence and language are applied before overlaps are settled, so what its policy does not want never
    suppresses what it wants. ``extra`` holds rules for all tenants.
    """
    settings = ["enabled_types", "min_confidence", "language"]
    filled = with_defaults(policies.select(tenant, *settings), settings)
    asked = filled.select(F.explode("enabled_types").alias("t")).groupBy("t").agg(F.lit(1)).collect()  # known types only
    levels = {r.c for r in filled.select(F.col("min_confidence").alias("c")).distinct().collect()}
    types = tuple(dict.fromkeys((*DEFAULT_TYPES, *sorted(r.t for r in asked))))
    union = ScanConfig(types, min((*levels, "medium"), key=RANKS.__getitem__), "auto", extra)
    rows = with_policy(df, filled.select(
        tenant, F.col("enabled_types").alias(TYPES), _rank_of(F.col("min_confidence")).alias(RANK),
        F.col("language").alias(LANGUAGE)), tenant, [TYPES, RANK, LANGUAGE])
    rows = rows.withColumns({
        TYPES: F.coalesce(TYPES, F.array(*map(F.lit, DEFAULT_TYPES))), RANK: F.coalesce(RANK, F.lit(RANKS["medium"])),
        LANGUAGE: F.coalesce(LANGUAGE, F.lit("auto"))})
    found = scan(rows, text_col, union, out, _allowed(tuple(r.type for r in extra)))
    return found.select(*[c for c in df.columns if c != out], out)
