"""The scan: one narrow projection from a text column to its detections. No shuffle, works on streams as is."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.functions.spans import bracket, chunked, no_pieces, place, running_max
from veilframe.functions.textforms import (
    CYRILLIC,
    SHIFT_TYPE,
    WIDE_SPACE,
    fold_lookalikes,
    is_ascii,
    resize,
    resized_class,
    same_length_form,
    unusual_class,
)
from veilframe.operators.detectors import (
    DENSE_DIGITS,
    DIGIT_RUNS,
    Rule,
    Views,
    candidates,
    enabled_rules,
    no_candidates,
    pieces,
    reachable,
)
from veilframe.operators.persons import person_rules, ru_names, ru_word_pieces, wants_ru_words
from veilframe.operators.resolve import DETECTION_TYPE, cluster_heads, resolve, to_detections, to_source
from veilframe.operators.secrets import secret_rules

TEMP = "__vf_"


def _t(name: str) -> Column:
    return F.col(TEMP + name)


def _fenced(value: Column) -> Column:
    """The same value, marked non-deterministic. The optimizer then computes it once, where it stands: it would
    otherwise push a later filter on the detections down through all stages and copy their expressions into it."""
    return F.when(F.spark_partition_id() >= 0, value)


def active_rules(cfg: ScanConfig) -> list[Rule]:
    return reachable(enabled_rules(cfg) + secret_rules(cfg) + person_rules(cfg), cfg.min_rank)


@lru_cache(maxsize=16)
def _rule_columns(cfg: ScanConfig, app_id: str) -> dict[str, Column]:
    """Expressions of the rule stages. They name temporary columns only, so one application builds them once."""
    rules = active_rules(cfg)
    views = Views(_t("plain"), _t("folded"), _t("ascii"), _t("cyrillic"), _t("lower"), _t("dense"), _t("runs"),
                  _t("chunks"))
    cut = [pieces(rule, views) for rule in rules]
    found = [candidates(rules, views, _t("hits"))] if rules else [no_candidates()]
    if wants_ru_words(cfg):
        cut.append(ru_word_pieces(views))
        found.append(ru_names(_t("words")))
    return {
        "cut": F.array(*cut),
        "placed": F.transform(_t("cut"), lambda p, i: place(p, i.alias("rule"))),
        "found": F.filter(F.concat(*found), lambda c: c["rank"] >= cfg.min_rank),
    }


def scan(df: DataFrame, text_col: str = "text", cfg: ScanConfig | None = None, out: str = "detections",
         allowed: Callable[[Column], Column] | None = None, where: Column | str | None = None) -> DataFrame:
    """Add ``out``: ``ARRAY<STRUCT<type, start, end, value, confidence, validator>>`` in reading order.

    The stages are separate projections on purpose: each text view is computed once and read by every rule. A rule
    runs only on rows that pass its gate, so a text without digits, cues and capitals costs a few passes. ``where`` names
    the rows to keep; it is applied to the source and reaches the files, while later filters do not move through the scan. ``allowed`` is a condition on candidates
    (``type``, ``rank``, ``ord``) that may read the row's columns; what it refuses never suppresses another candidate.
    """
    cfg = cfg or ScanConfig()
    df = df if where is None else df.filter(where)
    rules = active_rules(cfg)
    text = F.coalesce(F.col(text_col), F.lit(""))

    work = df.withColumns({TEMP + "text": text, TEMP + "ascii": is_ascii(text)})
    work = work.withColumn(TEMP + "odd", ~_t("ascii") & _t("text").rlike(unusual_class()))
    work = work.withColumn(TEMP + "flat", F.when(_t("odd"), same_length_form(_t("text"))).otherwise(_t("text")))
    work = work.withColumn(TEMP + "form", F.when(
        _t("odd") & _t("flat").rlike(resized_class()), resize(_t("flat"))))
    work = work.withColumns({
        TEMP + "plain": F.coalesce(_t("form")["text"], _t("flat")),
        TEMP + "shifts": _t("form")["shifts"].cast(SHIFT_TYPE),
    })
    work = work.withColumn(TEMP + "cyrillic", ~_t("ascii") & _t("plain").rlike(CYRILLIC))
    work = work.withColumns({
        TEMP + "folded": F.when(_t("cyrillic"), fold_lookalikes(_t("plain"), "en")).otherwise(_t("plain")),
        TEMP + "lower": F.lower(_t("plain")),
        TEMP + "dense": _t("plain").rlike(DENSE_DIGITS),
    })
    if any(r.lengths for r in rules):
        work = work.withColumn(TEMP + "runs", F.when(
            _t("dense"), bracket(_t("plain"), DIGIT_RUNS)).otherwise(no_pieces()))

    # All rules' matches are placed by one expression, and one expression tests them all.
    ru = wants_ru_words(cfg)
    if not rules and not ru:
        return df.withColumn(out, F.array().cast(DETECTION_TYPE))
    parts = _rule_columns(cfg, df.sparkSession.sparkContext.applicationId)
    work = work.withColumn(TEMP + "cut", parts["cut"])
    work = work.withColumn(TEMP + "placed", parts["placed"])
    stage = {TEMP + "hits": F.flatten(F.slice(_t("placed"), 1, len(rules)))}
    if ru:
        stage[TEMP + "words"] = F.get(_t("placed"), F.lit(len(rules)))
    work = work.withColumns(stage)
    work = work.withColumn(TEMP + "chunks", chunked(_t("plain"), _t("hits")))
    work = work.withColumn(TEMP + "found", parts["found"])
    if allowed is not None:
        work = work.withColumn(TEMP + "found", F.filter(_t("found"), allowed))
    # A hit found twice (two phone patterns, two secret views) is settled like any overlap: the first one stays.
    work = work.withColumn(TEMP + "ordered", F.array_sort(to_source(_t("found"), _t("shifts"))))
    work = work.withColumn(TEMP + "reach", running_max(F.transform(_t("ordered"), lambda c: c["end"])))
    work = work.withColumn(TEMP + "heads", F.when(
        F.size(_t("ordered")) > 1, cluster_heads(_t("ordered"), _t("reach"))))
    work = work.withColumn(TEMP + "kept", F.when(
        F.size(_t("ordered")) > 1, resolve(_t("ordered"), _t("heads"))).otherwise(_t("ordered")))
    found = _fenced(to_detections(_t("kept"), _t("text"))).cast(DETECTION_TYPE)
    return work.select(*df.columns, found.alias(out))


def scan_selection(df: DataFrame, text_col: str = "text", cfg: ScanConfig | None = None,
                   out: str = "detections") -> DataFrame:
    """Like :func:`scan`, but a non-blank text without findings is one ``MASKED`` detection as a whole."""
    whole = F.array(F.struct(
        F.lit("MASKED").alias("type"), F.lit(0).alias("start"), F.length(text_col).alias("end"),
        F.col(text_col).alias("value"), F.lit("high").alias("confidence"), F.lit("heuristic").alias("validator")))
    scanned = scan(df, text_col, cfg, out)
    return scanned.withColumn(out, F.when(
        (F.size(out) == 0) & F.col(text_col).rlike(f"[^\\s{WIDE_SPACE}]"), whole.cast(DETECTION_TYPE)).otherwise(F.col(out)))


def explode_detections(scanned: DataFrame, keep: list[str], detections: str = "detections") -> DataFrame:
    """One row per detection: ``keep`` columns, then the detection's fields."""
    return scanned.select(*keep, F.explode(detections).alias("d")).select(*keep, "d.*")


def type_counts(detections: Column) -> Column:
    """``MAP<type, count>`` of one text's detections."""
    types = F.transform(detections, lambda d: d["type"])
    return F.map_from_entries(F.transform(F.array_distinct(types), lambda t: F.struct(
        t, F.size(F.filter(types, lambda x: x == t)))))
