"""Measuring detections against labels, and checks that must come out empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The quality gate.
MIN_PRECISION, MIN_RECALL, MIN_PERSON_RECALL = 0.98, 0.95, 0.65


def matches(scanned: DataFrame, key: str, expected: str = "expected", detections: str = "detections") -> DataFrame:
    """Per item, type and value: how often expected, detected and matched (a multiset match).

    Labels and detections are stacked and counted in one aggregation; no join.
    """
    def side(column: str, is_label: bool) -> DataFrame:
        return scanned.select(key, F.explode(column).alias("x")).select(
            key, F.col("x.type").alias("type"), F.col("x.value").alias("value"), F.lit(is_label).alias("label"))

    both = side(expected, True).unionByName(side(detections, False))
    return both.groupBy(key, "type", "value").agg(
        F.count_if("label").alias("n_expected"), F.count_if(~F.col("label")).alias("n_detected")).withColumn(
        "n_matched", F.least("n_expected", "n_detected"))


def quality(matched: DataFrame) -> DataFrame:
    """One row: structured precision and recall, recall of persons, and the counts behind them."""
    person = F.col("type") == "PERSON"

    def total(name: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(name))), F.lit(0))

    sums = matched.agg(
        total("n_expected", ~person).alias("expected"), total("n_detected", ~person).alias("detected"),
        total("n_matched", ~person).alias("matched"), total("n_expected", person).alias("persons_expected"),
        total("n_matched", person).alias("persons_matched"))
    return sums.select("*", F.try_divide("matched", "detected").alias("precision"),
                       F.try_divide("matched", "expected").alias("recall"),
                       F.try_divide("persons_matched", "persons_expected").alias("person_recall"))


def by_type(matched: DataFrame) -> DataFrame:
    """Per type: labels, detections, matches, precision and recall (NULL where there is nothing to divide by)."""
    sums = matched.groupBy("type").agg(
        F.sum("n_expected").alias("expected"), F.sum("n_detected").alias("detected"), F.sum("n_matched").alias("matched"))
    return sums.select("*", F.try_divide("matched", "detected").alias("precision"),
                       F.try_divide("matched", "expected").alias("recall"))


def passes_gate(q: DataFrame) -> DataFrame:
    return q.withColumn("passed", (F.col("precision") >= MIN_PRECISION) & (F.col("recall") >= MIN_RECALL)
                        & (F.col("person_recall") >= MIN_PERSON_RECALL))


def loud_negatives(scanned: DataFrame, expected: str = "expected", detections: str = "detections") -> DataFrame:
    """Items without labels that have detections; must be empty."""
    return scanned.filter((F.size(expected) == 0) & (F.size(detections) > 0))


def residue(rows: DataFrame, text_col: str = "text", masked: str = "masked", restored: str = "restored",
            detections: str = "detections") -> DataFrame:
    """Rows that do not come back exactly, or whose masked text still shows a detected value; must be empty for texts
    in which no detected value also occurs as part of something undetected."""
    shown = F.exists(detections, lambda d: F.contains(F.col(masked), d["value"]))
    return rows.filter((F.col(restored) != F.col(text_col)) | shown)
