"""From candidate spans to the final, disjoint detections of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import chunked, let, read_out
from veilframe.functions.textforms import source_offset
from veilframe.operators.detectors import CANDIDATE_TYPE

DETECTION_TYPE = "array<struct<type:string,start:int,end:int,value:string,confidence:string,validator:string>>"


def to_source(candidates: Column, shifts: Column) -> Column:
    """Move candidates of a text whose length changed in normalisation back to source offsets."""

    def moved(c: Column) -> Column:
        def build(p: Column) -> Column:
            return F.struct(
                p["start"].alias("start"), (p["start"] - p["end"]).alias("shorter"), c["ord"].alias("ord"),
                p["end"].alias("end"), c["prio"].alias("prio"), c["rank"].alias("rank"), c["type"].alias("type"),
                c["validator"].alias("validator"))

        return let(F.struct(
            source_offset(shifts, c["start"]).alias("start"),
            (source_offset(shifts, c["end"] - 1) + 1).alias("end")), build)

    return F.when(shifts.isNull(), candidates).otherwise(F.transform(candidates, moved))


def _settle(cluster: Column) -> Column:
    """Walk a sorted cluster once: each candidate competes with the last one kept."""

    def step(acc: Column, c: Column) -> Column:
        last = acc["last"]
        overlaps = c["start"] < last["end"]
        wins = (c["shorter"] < last["shorter"]) | ((c["shorter"] == last["shorter"]) & (
            (c["prio"] > last["prio"]) | ((c["prio"] == last["prio"]) & (c["rank"] > last["rank"]))))
        return F.struct(
            F.when(overlaps, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(last))).alias("kept"),
            F.when(overlaps & ~wins, last).otherwise(c).alias("last"))

    start = F.struct(F.array().cast(CANDIDATE_TYPE).alias("kept"), F.get(cluster, F.lit(0)).alias("last"))
    folded = F.aggregate(
        F.slice(cluster, F.lit(2), F.size(cluster)), start, step,
        lambda acc: F.concat(acc["kept"], F.array(acc["last"])))
    return F.when(F.size(cluster) == 1, cluster).otherwise(folded)


def cluster_heads(ordered: Column, reach: Column) -> Column:
    """One-based positions where a cluster of touching spans begins; ``reach`` is the running maximum of the ends."""
    # Bound once: the optimizer may put a column's expression where it is used, here inside the filter's function.
    return let(reach, lambda r: F.filter(
        F.sequence(F.lit(1), F.size(ordered)),
        lambda i: (i == 1) | (F.get(ordered, i - 1)["start"] >= F.get(r, i - 2))))


def resolve(ordered: Column, heads: Column) -> Column:
    """Disjoint candidates in reading order, from candidates sorted by start, then longest first, then rule order.
    Clusters are independent, so the walk never carries more than one of them."""
    return F.flatten(F.transform(heads, lambda first, k: let(
        F.slice(ordered, first, F.coalesce(F.get(heads, k + 1), F.size(ordered) + 1) - first), _settle)))


def to_detections(resolved: Column, text: Column) -> Column:
    levels = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    return let(chunked(text, resolved), lambda chunks: F.transform(resolved, lambda c: F.struct(
        c["type"].alias("type"), c["start"].alias("start"), c["end"].alias("end"),
        read_out(text, chunks, c["start"], c["end"] - c["start"]).alias("value"),
        F.element_at(levels, c["rank"]).alias("confidence"), c["validator"].alias("validator"))))
