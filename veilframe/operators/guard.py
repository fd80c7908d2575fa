"""Guarding messages: hold those with detections, route decided ones, count prevented leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.sessions import url_host
from veilframe.sources.catalog import site_of


def guard_active(site: Column, enabled: Column, disabled_sites: Column) -> Column:
    """Guard is on unless switched off globally or for the message's site."""
    off_here = site.isNotNull() & F.array_contains(F.coalesce(disabled_sites, F.array().cast("array<string>")), site)
    return enabled & ~off_here


def guard(df: DataFrame, detections: str = "detections", active: Column | None = None, out: str = "action") -> DataFrame:
    """Add the decision: ``hold`` for a message with detections where guard is active, else ``pass``."""
    held = F.size(detections) > 0
    if active is not None:
        held = held & active
    return df.withColumn(out, F.when(held, F.lit("hold")).otherwise(F.lit("pass")))


def guard_urls(df: DataFrame, policy: DataFrame, url_col: str = "url", tenant: str = "tenant") -> DataFrame:
    """:func:`guard` under each tenant's policy (``guard_enabled``, ``guard_disabled_sites``)."""
    known = df.join(policy.select(tenant, "guard_enabled", "guard_disabled_sites"), tenant, "left")
    site = site_of(url_host(F.col(url_col)))["id"]
    active = guard_active(site, F.coalesce("guard_enabled", F.lit(True)), F.col("guard_disabled_sites"))
    return guard(known, active=active).drop("guard_enabled", "guard_disabled_sites")


def settle(df: DataFrame, action: str = "action", choice: str = "choice") -> DataFrame:
    """Replace ``hold`` by the sender's choice: ``mask``, ``send`` (as is) or ``drop``; undecided ones stay held."""
    return df.withColumn(action, F.when(
        (F.col(action) == "hold") & F.col(choice).isin("mask", "send", "drop"),
        F.when(F.col(choice) == "send", F.lit("pass")).otherwise(F.col(choice))).otherwise(F.col(action)))


def outgoing(df: DataFrame, text_col: str = "text", masked_col: str = "masked", action: str = "action") -> DataFrame:
    """The messages that leave: masked ones with their masked text, passed ones as they are."""
    return df.filter(F.col(action).isin("mask", "pass")).withColumn(
        "sent", F.when(F.col(action) == "mask", F.col(masked_col)).otherwise(F.col(text_col)))


def leaks_prevented(df: DataFrame, action: str = "action") -> DataFrame:
    """One per masked message; a streaming input needs output mode ``complete`` or ``update``."""
    return df.groupBy().agg(F.count_if(F.col(action) == "mask").alias("leaks_prevented"))
