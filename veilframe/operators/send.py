"""From message to what leaves: scan, hold, decide, mask, add the instruction and count, in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.functions.placeholders import append_instruction
from veilframe.operators.guard import guard, guard_active, settle
from veilframe.operators.mask import mask
from veilframe.operators.policy import with_defaults
from veilframe.operators.resolve import DETECTION_TYPE
from veilframe.operators.scan import scan
from veilframe.operators.sessions import url_host
from veilframe.operators.tenants import scan_by_policy, with_policy
from veilframe.sources.catalog import site_of

SETTINGS = ["guard_enabled", "guard_disabled_sites", "instruction_enabled"]


@dataclass(frozen=True)
class Sent:
    """Result of :func:`guard_send`. Write ``entries`` to the vault before ``rows`` leave."""

    rows: DataFrame
    entries: DataFrame

    @property
    def leaks(self) -> DataFrame:
        """One row: how many messages left masked."""
        return self.rows.agg(F.count_if(F.col("action") == "mask").alias("leaks_prevented"))


def decide(df: DataFrame, text_col: str = "text", cfg: ScanConfig | None = None, policies: DataFrame | None = None,
           tenant: str | None = None, url_col: str | None = None, choice: str = "choice") -> DataFrame:
    """Scanned messages with ``action`` and ``instructed`` (whether a masked text gets the instruction). Narrow, but for
    the join to the policies."""
    columns = df.columns
    if policies is None:
        rows, active, instructed = scan(df, text_col, cfg), None, F.lit(True)
    else:
        rows = with_policy(scan_by_policy(df, policies, tenant, text_col), with_defaults(
            policies.select(tenant, *SETTINGS), SETTINGS), tenant, SETTINGS)
        site = site_of(url_host(F.col(url_col)))["id"] if url_col else F.lit(None).cast("string")
        active = guard_active(site, F.coalesce("guard_enabled", F.lit(True)), F.col("guard_disabled_sites"))
        instructed = F.coalesce("instruction_enabled", F.lit(True))
    held = settle(guard(rows, active=active), choice=choice)
    return held.withColumn("instructed", instructed).select(*columns, "detections", "action", "instructed")


def guard_send(df: DataFrame, session: str, order: list[str], vault: DataFrame | None = None, text_col: str = "text",
               cfg: ScanConfig | None = None, policies: DataFrame | None = None, tenant: str | None = None,
               url_col: str | None = None, choice: str = "choice", style: str = "square") -> Sent:
    """Messages with ``action`` and ``sent``, and the vault entries that masking adds.

    A message without findings, or where guard is off, passes as it is. A held one goes by the sender's ``choice``:
    ``mask`` sends the masked text with the instruction (unless the policy turned that off), ``send`` the text as it is,
    ``drop`` nothing; without a choice it stays held. ``sent`` is NULL for what does not leave. Only masked messages add
    entries and numbers. With ``policies`` (see :func:`scan_by_policy`; also ``guard_enabled``, ``guard_disabled_sites``,
    ``instruction_enabled``) each row goes by those of its ``tenant``, and ``url_col`` names the site. The texts are
    scanned once.
    """
    return settled_send(decide(df, text_col, cfg, policies, tenant, url_col, choice), session, order, vault, text_col, style)


def settled_send(decided: DataFrame, session: str, order: list[str], vault: DataFrame | None = None,
                 text_col: str = "text", style: str = "square", counters: DataFrame | None = None) -> Sent:
    """The part of :func:`guard_send` behind :func:`decide`."""
    masks = F.col("action") == "mask"
    marked = decided.withColumn("__hits", F.when(masks, F.col("detections")).otherwise(F.array().cast(DETECTION_TYPE)))
    masked = mask(marked, session, order, vault, text_col, style, detections="__hits", out="__masked",
                  counters=counters)
    leaving = F.when(masks & F.col("instructed"), append_instruction(F.col("__masked"))).when(
        masks, F.col("__masked")).when(F.col("action") == "pass", F.col(text_col))
    rows = masked.rows.withColumn("sent", leaving).drop("__hits", "__masked", "instructed")
    return Sent(rows, masked.entries)
