"""Known chat sites as a dimension table and as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Site id, hosts, paths of conversations that have no id yet.
SITES = (
    ("chatgpt", ("chatgpt.com", "chat.openai.com"), ("/",)),
    ("claude", ("claude.ai",), ("/", "/new")),
    ("gemini", ("gemini.google.com",), ("/app",)),
    ("perplexity", ("perplexity.ai",), ("/",)),
    ("poe", ("poe.com",), ()),
    ("deepseek", ("chat.deepseek.com",), ("/",)),
    ("grok", ("grok.com",), ("/",)),
    ("yandexgpt", ("alice.yandex.ru",), ("/",)),
    ("gigachat", ("giga.chat",), ("/",)),
)


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, list(m), list(d)) for i, m, d in SITES], "id string, match array<string>, draft_paths array<string>")


def site_of(host: Column, table=SITES) -> Column:
    """``STRUCT<id, draft_paths>`` of the first site whose host equals ``host`` or is a dot-suffix of it, else NULL."""
    out = None
    for site, hosts, drafts in table:
        hit = None
        for h in hosts:
            one = (host == h) | F.endswith(host, F.lit("." + h))
            hit = one if hit is None else hit | one
        value = F.struct(F.lit(site).alias("id"), F.array(*map(F.lit, drafts)).cast("array<string>").alias("draft_paths"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def match_site(df: DataFrame, host_col: str = "host", out: str = "site") -> DataFrame:
    """Add the id of the site a host belongs to. Nine constant rows need no join."""
    return df.withColumn(out, site_of(F.col(host_col))["id"])
