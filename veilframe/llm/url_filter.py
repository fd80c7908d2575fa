"""URL filters: rules by host and path, then logistic regression on hashed character n-grams of both.

The model is trained from a small labelled table of URLs on the driver; its n-grams come from the same expressions that
score a table. Scoring is one projection of built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 13
GRAMS = (3, 4, 5)
MAX_LABELLED = 10_000

# Invented addresses: 1 is unwanted.
LABELLED = (
    ("http://best-casino-games.test/spin/1", 1), ("https://www.casino-royal.test/en/bonus", 1),
    ("http://online-casino.test/jackpot?id=3", 1), ("https://blog.win-big-casino.test/fr/8", 1),
    ("http://cheap-meds.test/order", 1), ("https://buy-pills-now.test/en/77", 1),
    ("http://www.discount-pills.test/de/9", 1), ("http://pills-without-prescription.test/", 1),
    ("https://m.cheap-watches.test/es/2", 1), ("http://cheap-loans-today.test/en/41", 1),
    ("http://spam-links.test/x", 1), ("https://www.link-farm.test/en/5", 1), ("http://seo-spam-farm.test/de/3", 1),
    ("http://mail-spam.test/fr/1", 1), ("https://adult-chat.test/cam", 1), ("http://www.adult-videos.test/en/9", 1),
    ("http://hot-adult-dates.test/", 1), ("https://xxx-cams.test/es/12", 1), ("http://free-slots.test/en/1", 1),
    ("http://sport-bets.test/odds", 1), ("https://www.live-bets.test/en/22", 1), ("http://bets-and-odds.test/fr/6", 1),
    ("https://ads-server.test/click", 1), ("http://click-track.test/pixel", 1), ("https://m.user-track.test/en/8", 1),
    ("http://ads-network.test/de/4", 1), ("http://free-download-crack.test/", 1), ("http://lottery-win.test/en/3", 1),
    ("http://win-prizes.test/fr/2", 1), ("https://www.free-money.test/en/100", 1),
    ("https://www.river-museum.test/en/12", 0), ("http://city-library.test/fr/3", 0),
    ("https://blog.gardening.test/en/2021/roses", 0), ("http://weather-station.test/de/5", 0),
    ("https://m.recipes.test/es/100", 0), ("https://docs.software.test/en/install.html", 0),
    ("http://www.university.test/en/research?page=2", 0), ("https://news-daily.test/fr/2044", 0),
    ("http://history-archive.test/de/77.html", 0), ("https://www.music-school.test/en/4#top", 0),
    ("http://blog.astronomy.test/en/88", 0), ("https://m.railways.test/fr/9/", 0),
    ("http://forest-society.test/es/61", 0), ("https://theatre.test/en/300?page=2", 0),
    ("http://www.hospital.test/de/14", 0), ("https://wiki.mountains.test/en/1", 0),
    ("http://townhall.test/en/402.html", 0), ("https://www.football-club.test/en/30", 0),
    ("http://bakery-corner.test/fr/18", 0), ("https://blog.chess.test/en/6", 0),
    ("http://m.travelling.test/es/41", 0), ("https://www.painters.test/de/310", 0),
    ("http://another-reading-list.test/en/5/", 0), ("https://science-notes.test/en/19", 0),
    ("http://mathematics.test/fr/27", 0), ("https://www.housing.test/en/8?ref=x", 0),
    ("http://the-old-mill.test/en/11", 0), ("https://birdwatching.test/en/74", 0),
    ("http://www.orchestra.test/de/2", 0), ("https://cinema-guide.test/es/5", 0),
)


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, like ``example.com/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"),
         Rule("net/es/", "block"), Rule("net/fr/", "block"))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: tuple[float, ...]  # of the buckets


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Buckets of the distinct n-grams; host and path keep apart, ends of the host are marked."""
    def of(text: Column, mark: str, n: int) -> Column:
        last = F.length(text) - (n - 1)
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))),
                                                    F.lit(BUCKETS)))

    marked = F.concat(F.lit("^"), host, F.lit("$"))
    return F.array_distinct(F.concat(*[of(t, m, n) for t, m in ((marked, "h"), (path, "p")) for n in GRAMS]))


def model_score(buckets: Column, model: Model) -> Column:
    """Log odds of being unwanted. Grams weigh less in a long address."""
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(weights, b.cast("int")))
    return F.lit(model.bias) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{u}', {y})" for u, y in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def train(labelled: DataFrame, ridge: float = 0.02, steps: int = 400) -> Model:
    """Fit by gradient descent on the driver; ``labelled`` holds url and label (1 unwanted), ``MAX_LABELLED`` rows at
    most. Rows with a null label are left out; no row or one label only gives a model that blocks nothing or all."""
    rows = labelled.filter("label IS NOT NULL").select(
        grams(url_host(F.col("url")), url_path(F.col("url"))).alias("g"), F.col("label").cast("int").alias("y")).limit(
        MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled addresses")
    if len({r.y for r in rows}) < 2:
        return Model(4.0 if rows and rows[0].y else -4.0, (0.0,) * BUCKETS)
    x = np.zeros((len(rows), BUCKETS))
    for k, r in enumerate(rows):
        x[k, r.g] = 1 / np.sqrt(max(1, len(r.g)))
    y, w, bias = np.array([r.y for r in rows], float), np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w -= 4.0 * (x.T @ error / len(y) + ridge / len(y) * w)
        bias -= 1.0 * error.mean()
    return Model(float(bias), tuple(round(float(v), 6) for v in w))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...], model: Model, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, score and verdict to all columns; input columns of these names are refused.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting one decides. Where
    none fits, a score above 0 blocks. A null address, or one without ``://``, has an empty host and path.
    """
    if {"host", "path", "rule", "score", "verdict"} & set(pages.columns):
        raise ValueError("an input column has the name of a result")
    found = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return found.withColumns({"rule": rule, "score": model_score(grams(F.col("host"), F.col("path")), model)}) \
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, RULES, train(labelled_urls(spark))).drop("url")
