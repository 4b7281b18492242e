"""URL verdicts: rules on host and path first, then a model on character n-grams.

The model is a logistic regression on hashed character n-grams of host and path.
It learns from a small table of labelled urls and runs as DataFrame functions and
JVM-side ML stages only.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is judged by the model; without any labelled url every verdict of the model is
``allow``; with labels of one kind only, every verdict is that kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import share_of

# A small table of labelled urls, spelled as hosts and paths.  A url is blocked
# if its host or its path is; the neutral hosts carry paths of both kinds.
BLOCKED_HOSTS = (
    "casino-online.com casinoroyal.net vegas-casino.org mega-casino.net casino-slots.com "
    "bets-today.com sportsbets.net freebets-club.com best-bets.org poker-win.net win-jackpot.com "
    "lottery-win.org slots-free.net free-spins.org pills-shop.net cheappills.org cheap-meds.com "
    "diet-pills.com online-pharma.net cheap-viagra.org adult-video.com adultchat.net adult-cams.org "
    "xxx-tube.com x-rated.net hot-adult.com spamlinks.net spam-mail.org link-farm.com linkfarm.net "
    "content-farm.org ads-server.net adtrack.com tracker-ads.org track-pixel.net clickads.com "
    "popup-ads.net payday-loans.com quick-loans.net replica-watch.org cheap-replica.com "
    "warez-crack.net cracked-keys.org phish-login.com fake-bank.net"
).split()
ALLOWED_HOSTS = (
    "library.org museum.net university.com school.org science.net history.org weather.com "
    "gardening.net cooking.com recipes.org travel.com railway.net theatre.org orchestra.com "
    "football.net chess.org hospital.org medicine.com parliament.net council.org courthouse.com "
    "archive.org encyclopedia.net dictionary.com journal.org newspaper.com radio.net television.com "
    "engineering.org software.net hardware.com mathematics.org physics.net chemistry.com biology.org "
    "architecture.net painting.com photography.org literature.net poetry.com translation.org "
    "mountains.net rivers.com oceans.org forests.net islands.com villages.org harbours.net"
).split()
NEUTRAL_HOSTS = (
    "mysite.com homepage.net webspace.org myhome.net userpages.com hosting.org bloghost.net "
    "freeweb.com webhome.org sitebuilder.net"
).split()
BLOCKED_PATHS = (
    "/casino/bonus /online-casino.html /adult/videos /adult/pills /xxx/gallery.html /xxx-pics/12 "
    "/viagra-cheap.html /cheap-viagra /pills/order /diet-pills.html /poker/win /poker-room.html "
    "/slots/free-spins /free-slots /betting/odds /sports-bets.html /payday-loans /loans/quick "
    "/replica-watches /warez/crack.zip /cracked-keys.html /phish/login /lottery/jackpot /porn/123"
).split()
ALLOWED_PATHS = (
    "/ /en/1024 /de/733/ /fr/58.html /es/4106 /2024/05/article.html /index.html /about /contact.html "
    "/library/books /science/physics.html /recipes/soup /history/maps /news/2023/11/ /blog/post-17 "
    "/docs/manual.pdf /images/garden.jpg /wiki/Chess /weather/today /music/concert.html "
    "/school/timetable /travel/rail-map /museum/opening-hours /poems/12"
).split()
SEED_PREFIXES = ("", "www.", "blog.", "m.")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains and every path that starts so."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModelParams:
    """``sample`` bounds the labelled urls used of each verdict."""

    grams: Sequence[int] = (2, 3, 4)
    buckets: int = 1 << 16
    sample: int = 10_000
    max_iter: int = 50
    reg: float = 1e-3
    block_from: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _grams(chars: Column, tag: str, sizes: Sequence[int]) -> Column:
    """Tagged n-grams of a column of characters; linear in their number."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(chars) - n + 1)
        joined = F.transform(
            starts,
            lambda i: F.concat(F.lit(f"{tag}{n}:"), *[F.element_at(chars, i + k) for k in range(n)]),
        )
        return F.when(F.size(chars) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in sizes])


def _features(df: DataFrame, params: UrlModelParams) -> DataFrame:
    def marked(part: str) -> Column:
        return F.split(F.concat(F.lit("^"), part, F.lit("$")), "")

    # Columns of their own: inside a lambda, the split would run again for every gram.
    split = df.withColumns({"_host_chars": marked("host"), "_path_chars": marked("path")})
    grams = F.concat(*[_grams(F.col(f"_{p}_chars"), p[0], params.grams) for p in ("host", "path")])
    tf = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=params.buckets, binary=True)
    return tf.transform(split.withColumn("_grams", grams).drop("_host_chars", "_path_chars"))


def seed_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table the model learns from by default: host, path, verdict."""
    groups = (
        (BLOCKED_HOSTS, ALLOWED_PATHS, "block"),
        (ALLOWED_HOSTS, ALLOWED_PATHS, "allow"),
        (NEUTRAL_HOSTS, ALLOWED_PATHS, "allow"),
        ([*NEUTRAL_HOSTS, *ALLOWED_HOSTS], BLOCKED_PATHS, "block"),
    )
    rows = [(h, list(paths), v) for hosts, paths, v in groups for h in hosts]
    base = spark.createDataFrame(rows, "_host string, _paths array<string>, verdict string")
    prefix = F.explode(F.array(*[F.lit(p) for p in SEED_PREFIXES]))
    named = base.select("verdict", "_host", "_paths", prefix.alias("_prefix"))
    path = F.explode("_paths").alias("path")
    return named.select(F.concat("_prefix", "_host").alias("host"), path, "verdict")


def fit_urls(labelled: DataFrame, params: UrlModelParams = UrlModelParams()):
    """Fit on distinct (host, path, verdict) rows; returns a model or the only verdict.

    At most ``params.sample`` urls of each verdict are used, by order of a hash.
    """
    rows = (
        labelled.where(F.col("verdict").isin("allow", "block"))
        .select("host", "path", "verdict")
        .distinct()
    )
    order = [F.xxhash64("host", "path"), F.col("host"), F.col("path")]
    some = [
        rows.where(F.col("verdict") == v).orderBy(*order).limit(params.sample)
        for v in ("allow", "block")
    ]
    sample = share_of(some[0].unionByName(some[1]), "url-labels")
    found = sorted(r["verdict"] for r in sample.select("verdict").distinct().collect())
    if len(found) < 2:
        return found[0] if found else "allow"
    train = _features(sample, params).withColumn(
        "_label", (F.col("verdict") == "block").cast("double")
    )
    learner = LogisticRegression(
        featuresCol="_features", labelCol="_label", maxIter=params.max_iter, regParam=params.reg
    )
    return learner.fit(train.select("_features", "_label"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    labelled: DataFrame | None = None,
    params: UrlModelParams = UrlModelParams(),
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict and the model's ``score`` for block.

    ``labelled`` (host, path, verdict) trains the model; by default a small built-in
    table does.  Other columns of ``pages`` are not read.
    """
    host, path = host_and_path(F.col("_url"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    rows = (
        pages.select(F.col(key).alias("page_id"), F.col(url).alias("_url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumns({"rule": rule, "_ruled": verdict})
    )
    model = fit_urls(labelled if labelled is not None else seed_urls(pages.sparkSession), params)
    if isinstance(model, str):
        scored = rows.withColumn("score", F.lit(1.0 if model == "block" else 0.0))
    else:
        model.setProbabilityCol("_probability")
        scored = model.transform(_features(rows, params)).withColumn(
            "score", vector_to_array("_probability")[1]
        )
    guess = F.when(F.col("score") >= params.block_from, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("_ruled", guess).alias("verdict"), "score"
    )
