"""URL filter: host and path rules first, else logistic regression on hashed character n-grams of host and path.

The model is fitted by Spark ML on a small labelled URL table; its weights are a constant of the scoring expression, so all
URLs are judged in one scan without Python.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import let

RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
BUCKETS = 2048
LENGTHS = (3, 4)

BLOCKED_URLS = (
    "https://ads.shopnow.test/banner/1", "http://ads-track.media.test/en/20?utm_source=feed", "https://adserver.site.test/click",
    "http://track.pixel.test/ads/view", "https://www.ads-network.test/banner.html", "http://tracking.click.test/redirect",
    "https://m.ad-click.test/pop", "http://popads.traffic.test/land", "https://casino-bonus.test/play", "http://www.bestcasino.test/slots",
    "https://online-poker.test/en/win", "http://free-xxx.test/videos", "https://porn-tube.test/watch", "http://adult-cams.test/live",
    "https://cheap-pills.test/viagra", "http://pharma-discount.test/buy", "https://spam-links.test/out/1", "http://seo-spam.test/links",
    "https://warez-crack.test/keygen", "http://torrent-download.test/crack", "https://banner-ads.example.test/fr/7", "http://click-track.test/de/3",
    "https://sponsor-ads.test/en/11", "http://affiliate-track.test/ref", "https://doorway.popunder.test/ads", "http://m.ads-track.test/es/4",
)
ALLOWED_URLS = (
    "https://www.citynews.test/en/2021/story.html", "http://blog.writer.test/posts/12", "https://docs.project.test/guide/intro",
    "http://www.university.test/research/paper", "https://museum.test/fr/visite", "http://library.test/de/buch/8", "https://m.weather.test/es/hoy",
    "http://recipes.kitchen.test/bread", "https://www.hospital.test/patients", "http://forum.gardening.test/topic/9", "https://school.test/en/lessons/4",
    "http://archive.history.test/1900", "https://www.science.test/articles/physics", "http://travel.guide.test/italy", "https://blog.theory.test/en/214#top",
    "http://www.thought.test/en/773?utm_source=feed", "https://m.nation.test/en/742/", "http://other.thing.test/fr/825?page=2&ref=x",
    "https://music.theater.test/concert", "http://www.health.test/advice", "https://static.data.test/en/31.html", "http://books.author.test/novel",
    "https://weather.three.test/en/88", "http://www.thread.test/de/19", "https://m.northern.test/en/12.html", "http://thesis.there.test/fr/5",
    "https://www.mother.test/es/61/", "http://blog.another.test/en/7?page=2&ref=x", "https://therapy.nother.test/en/900", "http://m.thing.test/de/31",
    "https://health.ether.test/en/41#top", "http://www.hither.test/en/2/", "https://blog.threshing.test/fr/70", "http://thin.author.test/en/63.html",
    "https://www.government.test/services", "http://sport.league.test/results", "https://photo.gallery.test/album/3", "http://www.handle.test/en/5",
)


def host_and_path(url: Column) -> Column:
    """Struct of ``host`` and ``path``: both empty if the URL is null or has no ``://``."""
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), capitals, small)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.struct(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, null if none fits."""
    tests = []
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        tests.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*tests)


def gram_buckets(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the character n-grams of host and path, with marks at their ends and for their part."""
    def grams(text: Column, part: str, n: int) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))),
            lambda i: F.pmod(F.xxhash64(F.lit(part), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    def of(value: Column, part: str, n: int) -> Column:
        return let(F.concat(F.lit("^"), value, F.lit("$")), lambda t: grams(t, part, n))

    parts = [of(value, part, n) for part, value in (("h", host), ("p", path)) for n in LENGTHS]
    return F.array_distinct(F.concat(*parts))


def fit(labelled: DataFrame, penalty: float = 0.01) -> list[float]:
    """Weights per bucket and the intercept last, from rows ``(url, blocked)``; ``labelled`` is a small table by contract."""
    rows = labelled.select(host_and_path(F.col("url")).alias("u"), F.col("blocked").cast("double").alias("label"))
    rows = rows.select("label", gram_buckets(F.col("u.host"), F.col("u.path")).alias("g"))
    flags = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.array_contains(F.col("g"), b).cast("double"))
    vectors = rows.select("label", array_to_vector(flags).alias("features"))
    model = LogisticRegression(regParam=penalty, maxIter=60, standardization=False).fit(vectors)
    return [*model.coefficients.toArray().tolist(), float(model.intercept)]


def labelled_table(spark: SparkSession, blocked=BLOCKED_URLS, allowed=ALLOWED_URLS) -> DataFrame:
    return spark.createDataFrame([(u, 1) for u in blocked] + [(u, 0) for u in allowed], "url string, blocked int")


def blocked_probability(host: Column, path: Column, weights: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    return let(table, lambda w: 1 / (1 + F.exp(-F.aggregate(
        gram_buckets(host, path), F.get(w, F.lit(BUCKETS)), lambda a, b: a + F.get(w, b)))))


def judge(pages: DataFrame, weights: list[float], rules=RULES, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and ``p_blocked`` of the model.

    A null URL or one without ``://`` has empty host and path and is judged by the model like others. Repeated rows are
    judged each on its own; extra columns are not looked at.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), host_and_path(F.col(url)).alias("u"))
    rows = rows.select("page_id", F.col("u.host").alias("host"), F.col("u.path").alias("path"))
    rows = rows.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("p_blocked", blocked_probability(F.col("host"), F.col("path"), weights))
    own = F.when(F.col("p_blocked") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "p_blocked")
