"""Mixing sources to target weights by Poisson replication.

Each document gets as many copies as a Poisson variable with its source's repetition rate has by inversion of a uniform
number hashed from seed and id. A draw needs nothing but its own row, so lost tasks repeat it exactly. The copies go to
random partitions and are put in random order there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import fresh, store

LARGEST_STEP = 64.0
"""A rate above this is drawn as a sum of Poisson variables of at most this mean, which has the same distribution."""


def unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, total: float = 1.0,
          source: str = "source", size: str = "n_chars") -> DataFrame:
    """Per source: documents, size, and the mean repetition rate at which its expected size is its share of the target.

    ``weights`` names the shares of the sources (others get none); without it a source's share goes with its size to the
    power ``alpha``. The target size is ``total`` times that of all documents. A null size counts as zero, a null source
    is a source of its own. A source of size zero is taken once.
    """
    sums = docs.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.col(size), F.lit(0))).cast("double").alias("size"))
    if weights is None:  # no source is left out
        sums = sums.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(float(alpha)))).otherwise(F.lit(0.0)))
    else:
        schema = T.StructType([T.StructField("_s", T.StringType()), T.StructField("weight", T.DoubleType())])
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], schema)
        sums = sums.join(given, sums["source"].eqNullSafe(given["_s"]), "left").drop("_s").fillna(0.0, ["weight"])
    sums = store(sums, "source-sizes")
    whole = sums.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted = F.col("weight") * F.lit((whole["size"] or 0.0) * total / (whole["weight"] or 1.0))
    rate = F.when(F.col("size") > 0, wanted / F.col("size")).otherwise(F.lit(1.0))
    steps = F.greatest(F.ceil(rate / F.lit(LARGEST_STEP)), F.lit(1)).cast("int")
    return sums.withColumns({"rate": rate, "steps": steps}).withColumn("cdf", cumulative(F.col("rate") / F.col("steps")))


def cumulative(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... events, as far as they differ from one; ``mean`` is at most ``LARGEST_STEP``."""
    none = F.exp(-mean)
    start = F.struct(none.alias("term"), none.alias("total"), F.array(none).alias("all"))

    def more(a: Column, k: Column) -> Column:
        term = a["term"] * mean / k
        total = a["total"] + term
        return F.when(a["total"] >= 1.0 - 2.0 ** -52, a).otherwise(F.struct(
            term.alias("term"), total.alias("total"), F.concat(a["all"], F.array(total)).alias("all")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(300)), start, more)["all"]


def copies(cdf: Column, steps: Column, seed: int, key: Column) -> Column:
    """The Poisson number of one row: per step, how many cumulative probabilities are at or below its uniform number."""
    def one(step: Column) -> Column:
        return F.size(F.filter(cdf, lambda p: p <= unit(F.lit(str(seed)), key, step.cast("string"))))

    return F.aggregate(F.sequence(F.lit(1), steps), F.lit(0), lambda a, step: a + one(step))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, total: float = 1.0, seed: int = 42,
        id_column: str = "doc_id", source: str = "source", size: str = "n_chars") -> DataFrame:
    """``docs`` replicated to the target mix, in random order, with ``replica`` (1, 2, ...) and ``shuffle_key``.

    Rows with the same id get the same count; null ids count as the text ``null``. Extra columns stay as they are;
    ``replica`` and ``shuffle_key`` get leading underscores if a column has such a name. The table of rates has one row a
    source; Spark broadcasts it if its files are small and otherwise joins by shuffle, splitting hot sources.
    """
    replica, order, n, key = fresh(docs, "replica", "shuffle_key", "_copies", "_id")
    table = rates(docs, weights, alpha, total, source, size).select(
        F.col("source").alias("_rate_source"), F.col("steps").alias("_rate_steps"), F.col("cdf").alias("_rate_cdf"))
    table = store(table, "source-rates")
    name = F.coalesce(docs[id_column].cast("string"), F.lit("null"))
    rows = docs.join(table, docs[source].eqNullSafe(table["_rate_source"])).select(
        *[docs[c] for c in docs.columns], name.alias(key),
        copies(table["_rate_cdf"], table["_rate_steps"], seed, name).alias(n))
    rows = rows.where(F.col(n) > 0).withColumn(replica, F.explode(F.sequence(F.lit(1), F.col(n))))
    rows = rows.withColumn(order, unit(F.lit(f"{seed} order"), F.col(key), F.col(replica).cast("string")))
    return rows.select(*docs.columns, replica, order).repartition(order).sortWithinPartitions(order)
