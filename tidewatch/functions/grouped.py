"""Grouped helpers that keep hot groups out of a single task.

Every helper first reduces rows with a partial aggregate and only then runs a
window, and that window is cut into cells whose size does not follow the size
of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import stored


def salted_join(rows: DataFrame, small: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """Equi join where one key may hold a large part of ``rows``; a key is cut into as many pieces as a shuffle has partitions."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on + ["_salt"], how).drop("_salt")


def value_counts(rows: DataFrame, keys: list[str], values: list[str], count: str = "n") -> DataFrame:
    return rows.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias(count))


def entropy_aggregate(count: Column) -> Column:
    """Shannon entropy in bits of a group whose rows carry value counts."""
    c = count.cast("double")
    total = F.sum(c)
    return F.log2(total) - F.sum(c * F.log2(c)) / total


def islands(change: Column, window) -> Column:
    """Running island number; ``change`` is true on the first row of an island."""
    return F.sum(F.when(change, 1).otherwise(0)).over(window)


def range_parts(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``rows`` with ``_part``: consecutive ranges of (group, order) with about equal numbers of rows, stored.

    Spark picks the limits from a sample of the rows, so a group with a third of them, or with most of its values in a narrow
    stretch, is spread over a third of the parts. Rows that are equal in all of ``order`` stay together.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), name)


def running_totals(rows: DataFrame, group: list[str], order: str, sums: list[str], descending: bool = True) -> DataFrame:
    """Inclusive running sums in ``order`` within ``group``, in two levels.

    Level one sums whole parts of ``range_parts``, level two runs inside a part, so no task sees a whole group. ``rows`` should hold
    one row per distinct ``order`` value (reduce first). Adds ``cum_<name>`` and ``all_<name>``.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    rows = range_parts(rows, group, [by], "running-totals")
    level = rows.groupBy(*group, "_part").agg(*[F.sum(s).alias(f"_b_{s}") for s in sums])
    whole, across = W.partitionBy(*group), W.partitionBy(*group).orderBy("_part")
    level = level.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"),
        *[(F.sum(f"_b_{s}").over(across) - F.col(f"_b_{s}")).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    inside = W.partitionBy(*group, "_part").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return rows.join(level, same).select(
        *[c for c in rows.columns if c != "_part"],
        *[(F.col(f"_before_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def _cell(v: Column) -> Column:
    """Non-decreasing map of a double to at most ~131,000 cells."""
    return (F.signum(v) * F.floor(F.log2(F.lit(1.0) + F.abs(v)) * 64)).cast("long")


def exact_quantiles(rows: DataFrame, group: list[str], value: str, probs: list[float],
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles, one row per (group, p).

    Exact at any size: rows are counted per coarse cell before any shuffle, the wanted
    ranks are located in their cells, only the values of those cells are counted, and
    one of 4,096 slices of a cell is put in order. ``weight`` repeats a value that many times.
    """
    n = F.col(weight).cast("long") if weight else F.lit(1)
    one = group if group else ["_one"]
    values = (
        rows.withColumn("_one", F.lit(1)).select(*one, F.col(value).cast("double").alias("_v"), n.alias("_w"))
        .where(F.col("_v").isNotNull() & (F.col("_w") > 0)).withColumn("_c", _cell(F.col("_v"))))
    everything = W.partitionBy(*one)
    cells = (
        values.groupBy(*one, "_c")
        .agg(F.sum("_w").alias("_cn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_before", F.sum("_cn").over(everything.orderBy("_c")) - F.col("_cn"))
        .withColumn("_total", F.sum("_cn").over(everything))
    )
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    picks = (
        cells.withColumn("p", F.explode(wanted))
        .withColumn("_pos", F.col("p") * (F.col("_total") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(
            F.floor("_pos").cast("long"), F.ceil("_pos").cast("long")))))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_cn")))
        .select(*one, "_c", "_lo", "_hi", "p", "_pos", "_rank", (F.col("_rank") - F.col("_before")).alias("_r1"))
    )
    width = F.col("_hi") - F.col("_lo")
    piece = F.when(width > 0, F.least(
        F.floor((F.col("_v") - F.col("_lo")) / F.when(width > 0, width) * 4096), F.lit(4095))).otherwise(F.lit(0)).cast("int")
    picks = stored(picks, "quantile-cells")          # at most two rows per group and p
    counts = (
        values.join(picks.select(*one, "_c").distinct(), one + ["_c"], "left_semi")
        .groupBy(*one, "_c", "_v").agg(F.sum("_w").alias("_n")))
    inside = counts.join(picks, one + ["_c"]).withColumn("_s", piece)
    key = one + ["p", "_rank"]
    slices = (
        inside.groupBy(*key, "_s").agg(F.sum("_n").alias("_sn"), F.first("_r1").alias("_r1"))
        .withColumn("_sb", F.sum("_sn").over(W.partitionBy(*key).orderBy("_s")) - F.col("_sn"))
        .where((F.col("_r1") >= F.col("_sb")) & (F.col("_r1") < F.col("_sb") + F.col("_sn")))
        .select(*key, "_s", (F.col("_r1") - F.col("_sb")).alias("_r2"))
    )
    ordered = W.partitionBy(*key, "_s").orderBy("_v")
    found = (
        inside.join(slices, key + ["_s"])
        .withColumn("_upto", F.sum("_n").over(ordered))
        .where((F.col("_r2") < F.col("_upto")) & (F.col("_r2") >= F.col("_upto") - F.col("_n")))
    )
    ends = found.groupBy(*one, "p").agg(
        F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"), F.max("_pos").alias("_pos"))
    frac = F.col("_pos") - F.floor("_pos")
    return ends.select(*group, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("q"))


def quantiles(rows: DataFrame, group: list[str], value: str, probs: list[float],
              weight: str | None = None, method: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """``method='approx'`` trades exactness for one aggregate (no weights there)."""
    if method == "exact":
        return exact_quantiles(rows, group, value, probs, weight)
    if weight:
        raise ValueError("weights need method='exact'")
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    got = rows.groupBy(*group).agg(F.percentile_approx(F.col(value).cast("double"), [float(p) for p in probs], accuracy).alias("_q"))
    return got.select(*group, F.explode(F.arrays_zip(wanted.alias("p"), F.col("_q").alias("q"))).alias("_z")).select(*group, "_z.p", "_z.q")


def hash_rank(rows: DataFrame, group: list[str], draw: Column, ties: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """0-based position of each row in its group by a uniform draw, and ``<name>_of`` = rows in the group.

    Positions are counted per slice of the draw and shifted by the slices before it, so a group is never ordered in one task.
    There are 1,024 slices, or four for each shuffle partition if that is more.
    """
    buckets = buckets or max(1024, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_d", draw).withColumn("_slice", F.floor(F.col("_d") * buckets).cast("int"))
    counts = rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select(
        *group, "_slice",
        (F.sum("_n").over(W.partitionBy(*group).orderBy("_slice")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(*group)).alias(f"{name}_of"))
    inside = F.row_number().over(W.partitionBy(*group, "_slice").orderBy("_d", *ties)) - 1
    joined = rows.withColumn("_in", inside).join(shift, [*group, "_slice"])
    return joined.withColumn(name, F.col("_before") + F.col("_in")).drop("_d", "_slice", "_in", "_before")
