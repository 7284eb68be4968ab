"""Label transfer between two flow tables: exact, by key and time text, then nearest in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import BENIGN
from tidewatch.functions.columns import endpoint_key
from tidewatch.functions.grouped import range_parts
from tidewatch.session import durable, stored
from tidewatch.sources.contract import twelve_hour_seconds


def first_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
                label: str = "label") -> DataFrame:
    """One-to-one part of an equi join.

    Keeping the first match per left row and then the first per right row leaves,
    for each key, the first left with the first right row. So both sides are
    reduced to their first row before the join and no key ever multiplies.
    """
    a = left.groupBy(*keys).agg(F.min(left_id).alias(left_id))
    b = right.groupBy(*keys).agg(F.min(right_id).alias(right_id), F.min_by(label, right_id).alias(label))
    return a.join(b, keys).select(left_id, right_id, label)


def without(rows: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return rows.join(matched.select(key), key, "left_anti")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, time: str, tolerance: float,
                    left_id: str, right_id: str, carry: list[str] = ()) -> DataFrame:
    """As-of join: the right row of the same key nearest in time, at most ``tolerance`` away.

    Equal distances go to the earlier side; among right rows of one time the earlier side takes the largest id, the later side the
    smallest. Both sides are dealt out by ranges of (key, time, side, id) with equal numbers of rows, so a key with a third of all rows
    in one hour is spread like any other. A key that goes on over several ranges gets its last right row from the ranges before and its
    first one from the ranges after.
    """
    def side(rows: DataFrame, number: int, ident: str, row: Column) -> DataFrame:
        return rows.select(F.col(key), F.col(time).cast("double").alias("_t"), F.lit(number).alias("_side"), F.col(ident).alias("_id"), row.alias("_r"))

    pack = F.struct(F.col(time).alias("t"), F.col(right_id).alias("id"), *carry)
    right = side(right, 0, right_id, pack)
    both = right.unionByName(side(left, 1, left_id, F.lit(None).cast(right.schema["_r"].dataType)))
    rows = range_parts(both, [key], ["_t", "_side", "_id"], "as-of-ranges")
    cell = W.partitionBy(key, "_part")
    up = cell.orderBy("_t", "_side", "_id").rowsBetween(W.unboundedPreceding, -1)
    down = cell.orderBy(F.desc("_t"), F.desc("_side"), F.desc("_id")).rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(F.col("_side") == 0, F.struct("_t", "_id", "_r"))
    ends = rows.groupBy(key, "_part").agg(F.max(mark).alias("_last"), F.min(mark).alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = W.partitionBy(key).orderBy("_part")
    ends = ends.select(
        key, "_part", F.last("_last._r", ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"),
        F.first("_first._r", ignorenulls=True).over(parts.rowsBetween(1, W.unboundedFollowing)).alias("_coming"))
    ends = stored(ends.where("_carried IS NOT NULL OR _coming IS NOT NULL"), "as-of-edges")       # only keys of several ranges
    seen = rows.withColumns({
        "_back": F.last("_r", ignorenulls=True).over(up), "_fore": F.last("_r", ignorenulls=True).over(down)}).where("_side = 1")
    seen = seen.join(ends, [key, "_part"], "left").withColumns({"_back": F.coalesce("_back", "_carried"), "_fore": F.coalesce("_fore", "_coming")})
    gap_b = F.col("_t") - F.col("_back.t").cast("double")
    gap_f = F.col("_fore.t").cast("double") - F.col("_t")
    ok_b = F.coalesce(gap_b <= tolerance, F.lit(False))
    ok_f = F.coalesce(gap_f <= tolerance, F.lit(False))
    pick = F.when(ok_b & (~ok_f | (gap_b <= gap_f)), F.col("_back")).when(ok_f, F.col("_fore"))
    return seen.select(
        F.col("_id").alias(left_id), F.col(key), F.col("_t").alias(time), pick.alias("_m"),
    ).where("_m is not null").select(
        left_id, key, time, F.col("_m.id").alias(right_id), *[F.col(f"_m.{c}").alias(c) for c in carry])


def first_per_right(matches: DataFrame, left_id: str, right_id: str, time: str, carry: list[str]) -> DataFrame:
    """Keep the earliest left row of each right row; an aggregate, so many-to-one matches combine map-side."""
    best = F.min_by(F.struct(left_id, *carry), F.struct(F.col(time).alias("t"), F.col(left_id).alias("i")))
    return matches.groupBy(right_id).agg(best.alias("_b")).select(
        F.col(f"_b.{left_id}").alias(left_id), right_id, *[F.col(f"_b.{c}").alias(c) for c in carry])


def transfer_labels(flows: DataFrame, labelled: DataFrame, exact: list[str], loose: list[str], key: str, time: str,
                    tolerance: float, left_id: str, right_id: str, label: str = "label") -> DataFrame:
    """(left_id, right_id, label, stage) after the three stages; each row of either side is used once."""
    # Pairs of each stage are read by the later stages and the result: written once, not recomputed.
    one = durable(first_pairs(flows, labelled, exact, left_id, right_id, label))
    left, right = without(flows, one, left_id), without(labelled, one, right_id)
    two = durable(first_pairs(left, right, loose, left_id, right_id, label))
    left, right = without(left, two, left_id), without(right, two, right_id)
    near = nearest_in_time(left, right, key, time, tolerance, left_id, right_id, [label])
    three = first_per_right(near, left_id, right_id, time, [label])
    parts = [p.select(left_id, right_id, label, F.lit(i + 1).alias("stage")) for i, p in enumerate((one, two, three))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def attach_labels(flows: DataFrame, matches: DataFrame, left_id: str, label: str = "label") -> DataFrame:
    """Left join on the unique row id; a flow without a match is benign."""
    joined = flows.join(matches.select(left_id, label), left_id, "left")
    return joined.withColumn(label, F.coalesce(F.col(label), F.lit(BENIGN)))


def coverage(flows: DataFrame, labelled: DataFrame, matches: DataFrame) -> DataFrame:
    """Sizes of both sides, matched rows and the matched share of each side in percent."""
    names = ("flow_rows", "label_rows", "matched")
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in zip((flows, labelled, matches), names)]
    stacked = counts[0].unionByName(counts[1], allowMissingColumns=True).unionByName(counts[2], allowMissingColumns=True)
    one = stacked.agg(*[F.max(n).alias(n) for n in names])
    return one.withColumns({
        "pct_labels_matched": F.col("matched") * 100.0 / F.greatest("label_rows", F.lit(1)),
        "pct_flows_matched": F.col("matched") * 100.0 / F.greatest("flow_rows", F.lit(1))})


def label_histogram(matches: DataFrame, label: str = "label") -> DataFrame:
    return matches.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


HELPERS = ("unified_row_id", "canon_key", "epoch_sec", "ts_str", "t_sec")


def without_helpers(df: DataFrame, helpers=HELPERS) -> DataFrame:
    return df.drop(*helpers)


def match_side(rows: DataFrame, keep: list, flow_id: str, src_ip: str, src_port: str, dst_ip: str, dst_port: str, protocol: str,
               timestamp: str, fwd_pkts: str) -> DataFrame:
    """What the three stages compare, under one set of names, from the columns given: ids, addresses, direction-free key, time text
    and its seconds, and forward packets as a whole number. ``keep`` goes along."""
    c = lambda name: F.col(f"`{name}`")
    text = F.trim(c(timestamp))
    number = lambda name: c(name).try_cast("double").cast("bigint")
    return rows.select(
        *keep, c(flow_id).alias("flow_id"), c(src_ip).alias("src_ip"), c(dst_ip).alias("dst_ip"),
        endpoint_key(c(src_ip), number(src_port), c(dst_ip), number(dst_port), number(protocol)).alias("canon_key"),
        text.alias("ts_str"), twelve_hour_seconds(text).alias("t_sec"), number(fwd_pkts).alias("fwd_pkts"))
