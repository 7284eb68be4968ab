"""Host graph per window: edges, node features, top hosts, alignment with windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.columns import is_internal
from tidewatch.functions.grouped import quantiles
from tidewatch.session import durable

HOSTS_PER_WINDOW = 32
# Order of the 14 node features.
NODE_FEATURES = (
    "out_flows", "in_flows", "out_bytes", "in_bytes", "out_packets", "in_packets", "out_syn", "in_syn",
    "out_rst", "in_rst", "distinct_ports", "distinct_peers", "internal", "degree",
)


def port_edges(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Flows reduced to one row per (window, source, destination, port): everything else starts here."""
    have = set(assigned.columns)

    def total(name):
        return F.sum(F.col(name).cast("double")) if name in have else F.lit(0.0)

    return assigned.groupBy(*by, "src_ip", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("flows"), (total("fwd_bytes") + total("bwd_bytes")).alias("bytes"),
        (total("fwd_pkts") + total("bwd_pkts")).alias("packets"),
        total("flag_syn").alias("syn"), total("flag_rst").alias("rst"))


def top_hosts(edges: DataFrame, by: list[str], n: int = HOSTS_PER_WINDOW) -> DataFrame:
    """Hosts touched by most flows (both ends count); equal degrees go to the smaller address."""
    ends = edges.select(*by, "flows", F.explode(F.array("src_ip", "dst_ip")).alias("host"))
    degree = ends.groupBy(*by, "host").agg(F.sum("flows").alias("degree"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("degree"), "host"))
    return degree.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def kept_edges(edges: DataFrame, hosts: DataFrame, by: list[str]) -> DataFrame:
    """Edges whose both ends are among the kept hosts."""
    src = hosts.select(*by, F.col("host").alias("src_ip"))
    dst = hosts.select(*by, F.col("host").alias("dst_ip"))
    return edges.join(src, [*by, "src_ip"], "left_semi").join(dst, [*by, "dst_ip"], "left_semi")


def edge_table(edges: DataFrame, by: list[str]) -> DataFrame:
    flows = F.sum("flows")
    return edges.groupBy(*by, "src_ip", "dst_ip").agg(flows.alias("flows"), F.log1p(flows.cast("double")).alias("weight"))


def node_table(edges: DataFrame, hosts: DataFrame, by: list[str]) -> DataFrame:
    """14 features per kept host; counts are log-compressed, ``internal`` is 0/1."""
    sums = ["flows", "bytes", "packets", "syn", "rst"]
    pairs = edges.groupBy(*by, "src_ip", "dst_ip").agg(*[F.sum(s).alias(s) for s in sums])
    out = pairs.groupBy(*by, F.col("src_ip").alias("host")).agg(
        *[F.sum(s).alias(f"out_{s}") for s in sums], F.count(F.lit(1)).alias("distinct_peers"))
    inn = pairs.groupBy(*by, F.col("dst_ip").alias("host")).agg(*[F.sum(s).alias(f"in_{s}") for s in sums])
    ports = (
        edges.groupBy(*by, F.col("src_ip").alias("host"), "dst_port").agg(F.lit(1).alias("one"))
        .groupBy(*by, "host").agg(F.count(F.lit(1)).alias("distinct_ports")))
    key = [*by, "host"]
    rows = hosts.join(out, key, "left").join(inn, key, "left").join(ports, key, "left")
    cols = []
    for f in NODE_FEATURES:
        if f == "internal":
            cols.append(is_internal(F.col("host")).cast("double").alias(f))
        else:
            cols.append(F.log1p(F.greatest(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(f))
    return rows.select(*key, *cols)


def window_graph(assigned: DataFrame, by: list[str], n: int = HOSTS_PER_WINDOW) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every window."""
    edges = durable(port_edges(assigned, by))      # reduced flows, read by every later step
    hosts = top_hosts(edges, by, n)
    kept = kept_edges(edges, hosts, by)
    return node_table(kept, hosts, by), edge_table(kept, by)


def nest_nodes(nodes: DataFrame, by: list[str]) -> DataFrame:
    """At most 32 nodes per window as one array, largest degree first."""
    node = F.struct((-F.col("degree")).alias("o"), "host", F.array(*NODE_FEATURES).alias("f"))
    return nodes.groupBy(*by).agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def align(windows: DataFrame, nested: DataFrame, by: list[str]) -> DataFrame:
    """Every window with its nodes; a window without flows has an empty array."""
    empty = F.array().cast(nested.schema["nodes"].dataType)
    return windows.select(*by).join(nested, by, "left").withColumn("nodes", F.coalesce("nodes", empty))


def gather_history(anchors: DataFrame, nested: DataFrame, keys: list[str], history: int) -> DataFrame:
    """Graphs of the last ``history`` windows of each anchor, oldest first; missing windows, also those before the first, are empty.

    One frame of ``history`` indices slides over each day, so a window's nodes are read once and never copied per anchor
    before they are gathered.
    """
    by = [*keys, "window_index"]
    rows = anchors.select(*by, F.lit(True).alias("_anchor")).join(nested, by, "full")
    past = W.partitionBy(*keys).orderBy("window_index").rangeBetween(-(history - 1), 0)
    got = F.map_from_entries(F.collect_list(F.when(F.col("nodes").isNotNull(), F.struct("window_index", "nodes"))).over(past))
    empty = F.array().cast(nested.schema["nodes"].dataType)
    steps = F.sequence(F.lit(-(history - 1)), F.lit(0))
    graphs = F.transform(steps, lambda o: F.coalesce(F.col("_got")[F.col("window_index") + o], empty))
    return rows.withColumn("_got", got).where("_anchor").select(*by, graphs.alias("graphs"))


def node_scaler(nodes: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """Median and interquartile range of each node feature over real train windows."""
    train = windows.where(F.col("split") == "train")
    if "is_synthetic" in windows.columns:
        train = train.where(F.col("is_synthetic") == 0)
    rows = nodes.join(train.select(*by), by, "left_semi")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in NODE_FEATURES])).alias("x")).select("x.*")
    q = quantiles(long, ["feature"], "v", [0.25, 0.5, 0.75])
    wide = q.groupBy("feature").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    width = F.col("q3") - F.col("q1")
    return wide.select("feature", "median", F.when(width == 0, 1.0).otherwise(width).alias("iqr"))
