"""Live forecasts: closed windows -> anchors -> forecast, alert and rules, once each, with session counters and the latest rows.

Two stateful operators follow each other (windows, then anchors per session). A forecast depends only on the anchor's state and
family, so the fitted state table becomes a small static table with one row for each pair, horizon and phases included,
and the stream joins it: no third stateful operator.

A finished stream is closed by a marker: a row of a second source that carries a time and no flow. It moves the watermark, the same
query closes what is open, and the checkpoint sees to it that nothing comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.config import BENIGN, STATES, Config
from tidewatch.operators import forecast, rules
from tidewatch.plans.serve import ANCHOR_FIELDS, with_family, with_horizon
from tidewatch.session import stored
from tidewatch.streaming.windows import GRACE_SECONDS, MARKER, SIZE_STEP, anchor_columns, closed_windows, stream_anchors

KEPT = 200
COUNTERS = ("flows_in", "windows", "forecasts", "alerts")


def outlook_table(spark: SparkSession, table: DataFrame, cfg: Config = Config(), hint: str | None = None) -> DataFrame:
    """Horizon, phases and alert for each state, family and whether it was inferred: 5 states x few families x 2 rows, stored."""
    families = dict.fromkeys([BENIGN, *forecast.FAMILY_WEIGHTS, *([hint] if hint else [])])
    rows = spark.createDataFrame([(s, s, f, i) for s in STATES for f in families for i in (False, True)],
                                 "now string, progression_state string, family string, family_inferred boolean")
    return stored(with_horizon(rows, table, ["now", "family", "family_inferred"], cfg), "outlook")


def live_forecasts(anchors: DataFrame, outlook: DataFrame, scaler: DataFrame | None, hint: str | None = None,
                   rule_set: rules.RuleSet | None = None) -> DataFrame:
    """Anchors (stream or batch) -> one row each with family, horizon, alert and matched rules."""
    rows = rules.rule_features(with_family(anchor_columns(anchors).drop("features", "x", "dt"), scaler, hint))
    rows = rows.select("session_id", "progression_state", *ANCHOR_FIELDS).withColumnRenamed("progression_state", "now")
    joined = rows.join(F.broadcast(outlook), ["now", "family", "family_inferred"], "left")
    return (rule_set or rules.RuleSet()).evaluate(joined)


def with_markers(flows: DataFrame, markers: DataFrame) -> DataFrame:
    """Flows and the markers' times in one stream; ``closed_windows`` takes markers for the watermark only."""
    rows = markers.select(F.col("until").alias("flow_start_epoch"), F.lit(True).alias(MARKER))
    return flows.withColumn(MARKER, F.lit(False)).unionByName(rows, allowMissingColumns=True)


def stream_markers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("until double").json(folder)


def mark_end(spark: SparkSession, folder: str, until: float, grace_seconds: float = GRACE_SECONDS) -> None:
    """Say that no flow before ``until`` will come; the next run of the query closes all windows that end by then."""
    spark.createDataFrame([(float(until) + grace_seconds,)], "until double").coalesce(1).write.mode("append").json(folder)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions below ``path``."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _drop_versions(spark: SparkSession, path: str, before: int) -> None:
    jvm = spark._jvm
    for v in _versions(spark, path):
        if v < before:
            old = jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def fold(spark: SparkSession, path: str, batch_id: int, batch: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge a micro-batch into a small running table.

    Version n is made of the last version before n and batch n, so a batch that is replayed gives the same version again. The
    version before stays for that; older ones go.
    """
    before = [v for v in _versions(spark, path) if v < batch_id]
    rows = batch
    if before:
        rows = spark.read.schema(batch.schema).parquet(f"{path}/version={before[-1]}").unionByName(batch)
    merge(rows).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
    if before:
        _drop_versions(spark, path, before[-1])


def newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last version of a running table, without rows if there is none yet."""
    found = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], schema)


def latest_rows(rows: DataFrame, keep: int = KEPT) -> DataFrame:
    """The last ``keep`` windows of each session."""
    order = W.partitionBy("session_id").orderBy(F.desc("window_index"))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def forecast_counts(rows: DataFrame) -> DataFrame:
    """Windows scored, forecasts and alerts of each session."""
    n = F.count(F.lit(1))
    return rows.groupBy("session_id").agg(
        F.lit(0).cast("long").alias("flows_in"), n.alias("windows"), n.alias("forecasts"), F.sum(F.col("alert").cast("long")).alias("alerts"))


def flow_counts(flows: DataFrame) -> DataFrame:
    """Flows of each session."""
    zero = F.lit(0).cast("long")
    name = F.coalesce(F.col("session_id"), F.lit("default")).alias("session_id") if "session_id" in flows.columns else F.lit("default").alias("session_id")
    return flows.groupBy(name).agg(F.count(F.lit(1)).alias("flows_in"), zero.alias("windows"), zero.alias("forecasts"), zero.alias("alerts"))


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


COUNTER_SCHEMA = "session_id string, " + ", ".join(f"{c} long" for c in COUNTERS)


class ForecastSink:
    """``foreachBatch`` target: each forecast once, the last ``keep`` of each session, and its counters.

    Rows of a micro-batch go to a folder of its number, so a batch that is replayed overwrites itself.
    """

    def __init__(self, path: str, keep: int = KEPT):
        self.path, self.keep = path.rstrip("/"), keep

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{self.path}/forecasts/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)           # the stateful plan runs once; what follows reads the files
        rows = spark.read.schema(batch.schema).parquet(folder)
        fold(spark, f"{self.path}/latest", batch_id, rows, lambda r: latest_rows(r, self.keep))
        fold(spark, f"{self.path}/forecast-counts", batch_id, forecast_counts(rows), _added)

    def forecasts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/forecasts").drop("batch")

    def latest(self, spark: SparkSession) -> DataFrame:
        found = _versions(spark, f"{self.path}/latest")
        return spark.read.parquet(f"{self.path}/latest/version={found[-1]}")

    def counters(self, spark: SparkSession) -> DataFrame:
        """``flows_in``, ``windows``, ``forecasts`` and ``alerts`` of each session, from both queries' last batches."""
        parts = [newest(spark, f"{self.path}/{name}", COUNTER_SCHEMA) for name in ("forecast-counts", "flow-counts")]
        return _added(parts[0].unionByName(parts[1]))


class FlowCountSink:
    """``foreachBatch`` target for the flows themselves: how many came in per session."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        fold(batch.sparkSession, f"{self.path}/flow-counts", batch_id, flow_counts(batch), _added)


def forecast_stream(flows: DataFrame, outlook: DataFrame, scaler: DataFrame | None, start_epoch: float, cfg: Config = Config(), hint: str | None = None,
                    rule_set: rules.RuleSet | None = None, grace_seconds: float = GRACE_SECONDS, size_step: int | None = SIZE_STEP) -> DataFrame:
    """Flow stream (with markers or not) -> forecast stream."""
    windows = closed_windows(flows, cfg.window, start_epoch, grace_seconds, size_step)
    return live_forecasts(stream_anchors(windows, cfg.window, cfg.sequence), outlook, scaler, hint, rule_set)


def run_sink(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``sink``."""
    writer = rows.writeStream.foreachBatch(lambda batch, batch_id: sink(batch, batch_id)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
