"""Readers and writers. Partitioned Parquet is the storage form of every table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.contract import trim_names
from tidewatch.sources.rows import numbered

# Text columns of the packet table.
PACKET_FIELDS = (
    "frame.time_epoch", "frame.len", "ip.src", "ip.dst", "ip.proto", "ip.ttl",
    "ip.flags.mf", "ip.flags.df", "ip.frag_offset",
    "tcp.srcport", "tcp.dstport", "tcp.window_size_value", "tcp.len", "tcp.hdr_len", "tcp.seq", "tcp.flags",
    "tcp.analysis.retransmission", "udp.srcport", "udp.dstport", "udp.length",
)
PACKET_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in PACKET_FIELDS])

FLOW_RECORD_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("flow_start_epoch", T.DoubleType()),
    T.StructField("Source IP", T.StringType()), T.StructField("Destination IP", T.StringType()),
    T.StructField("Source Port", T.IntegerType()), T.StructField("Destination Port", T.IntegerType()),
    T.StructField("Protocol", T.IntegerType()),
    T.StructField("Flow Duration", T.DoubleType()), T.StructField("Flow IAT Mean", T.DoubleType()),
    T.StructField("Total Fwd Packets", T.LongType()), T.StructField("Total Backward Packets", T.LongType()),
    T.StructField("Total Length of Fwd Packets", T.DoubleType()),
    T.StructField("Total Length of Bwd Packets", T.DoubleType()),
    *[T.StructField(f"flag_true_{f}", T.IntegerType()) for f in ("fin", "syn", "rst", "psh", "ack", "urg")],
])


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            out.append(p)
    return out


def read_flow_csv(spark: SparkSession, paths: list[str], fallback: list[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """Flow CSVs as text columns (typed later by the cleaning step), headers trimmed.

    Missing files are skipped; when none is there the fallback list is tried.
    Files may carry different columns: they are united by name.
    """
    found = _existing(spark, list(paths)) or _existing(spark, list(fallback))
    if not found:
        raise FileNotFoundError(f"no flow files among {list(paths) + list(fallback)}")
    # One read per distinct header: a multi-file read would take one file's header for all.
    layouts: dict[tuple, list[str]] = {}
    for p in found:
        head = tuple(spark.read.csv(p, header=True, inferSchema=False).columns) if schema is None else ()
        layouts.setdefault(head, []).append(p)
    out = None
    for head, group in layouts.items():
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.schema(
            T.StructType([T.StructField(c, T.StringType()) for c in head]))
        part = trim_names(reader.csv(group)).withColumn("source_path", F.input_file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_packet_csv(spark: SparkSession, paths: list[str], row_id: str = "pkt_id") -> DataFrame:
    """Packet table; every field stays text and empty text stays empty. ``row_id`` numbers the packets by file and line."""
    reader = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "")
    return numbered(reader.schema(PACKET_SCHEMA).csv(paths), row_id).fillna("")


def read_label_csv(spark: SparkSession, paths: list[str], row_id: str = "label_row_id") -> DataFrame:
    """Published flow table with labels: text columns under trimmed names, rows numbered by file and line, labels trimmed."""
    head = spark.read.csv(paths[0], header=True, inferSchema=False).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    rows = trim_names(numbered(spark.read.option("header", True).schema(schema).csv(paths), row_id))
    return rows.withColumn("Label", F.trim("Label"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored table, or ``build()`` written to ``path`` first."""
    if not _existing(spark, [path]):
        write_table(build(), path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition: tuple = ("day",), sort: tuple = (), mode: str = "overwrite") -> None:
    """Parquet partitioned by day. Rows are sorted inside the tasks that already hold them;
    a shuffle by day would put a whole day in one task."""
    keys = [c for c in partition if c in df.columns]
    if sort:
        df = df.sortWithinPartitions(*keys, *[F.col(f"`{c}`") for c in sort])
    writer = df.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested rows as one JSON object per line."""
    df.write.mode(mode).json(path)


def records(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, NULL fields kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def flow_records(batches: DataFrame, value: str = "value") -> DataFrame:
    """Messages ``{"type": "flows", "records": [...]}`` -> one row per record (batch or stream)."""
    message = T.StructType([
        T.StructField("type", T.StringType()), T.StructField("session_id", T.StringType()),
        T.StructField("records", T.ArrayType(FLOW_RECORD_SCHEMA))])
    parsed = batches.select(F.from_json(F.col(value).cast("string"), message).alias("m")).where("m.type = 'flows'")
    rows = parsed.select(F.col("m.session_id").alias("_session"), F.explode("m.records").alias("r"))
    return rows.select("_session", "r.*").withColumn(
        "session_id", F.coalesce("session_id", "_session")).drop("_session")


def stream_flow_records(spark: SparkSession, directory: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FLOW_RECORD_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(directory)
