"""Session settings and durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", name: str = "tidewatch", **extra: str) -> SparkSession:
    """Session for tests and the local benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = dict(SETTINGS)
    settings.update({
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.extraJavaOptions": "-Djava.net.preferIPv4Stack=true",
    })
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only where the session does not set it, as in tests, intermediate tables go below the warehouse folder.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def durable(df: DataFrame) -> DataFrame:
    """Write an intermediate table once to the shared folder and continue from the files."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``durable``, as Parquet: Spark knows the size of what it reads, so a join broadcasts it only if it is small."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
