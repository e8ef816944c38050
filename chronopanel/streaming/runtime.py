"""Running streaming queries to completion over the files that exist now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.session import scratch_path


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet", **options) -> DataFrame:
    """Event-time stream over parquet files; the schema comes from the files' footer, not from data.

    Watermarks need an instant, so naive event times are read in the session time zone.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, *, checkpoint: str | None = None, path: str | None = None, mode: str = "append") -> DataFrame:
    """Write everything available to a parquet table, exactly once, and read it back.

    Output and checkpoint live in the shared folder; passing the same pair again resumes the query.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_parts(rows: DataFrame, parts: list[Column], build: Callable[[DataFrame], DataFrame], name: str, *, flush: bool = False) -> DataFrame:
    """Deliver ``rows`` part by part to a folder and drain the query of ``build`` after each, resuming one checkpoint.

    Every part is at least one micro-batch of its own, so state and watermark are carried between them. ``flush`` ends
    bounded input: a marker row far in the future moves the watermark past every open window; its own window stays open and
    is never written.
    """
    spark = rows.sparkSession
    source, sink, checkpoint = (scratch_path(spark, f"{name}-{x}") for x in ("source", "sink", "checkpoint"))
    marker = rows.agg(F.max("ts").alias("ts")).select(*((F.col("ts") + F.expr("INTERVAL 1000 DAYS") if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes))
    for part in [*(rows.where(p) for p in parts), *([marker] if flush else [])]:
        part.write.mode("append").parquet(source)
        out = drain(build(read_events(spark, source, "*.parquet")), name, checkpoint=checkpoint, path=sink)
    return out
