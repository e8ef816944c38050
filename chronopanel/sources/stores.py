"""Stores written to the shared folder: partitioned, immutable, appended, nested JSON, reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronopanel.contracts import ContractError
from chronopanel.session import scratch_path


def scan_models(signals: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted models; a semi join, which prunes row groups or partitions at run time."""
    return signals.join(ids.select("model_id").distinct(), "model_id", "left_semi")


class FamilyStore:
    """Rows partitioned by family: publish, read one family, count, export."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def fresh(cls, spark: SparkSession) -> "FamilyStore":
        return cls(spark, scratch_path(spark, "family-store"))

    def publish(self, df: DataFrame) -> None:
        """Replace only the families present in ``df``; other partitions stay.

        One output directory per family but many writer tasks: rows of a hot
        family are spread over tasks by a hash of their key before the write.
        """
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != "family_id"]), F.lit(8))
        (df.withColumn("_salt", salt).repartition("family_id", "_salt").drop("_salt")
         .write.partitionBy("family_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path))

    def read(self, family_id: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df if family_id is None else df.where(F.col("family_id") == family_id)

    def row_counts(self) -> DataFrame:
        return self.read().groupBy("family_id").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("decision_date").alias("first_date"),
            F.max("decision_date").alias("last_date"))

    def export(self, path: str) -> None:
        self.read().write.mode("errorifexists").parquet(path)


def observation_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of write checks: duplicates, maturity order, missing values."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~(F.col("decision_date") < F.col("terminal_date"))).alias("_bad"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("_null"))
    return per_key.agg(F.count_if(F.col("_n") > 1).alias("duplicate_keys"), F.sum("_bad").alias("bad_order"),
                       F.sum("_null").alias("missing_scores"), F.sum("_n").alias("n_rows"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content identity: row count and two folds of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"),
                  F.sum(F.pmod(h, F.lit(1_000_003))).alias("sum_hash"))


def write_immutable(df: DataFrame, path: str, keys: Sequence[str]) -> str:
    """Write once: MISS on first write, HIT for identical content, an error otherwise."""
    audit = observation_audit(df, keys).first()
    if audit["duplicate_keys"] or audit["bad_order"] or audit["missing_scores"]:
        raise ContractError(f"observation checks failed: {audit.asDict()}")
    try:
        existing = df.sparkSession.read.parquet(path)
    except AnalysisException:
        existing = None
    if existing is not None:
        if content_fingerprint(existing.select(df.columns)).first() != content_fingerprint(df).first():
            raise ContractError(f"immutable partition already holds different content: {path}")
        return "HIT"
    df.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)
    return "MISS"


def immutable_roundtrip(panel: DataFrame) -> DataFrame:
    """Write, re-write, and try to change one partition; report the three outcomes."""
    path, keys = scratch_path(panel.sparkSession, "immutable"), ["decision_date", "ticker"]
    first = write_immutable(panel, path, keys)
    stored = panel.sparkSession.read.parquet(path)
    second = write_immutable(stored, path, keys)
    try:
        third = write_immutable(stored.withColumn("score", F.col("score") + 1), path, keys)
    except ContractError:
        third = "CONFLICT"
    return stored.agg(F.lit(first).alias("first_write"), F.lit(second).alias("second_write"),
                      F.lit(third).alias("changed_write"), F.count(F.lit(1)).alias("n_rows"))


class EpochSink:
    """One table appended to chunk by chunk, each chunk under its epoch, for ``foreachBatch`` or by hand.

    The first epoch pins names and types: later chunks are cast to it, and one with other columns fails. An epoch that comes
    again after a failure replaces itself, so no chunk counts twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def schema(self) -> StructType | None:
        try:
            return self.spark.read.parquet(f"{self.path}/epoch=0").schema
        except AnalysisException:
            return None

    def append(self, chunk: DataFrame, epoch: int) -> None:
        pinned = (self.schema() if epoch else None) or chunk.schema
        if sorted(chunk.columns) != sorted(pinned.names):
            raise ContractError(f"chunk {epoch} has columns {chunk.columns}, the first one {pinned.names}")
        chunk.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in pinned]).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema()).option("recursiveFileLookup", "true").parquet(self.path)


def append_chunks(spark: SparkSession, chunks: Sequence[DataFrame], convert: Callable[[DataFrame, int], DataFrame] = lambda chunk, epoch: chunk) -> DataFrame:
    """Stream ``chunks`` into one :class:`EpochSink`, each delivered alone and drained from one checkpoint. ``convert`` may change a chunk on its way."""
    source, path, checkpoint = (scratch_path(spark, f"append-{x}") for x in ("source", "sink", "checkpoint"))
    sink = EpochSink(spark, path)
    for chunk in chunks:
        chunk.write.mode("append").parquet(source)
        stream = spark.readStream.schema(chunk.schema).parquet(source)
        stream.writeStream.foreachBatch(lambda batch, epoch: sink.append(convert(batch, epoch), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sink.read()


def merge_partials(parts: Sequence[DataFrame], keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Sum partial aggregates that may repeat keys across chunks."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(n) for c, n in sums.items()])


def write_json(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.json(path)
    return path


def read_cell_documents(spark: SparkSession, path: str) -> DataFrame:
    """Completed cells, one row per outer result; nested rows are inlined, not gathered."""
    schema = "h long, d long, treatment string, status string, outer_rows array<struct<fold: long, cagr_excess: double>>"
    docs = spark.read.schema(schema).json(path)
    return docs.where("status = 'COMPLETE'").select("h", "d", "treatment", "status", F.inline("outer_rows"))


def candidate_choices(spark: SparkSession, path: str, latest_matured: str) -> DataFrame:
    """Per-candidate metrics over selection-only folds whose end date, parsed from the fold id, has matured."""
    schema = "h long, candidate_id string, selection_only boolean, fold_id string, cagr_excess double"
    rows = spark.read.schema(schema).json(path)
    fold_end = F.to_date(F.regexp_extract("fold_id", r"_(\d{4}-\d{2}-\d{2})_D", 1))
    return (rows.where(F.col("selection_only") & (fold_end <= F.to_date(F.lit(latest_matured))))
            .groupBy("h", "candidate_id").agg(F.count(F.lit(1)).alias("fold_count"),
                                              F.avg("cagr_excess").alias("mean_metric")))


def write_segments(spark: SparkSession, df: DataFrame, keys: Sequence[str]) -> str:
    path = scratch_path(spark, "segments")
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))          # a hot segment is written by several tasks
    df.withColumn("_salt", salt).repartition(*keys, "_salt").drop("_salt").write.partitionBy(*keys).parquet(path)
    return path


def latest_segments(spark: SparkSession, path: str, counted: int) -> DataFrame:
    """Latest segment per (seed, family) and the rows of segment ``counted``, read from the file paths."""
    part = lambda k: F.regexp_extract("_path", rf"{k}=([^/]+)", 1)
    files = (spark.read.parquet(path).select(F.input_file_name().alias("_path"))
             .groupBy("_path").agg(F.count(F.lit(1)).alias("n")))
    keyed = files.select(part("seed").alias("seed"), part("family_id").alias("family_id"),
                         part("segment").cast("long").alias("segment"), "n")
    return keyed.groupBy("seed", "family_id").agg(
        F.max("segment").alias("latest_segment"),
        F.coalesce(F.sum(F.when(F.col("segment") == counted, F.col("n"))), F.lit(0)).alias(f"rows_in_{counted}"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    schema = "family_id string, arm string, points array<struct<date: string, nav: double, benchmark_nav: double>>"
    return (spark.read.schema(schema).json(path).select("family_id", "arm", F.inline("points"))
            .withColumn("date", F.to_date("date")))


def gather_signals(spark: SparkSession, sources: Sequence[DataFrame], ids: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Matching rows from many files, one per key."""
    path = scratch_path(spark, "signals")
    for i, df in enumerate(sources):
        df.write.parquet(f"{path}/part={i}")
    return spark.read.parquet(path).where(F.col("model_id").isin(list(ids))).dropDuplicates(list(keys))


def write_report(spark: SparkSession, df: DataFrame, order: Sequence[str]) -> str:
    """CSV report in a total order (range-partitioned sort, many files)."""
    path = scratch_path(spark, "report")
    df.orderBy(*order).write.csv(path, header=True)
    return path
