"""Helpers shared by the text operators: table access and Arrow maps over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

WORD = r"[^\x20\x09-\x0D]+"
#: Letters A-Z become lower case; what is no digit, letter or non-ASCII byte becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of digits, letters and non-ASCII characters."""
    return text.translate(FOLD).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_crc(column: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def map_batches(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], dict[str, Iterable]]], schema: str, rows: int = 1 << 30) -> DataFrame:
    """Map every Arrow batch of ``df``, in slices of ``rows`` rows, to columns by name; ``build`` runs once in each task."""
    names = DataType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = step(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows at once to Python workers, which bounds the buffers on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    return [next(x for x in ("_" * k + n for k in range(1, len(used) + 2)) if x.lower() not in used) for n in names]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def filter_batches(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], Iterable[bool]]], rows: int = 1 << 30) -> DataFrame:
    """Rows of ``df`` for which the mask of their Arrow batch, in slices of ``rows`` rows, holds; columns stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(step(part), pa.bool_()))

    return df.mapInArrow(run, df.schema)
