"""Small shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, so that other columns of any name neither travel nor clash."""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))


def per_text(df: DataFrame, schema: str, make: Callable[[], Callable[[bytes | None], tuple]]) -> DataFrame:
    """Key column, then the values that a function of the text's UTF-8 bytes gives.

    ``make`` builds that function once per task, so tables and caches are made
    where they are used. One Arrow batch is held at a time.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        types = None
        for batch in batches:
            rows = [work(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            types = types or [_arrow(part) for part in schema.split(",")]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)] if rows else [pa.array([], t) for t in types[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return df.mapInArrow(run, schema)


def _arrow(part: str) -> pa.DataType:
    kind = part.split()[1]
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind]


def fold_of(key: Column, folds: int) -> Column:
    """Fold of a row: crc32 of the key as text, modulo the number of folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))
