"""Stage tables and fitted models on disk."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession


def checkpoint_table(df: DataFrame, path: str) -> DataFrame:
    """Write a stage table as Parquet and go on from the written files."""
    df.write.mode("overwrite").parquet(path)
    return load_table(df.sparkSession, path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, kind: type[MLReadable] = PipelineModel):
    return kind.load(path)
