"""Streams into tables that a replayed micro-batch does not change: each batch owns one folder, named by its id.

A batch writes its share with overwrite into batch_id=<id>; whether it runs once or again after a failure, the folder
holds the same rows in the end. What all batches together say is read by one aggregate.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _write(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch}")


def _read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """All batches' rows with batch_id; like gives the columns of a table that has no batch yet."""
    try:
        return spark.read.schema(StructType([*like.schema.fields, StructField("batch_id", LongType())])).option("basePath", folder).parquet(f"{folder}/batch_id=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0).withColumn("batch_id", F.lit(None).cast("long"))


def add_batch(folder: str, keys: dict[str, Column], sums: dict[str, Column]):
    """For foreachBatch: the sums of each key in a batch; later batches add to them (see totals)."""

    def run(df: DataFrame, batch: int) -> None:
        _write(df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(*(F.sum(c).alias(n) for n, c in sums.items())), folder, batch)

    return run


def totals(spark: SparkSession, folder: str, keys: list[str], sums: list[str]) -> DataFrame:
    """keys and sums over all batches."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch_id=*").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def deliver_batch(folder: str, id_col: str):
    """For foreachBatch: messages that no earlier batch has delivered, each id once; what is written is the mark of delivery.

    A batch that comes again looks at the marks of the batches before it only, so it delivers the same messages.
    """

    def run(df: DataFrame, batch: int) -> None:
        marks = _read(df.sparkSession, folder, df).where(F.col("batch_id") < batch).select(id_col)
        _write(df.dropDuplicates([id_col]).join(marks, id_col, "left_anti").select(*df.columns), folder, batch)

    return run


def undelivered(messages: DataFrame, folder: str, id_col: str) -> DataFrame:
    """Messages without a mark."""
    return messages.join(_read(messages.sparkSession, folder, messages).select(id_col), id_col, "left_anti").select(*messages.columns)


def into(stream: DataFrame, batch_function, checkpoint: str):
    """Starts a query that gives each micro-batch to batch_function, until what is there has been read."""
    return stream.writeStream.foreachBatch(batch_function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
