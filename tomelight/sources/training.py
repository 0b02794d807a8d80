"""Files of training records: written by Spark's text writer, so a task that fails or runs twice leaves no lines, and read back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tomelight.operators.training import SCHEMAS, records

#: CoNLL blocks end with an empty line; a block that is empty is an empty page.
BLOCK = "\n\n"


def write_training(pages: DataFrame, path: str, form: str, mode: str = "errorifexists", compression: str = "none", **options) -> int:
    """Write the records of pages (see operators.training.records) as files of one form; returns how many were written.

    The count comes from the writing job itself. Files appear when the job ends well; until then nothing reads them."""
    seen = Observation()
    lines = records(pages, form, **options).select("line").observe(seen, F.count(F.lit(1)).alias("n"))
    lines.write.mode(mode).option("compression", compression).option("lineSep", BLOCK if form == "conll" else "\n").text(path)
    return seen.get["n"]


def read_training(spark: SparkSession, path: str, form: str) -> DataFrame:
    """The records of such files, with the fields of SCHEMAS; a line that is no record of the form ends the job with an error."""
    if form != "conll":
        return spark.read.schema(SCHEMAS[form]).option("mode", "FAILFAST").json(path)
    blocks = spark.read.option("lineSep", BLOCK).text(path)
    lines = F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(F.split("value", "\n"))
    part = lambda k: F.transform(lines, lambda x: F.split_part(x, F.lit("\t"), F.lit(k)))
    return blocks.select(part(1).alias("tokens"), part(2).alias("tags"))
