"""A corpus pipeline of five operators: quality, exact copies, near copies, benchmark passages, token round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tomelight.llm import bpe
from tomelight.llm.decontaminate import decontaminate
from tomelight.llm.exact_dedup import exact_dedup
from tomelight.llm.jaccard_join import jaccard_components
from tomelight.llm.quality_classifier import fit_quality, score_quality
from tomelight.llm.queries import held_out, word_vocabulary
from tomelight.llm.store import durable, restrict, row_key, unused

#: Documents of a lower quality score go.
QUALITY = 0.3
#: Words of a shingle, and the least similarity of near copies in percent.
SHINGLE, SIMILAR = 5, 80

#: Bytes of a run of texts in the token stage, whose processes still hold memory of the stages before.
RUN = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of QUALITY or more; the labels of the held-out fold teach nothing."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    score = unused(docs, "__score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= QUALITY).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; rows with that id and text all stay, and those of a text with null ids only."""
    row = unused(docs, "__row")
    gone = exact_dedup(docs).where("not kept").select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_sha256").alias(row)).distinct()
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    docs = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", sha))
    return restrict(docs, durable(gone, "gone"), row, "left_anti").drop(row)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (chains of links), the row with the least doc_id, one with a null id only if no other is there.

    Rows are documents of their own, whatever ids they share; of rows with one id and text, one stays.
    """
    row = unused(docs, "__row")
    docs = docs.withColumn(row, row_key("doc_id", "text"))
    found = jaccard_components(docs, n=SHINGLE, num=SIMILAR, den=100, id_col=row).select(F.col(row).alias("r"), "component_id").distinct()
    rows = docs.groupBy(F.col(row).alias("r")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = durable(rows.join(found, "r"), "rows")
    first = F.min_by("r", F.struct(F.col("doc_id").isNull(), "doc_id", "r")).alias("r")
    heads = durable(rows.groupBy("component_id").agg(first).select("r"), "heads")
    ids = lambda df, name: durable(df.select(F.col("r").alias(row)), name)
    kept = restrict(docs, ids(rows.join(heads, "r", "left_anti"), "gone"), row, "left_anti")
    again = ids(rows.where("n > 1").join(heads, "r", "left_semi"), "again")
    if not again.isEmpty():
        kept = restrict(kept, again, row, "left_anti").unionByName(restrict(kept, again, row).dropDuplicates([row]))
    return kept.drop(row)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens, and digests of its token ids and of the text that they decode to."""
    return bpe.digests(docs, word_vocabulary(), run=RUN)


STAGES = [("quality", quality), ("exact dedup", exact), ("near copies", near), ("benchmark", benchmark), ("tokens", tokens)]

#: Trained scores and tokens cannot be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
