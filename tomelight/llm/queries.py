"""The queries opN_<name> over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe
from .conversation_repair import conversation_repair, damage
from .decontaminate import find_items
from .exact_dedup import exact_dedup
from .fingerprints import fingerprints
from .html_extract import extract_text
from .jaccard_join import jaccard_components
from .quality_classifier import fit_quality, score_quality
from .secret_scan import find_secrets, fit_secrets
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import token_store
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """The fold whose labels are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    out = score_quality(docs, model, score_col="score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def word_vocabulary() -> str:
    """The vocabulary file of the queries, as text; its place is a parameter of the installed package, never a copy."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), word_vocabulary())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return find_secrets(docs, fit_secrets(docs))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(_table(spark, sf_dir, "documents"), word_vocabulary(), end_id=1).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    out = conversation_repair(damage(rows), rows.select(F.col("conv_id").alias("conv")))
    return out.withColumnRenamed("conv", "conv_id")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def codes_sql() -> str:
    """op11 as one statement: a pair of steps for each round, distances as whole numbers."""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {s}) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS (SELECT vec_id, p, v[p * (len(v) // {n}) + 1 : (p + 1) * (len(v) // {n})] AS w FROM kept, range({n}) AS r(p))",
        "book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, w AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {k}))",
    ]
    for i in range(ROUNDS + 1):
        apart = "list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"near{i} AS (SELECT vec_id, p, any_value(w) AS w, min(struct_pack(d := d, k := k)) AS b FROM (SELECT vec_id, p, w, k, CAST({apart} AS BIGINT) AS d FROM parts JOIN book{i} USING (p)) GROUP BY vec_id, p)")
        if i < ROUNDS:
            steps += [
                f"flat{i} AS (SELECT p, b.k AS k, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM near{i})",
                f"mean{i} AS (SELECT p, k, list(m ORDER BY j) AS c FROM (SELECT p, k, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM flat{i} GROUP BY p, k, j) GROUP BY p, k)",
                f"book{i + 1} AS (SELECT p, k, coalesce(mean{i}.c, book{i}.c) AS c FROM book{i} LEFT JOIN mean{i} USING (p, k))",
            ]
    steps += [
        f"coded AS (SELECT vec_id, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{ROUNDS})",
    ]
    last = "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"
    return f"WITH {', '.join(steps)} {last}".format(s=SCALE, n=PARTS, k=ENTRIES)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_jaccard_join, op3_html_extraction, op4_decontamination, op5_bpe, op6_substring_dedup, op7_exact_dedup, op8_secret_scan, op9_token_files, op10_suffix_dedup, op11_vector_codes, op12_conversation_repair, op13_document_fingerprints)}
ORACLE_SQL = {"op7_exact_dedup": OP7_SQL, "op11_vector_codes": codes_sql()}
