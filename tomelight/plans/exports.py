"""Queries over training records of tagged texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tomelight.operators import training as R

from .registry import Tables, query

#: A word's tag: numbers and names, the same expression for both engines.
_TAG = "CASE WHEN regexp_like(w, '^[0-9]') THEN 'B-NUM' WHEN regexp_like(w, '^[A-Z]') THEN 'B-NAME' ELSE 'O' END"
_GROUPS = {"Names": ("NAME",), "Numbers": ("NUM", "YEAR")}
_TAGGED = f"p AS (SELECT doc_id, lang, list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '') AS w FROM documents), t AS (SELECT *, list_transform(w, lambda w: {_TAG.replace('regexp_like', 'regexp_matches')}) AS g FROM p)"
_EACH = "e AS (SELECT * FROM (SELECT doc_id, lang, w, unnest(g) AS tag, generate_subscripts(g, 1) AS k FROM t) WHERE tag <> 'O')"


def _pages(t: Tables) -> DataFrame:
    """Documents as pages of words with a tag each."""
    words = "filter(split(coalesce(text, ''), ' '), w -> w <> '')"
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), "source", F.expr(words).alias("tokens"), F.expr(f"transform({words}, w -> {_TAG})").alias("tags"))


def _lines(t: Tables, form: str, **options) -> DataFrame:
    return R.records(_pages(t), form, **options).select(F.col("id").cast("long").alias("doc_id"), "place", "line")


@query(f"WITH {_TAGGED} SELECT doc_id, to_json({{'id': cast(doc_id AS VARCHAR), 'tokens': w, 'ner_tags': list_transform(g, lambda x: CASE WHEN x = 'B-NAME' THEN x ELSE 'O' END)}}) AS line FROM t")
def q_export_huggingface(t: Tables) -> DataFrame:
    """Words and tags of each document, names only."""
    return _lines(t, "huggingface", kinds=["NAME"]).drop("place")


@query(f"WITH {_TAGGED}, {_EACH} SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS place, to_json({{'question': 'What is the ' || lower(substr(tag, 3)) || ' of \"' || lang || '\"?', 'answer': w[k], 'context': trim(array_to_string(w[greatest(1, k - 100):k + 100], ' '), ' ')}}) AS line FROM e")
def q_export_qa(t: Tables) -> DataFrame:
    """A question for each entity, with a hundred words on each side as context."""
    return _lines(t, "qa", metadata=False)


@query(f"WITH {_TAGGED}, {_EACH}, a AS (SELECT doc_id, k, w[k] AS answer, lang, tag, trim(array_to_string(w[greatest(1, k - 75):k + 75], ' '), ' ') AS x FROM e) SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS place, to_json({{'instruction': 'Extract the ' || lower(substr(tag, 3)) || ' of \"' || lang || '\".', 'input': CASE WHEN length(x) > 2000 THEN left(x, 1997) || '...' ELSE x END, 'output': answer}}) AS line FROM a")
def q_export_instructions(t: Tables) -> DataFrame:
    """An instruction for each entity, whose input is the text round it."""
    return _lines(t, "alpaca", metadata=False)


@query(None)
def q_export_spacy(t: Tables) -> DataFrame:
    """The text of each document with the places of its entities."""
    return _lines(t, "spacy").drop("place")


@query(f"""WITH {_TAGGED}, n AS (SELECT len(list_filter(g, lambda x: x = 'B-NAME')) AS names, len(list_filter(g, lambda x: x = 'B-NUM')) AS nums FROM t), one AS (SELECT count(*) AS n FROM t), e AS (SELECT coalesce(sum(names + nums), 0) AS n FROM n)
SELECT form, cast(CASE WHEN form IN ('alpaca', 'qa') THEN e.n WHEN form = 'sharegpt' THEN e.n + (SELECT count(*) FILTER (names >= 2) + count(*) FILTER (nums >= 2) + count(*) FILTER (names + nums >= 3) FROM n) ELSE one.n END AS BIGINT) AS records FROM (SELECT unnest({list(R.SCHEMAS)}) AS form), one, e""")
def q_training_records(t: Tables) -> DataFrame:
    """How many records each form makes of the documents."""
    counted = (_lines(t, form, **({"groups": _GROUPS} if form == "sharegpt" else {})).agg(F.count("line").alias("records")).withColumn("form", F.lit(form)) for form in R.SCHEMAS)
    return reduce(DataFrame.unionByName, counted)
