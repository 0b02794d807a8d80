"""Queries over words with places, folded names and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomelight.functions import folding, words

from .registry import Tables, query

_PIECES = rf"[{words.CJK}]|(?:[^\P{{L}}{words.CJK}]|[^\P{{N}}{words.CJK}])+|[^\p{{L}}\p{{N}}{words.CJK}]+"


@query(rf"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PIECES}')) AS w, generate_subscripts(regexp_extract_all(text, '{_PIECES}'), 1) AS k FROM documents), o AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM p),
t AS (SELECT doc_id, w, e - length(w) AS s, e, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM o WHERE regexp_matches(w, '^[\p{{L}}\p{{N}}{words.CJK}]'))
SELECT doc_id, CASE WHEN regexp_matches(w, '^[{words.CJK}]') THEN 'cjk' WHEN regexp_full_match(w, '\p{{N}}+') THEN 'number' WHEN regexp_full_match(w, '\p{{L}}+') THEN 'word' ELSE 'mixed' END AS kind, count(*) AS n, cast(sum(s) AS BIGINT) AS firsts, cast(sum(e) AS BIGINT) AS ends, cast(sum(i * (s + 1)) AS BIGINT) AS order_sum FROM t GROUP BY 1, 2""")
def q_word_places(t: Tables) -> DataFrame:
    """Words of every document by kind, with sums that tell their places."""
    docs = t.documents.select("doc_id", "text")
    rows = docs.lateralJoin(words.word_tokens(F.col("text").outer(), F.lit(""), F.lit(False)))
    total = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), total(F.col("first")).alias("firsts"), total(F.col("end")).alias("ends"), total(F.col("place").cast("long") * (F.col("first") + 1)).alias("order_sum"))


@query(r"""WITH n AS (SELECT doc_id, array_to_string(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[1:4], '-') AS name FROM documents),
k AS (SELECT doc_id, list_filter(string_split_regex(lower(strip_accents(name)), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS p FROM n)
SELECT doc_id, array_to_string(list_sort(list_transform(p, lambda w: replace(regexp_replace(replace(replace(w, 'ou', 'o'), 'oo', 'o'), 'oh([^aeiouy]|$)', 'o\1', 'g'), 'uu', 'u'))), ' ') AS key FROM k WHERE NOT regexp_matches(array_to_string(p, ' '), 'o[ouh][ouh]') """)
def q_folded_names(t: Tables) -> DataFrame:
    """Keys of the first four words of documents, accents and long vowels folded (without the few where one replacement makes room for another)."""
    name = F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 4), "-")
    bare = F.array_join(F.filter(F.split(F.lower(folding.without_marks(name)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    rows = t.documents.where(F.col("text").isNotNull()).select("doc_id", folding.person_key(name).alias("key"), bare.alias("bare"))
    return rows.where(~F.col("bare").rlike("o[ouh][ouh]")).select("doc_id", "key")


@query("""SELECT event_id, '{"user":{"id":' || user_id || ',"accessToken":"[REDACTED]","tags":["a",{"Set-Cookie":"[REDACTED]","n":1.5,"ok":true}]},"k":"' || json_extract_string(props, '$.k') || '"}' AS safe FROM events""")
def q_redact_nested(t: Tables) -> DataFrame:
    """Secrets inside objects and arrays; numbers stay numbers."""
    deep = F.struct(F.lit("s").alias("Set-Cookie"), F.lit(1.5).alias("n"), F.lit(True).alias("ok"))
    user = F.concat(F.lit('{"id":'), F.col("user_id"), F.lit(',"accessToken":{"value":"x"},"tags":["a",'), F.to_json(deep), F.lit("]}"))
    record = F.concat(F.lit('{"user": '), user, F.lit(', "k": "'), F.get_json_object("props", "$.k"), F.lit('"}'))
    return t.events.select("event_id", words.redacted(record).alias("safe"))
