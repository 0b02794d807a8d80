"""Queries over validated ranges, merged spans, weighted picks, page structure, streams' batch forms and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomelight.functions import html as H, titles as T
from tomelight.operators import matching, validation as V
from tomelight.streaming import events as E

from .registry import Tables, query
from .titles import TITLE, _lit, _noise_sql, _titles


@query(None)
def q_validated_ranges(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("number")).agg(F.min(F.col("l_suppkey") % 40 + F.col("l_linenumber") * 4).alias("first"), F.count("*").alias("n"), F.max(F.lit(30)).alias("expected"))
    return V.validated_ranges(rows.select("entity", "number", "first", (F.col("first") + F.col("n") + F.col("number") % 5).alias("last"), F.lit(0.9).alias("confidence"), "expected"), "expected")


@query(None)
def q_span_merge(t: Tables) -> DataFrame:
    start = (F.col("l_suppkey") % 30).cast("long")
    spans = t.lineitem.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3).alias("priority"), start.alias("start"), (start + F.col("l_linenumber")).alias("end"), F.col("l_returnflag").alias("kind"))
    return V.merged_spans(spans)


@query("""WITH c AS (SELECT o_custkey AS entity, o_orderpriority AS pattern, dayofweek(o_orderdate) AS weekday, o_orderdate AS due, o_orderkey % 10 / 10 AS confidence FROM orders),
s AS (SELECT entity, pattern, count(*) AS n, round(sum(confidence), 6) AS w FROM c WHERE confidence >= 0.3 GROUP BY 1, 2), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY w DESC, pattern) = 1),
d AS (SELECT entity, weekday, round(sum(confidence), 6) AS w FROM c GROUP BY 1, 2), e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY entity ORDER BY w DESC, weekday) = 1)
SELECT b.entity, b.pattern, round(b.w / n, 6) AS confidence, e.weekday AS weekday, (SELECT min(due) FROM c WHERE c.entity = b.entity) AS due FROM b JOIN e ON e.entity = b.entity WHERE n >= 2""")
def q_schedule_consensus(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("pattern"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("weekday"), F.col("o_orderdate").alias("due"), (F.col("o_orderkey") % 10 / 10).alias("confidence"))
    return V.schedule_consensus(rows, 0.3)


_SCALE = "CASE WHEN l_partkey % 500 = 0 THEN 0.7 ELSE least(1.5, 0.6 + 0.1 * log10(l_partkey % 500)) END"


@query(f"WITH c AS (SELECT l_orderkey AS entity, l_linenumber AS provider, l_quantity AS rating, round((1.0 - 0.1 * (l_linenumber % 5)) * {_SCALE}, 9) AS w FROM lineitem), r AS (SELECT *, sum(w) OVER (PARTITION BY entity) AS t, row_number() OVER (PARTITION BY entity ORDER BY w DESC, provider, rating) AS rn FROM c) SELECT entity, provider, rating, round(w / t, 6) AS confidence FROM r WHERE rn = 1")
def q_pick_rating(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("provider"), F.col("l_quantity").alias("rating"), (F.col("l_partkey") % 500).alias("votes"))
    return V.pick_rating(rows, F.lit(1.0) - 0.1 * (F.col("provider") % 5))


@query(f"""WITH q AS (SELECT lower({_noise_sql(TITLE)}) AS asked, cast(max(p_size) AS DOUBLE) AS chapters, max(1990 + p_size % 9) AS year FROM part GROUP BY 1), c AS (SELECT p_name AS id, lower(p_name) AS name, cast(min(p_size) AS DOUBLE) AS chapters, min(1990 + p_size % 5) AS year FROM part GROUP BY 1, 2),
g AS (SELECT asked, g, count(*) AS n FROM (SELECT asked, unnest(list_transform(generate_series(1, length(asked) - 1), lambda k: substr(asked, k, 2))) AS g FROM q) GROUP BY 1, 2), h AS (SELECT name, g, count(*) AS n FROM (SELECT name, unnest(list_transform(generate_series(1, length(name) - 1), lambda k: substr(name, k, 2))) AS g FROM c) GROUP BY 1, 2),
d AS (SELECT asked, name, 2 * sum(least(g.n, h.n)) / (length(asked) + length(name) - 2) AS dice FROM g JOIN h USING (g) GROUP BY 1, 2),
s AS (SELECT asked, id, abs(length(asked) - length(name)) AS gap, round(dice * least(length(asked), length(name)) / greatest(length(asked), length(name)) * (0.7 + 0.3 * least(q.chapters, c.chapters) / greatest(q.chapters, c.chapters)) * CASE WHEN q.year = c.year THEN 1.15 WHEN abs(q.year - c.year) <= 2 THEN 1.0 ELSE 0.8 END, 6) AS score FROM d JOIN q USING (asked) JOIN c USING (name))
SELECT asked, id, score FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, gap, id) = 1""")
def q_multi_signal_match(t: Tables) -> DataFrame:
    asked = _titles(t).groupBy("title").agg(F.max("p_size").alias("chapters"), F.max(1990 + F.col("p_size") % 9).alias("year"))  # titles repeat: each loses its noise once
    asked = asked.groupBy(F.lower(T.without_noise(F.col("title"))).alias("asked")).agg(F.max("chapters").cast("double").alias("chapters"), F.max("year").alias("year"))
    names = t.part.groupBy(F.col("p_name").alias("id")).agg(F.min("p_size").cast("double").alias("chapters"), F.min(1990 + F.col("p_size") % 5).alias("year")).withColumn("name", F.lower("id"))
    return matching.multi_signal_match(asked, names)


_DIFFERS = " OR ".join(f"regexp_matches(asked, {_lit(p)}) <> regexp_matches(name, {_lit(p)})" for p in (*T.EDITIONS, *T.SPINOFFS))


@query(f"""WITH i AS (SELECT p_name AS id, min(p_partkey) AS ref, cast(min(p_size) AS DOUBLE) AS chapters, min(1990 + p_size % 5) AS year FROM part GROUP BY 1),
q AS (SELECT lower({_noise_sql(TITLE)}) AS asked, CASE max(p_partkey) % 3 WHEN 1 THEN max(i.ref) WHEN 2 THEN max(p_partkey) % 40 + 1 END AS ref, cast(max(p_size) AS DOUBLE) AS chapters, max(1990 + p_size % 9) AS year FROM part JOIN i ON i.id = p_name GROUP BY 1),
c AS (SELECT id, lower(id) || CASE WHEN ref % 3 = 0 THEN ' deluxe' ELSE '' END AS name, ref, chapters, year FROM i UNION ALL SELECT id, lower(id) || ' omnibus', ref, chapters, year FROM i WHERE ref % 2 = 0),
g AS (SELECT asked, g, count(*) AS n FROM (SELECT asked, unnest(list_transform(generate_series(1, length(asked) - 1), lambda k: substr(asked, k, 2))) AS g FROM q) GROUP BY 1, 2), h AS (SELECT name, g, count(*) AS n FROM (SELECT name, unnest(list_transform(generate_series(1, length(name) - 1), lambda k: substr(name, k, 2))) AS g FROM (SELECT DISTINCT name FROM c)) GROUP BY 1, 2),
d AS (SELECT asked, name, 2 * sum(least(g.n, h.n)) / (length(asked) + length(name) - 2) AS dice FROM g JOIN h USING (g) GROUP BY 1, 2),
s AS (SELECT asked, name, id, coalesce(q.ref = c.ref, false) AS referred, NOT ({_DIFFERS}) AS fits, abs(length(asked) - length(name)) AS gap, round(dice * least(length(asked), length(name)) / greatest(length(asked), length(name)) * (0.7 + 0.3 * least(q.chapters, c.chapters) / greatest(q.chapters, c.chapters)) * CASE WHEN q.year = c.year THEN 1.15 WHEN abs(q.year - c.year) <= 2 THEN 1.0 ELSE 0.8 END, 6) AS score FROM d JOIN q USING (asked) JOIN c USING (name)),
f AS (SELECT asked, id, bool_or(NOT ({_DIFFERS})) AS fits FROM (SELECT DISTINCT asked FROM q), c GROUP BY 1, 2), b AS (SELECT s.asked, s.id, score, gap, CASE WHEN referred AND f.fits THEN 'edition' WHEN referred THEN 'reference' WHEN f.fits THEN 'title' END AS how FROM s JOIN f ON f.asked = s.asked AND f.id = s.id WHERE score >= 0.4)
SELECT asked, id, score, how FROM b WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY how, score DESC, gap, id) = 1""")
def q_referenced_match(t: Tables) -> DataFrame:
    """Entities that refer to the one asked for before others: a third of the titles asked for has their own reference, a third any other, a third none."""
    own = t.part.groupBy(F.col("p_name").alias("id")).agg(F.min("p_partkey").alias("ref"), F.min("p_size").cast("double").alias("chapters"), F.min(1990 + F.col("p_size") % 5).alias("year"))
    key = F.max("key")
    ref = F.when(key % 3 == 1, F.max("ref")).when(key % 3 == 2, key % 40 + 1)
    asked = _titles(t).groupBy("p_name", "title").agg(F.max("p_partkey").alias("key"), F.max("p_size").alias("chapters"), F.max(1990 + F.col("p_size") % 9).alias("year"))  # titles repeat: each loses its noise once
    asked = asked.join(own.select(F.col("id").alias("p_name"), "ref"), "p_name").groupBy(F.lower(T.without_noise(F.col("title"))).alias("asked"))
    asked = asked.agg(ref.alias("ref"), F.max("chapters").cast("double").alias("chapters"), F.max("year").alias("year"))
    first = own.withColumn("name", F.concat(F.lower("id"), F.when(F.col("ref") % 3 == 0, " deluxe").otherwise("")))
    second = own.where("ref % 2 = 0").withColumn("name", F.concat(F.lower("id"), F.lit(" omnibus")))
    return matching.referenced_match(asked, first.unionByName(second), T.edition_mismatch)


@query(f"WITH x AS (SELECT p_partkey, ' ' || lower({TITLE}) || ' ' AS t, lower(p_name) AS n FROM part) SELECT p_partkey, cast(CASE WHEN trim(t) = n THEN 1.0 WHEN contains(t, ' ' || n || ' ') THEN 0.9 WHEN contains(t, n) THEN 0.7 ELSE 0.0 END AS DOUBLE) AS confidence FROM x")
def q_token_match(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", T.match_confidence(F.lower("title"), F.lower("p_name")).alias("confidence"))


@query(f"WITH x AS (SELECT p_partkey, list_filter(string_split(lower({_noise_sql(TITLE)}), ' '), lambda w: regexp_matches(w, '^[a-z]{{2,}}$')) AS r, string_split(p_name, ' ') AS c FROM part) SELECT p_partkey, len(list_filter(r, lambda w: NOT list_contains(c[1:1], w) AND NOT list_contains(['deluxe', 'part', 'omnibus', 'digital'], w))) > 0 AND len(r) > 0 AS rejected FROM x")
def q_foreign_tokens(t: Tables) -> DataFrame:
    """Titles with words that neither the one accepted word (the first of the name) nor a qualifier explains."""
    accepted = F.array(F.get(F.split("p_name", " "), F.lit(0)))
    words = F.filter(F.split(F.lower(T.without_noise(F.col("title"))), " "), lambda w: w.rlike("^[a-z]{2,}$"))
    return _titles(t).select("p_partkey", T.foreign(words, F.array(accepted)).alias("rejected"))


@query(f"WITH x AS (SELECT p_partkey, list_filter(string_split(lower({_noise_sql(TITLE)}), ' '), lambda w: regexp_matches(w, '^[a-z]{{2,}}$')) AS r, string_split(p_name, ' ') AS c FROM part), y AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN c WHEN 1 THEN c[1:1] WHEN 2 THEN c[2:2] ELSE [] END AS a FROM x) SELECT p_partkey, len(r) > 0 AND len(a) = 1 AND length(a[1]) <= 6 AND len(list_filter(r, lambda w: NOT list_contains(a, w) AND NOT list_contains(['deluxe', 'part', 'omnibus', 'digital'], w))) > 0 AS rejected FROM y")
def q_foreign_titles(t: Tables) -> DataFrame:
    """The same for accepted titles of two words, of the first or the second word, and of none: some reject a release, others let it pass."""
    name, nth = F.split("p_name", " "), F.col("p_partkey") % 4
    accepted = F.when(nth == 0, name).when(nth == 1, F.slice(name, 1, 1)).when(nth == 2, F.slice(name, 2, 1)).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.lower(T.without_noise(F.col("title"))), " "), lambda w: w.rlike("^[a-z]{2,}$"))
    return _titles(t).select("p_partkey", T.foreign(words, F.array(accepted)).alias("rejected"))


@query(None)
def q_release_coverage(t: Tables) -> DataFrame:
    rows = _titles(t).select("p_partkey", T.release_coverage(F.col("title")).alias("c"))
    return rows.select("p_partkey", F.array_join(F.col("c.volumes").cast("array<string>"), ",").alias("volumes"), F.array_join(F.col("c.chapters").cast("array<string>"), ",").alias("chapters"))


@query("SELECT doc_id, coalesce(text, '') <> '' AND lang = 'en' AND NOT regexp_matches(text, '(?i)[àâãäåçéèêëìíîïñòóôõöùúûüýÿœæ]') AND NOT regexp_matches(text, '[\\x{3000}-\\x{9fff}\\x{ac00}-\\x{d7af}]') AS english FROM documents")
def q_likely_english(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.likely_english(F.col("text"), F.col("lang")).alias("english"))


@query(None)
def q_strip_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", H.strip_html("html").alias("text"))


@query(None)
def q_page_sections(t: Tables) -> DataFrame:
    return t.pages.select("page_id", H.section_text("html", F.lit("Summary")).alias("section"))


@query(None)
def q_page_structure(t: Tables) -> DataFrame:
    """Embedded data, key-value boxes and table rows of each page, as counts."""
    return t.pages.select("page_id", F.size(H.structured_data("html")).alias("fields"), F.size(H.infobox("html")).alias("pairs"), F.size(H.table_rows("html")).alias("rows"))


@query(None)
def q_folded_variants(t: Tables) -> DataFrame:
    word = F.explode(F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))).alias("word")
    words = t.documents.select(word).distinct()
    return words.select("word", F.array_join(H.folded_variants("word"), "|").alias("variants"))


@query(None)
def q_token_bucket(t: Tables) -> DataFrame:
    """Events that a bucket of three tokens a user, refilled by one an hour, lets through."""
    return E.token_bucket_batch(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", 3.0, 1 / 3600)
