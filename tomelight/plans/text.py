"""Queries over pages, documents, labels and a batch form of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tomelight.functions import columns as C, html as H, text as X
from tomelight.operators import labelling as L
from tomelight.streaming import events as E

from .registry import Tables, query


@query(None)
def q_html_meta(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.page_meta("html").alias("m")).select("page_id", "m.*")


# Signs of dangerous HTML.
_DANGERS = (r"(?i)<script[\s>]", r"(?i)javascript:", r"(?i)on\w+\s*=", r"(?i)<iframe[\s>]", r"(?i)<object[\s>]", r"(?i)<embed[\s>]", r"(?i)<form[\s>]", r"(?i)data:text/html", r"(?is)<svg[\s>].*<script")


@query("SELECT page_id, " + " + ".join(f"cast(regexp_matches(html, '{p}') AS INTEGER)" for p in _DANGERS) + " AS dangers FROM pages")
def q_dangerous_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", sum((F.col("html").rlike(p).cast("int") for p in _DANGERS), F.lit(0)).alias("dangers"))


@query("SELECT doc_id, CASE WHEN length(x) > 200 THEN trim(left(x, 200), ' ') || '...' ELSE x END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS x FROM documents)")
def q_excerpt(t: Tables) -> DataFrame:
    """The first 200 characters of each document, white space collapsed."""
    return t.documents.select("doc_id", H.excerpt(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " ")), 200).alias("excerpt"))


@query(None)
def q_sentence_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.sentences("text")).alias("k", "sentence"))


@query("SELECT p_partkey, regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]', '', 'g') AS key FROM part")
def q_title_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.title_key("p_name").alias("key"))


@query(None)
def q_bio_decode(t: Tables) -> DataFrame:
    word = F.split(F.col("text"), r"\s+")
    tags = F.transform(word, lambda w: F.when(w.rlike("^[0-9]"), "B-NUM").when(w.rlike("^[A-Z]"), "B-NAME").when(w.rlike(r"^\p{Lu}"), "I-NAME").otherwise("O"))
    return t.documents.select("doc_id", F.explode(L.bio_entities(tags)).alias("e")).select("doc_id", "e.*")


@query(None)
def q_viterbi(t: Tables) -> DataFrame:
    rows = F.transform(F.split("text", r"\s+"), lambda w: F.array(F.length(w) / 10.0, F.when(w.rlike("[.,]$"), 1.0).otherwise(0.0)))
    found = L.viterbi(t.documents.select("doc_id", rows.alias("emissions")), "emissions", [[0.5, 0.0], [0.2, -1.0]], start=[0.2, -0.5], end=[-0.3, 0.4])
    return found.select("doc_id", F.size("path").alias("n"), F.aggregate("path", F.lit(0), lambda a, b: a + b).alias("ones"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[àâçéèêëîïôùûüÿñæœ]')) AS accented FROM documents GROUP BY 1")
def q_language_signs(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("[àâçéèêëîïôùûüÿñæœ]")).alias("accented"))


@query("SELECT doc_id, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.5 THEN 'good' WHEN s >= 0.25 THEN 'fair' ELSE 'low' END AS tier FROM (SELECT doc_id, least(n_chars / 2000.0, 1) * 0.5 + (CASE WHEN lang = 'en' THEN 0.3 ELSE 0.1 END) + (CASE WHEN contains(text, chr(10)) THEN 0.2 ELSE 0 END) AS s FROM documents)")
def q_quality_tier(t: Tables) -> DataFrame:
    score = F.least(F.col("n_chars") / 2000.0, F.lit(1.0)) * 0.5 + F.when(F.col("lang") == "en", 0.3).otherwise(0.1) + F.when(F.contains("text", F.lit("\n")), 0.2).otherwise(0.0)
    return t.documents.select("doc_id", F.when(score >= 0.75, "high").when(score >= 0.5, "good").when(score >= 0.25, "fair").otherwise("low").alias("tier"))


@query("SELECT p_partkey, n.n AS item FROM part, generate_series(1, 50) n(n) WHERE n.n BETWEEN greatest(1, p_size - 2) AND p_size")
def q_range_expand(t: Tables) -> DataFrame:
    span = F.sequence(F.greatest(F.lit(1), F.col("p_size") - 2), F.col("p_size"))
    return t.part.where("p_size >= 1").select("p_partkey", F.explode(span).alias("item")).withColumn("item", F.col("item").cast("long"))


@query("SELECT p_partkey, k AS place FROM (VALUES (5, 0), (3, 1), (100000000, 2), (7, 3)) v(p_partkey, k) JOIN part USING (p_partkey)")
def q_in_id_order(t: Tables) -> DataFrame:
    ids = t.spark.range(1).select(F.posexplode(F.array(*map(F.lit, (5, 3, 100_000_000, 7)))).alias("place", "p_partkey"))
    return t.part.join(F.broadcast(ids), "p_partkey").select("p_partkey", "place").orderBy("place")


@query("SELECT event_id, CASE WHEN w IS NOT NULL THEN least(w, 2147483647) END AS waited FROM (SELECT event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM events)")
def q_waits(t: Tables) -> DataFrame:
    clock = F.unix_millis(F.col("ts").cast("timestamp"))
    gap = clock - F.lag(clock).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", F.when(gap.isNotNull(), F.least(gap, F.lit(2_147_483_647))).alias("waited"))


@query("SELECT o_orderkey, round(30 * pow(2, least(o_orderkey % 9, 6)), 3) AS delay FROM orders")
def q_backoff(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(C.backoff_seconds(30.0, F.col("o_orderkey") % 9 + 1), 3).alias("delay"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' ORDER BY value DESC, ts, event_id LIMIT 30")
def q_claim_topk(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").orderBy(F.desc("value"), "ts", "event_id").limit(30).select("event_id", "event_type", "user_id")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (value > 50 AND event_type = 'error') AS exhausted, count(*) FILTER (value <= 50 AND event_type = 'error') AS retry, min(ts) FILTER (event_type = 'error') AS oldest FROM events GROUP BY 1")
def q_stale_stats(t: Tables) -> DataFrame:
    error = F.col("event_type") == "error"
    return t.events.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(error & (F.col("value") > 50)).alias("exhausted"), F.count_if(error & (F.col("value") <= 50)).alias("retry"), F.min(F.when(error, F.col("ts"))).alias("oldest"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (ts > now - INTERVAL 7 DAY) AS current, count(*) FILTER (ts > now - INTERVAL 14 DAY AND ts <= now - INTERVAL 7 DAY) AS previous FROM events, m GROUP BY 1")
def q_period_deltas(t: Tables) -> DataFrame:
    rows = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))
    return rows.groupBy("event_type").agg(F.count_if(F.expr("ts > now - interval 7 days")).alias("current"), F.count_if(F.expr("ts > now - interval 14 days and ts <= now - interval 7 days")).alias("previous"))


@query("WITH b AS (SELECT a.o_orderkey, a.o_custkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) a WHERE rn > 3) SELECT o_custkey, count(*) AS dropped FROM b GROUP BY 1")
def q_keep_newest(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg((F.count("*") - 3).alias("dropped"))
    return counts.where("dropped > 0")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS slot, count(*) AS n FROM events GROUP BY 1, 2")
def q_window_counts(t: Tables) -> DataFrame:
    return E.window_counts(t.events, "event_type", "ts", "1 hour", "1 hour")


@query("""WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR AS new FROM events), s AS (SELECT *, sum(coalesce(cast(new AS INTEGER), 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def q_session_windows(t: Tables) -> DataFrame:
    return E.session_counts(t.events, "user_id", "ts", "2 hours", "1 hour")
