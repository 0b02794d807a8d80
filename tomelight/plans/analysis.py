"""Queries over windows, strings, consensus, labels, exports and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tomelight.functions import columns as C
from tomelight.operators import matching as M, consensus, relational as R, sequences as S

from .registry import Tables, query

_CLAIMS = "SELECT l_partkey AS entity, (['anilist','mangadex','mal','mangaupdates','kitsu','comicvine','fandom','wikipedia'])[1 + l_suppkey % 8] AS provider, l_returnflag AS value FROM lineitem"


def _claims(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, consensus.WEIGHTS))
    return t.lineitem.select(F.col("l_partkey").alias("entity"), F.element_at(names, (F.col("l_suppkey") % 8 + 1).cast("int")).alias("provider"), F.col("l_returnflag").alias("value"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY coalesce(l_extendedprice, 0) DESC, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn <= 5")
def q_top5_per_group(t: Tables) -> DataFrame:
    order = [F.desc(F.coalesce("l_extendedprice", F.lit(0.0))), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return R.top_k(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), ["l_partkey"], order, 5).drop("l_extendedprice").withColumn("rn", F.col("rn").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_shipdate DESC, l_partkey, l_suppkey) rn FROM lineitem) WHERE rn = 1")
def q_dedupe_best(t: Tables) -> DataFrame:
    order = [F.when(F.col("l_returnflag") == "A", 0).otherwise(1), F.desc("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")]
    return R.best_row(t.lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("WITH d AS (SELECT DISTINCT user_id, cast(ts AS DATE) AS day FROM events WHERE event_type = 'view'), r AS (SELECT user_id, count(*) AS n FROM (SELECT *, day - cast(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d) GROUP BY user_id, island) SELECT user_id, max(n) AS longest FROM r GROUP BY 1")
def q_longest_streak(t: Tables) -> DataFrame:
    return S.streaks(t.events.where("event_type = 'view'"), "user_id", "ts").groupBy("user_id").agg(F.max("length").alias("longest"))


@query("""
WITH g AS (SELECT *, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600 AS new FROM events),
s AS (SELECT *, sum(coalesce(cast(new AS INTEGER), 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, cast(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY 1, 2
""")
def q_sessions(t: Tables) -> DataFrame:
    found = S.sessions(t.events, "user_id", "ts", 21_600)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("WITH m AS (SELECT *, lead(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type IN ('view', 'purchase')) SELECT user_id, cast(sum(least(nxt - epoch_us(ts) // 1000000, 86400)) AS BIGINT) AS seconds, count(*) AS sessions FROM m WHERE event_type = 'view' AND nxt IS NOT NULL GROUP BY 1")
def q_session_pairs(t: Tables) -> DataFrame:
    found = S.paired_sessions(t.events, "user_id", "ts", "view", "purchase", 86_400)
    return found.groupBy("user_id").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("sessions"))


@query("SELECT user_id, round(regr_slope(value, rn), 6) AS slope FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) GROUP BY 1")
def q_trend_slope(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "value", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("rn"))
    return rows.groupBy("user_id").agg(F.round(F.regr_slope("value", "rn"), 6).alias("slope"))


@query("SELECT user_id, round(stddev_pop(value) / greatest(avg(value), 1), 6) AS volatility FROM events GROUP BY 1")
def q_volatility(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(F.stddev_pop("value") / F.greatest(F.avg("value"), F.lit(1.0)), 6).alias("volatility"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hour, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS hours6 FROM events")
def q_velocity(t: Tables) -> DataFrame:
    return S.trailing_counts(t.events, "user_id", "ts", {"hour": 3600, "hours6": 21_600}).select("event_id", "hour", "hours6")


@query("SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS slot, count(*) AS n FROM events GROUP BY 1, 2")
def q_fixed_window(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("slot"), "n")


@query("SELECT user_id, cast(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 3")
def q_anomaly_days(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("errors")).where("errors >= 3")


def _pairs(t: Tables) -> DataFrame:
    """Pairs of different names that share a bigram."""
    names = t.part.select(F.col("p_name").alias("a")).distinct()
    return M.dice_pairs(names, names.select(F.col("a").alias("b")), "a", "b").where("a < b")


@query("WITH n AS (SELECT DISTINCT p_name AS a FROM part), g AS (SELECT a, list_distinct(list_transform(generate_series(1, length(a) - 1), lambda k: substr(a, k, 2))) AS g FROM n) SELECT x.a, y.a AS b, round(1 - levenshtein(lower(x.a), lower(y.a)) / greatest(length(x.a), length(y.a)), 6) AS similarity FROM g x JOIN g y ON x.a < y.a AND len(list_intersect(x.g, y.g)) > 0")
def q_similarity(t: Tables) -> DataFrame:
    """Pairs of different names with a common bigram, by edit distance."""
    return _pairs(t).select("a", "b", F.round(C.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("WITH n AS (SELECT DISTINCT p_name AS a FROM part), g AS (SELECT a, list_distinct(list_transform(generate_series(1, length(a) - 1), lambda k: substr(a, k, 2))) AS g FROM n) SELECT x.a, y.a AS b, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 6) AS jaccard FROM g x JOIN g y ON x.a < y.a AND len(list_intersect(x.g, y.g)) > 0")
def q_ngram_jaccard(t: Tables) -> DataFrame:
    """Pairs of different names with a common bigram; all others have 0."""
    return _pairs(t).select("a", "b", F.round(C.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("""WITH n AS (SELECT DISTINCT p_name AS a FROM part), g AS (SELECT a, g, count(*) AS n FROM (SELECT a, unnest(list_transform(generate_series(1, length(a) - 1), lambda k: substr(a, k, 2))) AS g FROM n) GROUP BY 1, 2),
s AS (SELECT x.a, y.a AS b, sum(least(x.n, y.n)) AS shared FROM g x JOIN g y ON x.g = y.g AND x.a < y.a GROUP BY 1, 2) SELECT a, b, round(2 * shared / (length(a) + length(b) - 2), 6) AS dice FROM s""")
def q_dice(t: Tables) -> DataFrame:
    """Pairs of different names with a common bigram; all others have 0."""
    return _pairs(t).select("a", "b", F.round("dice", 6).alias("dice"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS alias FROM customer")
def q_hash_prefix(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.substring(F.sha2(F.col("c_name"), 256), 1, 16).alias("alias"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 7) || '...' ELSE p_name END AS short, regexp_replace(lower(trim(p_name)), '\\s+', '-', 'g') AS slug FROM part")
def q_truncate_slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C.truncated(F.col("p_name"), 10).alias("short"), C.slug(F.col("p_name")).alias("slug"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, '^https://[^/]+/.+/$') THEN rtrim(u, '/') ELSE u END AS url FROM (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '^http://', 'https://') AS u FROM pages)")
def q_url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", C.comparable_url(F.col("url")).alias("url"))


@query("SELECT c_custkey, cast(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS number FROM customer")
def q_extract_numbers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.element_at(F.regexp_extract_all("c_name", F.lit(r"(\d+(?:\.\d+)?)")), 1).cast("long").alias("number"))


@query("SELECT l_orderkey, cast(list_sort(list(l_linenumber))[count(*) // 2 + 1] AS BIGINT) AS low_median FROM lineitem GROUP BY 1")
def q_low_median(t: Tables) -> DataFrame:
    """The member in the middle of each group, at half its size; 10 for an empty group."""
    sizes = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("v"))
    return sizes.select("l_orderkey", F.coalesce(F.get("v", F.floor(F.size("v") / 2).cast("int")), F.lit(10)).cast("long").alias("low_median"))


@query("WITH w(provider, w) AS (VALUES ('anilist', 0.95), ('mangadex', 0.96), ('mal', 0.92), ('mangaupdates', 0.95), ('kitsu', 0.56), ('comicvine', 0.70), ('fandom', 0.87), ('wikipedia', 0.90)), c AS (" + _CLAIMS + "), v AS (SELECT entity, value, sum(cast(w AS DECIMAL(18,2))) AS w, count(DISTINCT CASE WHEN provider IN ('anilist', 'mal') THEN 'anchor' ELSE provider END) AS k FROM c JOIN w USING (provider) GROUP BY 1, 2), r AS (SELECT *, cast(w AS DOUBLE) / cast(sum(w) OVER (PARTITION BY entity) AS DOUBLE) AS agreement, row_number() OVER (PARTITION BY entity ORDER BY w DESC, value) AS rn FROM v) SELECT entity, value, round(agreement, 6) AS agreement, round(agreement * CASE WHEN k <= 1 THEN 0.6 WHEN k = 2 THEN 0.85 ELSE 1.0 END, 6) AS confidence FROM r WHERE rn = 1")
def q_categorical_vote(t: Tables) -> DataFrame:
    return consensus.categorical_vote(_claims(t)).withColumns({c: F.round(c, 6) for c in ("agreement", "confidence")})


@query("WITH c AS (" + _CLAIMS + "), v AS (SELECT entity, value, count(*) AS votes FROM c GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY votes DESC) AS r FROM v) SELECT entity, min(value) AS value, max(votes) AS votes FROM r WHERE r = 1 AND votes >= 2 GROUP BY 1 HAVING count(*) = 1")
def q_strict_plurality(t: Tables) -> DataFrame:
    return consensus.strict_plurality(_claims(t))


@query("SELECT p_partkey, round((cast(p_name IS NOT NULL AS INTEGER) + cast(p_brand IS NOT NULL AS INTEGER) + cast(p_size > 25 AS INTEGER)) / 3, 6) AS completeness FROM part")
def q_completeness(t: Tables) -> DataFrame:
    filled = F.col("p_name").isNotNull().cast("int") + F.col("p_brand").isNotNull().cast("int") + (F.col("p_size") > 25).cast("int")
    return t.part.select("p_partkey", F.round(filled / 3, 6).alias("completeness"))


@query("SELECT count(*) AS units, count(*) FILTER (quality = toxic) AS agreed, round(count(*) FILTER (quality = toxic) / count(*), 6) AS share FROM labels")
def q_annotator_agreement(t: Tables) -> DataFrame:
    return t.labels.agg(F.count("*").alias("units"), F.count_if(F.expr("quality = toxic")).alias("agreed"), F.round(F.count_if(F.expr("quality = toxic")) / F.count("*"), 6).alias("share"))


@query("SELECT conv_id, count(*) AS turns, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY 1")
def q_export_dialogues(t: Tables) -> DataFrame:
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", who, "text").alias("line"))))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("dialogue"))


@query("SELECT a.conv_id, a.turn, a.text AS instruction, CASE WHEN length(c.text) > 2000 THEN left(c.text, 1997) || '...' ELSE coalesce(c.text, '') END AS input, b.text AS output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def q_export_pairs(t: Tables) -> DataFrame:
    """A user's turn, whole, with the answer to it; the turn before, as input, is cut to 2,000 characters."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    near = [F.lead(c).over(order).alias(f"next_{c}") for c in ("turn", "role", "text")] + [F.lag(c).over(order).alias(f"last_{c}") for c in ("turn", "text")]
    kept = t.conversations.select("conv_id", "turn", "role", "text", *near).where("role = 'user' and next_role = 'assistant' and next_turn = turn + 1")
    before = F.coalesce(F.when(F.col("last_turn") == F.col("turn") - 1, C.truncated(F.col("last_text"), 2000)), F.lit(""))
    return kept.select("conv_id", "turn", F.col("text").alias("instruction"), before.alias("input"), F.col("next_text").alias("output"))


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'text': text}) AS line FROM documents")
def q_export_jsonl(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "text")).alias("line"))
