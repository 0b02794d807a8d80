"""Queries over agreement, picks, gates, JSON, exports and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tomelight.functions import columns as C
from tomelight.operators import curation as K, sequences as S

from .registry import Tables, query


_NOW = "2024-02-01 00:00:00"


@query("""WITH a AS (SELECT doc_id AS unit, unnest([quality, toxic, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END]) AS label FROM labels LEFT JOIN documents USING (doc_id)), n AS (SELECT unit, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY unit) - count(*) AS other FROM a WHERE label IS NOT NULL GROUP BY 1, 2),
c AS (SELECT label, sum(n * (n - 1) / 2) AS same, sum(n * other) AS cross_ FROM n GROUP BY 1), s AS (SELECT sum(same + cross_) AS t, sum(cross_) AS x, sum((same + cross_) * (same + cross_)) AS q FROM c),
r AS (SELECT x / t AS observed, (t * t - q) / (t * (t - 1)) AS expected FROM s)
SELECT (SELECT count(DISTINCT unit) FROM a) AS units, round(observed, 6) AS observed, round(expected, 6) AS expected, round(1 - observed / expected, 6) AS alpha, CASE WHEN 1 - observed / expected >= 0.8 THEN 'excellent' WHEN 1 - observed / expected >= 0.67 THEN 'good' WHEN 1 - observed / expected >= 0.4 THEN 'fair' ELSE 'poor' END AS level FROM r""")
def q_iaa_alpha(t: Tables) -> DataFrame:
    """Two marks of each document as annotators, and a third who marks by length."""
    third = F.when(F.col("n_chars") >= 1000, 1).otherwise(0)
    both = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id", "left")
    rows = both.select(F.col("doc_id").alias("unit"), F.posexplode(F.array("quality", "toxic", third)).alias("annotator", "label"))
    return K.alpha(rows)


_BAD = " OR ".join(f"regexp_matches(trim(text), '{p}')" for p in K.PLACEHOLDERS)
_WEIGHT = "(CASE turn % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.87 ELSE 0.56 END)"


@query(f"""WITH c AS (SELECT conv_id, turn, trim(text) AS x FROM conversations WHERE NOT ({_BAD}) AND length(trim(text)) >= 80),
s AS (SELECT conv_id, turn, round({_WEIGHT} * least(1.5, 0.6 + 0.6 * least(1.0, length(x) / 800) + 0.3 * CASE WHEN length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) / length(x) < 0.4 THEN 0.0 ELSE least(1.0, len(regexp_extract_all(x, '{K.ENGLISH}')) / 10) END), 6) AS score FROM c)
SELECT conv_id AS entity, turn AS position, score, round(least(1.0, score / 1.5), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rn FROM s) WHERE rn = 1""")
def q_pick_text(t: Tables) -> DataFrame:
    claims = t.conversations.select(F.col("conv_id").alias("entity"), F.col("turn").alias("position"), "text")
    return K.pick_text(claims, F.when(F.col("position") % 3 == 0, 0.95).when(F.col("position") % 3 == 1, 0.87).otherwise(0.56))


@query("WITH v AS (SELECT l_partkey AS entity, max(l_quantity) AS value, min(l_quantity) FILTER (l_suppkey % 4 = 0) AS anchor FROM lineitem GROUP BY 1) SELECT entity, value, coalesce(abs(value - anchor) / greatest(abs(anchor), 1.0) > 0.2, false) AS refused FROM v")
def q_drift_guard(t: Tables) -> DataFrame:
    votes = t.lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(F.max("l_quantity").alias("value"), F.min(F.when(F.col("l_suppkey") % 4 == 0, F.col("l_quantity"))).alias("anchor"))
    return K.drift_guard(votes, 0.2).select("entity", "value", "refused")


@query("""WITH m AS (SELECT l_orderkey AS entity, l_linenumber % 4 AS part, l_suppkey % 60 + (l_linenumber % 2) / 2 AS number FROM lineitem), p AS (SELECT entity, part, count(*) AS size, min(CASE WHEN number = floor(number) THEN number END) AS start FROM m GROUP BY 1, 2),
d AS (SELECT entity, max(n) AS times FROM (SELECT entity, number, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1), b AS (SELECT *, coalesce(start < max(start) OVER (PARTITION BY entity ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS back FROM p),
e AS (SELECT entity, count(*) AS parts, bool_or(back) AS back, list_sort(list(size)) AS sizes FROM b GROUP BY 1)
SELECT entity, CASE WHEN parts < 3 THEN 'few' WHEN times > 1 THEN 'twice' WHEN back THEN 'order' WHEN NOT sizes[len(sizes) // 2 + 1] BETWEEN 2 AND 30 THEN 'median' END AS reason FROM e JOIN d USING (entity)""")
def q_partition_gate(t: Tables) -> DataFrame:
    number = F.col("l_suppkey") % 60 + (F.col("l_linenumber") % 2) / 2
    return K.partition_gate(t.lineitem.select(F.col("l_orderkey").alias("entity"), (F.col("l_linenumber") % 4).alias("part"), number.alias("number")))


@query("WITH n AS (SELECT DISTINCT l_partkey AS entity, cast(floor(l_quantity) AS INTEGER) AS n FROM lineitem), a AS (SELECT *, lead(n) OVER (PARTITION BY entity ORDER BY n) AS nxt FROM n) SELECT entity, cast(unnest(generate_series(greatest(n + 1, nxt - 5), nxt - 1)) AS INTEGER) AS filled FROM a WHERE nxt > n + 1")
def q_small_gap_fill(t: Tables) -> DataFrame:
    return K.small_gaps(t.lineitem.select(F.col("l_partkey").alias("entity"), F.col("l_quantity").alias("number")))


@query("WITH m AS (SELECT l_orderkey, l_quantity + CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0 END AS x FROM lineitem) SELECT l_orderkey, coalesce(min(x) FILTER (x = floor(x)), min(x)) AS first_member, coalesce(max(x) FILTER (x = floor(x)), max(x)) AS last_member FROM m GROUP BY 1")
def q_member_range(t: Tables) -> DataFrame:
    """The ends of an entity's members, whole numbers before others."""
    x = F.col("l_quantity") + F.when(F.col("l_linenumber") % 2 == 0, 0.5).otherwise(0)
    whole = F.when(x == F.floor(x), x)
    return t.lineitem.groupBy("l_orderkey").agg(F.coalesce(F.min(whole), F.min(x)).alias("first_member"), F.coalesce(F.max(whole), F.max(x)).alias("last_member"))


@query("SELECT role, cast(sum(len(string_split(text, ' '))) AS BIGINT) AS words, cast(sum(len(list_filter(string_split(text, ' '), lambda w: length(w) > 6))) AS BIGINT) AS long_words, round(sum(len(list_filter(string_split(text, ' '), lambda w: length(w) > 6))) / nullif(sum(len(string_split(text, ' '))), 0), 6) AS share FROM conversations GROUP BY 1")
def q_array_len_ratio(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    rows = t.conversations.select("role", F.size(words).alias("n"), F.size(F.filter(words, lambda w: F.length(w) > 6)).alias("long"))
    return rows.groupBy("role").agg(F.sum("n").alias("words"), F.sum("long").alias("long_words"), F.round(C.safe_ratio(F.sum("long"), F.sum("n")), 6).alias("share"))


@query("SELECT user_id, cast(floor(max(CASE WHEN value BETWEEN 1 AND 50 THEN value END)) AS BIGINT) AS most FROM events GROUP BY 1")
def q_floor_max(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.floor(F.max(F.when(F.col("value").between(1, 50), F.col("value")))).alias("most"))


@query("SELECT source, lang, count(*) AS pages, round(avg(n_chars), 4) AS mean_chars, count(*) FILTER (n_chars < 200) AS short_pages FROM documents GROUP BY 1, 2")
def q_page_averages(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("pages"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("n_chars") < 200).alias("short_pages"))


@query("""WITH a AS (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderdate, o_orderkey) AS rn FROM orders), f AS (SELECT o_custkey, p, min(rn) AS rn FROM a GROUP BY 1, 2)
SELECT o_custkey, string_agg(p, ',' ORDER BY rn) AS priorities FROM f GROUP BY 1""")
def q_array_union(t: Tables) -> DataFrame:
    """The values of two arrays, those of the first first, each once, in order; no entity has many orders."""
    of = lambda done: F.transform(F.array_sort(F.collect_list(F.when((F.col("o_orderstatus") == "F") == F.lit(done), F.struct("o_orderdate", "o_orderkey", "o_orderpriority")))), lambda x: x["o_orderpriority"])
    both = t.orders.groupBy("o_custkey").agg(of(True).alias("a"), of(False).alias("b"))
    return both.select("o_custkey", F.array_join(F.array_union("a", "b"), ",").alias("priorities"))


@query(f"SELECT event_type, count(*) FILTER (user_id % 3 = 0 OR ts + to_days(cast(value AS INTEGER)) > TIMESTAMP '{_NOW}') AS active, count(*) AS n FROM events GROUP BY 1")
def q_expiry(t: Tables) -> DataFrame:
    """Entries without an expiry, or with one after a fixed now; it lies whole days ahead, half days go to the even one."""
    expiry = F.when(F.col("user_id") % 3 != 0, F.col("ts").cast("timestamp") + F.make_dt_interval(F.bround("value").cast("int")))
    return t.events.withColumn("expiry", expiry).groupBy("event_type").agg(F.count_if(F.col("expiry").isNull() | (F.col("expiry") > F.lit(_NOW).cast("timestamp"))).alias("active"), F.count("*").alias("n"))


@query(f"SELECT event_id, CASE WHEN event_type = 'view' THEN 'seen' ELSE 'base' END AS src, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE ts + INTERVAL 20 DAY > TIMESTAMP '{_NOW}'")
def q_hash_merge(t: Tables) -> DataFrame:
    """Fields of two hashes, the later one's win, read while they have not run out."""
    old = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("src"), F.lit("base")))
    new = F.when(F.col("event_type") == "view", F.create_map(F.lit("src"), F.lit("seen"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    rows = t.events.where(F.col("ts").cast("timestamp") + F.expr("interval 20 days") > F.lit(_NOW).cast("timestamp")).select("event_id", merged.alias("h"))
    return rows.select("event_id", F.col("h.src").alias("src"), F.col("h.k").cast("long").alias("k"))


@query("SELECT event_id + 1000000 AS job_id, user_id, ts + to_minutes(cast(5 * (user_id % 7 + 1) AS INTEGER)) AS run_at FROM events WHERE event_type = 'error'")
def q_enqueue(t: Tables) -> DataFrame:
    """Jobs to append, with the time at which each is due."""
    due = F.col("ts") + F.make_dt_interval(mins=(5 * (F.col("user_id") % 7 + 1)).cast("int"))
    return t.events.where("event_type = 'error'").select((F.col("event_id") + 1_000_000).alias("job_id"), "user_id", due.alias("run_at"))


@query("SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"apiToken\":\"[REDACTED]\"}' AS safe FROM events")
def q_redact(t: Tables) -> DataFrame:
    """Values under sensitive keys are replaced, whatever the case of the key."""
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("apiToken"), F.col("user_id").cast("string")))
    safe = F.transform_values(props, lambda k, v: F.when(k.rlike("(?i)(password|secret|token|api_?key|authorization)"), "[REDACTED]").otherwise(v))
    return t.events.select("event_id", F.to_json(safe).alias("safe"))


@query("SELECT p_partkey, item FROM part, unnest([p_size, p_size + 1, p_size % 3]) x(item) WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 2 = 1")
def q_array_elements(t: Tables) -> DataFrame:
    """Elements of a JSON array, a row with null where there is none."""
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("["), F.concat_ws(",", "p_size", F.col("p_size") + 1, F.col("p_size") % 3), F.lit("]")))
    return t.part.select("p_partkey", F.explode_outer(F.from_json(F.coalesce(text, F.lit("[]")), "array<int>")).alias("item"))


_RATING = "CASE p_size % 4 WHEN 0 THEN concat(p_size) WHEN 1 THEN concat('{\"value\": ', p_size, '.5}') WHEN 2 THEN '{\"other\": 1}' ELSE '{broken' END"


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN cast(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5 ELSE 0 END AS rating FROM part")
def q_polymorphic_json(t: Tables) -> DataFrame:
    """A number, or an object with one under value, else 0."""
    x = F.expr(_RATING)
    return t.part.select("p_partkey", F.coalesce(x.try_cast("double"), F.get_json_object(x, "$.value").try_cast("double"), F.lit(0.0)).alias("rating"))


@query("SELECT p_size % 4 AS kind, count(*) AS n, cast(sum(CASE p_size % 4 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS objects FROM part GROUP BY 1")
def q_lenient_json(t: Tables) -> DataFrame:
    """Text that does not parse as an object falls back to an empty one."""
    parsed = F.coalesce(F.from_json(F.expr(_RATING), "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
    return t.part.groupBy((F.col("p_size") % 4).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.size(parsed) > 0).alias("objects"))


@query("SELECT CASE WHEN n_chars >= 4000 THEN 'gold' WHEN n_chars >= 1500 THEN 'silver' WHEN n_chars >= 300 THEN 'bronze' ELSE 'none' END AS tier, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, count(DISTINCT source) AS sources, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def q_tier_stats(t: Tables) -> DataFrame:
    tier = F.when(F.col("n_chars") >= 4000, "gold").when(F.col("n_chars") >= 1500, "silver").when(F.col("n_chars") >= 300, "bronze").otherwise("none")
    rows = t.documents.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_distinct("source").alias("sources"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # four rows


@query("SELECT doc_id, concat_ws(',', CASE WHEN n_chars > 500 THEN 'SUMMARIZATION' END, CASE WHEN contains(text, '?') THEN 'QA' END, CASE WHEN lang <> 'en' THEN 'TRANSLATION' END, CASE WHEN contains(text, chr(10)) THEN 'INSTRUCTION_TUNING' END) AS uses FROM documents WHERE n_chars >= 300")
def q_use_cases(t: Tables) -> DataFrame:
    """The uses that a document is fit for, in a stated order; documents of a tier or more."""
    uses = F.array_compact(F.array(F.when(F.col("n_chars") > 500, "SUMMARIZATION"), F.when(F.contains("text", F.lit("?")), "QA"), F.when(F.col("lang") != "en", "TRANSLATION"), F.when(F.contains("text", F.lit("\n")), "INSTRUCTION_TUNING")))
    return t.documents.where("n_chars >= 300").select("doc_id", F.array_join(uses, ",").alias("uses"))


@query("WITH d AS (SELECT DISTINCT user_id, cast(ts AS DATE) AS day FROM events), r AS (SELECT user_id, max(day) AS last_day, count(*) AS n FROM (SELECT *, day - cast(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d) GROUP BY user_id, island) SELECT user_id, max(n) AS longest, coalesce(max(n) FILTER (last_day >= (SELECT max(cast(ts AS DATE)) - 1 FROM events)), 0) AS current FROM r GROUP BY 1")
def q_streaks(t: Tables) -> DataFrame:
    """The longest run of days, and the one that lasts: its last day is today (the last of all) or the day before."""
    today = t.events.agg(F.max(F.col("ts").cast("date")).alias("today"))
    runs = S.streaks(t.events, "user_id", "ts").crossJoin(F.broadcast(today))
    return runs.groupBy("user_id").agg(F.max("length").alias("longest"), F.coalesce(F.max(F.when(F.col("last_day") >= F.date_sub("today", 1), F.col("length"))), F.lit(0)).alias("current"))


@query("WITH m AS (SELECT *, epoch_us(ts) // 1000000 AS s, (SELECT max(epoch_us(ts) // 1000000) FROM events) AS now FROM events WHERE event_type IN ('view', 'purchase')), n AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY ts, event_id), now) AS e FROM m) SELECT user_id, cast(sum(least(e - s, 86400)) AS BIGINT) AS seconds, count(*) AS sessions FROM n WHERE event_type = 'view' GROUP BY 1")
def q_login_sessions(t: Tables) -> DataFrame:
    """As q_session_pairs, a session that is still open lasting until now (the time of the last event)."""
    now = t.events.agg(F.unix_timestamp(F.max("ts").cast("timestamp")).alias("now"))
    found = S.paired_sessions(t.events.crossJoin(F.broadcast(now)), "user_id", "ts", "view", "purchase", 86_400, now="now")
    return found.groupBy("user_id").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("sessions"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, min(l_suppkey % 50) AS a, max(l_suppkey % 50 + l_quantity / 10) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
q AS (SELECT l_orderkey, count(*) AS parts, count(*) FILTER (a < pa) / (count(*) - 1) AS back, count(*) FILTER (a <= pb) / (count(*) - 1) AS inside, count(*) FILTER (n >= 2 AND b - a + 1 > 3 * n) / count(*) AS wide FROM p GROUP BY 1 HAVING count(*) >= 3) SELECT l_orderkey, back > 0.3 AS back, inside > 0.3 AS inside, wide > 0.3 AS wide FROM q""")
def q_neighbour_ratios(t: Tables) -> DataFrame:
    """Numbered ranges that go back, overlap, or are wide for what they hold, in more than 0.3 of the places; three ranges at least."""
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_suppkey") % 50).alias("a"), F.max(F.col("l_suppkey") % 50 + F.col("l_quantity") / 10).alias("b"), F.count("*").alias("n"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    rows = rows.withColumns({"pa": F.lag("a").over(order), "pb": F.lag("b").over(order)}).groupBy("l_orderkey")
    share = lambda c, n: (C.safe_ratio(F.count_if(c), n) > 0.3)
    n = F.count("*")
    return rows.agg(share(F.expr("a < pa"), n - 1).alias("back"), share(F.expr("a <= pb"), n - 1).alias("inside"), share(F.expr("n >= 2 and b - a + 1 > 3 * n"), n).alias("wide"), n.alias("parts")).where("parts >= 3").drop("parts")


@query("SELECT page_id, CASE WHEN greatest(a, b, c) < 2 THEN 'none' WHEN a >= b AND a >= c THEN 'article' WHEN b >= c THEN 'links' ELSE 'form' END AS kind FROM (SELECT page_id, 10 * len(regexp_extract_all(html, '<article')) + len(regexp_extract_all(html, '<p>')) AS a, 3 * len(regexp_extract_all(html, '<a href')) + len(regexp_extract_all(html, '<li>')) AS b, 10 * len(regexp_extract_all(html, '<form')) + 3 * len(regexp_extract_all(html, '<input')) AS c FROM pages)")
def q_weighted_keyword_class(t: Tables) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p))
    scores = {"article": 10 * n("<article") + n("<p>"), "links": 3 * n("<a href") + n("<li>"), "form": 10 * n("<form") + 3 * n("<input")}
    return t.pages.select("page_id", C.first_best(scores, 2, "none").alias("kind"))


@query("WITH x AS (SELECT event_id, user_id, exp((value - max(value) OVER (PARTITION BY user_id)) / 10) AS e FROM events) SELECT event_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS p FROM x")
def q_softmax(t: Tables) -> DataFrame:
    every = Window.partitionBy("user_id")
    rows = t.events.withColumn("e", F.exp((F.col("value") - F.max("value").over(every)) / 10))
    return rows.select("event_id", F.round(F.col("e") / F.sum("e").over(every), 6).alias("p"))


@query("SELECT l_orderkey, CASE WHEN count(*) % 2 = 1 THEN median(l_quantity) ELSE floor(median(l_quantity) + 0.5) END AS median FROM lineitem GROUP BY 1")
def q_rounded_median(t: Tables) -> DataFrame:
    """Counted by value, so no group is listed."""
    median = F.percentile("l_quantity", 0.5)
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.count("l_quantity") % 2 == 1, median).otherwise(C.half_up(median).cast("double")).alias("median"))


_ANSWER = "regexp_extract(text, '[A-Za-z]{7,}', 0)"


_ROUND = 200
_AT = f"strpos(text, {_ANSWER})"


@query(f"SELECT conv_id, turn, conv_id || '-' || turn AS id, {_ANSWER} AS answer, least({_AT} - 1, {_ROUND}) AS answer_start, substr(text, greatest(1, {_AT} - {_ROUND}), least({_AT} - 1, {_ROUND}) + length({_ANSWER}) + {_ROUND}) AS context FROM conversations WHERE {_ANSWER} <> ''")
def q_export_squad(t: Tables) -> DataFrame:
    """Question records: the answer, the text round it as context, and where the answer begins in that."""
    rows = t.conversations.withColumn("answer", F.regexp_extract("text", "[A-Za-z]{7,}", 0)).where("answer <> ''").withColumn("at", F.instr("text", F.col("answer")))
    start = F.least(F.col("at") - 1, F.lit(_ROUND))
    context = F.substring(F.col("text"), F.greatest(F.lit(1), F.col("at") - _ROUND), start + F.length("answer") + _ROUND)
    return rows.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), "answer", start.cast("long").alias("answer_start"), context.alias("context"))


@query(f"""WITH a AS (SELECT conv_id, turn, text, {_ANSWER} AS own, md5(conv_id || '-' || turn) AS h FROM conversations WHERE {_ANSWER} <> ''), n AS (SELECT *, lead(own) OVER w AS other, first_value(own) OVER w AS first FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY h))
SELECT conv_id, turn, coalesce(other, first) AS asked, NOT contains(text, coalesce(other, first)) AS impossible FROM n WHERE own <> coalesce(other, first)""")
def q_export_negatives(t: Tables) -> DataFrame:
    """For each turn the answer of another turn of its conversation, by a hash, and whether its own text lacks it: a question without an answer."""
    rows = t.conversations.withColumn("own", F.regexp_extract("text", "[A-Za-z]{7,}", 0)).where("own <> ''")
    by = Window.partitionBy("conv_id").orderBy(F.md5(F.concat_ws("-", "conv_id", "turn").cast("binary")))
    asked = F.coalesce(F.lead("own").over(by), F.first("own").over(by))
    rows = rows.withColumn("asked", asked).where("own <> asked")
    return rows.select("conv_id", "turn", "asked", (~F.contains("text", "asked")).alias("impossible"))


@query("SELECT doc_id, '---' || chr(10) || 'id: \"' || doc_id || '\"' || chr(10) || 'lang: \"' || lang || '\"' || chr(10) || 'source: \"' || replace(source, '\"', '\\\"') || '\"' || chr(10) || '---' || chr(10) || chr(10) || text AS markdown FROM documents")
def q_export_markdown(t: Tables) -> DataFrame:
    fields = {"id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source")}
    return t.documents.select("doc_id", K.front_matter(fields, F.col("text")).alias("markdown"))


@query(None)
def q_ner_spans(t: Tables) -> DataFrame:
    """Offsets of a title's words, the last first, and of a word twice: each takes the first place that is free."""
    words = F.split("p_name", " ")
    text = F.concat_ws(" ", "p_name", "p_type", "p_name")
    terms = F.concat(F.reverse(words), F.array(F.get(words, F.lit(0)), F.lit(""), F.lit("missing")))
    rows = t.part.select("p_name", "p_type").distinct()
    return rows.select("p_name", "p_type", F.transform(K.first_spans(text, terms), lambda s: F.format_string("%s:%d:%d", s["term"], s["start"], s["end"])).alias("spans")).select("p_name", "p_type", F.array_join("spans", ",").alias("spans"))


@query("SELECT p_partkey, regexp_matches(p_name, '(?i)^RED|bolt$') AS by_pattern, contains(lower(p_name), '(red') AS by_text FROM part")
def q_regex_search(t: Tables) -> DataFrame:
    """A search by pattern in any case; one that is no pattern is searched for as text."""
    return t.part.select("p_partkey", C.pattern_or_text(t.spark, F.col("p_name"), "^RED|bolt$").alias("by_pattern"), C.pattern_or_text(t.spark, F.col("p_name"), "(red").alias("by_text"))


@query("WITH s AS (SELECT user_id % 5 AS server, user_id, max(ts) AS seen FROM events GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events) SELECT server, count(*) AS subscribers, max(seen) AS last_seen FROM s, n WHERE seen >= now - INTERVAL 5 DAY GROUP BY 1")
def q_route_active(t: Tables) -> DataFrame:
    """Servers with a subscriber seen lately, and how many each has: where a message of a channel goes."""
    now = t.events.agg(F.max("ts").alias("now"))
    seen = t.events.groupBy((F.col("user_id") % 5).alias("server"), "user_id").agg(F.max("ts").alias("seen"))
    live = seen.crossJoin(F.broadcast(now)).where("seen >= now - interval 5 days")
    return live.groupBy("server").agg(F.count("*").alias("subscribers"), F.max("seen").alias("last_seen"))


@query("WITH d AS (SELECT DISTINCT event_id FROM events WHERE event_type = 'view') SELECT e.user_id, count(*) AS waiting, min(e.event_id) AS oldest FROM events e LEFT JOIN d USING (event_id) WHERE d.event_id IS NULL GROUP BY 1")
def q_undelivered(t: Tables) -> DataFrame:
    """Messages without a mark of delivery; a mark that comes twice counts once, so a batch can be sent again."""
    marks = t.events.where("event_type = 'view'").select("event_id").distinct()
    left = t.events.join(marks, "event_id", "left_anti")
    return left.groupBy("user_id").agg(F.count("*").alias("waiting"), F.min("event_id").alias("oldest"))


@query("""WITH s AS (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id)) AS seen FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT e.user_id, count(*) AS waiting, min(e.ts) AS since, max(s.user_id) IS NOT NULL AS reader FROM events e LEFT JOIN s USING (user_id) WHERE event_type <> 'view' AND (seen IS NULL OR e.ts > seen.ts OR (e.ts = seen.ts AND e.event_id > seen.event_id)) GROUP BY 1""")
def q_unacknowledged(t: Tables) -> DataFrame:
    """Messages of a user after the last one that the user acknowledged (a view): an acknowledgement marks all before it, and one that comes late moves nothing back."""
    at = F.struct("ts", "event_id")
    seen = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.max(at).alias("seen"))
    left = t.events.where("event_type <> 'view'").join(seen, "user_id", "left").where(F.col("seen").isNull() | (at > F.col("seen")))
    return left.groupBy("user_id").agg(F.count("*").alias("waiting"), F.min("ts").alias("since"), F.max("seen").isNotNull().alias("reader"))


@query("WITH a AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events WHERE event_type = 'error') SELECT user_id, event_id, CASE WHEN age > 10 THEN 'evicted' WHEN attempt % 4 = 0 THEN 'dead' ELSE 'retry' END AS state, cast(CASE WHEN age <= 10 AND attempt % 4 <> 0 THEN least(30, pow(2, attempt % 4)) END AS BIGINT) AS wait FROM a")
def q_retry_queue(t: Tables) -> DataFrame:
    """A queue of the newest ten entries: older ones are evicted, those of the fourth attempt dead, others wait up to 30 seconds."""
    by = Window.partitionBy("user_id")
    rows = t.events.where("event_type = 'error'").select("user_id", "event_id", F.row_number().over(by.orderBy("ts", "event_id")).alias("attempt"), F.row_number().over(by.orderBy(F.desc("ts"), F.desc("event_id"))).alias("age"))
    state = F.when(F.col("age") > 10, "evicted").when(F.col("attempt") % 4 == 0, "dead").otherwise("retry")
    return rows.select("user_id", "event_id", state.alias("state"), F.when(state == "retry", F.least(F.lit(30.0), C.backoff_seconds(2, F.col("attempt") % 4))).cast("long").alias("wait"))
