"""Queries over overlapping ranges, cascaded matches, claims of several providers, and event streams as batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.functions import columns as C, folding
from tomelight.operators import consensus, ranges, relational as R

from .registry import Tables, query
from .relational import key_of_props

_PROVIDERS = "['anilist','mangadex','mal','mangaupdates','kitsu','comicvine','fandom','wikipedia']"
_COUNTS = f"SELECT l_partkey AS entity, ({_PROVIDERS})[1 + l_suppkey % 8] AS provider, l_quantity AS value FROM lineitem"


def _counts(t: Tables) -> DataFrame:
    """All the numbers that providers claim for an entity."""
    name = F.element_at(F.array(*map(F.lit, consensus.WEIGHTS)), (F.col("l_suppkey") % 8 + 1).cast("int"))
    return t.lineitem.select(F.col("l_partkey").alias("entity"), name.alias("provider"), F.col("l_quantity").alias("value"))


@query("SELECT a.o_custkey, count(*) AS pairs, cast(sum(least(a.d, b.d) + 20 - greatest(a.d, b.d)) AS BIGINT) AS days FROM (SELECT o_custkey, o_orderkey, cast(o_orderdate AS DATE) - DATE '1970-01-01' AS d FROM orders) a JOIN (SELECT o_custkey, o_orderkey, cast(o_orderdate AS DATE) - DATE '1970-01-01' AS d FROM orders) b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.d <= b.d + 20 AND b.d <= a.d + 20 GROUP BY 1")
def q_overlap_join(t: Tables) -> DataFrame:
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    rows = t.orders.select("o_custkey", "o_orderkey", day.alias("first"), (day + 20).alias("last"))
    pairs = ranges.overlap_join(rows, rows, "o_custkey", "first", "last", 40, "l.o_orderkey < r.o_orderkey")
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.sum(F.col("until") - F.col("since")).cast("long").alias("days"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity BETWEEN 1 AND p_size THEN 1 WHEN l_quantity BETWEEN p_size - 5 AND p_size + 10 THEN 2 WHEN l_quantity BETWEEN 40 AND 45 THEN 3 END AS volume FROM lineitem JOIN part ON p_partkey = l_partkey")
def q_range_containment(t: Tables) -> DataFrame:
    """The first of an entity's numbered ranges that holds a number; null if none does."""
    spans = [(F.lit(1), F.col("p_size")), (F.col("p_size") - 5, F.col("p_size") + 10), (F.lit(40), F.lit(45))]
    volumes = t.part.select(F.col("p_partkey").alias("l_partkey"), F.array(*(F.struct(F.lit(k).cast("long").alias("number"), a.alias("first"), b.alias("last")) for k, (a, b) in enumerate(spans, 1))).alias("spans"))
    inside = F.filter("spans", lambda s: F.col("l_quantity").between(s["first"], s["last"]))
    return t.lineitem.join(volumes, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.get(inside, F.lit(0))["number"].alias("volume"))


@query("SELECT event_id, target FROM events LEFT JOIN (SELECT cast(p_size AS BIGINT) AS k, min(p_partkey) AS target FROM part GROUP BY 1) ON k = cast(json_extract_string(props, '$.k') AS BIGINT)")
def q_external_id_resolve(t: Tables) -> DataFrame:
    targets = t.part.groupBy(F.col("p_size").cast("long").alias("k")).agg(F.min("p_partkey").alias("target"))
    return t.events.select("event_id", key_of_props().alias("k")).join(targets, "k", "left").select("event_id", "target")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN held > 0 THEN 'queued' ELSE 'queue' END AS action FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS held FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def q_action_case(t: Tables) -> DataFrame:
    held = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("held"))
    action = F.when(F.col("held").isNull(), "missing").when(F.col("held") > 0, "queued").otherwise("queue")
    return t.customer.select("c_custkey").join(held, "c_custkey", "left").select("c_custkey", action.alias("action"))


@query("SELECT p_partkey, CASE WHEN lower(p_name) IN ('red ring', 'small box') THEN 'title' WHEN regexp_matches(lower(p_name), 'ring$') THEN 'ring$' WHEN regexp_matches(lower(p_name), '^(small|big) ') THEN '^(small|big) ' END AS reason FROM part")
def q_blocklist_match(t: Tables) -> DataFrame:
    """Exact titles first, then the first pattern of a stated list that matches; every row gets a result."""
    return t.part.select("p_partkey", C.first_block(t.spark, F.col("p_name"), ["Red ring", "small box"], ["ring$", "^(small|big) ", "(broken"]).alias("reason"))


@query("""WITH w AS (SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM events)
SELECT event_id, coalesce(a.p, b.p) AS p_partkey, CASE WHEN a.p IS NOT NULL THEN 0 WHEN b.p IS NOT NULL THEN 1 END AS clause FROM w
LEFT JOIN (SELECT p_partkey AS x, p_size AS y, p_partkey AS p FROM part) a ON a.x = w.user_id AND a.y = w.k LEFT JOIN (SELECT p_size AS y, min(p_partkey) AS p FROM part GROUP BY 1) b ON b.y = w.k""")
def q_identity_cascade(t: Tables) -> DataFrame:
    """The first clause with a match names the entity: by both keys, then by the second key alone."""
    wanted = t.events.select("event_id", F.col("user_id").alias("a"), key_of_props().alias("b"))
    known = t.part.select(F.col("p_partkey").alias("a"), F.col("p_size").cast("long").alias("b"), "p_partkey")
    return R.match_cascade(wanted, known, [["a", "b"], ["b"]], "p_partkey", "clause").select("event_id", "p_partkey", "clause")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a.s_name AS by_id, b.s_name AS by_number FROM lineitem LEFT JOIN supplier a ON a.s_suppkey = l_suppkey LEFT JOIN supplier b ON b.s_suppkey = l_linenumber * 2")
def q_double_left_join(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") * 2).cast("long").alias("other"))
    lines = lines.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("by_id")), "l_suppkey", "left")
    return lines.join(t.supplier.select(F.col("s_suppkey").alias("other"), F.col("s_name").alias("by_number")), "other", "left").drop("other")


@query("SELECT l_orderkey, count(*) AS missing FROM (SELECT DISTINCT l_orderkey, l_linenumber AS s FROM lineitem WHERE l_returnflag <> 'A' EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1")
def q_signature_missing(t: Tables) -> DataFrame:
    sign = t.lineitem.select("l_orderkey", F.coalesce(F.concat(F.lit("ch:"), F.col("l_linenumber").cast("string")), F.concat(F.lit("raw:"), "l_linestatus")).alias("s"), "l_returnflag")
    wanted, held = sign.where("l_returnflag <> 'A'").select("l_orderkey", "s").distinct(), sign.where("l_returnflag = 'A'")
    return wanted.join(held, ["l_orderkey", "s"], "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("missing"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1996-01-01') AS before, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS after FROM customer")
def q_snapshot_counts(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.expr("o_orderdate < timestamp_ntz'1996-01-01'")).alias("before"), F.count("*").alias("after"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").na.fill(0, ["before", "after"])


@query("SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus NOT IN ('P', 'O')) AS latest, count(*) AS n, max(o_totalprice) AS most, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY 1")
def q_latest_per_entity(t: Tables) -> DataFrame:
    closed = ~F.col("o_orderstatus").isin("P", "O")
    return t.orders.groupBy("o_custkey").agg(F.max(F.when(closed, F.col("o_orderdate"))).alias("latest"), F.count("*").alias("n"), F.max("o_totalprice").alias("most"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey) > 1 THEN 'CANCELLED' ELSE o_orderstatus END AS status FROM orders")
def q_dedupe_mark(t: Tables) -> DataFrame:
    """Of a key's active rows the newest stays; the others are marked, not dropped."""
    active = F.col("o_orderstatus").isin("O", "P")
    rn = F.row_number().over(Window.partitionBy("o_custkey", active).orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return t.orders.select("o_orderkey", F.when(active & (rn > 1), "CANCELLED").otherwise(F.col("o_orderstatus")).alias("status"))


@query("WITH w AS (SELECT o_custkey, o_totalprice < lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS down FROM orders) SELECT o_custkey, round(count(*) FILTER (down) / (count(*) - 1), 6) AS ratio FROM w GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (down) / (count(*) - 1) > 0.3")
def q_neighbour_violations(t: Tables) -> DataFrame:
    """Keys with three rows or more where over 30 % of neighbours are out of order."""
    down = F.col("o_totalprice") < F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    found = t.orders.select("o_custkey", down.alias("down")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if("down").alias("bad"))
    return found.where("n >= 3").select("o_custkey", F.round(F.col("bad") / (F.col("n") - 1), 6).alias("ratio")).where("ratio > 0.3")


@query("SELECT event_id, user_id FROM events ORDER BY ts >= TIMESTAMP '2024-01-08', value, ts, event_id LIMIT 40")
def q_evict_topk(t: Tables) -> DataFrame:
    """Expired rows first, then the least used, then the oldest."""
    return t.events.orderBy(F.expr("ts >= timestamp_ntz'2024-01-08'"), "value", "ts", "event_id").limit(40).select("event_id", "user_id")


@query("SELECT user_id AS id FROM events UNION SELECT cast(json_extract_string(props, '$.k') AS BIGINT) FROM events")
def q_union_json_ids(t: Tables) -> DataFrame:
    ids = F.array("user_id", key_of_props())
    return t.events.select(F.explode(ids).alias("id")).distinct()


@query("SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def q_json_each(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")))


@query("SELECT 'list' AS source, l_orderkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 2 UNION ALL SELECT 'text', l_orderkey, max(l_quantity) FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY 2")
def q_precedence_union(t: Tables) -> DataFrame:
    """Rows of the list win over rows of the text with the same key: one roll-up of both, no join."""
    groups = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.expr("case when l_returnflag = 'A' then l_quantity end")).alias("a"), F.max(F.expr("case when l_returnflag <> 'A' then l_quantity end")).alias("b"))
    return groups.select(F.when(F.col("a").isNotNull(), "list").otherwise("text").alias("source"), "k", F.coalesce("a", "b").alias("v"))


@query("SELECT p_partkey, round(len(list_filter(['red', 'ring', 'box'], lambda w: contains(lower(p_name), w))) / 3, 6) AS ratio FROM part")
def q_term_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(C.term_ratio(F.col("p_name"), ["red", "ring", "box"]), 6).alias("ratio"))


@query("SELECT page_id, regexp_matches(lower(trim(url)), '^https?://[^/]') AND NOT regexp_matches(lower(trim(url)), '^(javascript|data|vbscript|file):|^//') AS safe FROM pages")
def q_url_safety(t: Tables) -> DataFrame:
    return t.pages.select("page_id", C.safe_url(F.col("url")).alias("safe"))


@query("WITH c AS (" + _COUNTS + ") SELECT entity, CASE WHEN count(*) >= 2 AND min(value) >= 0.9 * max(value) THEN max(value) END AS ceiling FROM c GROUP BY 1")
def q_soft_ceiling(t: Tables) -> DataFrame:
    near = (F.count("*") >= 2) & (F.min("value") >= 0.9 * F.max("value"))
    return _counts(t).groupBy("entity").agg(F.when(near, F.max("value")).alias("ceiling"))


@query(None)
def q_vote_numeric(t: Tables) -> DataFrame:
    return consensus.numeric_vote(_counts(t), 0.05)


_RANKED = "WITH p(provider, rank) AS (SELECT unnest(" + _PROVIDERS + "), generate_subscripts(" + _PROVIDERS + ", 1)), c AS (SELECT * FROM (" + _COUNTS + ") JOIN p USING (provider))"


@query(_RANKED + """, s AS (SELECT DISTINCT entity, value AS seed FROM c), k AS (SELECT s.entity, seed, count(*) AS n, count(*) FILTER (provider NOT IN ('anilist', 'mal')) AS others, min(rank) AS rank, min(value) AS lo, max(value) AS hi, median(value) AS mid FROM s JOIN c ON c.entity = s.entity AND abs(value - seed) <= 1 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, others DESC, rank, lo) AS rn FROM k), a AS (SELECT entity, count(*) AS total, min(value) AS least FROM c GROUP BY 1)
SELECT entity, CASE WHEN n >= 2 THEN floor(mid + 0.5) ELSE least END AS value, CASE WHEN n >= 2 AND n = total THEN 'high' WHEN n >= 2 AND NOT EXISTS (SELECT 1 FROM k WHERE k.entity = b.entity AND k.n = b.n AND (k.hi < b.lo OR k.lo > b.hi)) THEN 'medium' ELSE 'low' END AS level FROM b JOIN a USING (entity) WHERE rn = 1""")
def q_count_consensus(t: Tables) -> DataFrame:
    return consensus.count_consensus(_counts(t), 1)


@query("WITH w(provider, rank) AS (SELECT unnest(" + _PROVIDERS + "), generate_subscripts(" + _PROVIDERS + ", 1)), c AS (" + _COUNTS + ") SELECT entity, struct_extract(min({'r': rank, 'v': value}), 'v') AS value, count(DISTINCT value) - 1 AS conflicts FROM c JOIN w USING (provider) GROUP BY 1")
def q_merge_conflicts(t: Tables) -> DataFrame:
    return consensus.first_claim(_counts(t))


@query("WITH c AS (" + _COUNTS + "), m AS (SELECT entity, value, count(*) AS votes FROM c GROUP BY 1, 2) SELECT entity, value, round(votes / sum(votes) OVER (PARTITION BY entity), 6) AS share FROM m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY votes DESC, value) <= 4")
def q_vote_list(t: Tables) -> DataFrame:
    return consensus.list_vote(_counts(t), 4).withColumn("share", F.round("share", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_returnflag = 'A' AND l_quantity > 40) OVER (PARTITION BY l_orderkey, l_linestatus) AS covered FROM lineitem")
def q_archive_coverage(t: Tables) -> DataFrame:
    flag = F.max(F.expr("l_returnflag = 'A' and l_quantity > 40")).over(Window.partitionBy("l_orderkey", "l_linestatus"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag.alias("covered"))


@query("WITH s AS (SELECT o_custkey, o_orderkey, cast(o_orderdate AS DATE) - DATE '1970-01-01' AS a FROM orders), r AS (SELECT *, greatest(a, 1 + max(a + 30) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS first FROM s) SELECT o_orderkey, cast(first AS BIGINT) AS first, cast(a + 30 AS BIGINT) AS last FROM r WHERE first <= a + 30")
def q_boundary_repair(t: Tables) -> DataFrame:
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    rows = t.orders.select("o_custkey", "o_orderkey", day.alias("first"), (day + 30).alias("last"))
    return ranges.trim_overlaps(rows, "o_custkey", "first", "last", "o_orderkey").select("o_orderkey", "first", "last")


def _run_of_failures(failed: Column) -> Column:
    """The number of failures since the key's last success, this row included."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(order)
    return n - F.coalesce(F.max(F.when(~failed, F.col("__n"))).over(order), F.lit(0))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT *, n - coalesce(max(CASE WHEN event_type <> 'error' THEN n END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS run FROM n) SELECT user_id, max(run) AS longest, count(*) FILTER (run = 2) AS opened FROM r GROUP BY 1")
def q_circuit_breaker(t: Tables) -> DataFrame:
    """Runs of failures of each key, and how often one reached the threshold of two."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.select("user_id", "ts", "event_id", "event_type", F.row_number().over(order).cast("long").alias("__n"))
    runs = rows.select("user_id", _run_of_failures(F.col("event_type") == "error").alias("run"))
    return runs.groupBy("user_id").agg(F.max("run").alias("longest"), F.count_if(F.col("run") == 2).alias("opened"))


@query("SELECT event_type, round(count(*) FILTER (value > 10) / count(*), 6) AS availability, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 12 HOUR GROUP BY 1")
def q_availability(t: Tables) -> DataFrame:
    last = t.events.agg((F.max("ts") - F.expr("interval 12 hours")).alias("cutoff"))
    rows = t.events.crossJoin(F.broadcast(last)).where("ts > cutoff")
    return rows.groupBy("event_type").agg(F.round(F.count_if(F.col("value") > 10) / F.count("*"), 6).alias("availability"), F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN user_id % 4 >= 3 THEN 'FAILED' ELSE 'RETRY' END AS status, CASE WHEN user_id % 4 < 3 THEN ts + to_seconds(cast(30 * pow(2, user_id % 4) AS BIGINT)) END AS due FROM events WHERE event_type = 'error'")
def q_stale_recovery(t: Tables) -> DataFrame:
    """Expired leases: fail when the attempts are used up, else retry after a back-off."""
    attempts = F.col("user_id") % 4
    due = F.col("ts") + F.make_dt_interval(secs=C.backoff_seconds(30.0, attempts + 1).cast("decimal(18,6)"))
    return t.events.where("event_type = 'error'").select("event_id", F.when(attempts >= 3, "FAILED").otherwise("RETRY").alias("status"), F.when(attempts < 3, due).alias("due"))


@query("SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_shipdate, l_orderkey, l_linenumber")
def q_distinct_on(t: Tables) -> DataFrame:
    """The first row of each key, as one aggregate of structs: no sort."""
    first = F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    return t.lineitem.groupBy("l_partkey").agg(first.alias("x")).select("l_partkey", "x.l_orderkey", "x.l_linenumber")


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 480000")
def q_except_chain(t: Tables) -> DataFrame:
    """Keys of the first set that neither other holds, from one pass over the table."""
    groups = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.expr("(o_orderstatus = 'P' and o_totalprice > 300000) or o_totalprice > 480000")).alias("out"))
    return groups.where("not coalesce(out, false)").select("k")


@query("SELECT l_orderkey, l_linenumber, arg_min(l_returnflag, l_suppkey) FILTER (l_returnflag <> 'N') AS flag, min(l_suppkey) FILTER (l_tax > 0.02) AS supplier FROM (SELECT l_orderkey, l_linenumber, l_suppkey, min(l_returnflag) FILTER (l_returnflag <> 'N') AS l_returnflag, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2")
def q_coalesce_merge(t: Tables) -> DataFrame:
    """Duplicates by key merged: of each column the first value that is not null, in order of the source."""
    flag = F.when(F.col("l_returnflag") != "N", F.struct("l_suppkey", "l_returnflag"))
    supplier = F.when(F.col("l_tax") > 0.02, F.col("l_suppkey"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(flag)["l_returnflag"].alias("flag"), F.min(supplier).alias("supplier"))


@query("SELECT l_orderkey, round((CASE WHEN max(l_quantity) > 45 THEN 0.7 ELSE 1.0 END) * (CASE WHEN count(*) <> max(l_linenumber) THEN 0.8 ELSE 1.0 END) * pow(0.9, count(*) FILTER (l_quantity < 10)), 6) AS confidence FROM lineitem GROUP BY 1")
def q_penalty_confidence(t: Tables) -> DataFrame:
    groups = t.lineitem.groupBy("l_orderkey").agg(F.max("l_quantity").alias("most"), F.count("*").alias("n"), F.max("l_linenumber").alias("top"), F.count_if(F.col("l_quantity") < 10).alias("small"))
    score = F.when(F.col("most") > 45, 0.7).otherwise(1.0) * F.when(F.col("n") != F.col("top"), 0.8).otherwise(1.0) * F.pow(F.lit(0.9), F.col("small"))
    return groups.select("l_orderkey", F.round(score, 6).alias("confidence"))


@query("SELECT l_partkey, round(coalesce(sum(cast(round(l_discount * 100) AS BIGINT) * l_linenumber) / nullif(sum(l_linenumber), 0) / 100, 0.5), 6) AS confidence FROM lineitem GROUP BY 1")
def q_weighted_confidence(t: Tables) -> DataFrame:
    cents = F.round(F.col("l_discount") * 100).cast("long")
    mean = C.safe_ratio(F.sum(cents * F.col("l_linenumber")), F.sum("l_linenumber")) / 100
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.coalesce(mean, F.lit(0.5)), 6).alias("confidence"))


@query("""WITH s AS (SELECT doc_id, 2 * cast(contains(text, '@') AS INTEGER) + cast(contains(text, 'http') AS INTEGER) AS contact, 2 * cast(n_chars > 3000 AS INTEGER) + cast(contains(text, chr(10)) AS INTEGER) AS article, 3 * cast(regexp_matches(text, '[0-9]{4}') AS INTEGER) AS data FROM documents)
SELECT doc_id, CASE WHEN greatest(contact, article, data) < 2 THEN 'mixed' WHEN contact = greatest(contact, article, data) THEN 'contact' WHEN article = greatest(contact, article, data) THEN 'article' ELSE 'data' END AS category FROM s""")
def q_doc_category(t: Tables) -> DataFrame:
    """Additive scores of each class; the first of the best, or mixed below two points."""
    sign = lambda *pairs: sum((F.when(F.expr(c), k).otherwise(0) for k, c in pairs), F.lit(0))
    scores = {"contact": sign((2, "contains(text, '@')"), (1, "contains(text, 'http')")), "article": sign((2, "n_chars > 3000"), (1, "contains(text, '\\n')")), "data": sign((3, "text rlike '[0-9]{4}'"))}
    return t.documents.select("doc_id", C.first_best(scores, 2, "mixed").alias("category"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS slot, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'error') >= 3 OR count(*) FILTER (event_type = 'view') >= 5")
def q_alerts(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(*(F.count_if(F.col("event_type") == k).alias(f"{k}s") for k in ("error", "view")))
    return counts.where("errors >= 3 or views >= 5").select("user_id", F.col("w.start").alias("slot"), "errors", "views")


@query("WITH v AS (SELECT l_partkey AS entity, l_linenumber AS item, l_returnflag AS pick, count(*) AS votes, min(l_suppkey) AS first FROM lineitem GROUP BY 1, 2, 3) SELECT entity, item, pick, votes, conflicts FROM (SELECT *, row_number() OVER (PARTITION BY entity, item ORDER BY votes DESC, first, pick) AS rn, count(*) OVER (PARTITION BY entity, item) - 1 AS conflicts FROM v) WHERE rn = 1")
def q_membership_vote(t: Tables) -> DataFrame:
    """For each item of an entity the class with the most votes, then of the first source; and how many others were named."""
    votes = t.lineitem.groupBy(F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("item"), F.col("l_returnflag").alias("pick")).agg(F.count("*").alias("votes"), F.min("l_suppkey").alias("first"))
    best = F.min(F.struct((-F.col("votes")).alias("minus"), "first", "pick"))
    found = votes.groupBy("entity", "item").agg(best.alias("b"), (F.count("*") - 1).alias("conflicts"))
    return found.select("entity", "item", "b.pick", (-F.col("b.minus")).alias("votes"), "conflicts")


@query("WITH s AS (SELECT p_partkey, p_brand, p_size = 50 AS rejected, (CASE WHEN p_name LIKE '%ring%' THEN 100 WHEN p_name LIKE '%box%' THEN 80 ELSE 0 END) + least(p_size * 3, 100) + (CASE WHEN p_retailprice < 1000 THEN 20 WHEN p_retailprice < 1500 THEN 10 ELSE 5 END) AS score FROM part) SELECT p_brand, p_partkey, cast(CASE WHEN rejected THEN -1 ELSE score END AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN rejected THEN -1 ELSE score END DESC, p_partkey) <= 3")
def q_score_rank(t: Tables) -> DataFrame:
    """Rules that reject come first; the others' points add up, and the best three of each group stay."""
    kind = F.when(F.col("p_name").like("%ring%"), 100).when(F.col("p_name").like("%box%"), 80).otherwise(0)
    recent = F.when(F.col("p_retailprice") < 1000, 20).when(F.col("p_retailprice") < 1500, 10).otherwise(5)
    score = F.when(F.col("p_size") == 50, -1).otherwise(kind + F.least(F.col("p_size") * 3, F.lit(100)) + recent).cast("long")
    return R.top_k(t.part.select("p_brand", "p_partkey", score.alias("score")), ["p_brand"], [F.desc("score"), F.col("p_partkey")], 3).drop("rn")


@query("SELECT c_custkey, array_to_string(list_sort(string_split(lower(replace(c_name, '#', ' ')), ' ')), ' ') AS key FROM customer")
def q_person_key(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", folding.person_key(F.col("c_name")).alias("key"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def q_shared_members(t: Tables) -> DataFrame:
    """Members of the groups above a size, by a join with the groups' keys, one row each."""
    busy = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n > 12")
    return t.customer.select("c_custkey").join(busy, "c_custkey")
