"""Queries over filters, joins, aggregates and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.functions.columns import half_up, safe_ratio
from tomelight.operators import relational as R

from .registry import Tables, query

def key_of_props() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


@query("""
WITH viewed AS (SELECT cast(json_extract_string(props, '$.k') AS BIGINT) AS entity, max(ts) AS read_at FROM events WHERE event_type = 'view' GROUP BY 1),
base AS (SELECT l_partkey AS entity, l_extendedprice < 90000 AS is_real, l_linestatus = 'F' AS numbered, CASE WHEN l_linenumber <= 5 THEN l_linenumber ELSE -1 END AS bucket,
 l_returnflag = 'A' AS done, l_returnflag = 'R' AS error, l_returnflag = 'A' AND l_quantity > 25 AS archived, l_extendedprice AS price, read_at FROM lineitem LEFT JOIN viewed ON l_partkey = entity),
scalars AS (SELECT entity, count(*) FILTER (is_real) AS real_count, count(*) FILTER (is_real AND done) AS done_count, count(*) FILTER (is_real AND read_at IS NOT NULL) AS read_count,
 bool_or(is_real AND error) AS has_errors, max(price) FILTER (is_real) AS latest, max(read_at) AS last_read_at FROM base GROUP BY 1),
buckets AS (SELECT entity, bucket, count(*) FILTER (numbered) AS n, count(*) FILTER (numbered AND done) AS d, bool_or(archived AND NOT numbered) AND bucket >= 0 AS arch FROM base GROUP BY 1, 2)
SELECT s.*, t.total_items, t.done_items, t.total_buckets, t.done_buckets FROM scalars s JOIN (SELECT entity,
 cast(sum(CASE WHEN n > 0 THEN n WHEN arch THEN 1 ELSE 0 END) AS BIGINT) AS total_items, cast(sum(CASE WHEN arch AND n > 0 THEN n WHEN arch THEN 1 ELSE d END) AS BIGINT) AS done_items,
 cast(count(*) FILTER (bucket >= 0 AND (n > 0 OR arch)) AS BIGINT) AS total_buckets, cast(count(*) FILTER (bucket >= 0 AND (arch OR (n > 0 AND d = n))) AS BIGINT) AS done_buckets FROM buckets GROUP BY 1) t USING (entity)
""")
def q_entity_stats(t: Tables) -> DataFrame:
    """Two-level roll-up: one shuffle by entity and bucket, a second of the partial rows by entity."""
    viewed = t.events.where("event_type = 'view'").groupBy(key_of_props().alias("entity")).agg(F.max("ts").alias("read_at"))
    base = t.lineitem.select(
        F.col("l_partkey").alias("entity"), (F.col("l_extendedprice") < 90000).alias("is_real"), (F.col("l_linestatus") == "F").alias("numbered"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).otherwise(-1).alias("bucket"), (F.col("l_returnflag") == "A").alias("done"),
        (F.col("l_returnflag") == "R").alias("error"), ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25)).alias("archived"), F.col("l_extendedprice").alias("price"),
    )
    base = base.join(viewed, "entity", "left")
    buckets = base.groupBy("entity", "bucket").agg(
        F.count_if(F.expr("is_real")).alias("real"), F.count_if(F.expr("is_real and done")).alias("real_done"), F.count_if(F.expr("is_real and read_at is not null")).alias("real_read"),
        F.bool_or(F.expr("is_real and error")).alias("errors"), F.max(F.when(F.col("is_real"), F.col("price"))).alias("latest"), F.max("read_at").alias("read_at"),
        F.count_if(F.expr("numbered")).alias("n"), F.count_if(F.expr("numbered and done")).alias("d"), (F.bool_or(F.expr("archived and not numbered")) & (F.col("bucket") >= 0)).alias("arch"),
    )
    return buckets.groupBy("entity").agg(
        F.sum("real").alias("real_count"), F.sum("real_done").alias("done_count"), F.sum("real_read").alias("read_count"), F.bool_or("errors").alias("has_errors"),
        F.max("latest").alias("latest"), F.max("read_at").alias("last_read_at"),
        F.sum(F.expr("case when n > 0 then n when arch then 1 else 0 end")).alias("total_items"), F.sum(F.expr("case when arch and n > 0 then n when arch then 1 else d end")).alias("done_items"),
        F.count_if(F.expr("bucket >= 0 and (n > 0 or arch)")).alias("total_buckets"), F.count_if(F.expr("bucket >= 0 and (arch or (n > 0 and d = n))")).alias("done_buckets"),
    )


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def q_scan_filter(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT 'customer' AS provider, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey FROM supplier")
def q_federated_union(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("provider"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("provider"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("SELECT p_partkey AS entity, u.field, u.value FROM part, LATERAL (VALUES ('brand', p_brand), ('type', p_type), ('name', p_name)) u(field, value) WHERE u.value IS NOT NULL")
def q_claims_unpivot(t: Tables) -> DataFrame:
    wide = t.part.selectExpr("p_partkey as entity", "p_brand as brand", "p_type as type", "p_name as name")
    return wide.unpivot("entity", ["brand", "type", "name"], "field", "value").where("value is not null")


@query("""SELECT o_custkey AS k, o_orderkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders) WHERE rn = 1
UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def q_insert_ignore(t: Tables) -> DataFrame:
    held = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))
    return R.insert_ignore(held, t.customer.select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v")), ["k"])


@query("SELECT user_id, cast(ts AS DATE) AS day, count(*) AS n, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def q_upsert_increment(t: Tables) -> DataFrame:
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day"), F.pmod("event_id", F.lit(2)).alias("half")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return R.upsert_add(days.where("half = 0").drop("half"), days.where("half = 1").drop("half"), ["user_id", "day"], ["n", "cents"])


@query("SELECT s_suppkey, n_name FROM supplier CROSS JOIN (SELECT n_name FROM nation ORDER BY n_name LIMIT 1)")
def q_cross_limit1(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey").crossJoin(F.broadcast(t.nation.select("n_name").orderBy("n_name").limit(1)))


@query("""SELECT o_orderkey, count(l_orderkey) AS lines, coalesce(bool_and(l_returnflag = 'A'), false) AS all_done, coalesce(bool_or(l_returnflag = 'A'), false) AS any_done,
count(*) FILTER (l_returnflag = 'A') BETWEEN 1 AND count(l_orderkey) - 1 AS in_progress FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def q_quantified_filters(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("d"))
    both = t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").na.fill(0, ["n", "d"])
    return both.select("o_orderkey", F.col("n").alias("lines"), F.expr("n > 0 and d = n").alias("all_done"), F.expr("d > 0").alias("any_done"), F.expr("d between 1 and n - 1").alias("in_progress"))


@query("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6")
def q_range_filters(t: Tables) -> DataFrame:
    orders = t.orders.where("o_orderdate between timestamp_ntz'1995-01-01' and timestamp_ntz'1997-12-31'")
    return t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n")).where("n between 2 and 6")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'small']) AND NOT list_has_any(string_split(p_name, ' '), ['ring'])")
def q_array_include_exclude(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    wanted, unwanted = F.array(F.lit("red"), F.lit("small")), F.array(F.lit("ring"))
    return t.part.where(F.arrays_overlap(words, wanted) & ~F.arrays_overlap(words, unwanted)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'brand#2') OR contains(lower(p_type), 'ring')")
def q_multi_field_search(t: Tables) -> DataFrame:
    fields = F.array("p_name", "p_type")
    return t.part.where(F.exists(fields, lambda x: F.contains(F.lower(x), F.lit("ring"))) | F.contains(F.lower("p_brand"), F.lit("brand#2"))).select("p_partkey")


@query("SELECT letter, min(rn) - 1 AS first_index, count(*) AS n FROM (SELECT CASE WHEN upper(left(p_name, 1)) BETWEEN 'A' AND 'Z' THEN upper(left(p_name, 1)) ELSE '#' END AS letter, row_number() OVER (ORDER BY p_name, p_partkey) rn FROM part) GROUP BY 1")
def q_letter_index(t: Tables) -> DataFrame:
    """The index of a letter is the number of names before it: counts per letter, then a running sum over 27 rows at most."""
    first = F.upper(F.substring("p_name", 1, 1))
    names = t.part.groupBy(F.when(first.rlike("^[A-Z]$"), first).otherwise("#").alias("letter")).agg(F.min("p_name").alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1))
    return names.select("letter", F.coalesce(before, F.lit(0)).cast("long").alias("first_index"), "n")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' AND value > 20 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def q_event_search_page(t: Tables) -> DataFrame:
    found = t.events.where(F.col("event_type").isin("error", "click") & F.expr("ts >= timestamp_ntz'2024-01-03' and ts < timestamp_ntz'2024-01-20' and value > 20"))
    return found.orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50).select("event_id", "user_id", "event_type")


@query("SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '7')")
def q_json_path_filter(t: Tables) -> DataFrame:
    return t.events.where(F.contains(F.get_json_object("props", "$.k"), F.lit("7"))).select("event_id")


@query("SELECT user_id, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_key, cast(max(cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS top FROM events GROUP BY 1")
def q_json_key_exists(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.get_json_object("props", "$.k")).alias("with_key"), F.max(key_of_props()).alias("top"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_discount IS DISTINCT FROM l_tax GROUP BY 1, 2")
def q_null_safe_drift(t: Tables) -> DataFrame:
    return t.lineitem.where(~F.col("l_discount").eqNullSafe(F.col("l_tax"))).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def q_retention(t: Tables) -> DataFrame:
    last = t.events.agg((F.max("ts") - F.expr("interval 3 days")).alias("cutoff"))
    return t.events.crossJoin(F.broadcast(last)).where("ts >= cutoff").select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount >= 0.07 THEN 'accept' WHEN l_discount >= 0.04 THEN 'badge' ELSE 'reject' END AS class FROM lineitem")
def q_confidence_class(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_discount") >= 0.07, "accept").when(F.col("l_discount") >= 0.04, "badge").otherwise("reject").alias("class"))


@query("SELECT c_custkey, max(o_orderkey) IS NOT NULL AS has_open FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY 1")
def q_left_join_flag(t: Tables) -> DataFrame:
    held = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return t.customer.select("c_custkey").join(held.withColumn("has_open", F.lit(True)), "c_custkey", "left").na.fill(False, ["has_open"])


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def q_inner_group_count(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.nation.join(counts, "n_nationkey").select("n_name", "n")


@query("SELECT p_partkey, count(*) AS n FROM events JOIN part ON cast(json_extract_string(props, '$.k') AS BIGINT) = p_partkey GROUP BY 1")
def q_join_on_json_key(t: Tables) -> DataFrame:
    counts = t.events.groupBy(key_of_props().alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.part.select("p_partkey").join(counts, "p_partkey")


@query("SELECT o_orderkey, count(l_orderkey) AS near FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND abs(epoch(l_shipdate) - epoch(o_orderdate)) <= 86400 GROUP BY 1")
def q_interval_join(t: Tables) -> DataFrame:
    a, b = t.orders.select("o_orderkey", "o_orderdate"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    near = R.interval_join(a, b, "o_orderkey", "o_orderdate", "l_shipdate", 1).groupBy("o_orderkey").agg(F.count("*").alias("near"))
    return R.zero_filled(near, t.orders.select("o_orderkey"), "o_orderkey", "near")


@query("SELECT a.user_id, a.event_type, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND abs(date_diff('microsecond', a.ts, b.ts)) < 86400000000 GROUP BY 1, 2")
def q_overlap_self_join(t: Tables) -> DataFrame:
    """Ordered pairs less than a day apart, as counts of a range frame: no pair is ever made."""
    day = 86_400_000_000 - 1
    order = Window.partitionBy("user_id", "event_type").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-day, day)
    near = t.events.select("user_id", "event_type", (F.count("*").over(order) - 1).alias("n"))
    return near.groupBy("user_id", "event_type").agg(F.sum("n").alias("pairs")).where("pairs > 0")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def q_semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_anti_join(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders) WHERE rn = 1")
def q_first_match_per_key(t: Tables) -> DataFrame:
    return R.best_row(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT 'lost' AS side, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'new', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def q_diff_both_sides(t: Tables) -> DataFrame:
    """One roll-up of the keys of both sides, so that a task holds no more than its sums; a null key equals no other."""
    order = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(1).alias("n"), (F.col("o_orderstatus") != "P").alias("kept"), F.lit(False).alias("line"))
    line = t.lineitem.select(F.col("l_orderkey").alias("k"), F.lit(0).alias("n"), F.lit(False).alias("kept"), F.lit(True).alias("line"))
    keys = order.unionByName(line).groupBy("k").agg(F.sum("n").cast("int").alias("n"), F.max("kept").alias("kept"), F.max("line").alias("line"))
    lone = F.col("k").isNull()
    lost = F.array_repeat(F.lit("lost"), F.when(lone | ~F.col("line"), F.col("n")).otherwise(0))
    new = F.array_repeat(F.lit("new"), F.when(F.col("line") & (lone | ~F.coalesce("kept", F.lit(False))), 1).otherwise(0))
    return keys.select(F.explode(F.concat(lost, new)).alias("side"), "k")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def q_group_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders GROUP BY 1")
def q_status_pivot(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in (("done", "o_orderstatus = 'F'"), ("open", "o_orderstatus = 'O'"), ("other", "o_orderstatus not in ('F', 'O')"))))


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def q_recent_avg(t: Tables) -> DataFrame:
    last = t.events.agg((F.max("ts") - F.expr("interval 1 day")).alias("cutoff"))
    return t.events.crossJoin(F.broadcast(last)).where("ts >= cutoff").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM events")
def q_global_agg(t: Tables) -> DataFrame:
    return t.events.agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (value > 50) AS heavy FROM events GROUP BY 1")
def q_distinct_filter(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("heavy"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS least FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_having_dupes(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_partkey").alias("least")).where("n > 1")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) = count(*) FILTER (l_returnflag = 'A')")
def q_all_complete(t: Tables) -> DataFrame:
    groups = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("d"))
    return groups.where("n = d").select("l_orderkey", "n")


@query("SELECT count(*) FILTER (l_discount < 0 OR l_discount > 0.09) AS odd_discount, count(*) FILTER (o_orderkey IS NULL) AS orphans, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def q_integrity(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.agg(F.count_if(F.expr("l_discount < 0 or l_discount > 0.09")).alias("odd_discount"), F.count_if(F.col("o_orderkey").isNull()).alias("orphans"), F.count("*").alias("n"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, cast(floor(cast(sum(cast(value AS DECIMAL(18, 6))) AS DOUBLE) / 60 + 0.5) AS BIGINT) AS minutes, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS week, count(*) FILTER (cast(ts AS DATE) = cast(now AS DATE)) AS today FROM events, m GROUP BY 1")
def q_period_sums(t: Tables) -> DataFrame:
    """Seconds are summed as decimals: a sum of doubles depends on their order, which would settle the halves."""
    now = t.events.agg(F.max("ts").alias("now"))
    rows = t.events.crossJoin(F.broadcast(now))
    return rows.groupBy("user_id").agg(half_up(F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / 60).alias("minutes"), F.count_if(F.expr("ts >= now - interval 7 days")).alias("week"), F.count_if(F.expr("to_date(ts) = to_date(now)")).alias("today"))


@query("SELECT event_type AS namespace, count(*) AS n, round(count(*) FILTER (value > 50) / nullif(count(*) FILTER (value > 20), 0), 6) AS rate FROM events GROUP BY 1")
def q_namespace_stats(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("namespace")).agg(F.count("*").alias("n"), F.round(safe_ratio(F.count_if(F.col("value") > 50), F.count_if(F.col("value") > 20)), 6).alias("rate"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def q_top_groups(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@query("SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000 GROUP BY 1")
def q_zero_fill(t: Tables) -> DataFrame:
    counts = t.supplier.where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return R.zero_filled(counts, t.nation.select("n_nationkey"), "n_nationkey", "n")


@query("SELECT o_custkey, string_agg(cast(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1")
def q_ordered_agg(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT date_trunc('hour', ts) AS hour, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 6) AS uptime FROM events GROUP BY 1")
def q_hourly_rollup(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", F.col("ts")).alias("hour")).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.count_if(F.col("event_type") != "error") * 100.0 / F.count("*"), 6).alias("uptime"),
    ).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT DISTINCT 'brand' AS kind, p_brand AS value FROM part UNION SELECT DISTINCT 'type', p_type FROM part")
def q_facets(t: Tables) -> DataFrame:
    return t.part.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")).union(t.part.select(F.lit("type"), "p_type")).distinct()


@query("SELECT o_orderkey, rn, total FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F') WHERE rn BETWEEN 41 AND 60")
def q_page(t: Tables) -> DataFrame:
    """Page 3 of 20: the page by a top-k, its total by a count, so no task sees all rows."""
    rows = t.orders.where("o_orderstatus = 'F'")
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(60).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rn > 40")
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select("o_orderkey", F.col("rn").cast("long").alias("rn"), "total")


@query("SELECT event_id, user_id FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-10', 5000) ORDER BY ts DESC, event_id DESC LIMIT 25")
def q_keyset_page(t: Tables) -> DataFrame:
    before = F.expr("ts < timestamp_ntz'2024-01-10' or (ts = timestamp_ntz'2024-01-10' and event_id < 5000)")
    return t.events.where(before).orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id")


@query("SELECT l_orderkey, x.n AS slot, l.l_orderkey IS NOT NULL AND bool_or(l_linenumber = x.n) AS filled FROM lineitem l, generate_series(1, 7) x(n) GROUP BY 1, 2, l.l_orderkey")
def q_gap_fill(t: Tables) -> DataFrame:
    held = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("held"))
    return held.select("l_orderkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("slot"), "held").select("l_orderkey", F.col("slot").cast("long").alias("slot"), F.array_contains("held", F.col("slot")).alias("filled"))
