"""Queries over passes of links, leases, runs, claims of several fields, blocklists and training formats."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from tomelight.functions import titles as T
from tomelight.operators import consensus, sequences as S

from .catalogue import _COUNTS, _RANKED, _counts
from .registry import Tables, query
from .titles import TITLE, _hit, _lit, _titles


@query("WITH f AS (SELECT * FROM events WHERE event_type IN ('error', 'click') AND value > 20) SELECT event_id, user_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def q_search_page_total(t: Tables) -> DataFrame:
    """A page by a top-k, and the number of all hits by a count: no task sees all rows."""
    found = t.events.where(F.col("event_type").isin("error", "click") & (F.col("value") > 20))
    page = found.orderBy(F.desc("ts"), F.desc("event_id")).offset(50).limit(50)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).select("event_id", "user_id", "total")


_BLOCKED = "(SELECT DISTINCT lower(p_name) AS title FROM part WHERE p_size >= 49)"
_PATTERNS = [(0, "^red"), (1, "bolt$"), (2, "gear")]


@query(f"WITH b AS {_BLOCKED}, p(rank, pattern) AS (VALUES {', '.join(str(x) for x in _PATTERNS)}) SELECT p_partkey, CASE WHEN b.title IS NOT NULL THEN 'title' ELSE (SELECT arg_min(pattern, rank) FROM p WHERE regexp_matches(lower(p_name), pattern)) END AS reason FROM part LEFT JOIN b ON b.title = lower(p_name)")
def q_blocklist_join(t: Tables) -> DataFrame:
    """Titles by an equi-join with a table of any size; a stated list of patterns by a broadcast, first match wins; every row gets a result."""
    titles = t.part.where("p_size >= 49").select(F.lower("p_name").alias("title")).distinct()
    patterns = F.broadcast(t.spark.createDataFrame(_PATTERNS, "rank int, pattern string"))
    names = t.part.select(F.lower("p_name").alias("name")).distinct()
    hits = names.join(patterns, F.expr("name rlike pattern")).groupBy("name").agg(F.min_by("pattern", "rank").alias("pattern"))
    rows = t.part.select("p_partkey", F.lower("p_name").alias("name")).join(titles, F.col("name") == F.col("title"), "left").join(hits, "name", "left")
    return rows.select("p_partkey", F.when(F.col("title").isNotNull(), "title").otherwise(F.col("pattern")).alias("reason"))


_BANDS = "SELECT l_orderkey AS entity, l_linenumber AS number, min(l_suppkey % 40) AS a, max(l_suppkey % 40) + 4 AS b FROM lineitem GROUP BY 1, 2"


@query(f"WITH r AS ({_BANDS}), i AS (SELECT l_orderkey AS entity, l_linenumber AS own, l_suppkey % 40 + 3 AS item, l_partkey FROM lineitem) SELECT entity, own, item, l_partkey, coalesce((SELECT number FROM r WHERE r.entity = i.entity AND number = own AND item BETWEEN a AND b), (SELECT min(number) FROM r WHERE r.entity = i.entity AND item BETWEEN a AND b)) AS linked FROM i")
def q_relink_passes(t: Tables) -> DataFrame:
    """Passes in order: a link outside its range is cleared, then the first range of the entity that holds the item is taken."""
    bands = t.lineitem.groupBy(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("number")).agg(F.min(F.col("l_suppkey") % 40).alias("a"), (F.max(F.col("l_suppkey") % 40) + 4).alias("b"))
    spans = bands.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("number", "a", "b"))).alias("spans"))  # an entity's numbered ranges
    items = t.lineitem.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("own"), (F.col("l_suppkey") % 40 + 3).alias("item"), "l_partkey")
    inside = F.filter("spans", lambda s: F.col("item").between(s["a"], s["b"]))
    kept = F.get(F.filter(inside, lambda s: s["number"] == F.col("own")), F.lit(0))["number"]
    return items.join(spans, "entity").select("entity", "own", "item", "l_partkey", F.coalesce(kept, F.get(inside, F.lit(0))["number"]).alias("linked"))


@query("WITH m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), e AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_returnflag = 'R') SELECT e.l_orderkey, l_partkey, l_suppkey, cast(coalesce(top, 0) + rn AS BIGINT) AS number FROM e LEFT JOIN m ON m.l_orderkey = e.l_orderkey")
def q_appended_tail(t: Tables) -> DataFrame:
    """Closing rows of an entity get the numbers after its greatest one."""
    top = F.max(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).over(Window.partitionBy("l_orderkey"))
    rows = t.lineitem.withColumn("top", top).where("l_returnflag = 'R'")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", (F.coalesce("top", F.lit(0)) + rank).cast("long").alias("number"))


_MAPPED = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low", "5-LOW": "low"}


@query("WITH w(provider, w) AS (VALUES " + ", ".join(str((k, v)) for k, v in consensus.WEIGHTS.items()) + f"), c AS (SELECT o_custkey AS entity, ({list(consensus.WEIGHTS)})[1 + o_orderkey % 8] AS provider, CASE o_orderpriority " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in _MAPPED.items()) + " ELSE lower(o_orderpriority) END AS value FROM orders), v AS (SELECT entity, value, sum(cast(w AS DECIMAL(18,2))) AS w, count(DISTINCT CASE WHEN provider IN ('anilist', 'mal') THEN 'anchor' ELSE provider END) AS k FROM c JOIN w USING (provider) GROUP BY 1, 2), r AS (SELECT *, cast(w AS DOUBLE) / cast(sum(w) OVER (PARTITION BY entity) AS DOUBLE) AS agreement, row_number() OVER (PARTITION BY entity ORDER BY w DESC, value) AS rn FROM v) SELECT entity, value, round(agreement * CASE WHEN k <= 1 THEN 0.6 WHEN k = 2 THEN 0.85 ELSE 1.0 END, 6) AS confidence FROM r WHERE rn = 1")
def q_normalised_vote(t: Tables) -> DataFrame:
    """A vote over values that are first mapped to common names; a value without one votes for itself in lower case."""
    name = F.element_at(F.array(*map(F.lit, consensus.WEIGHTS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    common = F.create_map(*(F.lit(x) for kv in _MAPPED.items() for x in kv))
    claims = t.orders.select(F.col("o_custkey").alias("entity"), name.alias("provider"), F.coalesce(F.try_element_at(common, F.col("o_orderpriority")), F.lower("o_orderpriority")).alias("value"))
    return consensus.categorical_vote(claims).select("entity", "value", F.round("confidence", 6).alias("confidence"))


@query("WITH c AS (" + _COUNTS + "), w(provider, w) AS (VALUES " + ", ".join(str((k, v)) for k, v in consensus.WEIGHTS.items()) + "), v AS (SELECT entity, cast(value % 10 AS INTEGER) AS item, cast(sum(cast(w AS DECIMAL(18,2))) AS DOUBLE) AS w FROM c JOIN w USING (provider) GROUP BY 1, 2), t AS (SELECT c.entity, cast(sum(cast(w AS DECIMAL(18,2))) AS DOUBLE) AS total FROM c JOIN w USING (provider) GROUP BY 1), r AS (SELECT v.entity, item, round(w / total, 6) AS share FROM v JOIN t USING (entity) QUALIFY row_number() OVER (PARTITION BY v.entity ORDER BY w DESC, item) <= 3) SELECT entity, string_agg(item, ',' ORDER BY share DESC, item) AS items, round(greatest(0.4, avg(share)), 6) AS confidence FROM r GROUP BY 1")
def q_list_union(t: Tables) -> DataFrame:
    """The heaviest three items of an entity's lists under one key, and their mean share with a floor."""
    claims = _counts(t).withColumn("item", (F.col("value") % 10).cast("int"))
    found = consensus.weighted_items(claims, 3)
    order = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("minus"), "item")))
    return found.groupBy("entity").agg(F.array_join(F.transform(order, lambda x: x["item"].cast("string")), ",").alias("items"), F.round(F.greatest(F.lit(0.4), F.avg("share")), 6).alias("confidence"))


@query(_RANKED + " SELECT entity, string_agg(provider || '=' || cast(cast(value AS INTEGER) AS VARCHAR), ',' ORDER BY rank, value) AS conflicts FROM (SELECT DISTINCT c.entity, provider, rank, value FROM c WHERE value <> (SELECT struct_extract(min({'r': d.rank, 'v': d.value}), 'v') FROM c d WHERE d.entity = c.entity)) GROUP BY 1")
def q_conflict_list(t: Tables) -> DataFrame:
    """The claims that differ from the one that wins, by provider."""
    rank = F.array_position(F.array(*map(F.lit, consensus.WEIGHTS)), F.col("provider"))
    rows = _counts(t).distinct().withColumn("rank", rank)
    first = F.min(F.struct("rank", "value")).over(Window.partitionBy("entity"))["value"]
    other = rows.withColumn("first", first).where("value <> first").groupBy("entity")
    named = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "provider"))), lambda x: F.concat_ws("=", x["provider"], x["value"].cast("int").cast("string")))
    return other.agg(F.array_join(named, ",").alias("conflicts"))


@query("WITH r AS (SELECT o_custkey, year(o_orderdate) AS run, max(o_orderdate) AS newest, max(o_orderkey) AS id, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, cast(run AS INTEGER) AS run, n FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY newest DESC, id DESC) > 3")
def q_retain_newest_k(t: Tables) -> DataFrame:
    """The runs of each key that are older than its newest three."""
    runs = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("run")).agg(F.max("o_orderdate").alias("at"), F.max("o_orderkey").alias("id"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("at"), F.desc("id")))
    return runs.withColumn("rn", rank).where("rn > 3").select("o_custkey", "run", "n")


@query("SELECT event_id, count(*) OVER (w RANGE BETWEEN INTERVAL 10 SECOND PRECEDING AND CURRENT ROW) AS s10, count(*) OVER (w RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW) AS m1, count(*) OVER (w RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) AS m5 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)")
def q_velocities(t: Tables) -> DataFrame:
    return S.trailing_counts(t.events, "event_type", "ts", {"s10": 10, "m1": 60, "m5": 300}).select("event_id", "s10", "m1", "m5")


@query("""WITH n AS (SELECT *, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, n - coalesce(max(CASE WHEN event_type <> 'error' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS run FROM n),
o AS (SELECT *, max(CASE WHEN run >= 2 THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened, lag(run) OVER (PARTITION BY user_id ORDER BY n) AS before FROM r)
SELECT event_id, coalesce(before >= 2 AND epoch_us(ts) - opened < 43200000000, false) AS refused FROM o""")
def q_breaker_state(t: Tables) -> DataFrame:
    """Whether each call meets an open breaker: two failures in a row before it, the last of them within the cool-down of 12 hours."""
    return S.breaker(t.events, "user_id", "ts", F.col("event_type") == "error", 2, 43_200).select("event_id", "refused")


@query(f"SELECT p_partkey, array_to_string(regexp_extract_all(t, '\\d+(?:\\.\\d+)?'), ',') AS numbers FROM (SELECT p_partkey, {TITLE} AS t FROM part)")
def q_all_numbers(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", F.array_join(F.regexp_extract_all("title", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), ",").alias("numbers"))


_LISTED = "concat(CASE p_partkey % 7 WHEN 0 THEN concat('Ch. ', p_size) WHEN 1 THEN concat(p_size, ' pages') WHEN 2 THEN concat(p_size % 28 + 1, ' March 2016') WHEN 3 THEN concat('000-', p_size % 5, ' x') WHEN 4 THEN concat('ISBN 978-1-', p_size) WHEN 5 THEN concat(p_size, ': ', p_name) ELSE concat('2016-03-', p_size) END, '')"
_EXPLICIT = f"try_cast(coalesce('0.' || {_hit('t', T.MARKED_PREQUEL)}, " + ", ".join(_hit("t", p) for p in T.MARKERS) + ") AS DOUBLE)"
_BARE = f"try_cast(coalesce('0.' || {_hit('t', T.PREQUEL[1])}, '0.' || {_hit('t', T.PREQUEL[2])}, " + ", ".join(_hit("t", p) for p in T.IN_FRONT) + ") AS DOUBLE)"


@query(f"SELECT p_partkey, CASE WHEN {_EXPLICIT} >= 0 AND {_EXPLICIT} < 10000 THEN {_EXPLICIT} WHEN NOT (" + " OR ".join(f"regexp_matches(t, {_lit(p)})" for p in (T.ISBN, *T.NO_ENTRY)) + f") AND {_BARE} < 10000 THEN {_BARE} END AS number FROM (SELECT p_partkey, {_LISTED} AS t FROM part)")
def q_listed_number(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.listed_number(F.expr(_LISTED)).alias("number"))


@query("WITH c AS (SELECT l_orderkey AS entity, l_linenumber AS provider, l_shipdate AS day, 1 - l_linenumber / 10 AS w FROM lineitem) SELECT entity, min(day) AS first_day, round(arg_min(w, (day, provider, w)) / sum(w), 6) AS share, count(*) AS claims FROM c GROUP BY 1")
def q_earliest_claim(t: Tables) -> DataFrame:
    """The earliest date claimed for an entity, and the share of all weight that is behind it."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("entity"), F.col("l_shipdate").alias("day"), F.col("l_linenumber").alias("provider"), (1 - F.col("l_linenumber") / 10).alias("w"))
    return rows.groupBy("entity").agg(F.min("day").alias("first_day"), F.round(F.min_by("w", F.struct("day", "provider", "w")) / F.sum("w"), 6).alias("share"), F.count("*").alias("claims"))


@query(_RANKED + """, s AS (SELECT DISTINCT entity, value AS seed FROM c), k AS (SELECT s.entity, seed, count(*) AS n, count(*) FILTER (provider NOT IN ('anilist', 'mal')) AS others, min(rank) AS rank, min(value) AS lo, median(value) AS mid FROM s JOIN c ON c.entity = s.entity AND abs(value - seed) <= 4 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, others DESC, rank, lo) AS rn FROM k) SELECT b.entity, CASE WHEN n >= 2 THEN least(floor(mid + 0.5), lo) ELSE (SELECT min(value) FROM c WHERE c.entity = b.entity) END AS value FROM b WHERE rn = 1""")
def q_chapter_consensus(t: Tables) -> DataFrame:
    """Counts within a window of two and two bonus entries; the least of the largest cluster."""
    return consensus.count_consensus(_counts(t), 2 + 2, least=True).select("entity", "value")


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text <> '') SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 = doc_id % 5 THEN 'B-NAME' WHEN i - 1 > doc_id % 5 AND i - 1 <= doc_id % 5 + 2 THEN 'I-NAME' ELSE 'O' END), ' ') AS tags FROM w")
def q_bio_encode(t: Tables) -> DataFrame:
    """Tags of all words from a span of word numbers, both ends inside."""
    words = F.split("text", " ")
    tag = lambda _, i: F.when(i == F.col("a"), "B-NAME").when((i > F.col("a")) & (i <= F.col("a") + 2), "I-NAME").otherwise("O")
    rows = t.documents.where("text <> ''").withColumn("a", F.col("doc_id") % 5)
    return rows.select("doc_id", F.array_join(F.transform(words, tag), " ").alias("tags"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text <> '') SELECT doc_id, array_to_string(list_transform(w, lambda x: x || chr(9) || CASE WHEN regexp_matches(x, '^[A-Z]') THEN 'B-NAME' ELSE 'O' END), chr(10)) AS conll FROM w")
def q_export_conll(t: Tables) -> DataFrame:
    """A word and its tag a line."""
    line = F.transform(F.split("text", " "), lambda w: F.concat_ws("\t", w, F.when(w.rlike("^[A-Z]"), "B-NAME").otherwise("O")))
    return t.documents.where("text <> ''").select("doc_id", F.array_join(line, "\n").alias("conll"))


@query("SELECT conv_id, turn, to_json({'instruction': 'Reply to the user.', 'input': CASE WHEN length(text) > 2000 THEN left(text, 1997) || '...' ELSE text END, 'output': nxt}) AS line FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND who = 'assistant'")
def q_export_alpaca(t: Tables) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(order).alias("output"), F.lead("role").over(order).alias("who")).where("role = 'user' and who = 'assistant'")
    short = F.when(F.length("text") > 2000, F.concat(F.substring("text", 1, 1997), F.lit("..."))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.to_json(F.struct(F.lit("Reply to the user.").alias("instruction"), short.alias("input"), "output")).alias("line"))


@query("WITH a AS (SELECT 0 AS priority, 'customer' AS provider, c_name AS name, NULL AS error FROM customer UNION ALL SELECT 1, 'supplier', s_name, NULL FROM supplier UNION ALL SELECT 2, 'missing', NULL, 'not found') SELECT * FROM a")
def q_federated_errors(t: Tables) -> DataFrame:
    """Rows of several sources in order of priority; a source whose read fails gives one row with its error."""
    parts = []
    for k, (name, column) in enumerate({"customer": "c_name", "supplier": "s_name", "missing": "name"}.items()):
        try:
            own, error = getattr(t, name).select(F.col(column).alias("name")), None
        except AnalysisException as e:
            own = t.spark.range(1).select(F.lit(None).cast("string").alias("name"))
            error = "not found" if e.getCondition() == "PATH_NOT_FOUND" else e.getCondition()
        parts.append(own.select(F.lit(k).alias("priority"), F.lit(name).alias("provider"), "name", F.lit(error).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT p_partkey AS entity, u.field, u.value FROM part, LATERAL (VALUES ('publisher', p_brand), ('genre', p_type), ('name', p_name)) u(field, value) WHERE u.value IS NOT NULL")
def q_claims_aliases(t: Tables) -> DataFrame:
    """Fields of wide rows in long form, older names of fields mapped to the present ones."""
    present = F.create_map(*map(F.lit, ("brand", "publisher", "type", "genre")))
    wide = t.part.selectExpr("p_partkey as entity", "p_brand as brand", "p_type as type", "p_name as name")
    rows = wide.unpivot("entity", ["brand", "type", "name"], "field", "value").where("value is not null")
    return rows.select("entity", F.coalesce(F.try_element_at(present, F.col("field")), F.col("field")).alias("field"), "value")


@query("WITH n AS (SELECT max(ts) AS now FROM events), j AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events, n WHERE user_id % 3 = 0 OR ts + INTERVAL 30 SECOND < now) SELECT event_type, event_id, now + INTERVAL 30 SECOND AS lease_until FROM j WHERE rn <= 4")
def q_lease_claims(t: Tables) -> DataFrame:
    """The first four jobs of each queue that no one holds, or whose lease of 30 seconds has run out, with a new lease."""
    now = t.events.agg(F.max("ts").alias("now"))
    free = t.events.crossJoin(F.broadcast(now)).where("user_id % 3 = 0 or ts + interval 30 seconds < now")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return free.withColumn("rn", rank).where("rn <= 4").select("event_type", "event_id", F.expr("now + interval 30 seconds").alias("lease_until"))


@query("SELECT c_mktsegment AS segment, p AS facet, count(*) AS n FROM customer JOIN (SELECT o_custkey, unnest([o_orderpriority, o_orderstatus]) AS p FROM orders) ON o_custkey = c_custkey GROUP BY 1, 2")
def q_unnest_facets(t: Tables) -> DataFrame:
    values = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("facet"))
    return values.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey").groupBy("segment", "facet").agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT l_partkey AS entity, l_linenumber AS item, l_returnflag AS pick, count(*) AS votes, min(l_suppkey) AS first FROM lineitem GROUP BY 1, 2, 3), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY entity, item ORDER BY votes DESC, first, pick) = 1) SELECT entity, pick, min(item) AS first_item, max(item) AS last_item, count(*) AS n, cast(round(least(1.0, 0.5 + 0.15 * max(votes)), 6) AS DOUBLE) AS confidence FROM b GROUP BY 1, 2")
def q_membership_manifest(t: Tables) -> DataFrame:
    """What each class of an entity holds after the vote over its items."""
    votes = t.lineitem.groupBy(F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("item"), F.col("l_returnflag").alias("pick")).agg(F.count("*").alias("votes"), F.min("l_suppkey").alias("first"))
    best = votes.groupBy("entity", "item").agg(F.min(F.struct(-F.col("votes"), "first", "pick", "votes")).alias("b")).select("entity", "item", "b.pick", "b.votes")
    return best.groupBy("entity", "pick").agg(F.min("item").alias("first_item"), F.max("item").alias("last_item"), F.count("*").alias("n"), F.round(F.least(F.lit(1.0), 0.5 + 0.15 * F.max("votes")), 6).alias("confidence"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN c >= 0.9 THEN 'accept' WHEN c >= 0.6 THEN 'review' ELSE 'reject' END WHEN 'view' THEN CASE WHEN c >= 0.7 THEN 'accept' WHEN c >= 0.5 THEN 'review' ELSE 'reject' END ELSE CASE WHEN c >= 0.8 THEN 'accept' WHEN c >= 0.4 THEN 'review' ELSE 'reject' END END AS decision FROM (SELECT *, least(1.0, value / 50) AS c FROM events)")
def q_decision_by_field(t: Tables) -> DataFrame:
    """The class of a confidence by the cut-offs of its kind of field."""
    cuts, c = {"error": (0.9, 0.6), "view": (0.7, 0.5)}, F.least(F.lit(1.0), F.col("value") / 50)
    of = lambda k: F.coalesce(*(F.when(F.col("event_type") == name, x[k]) for name, x in cuts.items()), F.lit((0.8, 0.4)[k]))
    return t.events.select("event_id", F.when(c >= of(0), "accept").when(c >= of(1), "review").otherwise("reject").alias("decision"))
