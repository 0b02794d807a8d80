"""Queries over picks and unions of structured fields, lists, and links made right."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomelight.operators import consensus, picks as P

from .catalogue import _COUNTS, _PROVIDERS, _counts
from .registry import Tables, query

_WEIGHT = "CAST(1.0 - 0.1 * (l_linenumber % 5) AS DECIMAL(18,6))"


def _lift(share: str, n: str) -> str:
    return f"greatest({share}, CASE WHEN {n} <= 1 THEN 0.75 WHEN {n} <= 4 THEN 0.55 ELSE 0.45 END::DOUBLE)"


@query(f"""WITH c AS (SELECT l_orderkey AS entity, l_linenumber AS provider, l_shipdate AS date, {_WEIGHT} AS w FROM lineitem WHERE l_returnflag <> 'A' OR l_linenumber < 4), a AS (SELECT entity, cast(sum(w) AS DOUBLE) AS total, count(*) AS sources FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, w DESC, provider) AS e, row_number() OVER (PARTITION BY entity ORDER BY date DESC, w DESC, provider) AS l FROM c), p AS (SELECT entity, 'earliest' AS mode, provider, date, w FROM r WHERE e = 1 UNION ALL SELECT entity, 'latest', provider, date, w FROM r WHERE l = 1),
q AS (SELECT p.*, sources, round({_lift('cast(w AS DOUBLE) / total', 'sources')}, 6) AS confidence FROM p JOIN a USING (entity)) SELECT entity, mode, provider, date, sources, confidence FROM q WHERE confidence >= 0.5""")
def q_pick_dates(t: Tables) -> DataFrame:
    """The earliest and the latest date of each entity, with a confidence that a few credible sources raise."""
    claims = t.lineitem.where("l_returnflag <> 'A' or l_linenumber < 4").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("provider"), F.col("l_shipdate").alias("date"), F.expr(_WEIGHT).alias("weight"))
    both = [P.pick_date(claims, late).withColumn("mode", F.lit("latest" if late else "earliest")) for late in (False, True)]
    return both[0].unionByName(both[1])


_VOTED = f"CAST({_WEIGHT} * CASE WHEN l_partkey % 500 = 0 THEN 0.7 ELSE least(1.5, 0.6 + 0.1 * log10(l_partkey % 500)) END AS DECIMAL(18,6))"


@query(f"""WITH c AS (SELECT l_orderkey AS entity, l_linenumber AS provider, l_quantity AS rating, {_VOTED} AS w FROM lineitem), a AS (SELECT entity, cast(sum(w) AS DOUBLE) AS total, count(*) AS sources FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY w DESC, provider, rating) AS rn FROM c),
q AS (SELECT r.entity, provider, rating, sources, round({_lift('cast(w AS DOUBLE) / total', 'sources')}, 6) AS confidence FROM r JOIN a USING (entity) WHERE rn = 1) SELECT * FROM q WHERE confidence >= 0.5""")
def q_pick_rating_lifted(t: Tables) -> DataFrame:
    """The rating with the greatest weight by votes, where its lifted confidence is enough."""
    claims = t.lineitem.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("provider"), F.col("l_quantity").alias("rating"), (F.col("l_partkey") % 500).alias("votes"), F.expr(_WEIGHT).alias("weight"))
    return P.pick_rating_lifted(claims)


_LINK = "CASE p_size % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN concat(' ', lower(p_type)) ELSE p_type END AS site, CASE WHEN p_size % 7 = 0 THEN '  ' ELSE concat('https://', CASE WHEN p_size % 2 = 0 THEN upper(replace(p_name, ' ', '.')) ELSE replace(p_name, ' ', '.') END, '/x') END AS url"


@query(f"WITH c AS (SELECT p_brand AS entity, p_partkey AS rank, {_LINK} FROM part) SELECT entity, trim(site) AS site, trim(url) AS url FROM c WHERE trim(site) <> '' AND trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY entity, lower(trim(site)), lower(trim(url)) ORDER BY rank, trim(site), trim(url)) = 1")
def q_link_union(t: Tables) -> DataFrame:
    """The links of each brand, each once in any case."""
    return P.union_links(t.part.selectExpr("p_brand AS entity", "p_partkey AS rank", *_LINK.replace(" AS site, ", " AS site\0").split("\0")))


_IMAGE = "concat(CASE l_linenumber % 4 WHEN 0 THEN 'http://' WHEN 1 THEN ' HTTPS://' WHEN 2 THEN 'https://' ELSE 'ftp://' END, 'img/', l_suppkey % 9, '.JPG ')"


@query(f"SELECT l_partkey AS entity, trim({_IMAGE}) AS url FROM lineitem WHERE regexp_matches(lower(trim({_IMAGE})), '^https?://') QUALIFY row_number() OVER (PARTITION BY l_partkey, lower(trim({_IMAGE})) ORDER BY l_orderkey, trim({_IMAGE})) = 1")
def q_gallery_union(t: Tables) -> DataFrame:
    """The images of each part, each address once."""
    return P.union_gallery(t.lineitem.select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("rank"), F.expr(_IMAGE).alias("url")))


# Spellings of entries of lists, dealt over the lines of orders.
_SPELLED = {
    "genres": ["Science Fiction", "science_fiction", "SciFi", "Slice of Life", "slice-of-life", "Boys Love", "BL", "Action", " action", "Comedy", "Drama", "Horror", "Mystery", "Romance", "Sports", "Fantasy", "History", "Music"],
    "authors": ["Mori Ryou", "Ryo Mori", "KATO, Yuuki", "Yuki Katou", "Ueda Shin", "Shin Ueda", "Abe Ken", "Hara Mei", "Kubo Ai", "Ono Jun", "Sato Rin", "Wada Kei", "Yano Emi", "Noda Go"],
    "publishers": ["North Press", "north-press", "South_Press", "", "South Press", "East House"],
}
_ITEM = "CASE l_suppkey % 3 " + " ".join(f"WHEN {k} THEN element_at(array({', '.join(map(repr, v))}), CAST((l_partkey + l_linenumber) % {len(v)} AS INT) + 1)" for k, v in enumerate(_SPELLED.values())) + " END"
_ITEM_SQL = "CASE l_suppkey % 3 " + " ".join(f"WHEN {k} THEN ({v})[(l_partkey + l_linenumber) % {len(v)} + 1]" for k, v in enumerate(_SPELLED.values())) + " END"
_FIELD = "CASE l_suppkey % 3 WHEN 0 THEN 'genres' WHEN 1 THEN 'authors' ELSE 'publishers' END"
_LOW = "trim(regexp_replace(lower(item), '[\\s_-]+', ' ', 'g'))"
_ALIAS = "CASE " + _LOW + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ALIASES.items()) + f" ELSE {_LOW} END"
_PERSON = "array_to_string(list_sort(list_transform(list_filter(string_split_regex(lower(item), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: replace(replace(replace(x, 'ou', 'o'), 'oo', 'o'), 'uu', 'u'))), ' ')"


@query(f"""WITH c AS (SELECT l_suppkey % 40 AS entity, {_FIELD} AS field, l_linenumber AS provider, l_orderkey * 8 + l_linenumber AS rank, trim({_ITEM_SQL}) AS item, {_WEIGHT} AS w FROM lineitem WHERE l_suppkey % 40 >= 6 OR l_linenumber <= 1 + l_suppkey % 2),
k AS (SELECT *, CASE field WHEN 'authors' THEN {_PERSON} WHEN 'genres' THEN {_ALIAS} ELSE {_LOW} END AS key FROM c WHERE item <> ''), n AS (SELECT entity, field, count(DISTINCT provider) AS sources FROM k GROUP BY 1, 2),
g AS (SELECT entity, field, key, sum(w) AS w, min(rank) AS first, arg_min(item, {{'a': CASE field WHEN 'authors' THEN -w ELSE 0 END, 'b': CASE field WHEN 'authors' THEN 0 ELSE rank END, 'c': item}}) AS item FROM k GROUP BY 1, 2, 3),
p AS (SELECT *, cast(w AS DOUBLE) / cast(sum(w) OVER (PARTITION BY entity, field) AS DOUBLE) AS share, row_number() OVER (PARTITION BY entity, field ORDER BY w DESC, first, key) AS place FROM g),
m AS (SELECT *, avg(share) OVER (PARTITION BY entity, field) AS mean FROM p WHERE place <= CASE field WHEN 'genres' THEN 12 WHEN 'authors' THEN 8 ELSE 6 END), f AS (SELECT m.*, round(greatest(mean, CASE WHEN sources <= 1 THEN 0.5 WHEN sources <= 2 THEN 0.4 ELSE 0 END::DOUBLE), 6) AS confidence FROM m JOIN n USING (entity, field))
SELECT entity, field, item, round(share, 6) AS share, place, confidence FROM f WHERE confidence >= 0.3""")
def q_field_lists(t: Tables) -> DataFrame:
    """Lists of genres, authors and publishers that several sources spell in their own ways; those that nobody agrees on go."""
    rows = t.lineitem.where("l_suppkey % 40 >= 6 or l_linenumber <= 1 + l_suppkey % 2")
    claims = rows.select((F.col("l_suppkey") % 40).alias("entity"), F.expr(_FIELD).alias("field"), F.col("l_linenumber").alias("provider"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rank"), F.expr(_ITEM).alias("item"), F.expr(_WEIGHT).alias("weight"))
    return P.union_lists(claims)


_STUBBED = f"SELECT entity, provider, CASE WHEN provider = 'wikipedia' AND entity % 2 = 0 THEN 1 ELSE value END AS value FROM ({_COUNTS})"


@query(f"""WITH p(provider, rank) AS (SELECT unnest({_PROVIDERS}), generate_subscripts({_PROVIDERS}, 1)), o AS ({_STUBBED}), c AS (SELECT * FROM o JOIN p USING (provider) WHERE NOT (provider = 'wikipedia' AND value = 1 AND EXISTS (SELECT 1 FROM o r WHERE r.entity = o.entity AND r.provider <> 'wikipedia' AND r.value >= 3))),
s AS (SELECT DISTINCT entity, value AS seed FROM c), k AS (SELECT s.entity, seed, count(*) AS n, count(*) FILTER (provider NOT IN ('anilist', 'mal')) AS others, min(rank) AS rank, min(value) AS lo, median(value) AS mid FROM s JOIN c ON c.entity = s.entity AND abs(value - seed) <= 1 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, others DESC, rank, lo) AS rn FROM k), a AS (SELECT entity, count(*) AS votes, min(value) AS least FROM c GROUP BY 1)
SELECT entity, votes, CASE WHEN n >= 2 THEN floor(mid + 0.5) ELSE least END AS value FROM b JOIN a USING (entity) WHERE rn = 1""")
def q_volume_consensus(t: Tables) -> DataFrame:
    """Counts within one of each other, after a source's placeholder of 1 has gone where others count three or more."""
    stub = F.when((F.col("provider") == "wikipedia") & (F.col("entity") % 2 == 0), 1).otherwise(F.col("value"))
    claims = P.without_stubs(_counts(t).withColumn("value", stub))
    return consensus.count_consensus(claims, 1).select("entity", "value").join(claims.groupBy("entity").agg(F.count("*").alias("votes")), "entity")


_PARTS = "SELECT o_custkey % 500 AS entity, o_orderkey % 6 AS part, min(o_orderkey) AS id, CASE WHEN o_orderkey % 6 < 5 THEN (o_orderkey % 6) * 10 + 1 END AS first, CASE WHEN o_orderkey % 6 < 5 THEN (o_orderkey % 6) * 10 + 12 END AS last FROM orders GROUP BY ALL"
_ITEMS = "SELECT o_orderkey AS item, o_custkey % 500 AS entity, CAST(o_orderkey % 63 + CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS number, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 7 END AS part, CASE WHEN o_orderkey % 5 < 2 THEN o_custkey % 6 END AS own FROM orders"


@query(f"""WITH p AS ({_PARTS}), i AS (SELECT i.*, p.id AS link FROM ({_ITEMS}) i LEFT JOIN p ON p.entity = i.entity AND p.part = i.own),
a AS (SELECT i.*, coalesce(number < p.first OR number > p.last, false) AS wrong FROM i LEFT JOIN p ON p.entity = i.entity AND p.id = i.link), b AS (SELECT item, entity, number, CASE WHEN NOT wrong THEN part END AS part, CASE WHEN NOT wrong THEN link END AS link FROM a),
c AS (SELECT b.*, CASE WHEN link IS NULL THEN p.id END AS named, link IS NULL AND coalesce(floor(number) < p.first OR floor(number) > p.last, false) AS stale FROM b LEFT JOIN p ON p.entity = b.entity AND p.part = b.part), d AS (SELECT item, entity, number, CASE WHEN NOT stale THEN part END AS part, coalesce(link, CASE WHEN NOT stale THEN named END) AS link FROM c),
h AS (SELECT item, min(p.part) AS part FROM d JOIN p ON p.entity = d.entity AND number BETWEEN first AND last WHERE link IS NULL GROUP BY 1)
SELECT d.item, cast(coalesce(h.part, d.part) AS BIGINT) AS part, coalesce(link, (SELECT id FROM p WHERE p.entity = d.entity AND p.part = h.part)) AS link FROM d LEFT JOIN h ON h.item = d.item""")
def q_relink_floor(t: Tables) -> DataFrame:
    """Items linked to numbered parts in three passes, entries between whole numbers by the number below them."""
    parts = t.orders.groupBy((F.col("o_custkey") % 500).alias("entity"), (F.col("o_orderkey") % 6).alias("part")).agg(F.min("o_orderkey").alias("id"))
    start = F.when(F.col("part") < 5, F.col("part") * 10)
    parts = parts.withColumns({"first": start + 1, "last": start + 12})
    items = t.orders.selectExpr("o_orderkey AS item", "o_custkey % 500 AS entity", "CAST(o_orderkey % 63 + CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS number", "CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 7 END AS part", "CASE WHEN o_orderkey % 5 < 2 THEN o_custkey % 6 END AS own")
    own = parts.select("entity", F.col("part").alias("own"), F.col("id").alias("link"))
    return P.relink(items.join(own, ["entity", "own"], "left").drop("own"), parts).select("item", F.col("part").cast("long").alias("part"), "link")
