"""Queries over titles: sort modes, numbers and ranges, comparison, matching and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomelight.functions import columns as C, titles as T
from tomelight.operators import matching

from .registry import Tables, query

#: Release titles made of part rows; the same expression for both engines.
TITLE = """CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ' v', lpad(concat(p_size), 2, '0'), '-v', p_size + 3) WHEN 1 THEN concat('[Team] ', p_name, ' Chapter ', p_size, '.5 (2019)')
WHEN 2 THEN concat('000-', p_size % 5 + 1, '. ', p_name) WHEN 3 THEN concat(p_size, '. ', p_name) WHEN 4 THEN concat(p_name, ' {2019} Vol. ', p_size, ' to ', p_size + 2) WHEN 5 THEN concat('第', p_size, '-', p_size + 2, '巻 ', p_name)
WHEN 6 THEN concat(p_size, '-', p_size + 4, ' ', p_name, ' Deluxe') WHEN 7 THEN concat(p_name, ' Tome ', p_size, ' part 2') ELSE p_name END"""


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hit(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {_lit(pattern)}, {group}), '')"


def _titles(t: Tables) -> DataFrame:
    return t.part.select("*", F.expr(TITLE).alias("title"))


_SORTED = "SELECT p_brand, l_partkey, row_number() OVER (w ORDER BY p_name, l_partkey) AS alphabetical, row_number() OVER (w ORDER BY p_name DESC, l_partkey) AS alphabetical_desc, row_number() OVER (w ORDER BY added DESC, l_partkey) AS date_added, row_number() OVER (w ORDER BY added, l_partkey) AS date_added_desc, row_number() OVER (w ORDER BY last_read DESC, l_partkey) AS last_read, row_number() OVER (w ORDER BY progress DESC, l_partkey) AS progress, row_number() OVER (w ORDER BY n DESC, l_partkey) AS rating FROM e WINDOW w AS (PARTITION BY p_brand)"


@query(f"WITH e AS (SELECT p_brand, l_partkey, p_name, min(l_shipdate) AS added, max(CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE TIMESTAMP '1970-01-01' END) AS last_read, count(*) FILTER (l_returnflag = 'R') / count(*) AS progress, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3) {_SORTED}")
def q_sort_modes(t: Tables) -> DataFrame:
    """The place of each entity of a brand in the seven sort modes; one shuffle for all."""
    read = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).otherwise(F.lit("1970-01-01").cast("timestamp"))
    own = t.lineitem.groupBy("l_partkey").agg(F.min("l_shipdate").alias("added"), F.max(read).alias("last_read"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("progress"), F.count("*").alias("n"))
    rows = own.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey")
    return matching.sort_modes(rows, "p_brand", "l_partkey", "p_name")


_MINOR = "coalesce(" + ", ".join(_hit("t", p) for p in T.PREQUEL) + ")"
_NUMBER = f"try_cast(coalesce('0.' || {_MINOR}, " + ", ".join(_hit("t", p) for p in T.NUMBERED) + ") AS DOUBLE)"


@query(f"SELECT p_partkey, CASE WHEN n >= 0 AND n < 10000 THEN n END AS number FROM (SELECT p_partkey, {_NUMBER} AS n FROM (SELECT p_partkey, {TITLE} AS t FROM part))")
def q_extract_seq_no(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", T.sequence_number(F.col("title")).alias("number"))


def _range_sql() -> str:
    ints = lambda p, g: f"try_cast({_hit('t', p, g)} AS INTEGER)"
    first, last, single = [], [], []
    for k, p in enumerate(T.RANGES):
        a, b = ints(p, 1), ints(p, 2)
        ok = f"{b} >= {a}" + (f" AND {a} >= 1 AND {b} <= 999 AND {b} - {a} <= 100" if k == len(T.RANGES) - 1 else "")
        first.append(f"WHEN {ok} THEN {a}")
        last.append(f"WHEN {ok} THEN {b}")
        single.append(f"WHEN {ok} THEN false")
    for k, p in enumerate(T.SINGLES):
        a = ints(p, 1)
        ok = f"{a} BETWEEN 1 AND 99 AND NOT regexp_matches(t, {_lit(T.VOLUME_WORD)})" if k == len(T.SINGLES) - 1 else f"{a} IS NOT NULL"
        first.append(f"WHEN {ok} THEN {a}")
        last.append(f"WHEN {ok} THEN {a}")
        single.append(f"WHEN {ok} THEN true")
    case = lambda xs: f"CASE {' '.join(xs)} END"
    pad = lambda c: f"'v' || lpad(cast({c} AS VARCHAR), cast(greatest(2, length(cast({c} AS VARCHAR))) AS INTEGER), '0')"
    rows = f"SELECT p_partkey, {case(first)} AS a, {case(last)} AS b, {case(single)} AS s FROM (SELECT p_partkey, trim(regexp_replace({TITLE}, '[\\[\\](){{}}<>]', ' ', 'g')) AS t FROM part)"
    return f"SELECT p_partkey, a AS first_volume, b AS last_volume, s AS single, CASE WHEN s THEN {pad('a')} ELSE {pad('a')} || '-' || {pad('b')} END AS label, greatest(b - a + 1, 0) AS volumes FROM ({rows}) WHERE a IS NOT NULL"


@query(_range_sql())
def q_parse_range(t: Tables) -> DataFrame:
    rows = _titles(t).select("p_partkey", T.volume_range(F.col("title")).alias("r")).where("r is not null")
    volumes = F.greatest(F.col("r.end") - F.col("r.start") + 1, F.lit(0))
    return rows.select("p_partkey", F.col("r.start").alias("first_volume"), F.col("r.end").alias("last_volume"), F.col("r.single").alias("single"), T.volume_label(F.col("r")).alias("label"), volumes.alias("volumes"))


def _noise_sql(x: str) -> str:
    for p in T.NOISE:
        x = f"regexp_replace({x}, {_lit(p)}, ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT {_noise_sql(TITLE)} AS bare FROM part")
def q_strip_noise(t: Tables) -> DataFrame:
    return _titles(t).select(T.without_noise(F.col("title")).alias("bare")).distinct()


@query("SELECT p_partkey, " + " OR ".join(f"regexp_matches(a, {_lit(p)}) <> regexp_matches(b, {_lit(p)})" for p in (*T.EDITIONS, *T.SPINOFFS)) + f" AS mismatch FROM (SELECT p_partkey, {TITLE} AS a, p_name AS b FROM part)")
def q_edition_mismatch(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", T.edition_mismatch(F.col("title"), F.col("p_name")).alias("mismatch"))


_GRAMS = "list_distinct(list_transform(generate_series(1, length({0}) - 1), lambda k: substr({0}, k, 2)))"
_PAIRS = f"(SELECT DISTINCT translate(lower({TITLE}), '第巻', '##') AS a, lower(concat(p_type, ' ', p_name)) AS b FROM part)"


def _pairs(t: Tables) -> DataFrame:
    """Title and type with name; ASCII, as DuckDB's edit distance counts bytes."""
    return _titles(t).select(F.translate(F.lower("title"), "第巻", "##").alias("a"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("b")).distinct()


@query(f"WITH x AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS lev, {_GRAMS.format('a')} AS ga, {_GRAMS.format('b')} AS gb FROM {_PAIRS}) SELECT a, b, round(0.4 * lev + 0.6 * len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) AS score FROM x")
def q_combined_similarity(t: Tables) -> DataFrame:
    pairs = _pairs(t)
    score = 0.4 * C.similarity(F.col("a"), F.col("b")) + 0.6 * C.jaccard(F.col("a"), F.col("b"))
    return pairs.select("a", "b", F.round(score, 6).alias("score"))


@query(f"WITH x AS (SELECT a, b, list_distinct(string_split(a, '')) AS ca, list_distinct(string_split(b, '')) AS cb FROM {_PAIRS}) SELECT a, b, round(CASE WHEN length(a) < length(b) AND contains(b, a) THEN length(a) / length(b) WHEN length(a) >= length(b) AND contains(a, b) THEN length(b) / length(a) ELSE len(list_intersect(ca, cb)) / (len(ca) + len(cb) - len(list_intersect(ca, cb))) END, 6) AS overlap FROM x")
def q_charset_overlap(t: Tables) -> DataFrame:
    pairs = _pairs(t)
    return pairs.select("a", "b", F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


_SYNONYMS = "(SELECT p_partkey, unnest([p_name, upper(p_name), replace(p_name, ' ', '-'), p_type, lower(p_type) || '!']) AS s, unnest([1, 2, 3, 4, 5]) AS pos FROM part)"


@query(f"SELECT p_partkey, string_agg(s, '|' ORDER BY pos) AS synonyms FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, trim(regexp_replace(lower(s), '[\\s_\\-:/.,;!?''\"]+', ' ', 'g')) ORDER BY pos) AS rn FROM {_SYNONYMS}) WHERE rn = 1 GROUP BY 1")
def q_synonym_dedupe(t: Tables) -> DataFrame:
    """Synonyms with one key are one, the first; inside the row, without a shuffle."""
    name, kind = F.col("p_name"), F.col("p_type")
    return t.part.select("p_partkey", F.array_join(matching.first_by_key(F.array(name, F.upper(name), F.replace(name, F.lit(" "), F.lit("-")), kind, F.concat(F.lower(kind), F.lit("!"))), T.synonym_key), "|").alias("synonyms"))


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({TITLE}), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def q_comparison_key(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", T.comparison_key(F.col("title")).alias("key"))


@query(rf"WITH k AS (SELECT p_partkey, unnest(regexp_extract_all({TITLE}, '[{T.CJK}]|[^\s{T.CJK}]+')) AS w FROM part) SELECT p_partkey, CASE WHEN regexp_matches(w, '^[{T.CJK}]$') THEN 'cjk' WHEN regexp_matches(w, '^\d+(?:[.,]\d+)?$') THEN 'number' WHEN regexp_matches(w, '^\p{{L}}+$') THEN 'word' ELSE 'mixed' END AS kind, count(*) AS n FROM k GROUP BY 1, 2")
def q_typed_tokens(t: Tables) -> DataFrame:
    words = _titles(t).select("p_partkey", F.explode(T.cjk_tokens(F.col("title"))).alias("w"))
    return words.groupBy("p_partkey", T.token_type(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


_NAMES = "SELECT p_name AS title, p_name || ' ' || min(p_type) AS synonym, count(*) AS popularity, starts_with(p_name, 'hot') AS adult, ends_with(p_name, 'anvil') AS novel FROM part GROUP BY p_name"
_BIGRAMS = "SELECT {0}, g, count(*) AS n FROM (SELECT {0}, unnest(list_transform(generate_series(1, length({0}) - 1), lambda k: substr({0}, k, 2))) AS g FROM (SELECT DISTINCT {0} FROM {1})) GROUP BY 1, 2"


@query(f"""WITH q AS (SELECT DISTINCT lower({_noise_sql(TITLE)}) AS asked FROM part), n AS ({_NAMES}), c AS (SELECT title AS id, lower(title) AS name, true AS main FROM n UNION ALL SELECT title, lower(synonym), false FROM n),
gq AS ({_BIGRAMS.format('asked', 'q')}), gc AS ({_BIGRAMS.format('name', 'c')}),
d AS (SELECT asked, name, sum(least(gq.n, gc.n)) AS shared FROM gq JOIN gc USING (g) GROUP BY 1, 2),
s AS (SELECT asked, id, name, main, 2 * shared / (length(asked) + length(name) - 2) AS dice FROM d JOIN c USING (name)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked, id ORDER BY dice DESC, main DESC, name) AS rn FROM s) WHERE rn = 1),
p AS (SELECT asked, id, main, popularity, round((dice * CASE WHEN adult THEN 0.5 ELSE 1 END - CASE WHEN len(string_split(asked, ' ')) >= 2 AND len(string_split(name, ' ')) >= 3 AND len(list_filter(string_split(asked, ' '), lambda w: list_contains(string_split(name, ' '), w))) <= 1 THEN 0.25 ELSE 0 END) * CASE WHEN novel THEN 0.8 ELSE 1 END, 6) AS score FROM b JOIN n ON n.title = b.id)
SELECT asked, id, score FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, main DESC, popularity DESC, id) AS rn FROM p) WHERE rn = 1 AND score >= 0.3""")
def q_best_match(t: Tables) -> DataFrame:
    asked = _titles(t).select("title").distinct().select(F.lower(T.without_noise(F.col("title"))).alias("asked")).distinct()
    names = t.part.groupBy(F.col("p_name").alias("id")).agg(F.concat_ws(" ", "p_name", F.min("p_type")).alias("synonym"), F.count("*").alias("popularity"))
    names = names.select("id", F.array(F.lower("id")).alias("titles"), F.array(F.lower("synonym")).alias("synonyms"), "popularity", F.startswith("id", F.lit("hot")).alias("adult"), F.endswith("id", F.lit("anvil")).alias("novel"))
    return matching.best_match(asked, names)


@query(f"""WITH q AS (SELECT DISTINCT {TITLE} AS path, lower({_noise_sql(TITLE)}) AS title FROM part), k AS (SELECT p_name AS path, lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1, 2),
e AS (SELECT q.path, q.title, k.id, CASE WHEN q.path = k.path THEN 2.0 ELSE 1 - levenshtein(q.title, k.name) / greatest(length(q.title), length(k.name)) END AS score FROM q CROSS JOIN k)
SELECT path, id, least(round(score, 6), 1.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS rn FROM e WHERE score >= 0.8 - 1e-9) WHERE rn = 1""")
def q_fuzzy_dupes(t: Tables) -> DataFrame:
    new = _titles(t).select(F.col("title").alias("path"), F.lower(T.without_noise(F.col("title"))).alias("title")).distinct()
    known = t.part.groupBy(F.col("p_name").alias("path")).agg(F.min("p_partkey").alias("id")).select("path", F.lower("path").alias("title"), "id")
    return matching.fuzzy_duplicates(new, known, 0.8)
