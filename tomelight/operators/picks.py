"""Picks and unions of structured fields and lists that several sources name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.functions.folding import person_key
from tomelight.functions.titles import synonym_key
from tomelight.operators.validation import votes_scale

# Least confidences by the number of sources, the ones below which nothing is picked, entries kept of a list.
LIFTS, REJECT, LIST_REJECT, LIST_FLOORS, UNION = ((1, 0.75), (4, 0.55)), 0.50, 0.30, ((1, 0.5), (2, 0.4)), 0.9
MANY_LIFT = 0.45
LIMITS = {"genres": 12, "tags": 30, "themes": 20, "authors": 8, "artists": 8, "synonyms": 25, "urls": 40, "publishers": 6}
LIMIT = 30
PEOPLE, ALIASED = ("authors", "artists"), ("genres", "tags", "themes")
ALIASES = {
    "science fiction": "sci-fi", "scifi": "sci-fi", "sci fi": "sci-fi", "coming of age": "coming-of-age", "boys love": "boys-love", "bl": "boys-love",
    "girls love": "girls-love", "gl": "girls-love", "martial arts": "martial-arts", "post apocalyptic": "post-apocalyptic",
}
_EXACT = "decimal(18,6)"


def lifted(share: Column, weight: Column, sources: Column) -> Column:
    """A share of weight, raised to what one credible source, two to four, or more are worth; not where the weight is 0."""
    floor = F.lit(MANY_LIFT)
    for most, least in reversed(LIFTS):
        floor = F.when(sources <= most, least).otherwise(floor)
    return F.when(weight > 0, F.greatest(share, floor)).otherwise(share)


def _picked(rows: DataFrame, order: Column, value: str) -> DataFrame:
    """rows (entity, provider, weight as decimal, value) to the first of each entity by `order`, with its lifted confidence, if it is enough."""
    best = rows.groupBy("entity").agg(F.min_by(F.struct("provider", value, "weight"), order).alias("b"), F.sum("weight").cast("double").alias("all"), F.count("*").alias("sources"))
    weight = F.col("b.weight").cast("double")
    share = F.when(F.col("all") > 0, weight / F.col("all")).otherwise(0.0)
    found = best.withColumn("confidence", F.round(lifted(share, weight, F.col("sources")), 6)).where(F.col("confidence") >= REJECT)
    return found.select("entity", "b.provider", f"b.{value}", "sources", "confidence")


def pick_date(claims: DataFrame, latest: bool = False) -> DataFrame:
    """claims (entity, provider, date, weight) to entity, provider, date, sources, confidence: the earliest or latest date, then the heaviest, then the first name.

    Null dates are no claims; an entity whose confidence stays below 0.5 (five or more sources of which the picked one is light) is left out."""
    rows = claims.where("date is not null").select("entity", "provider", "date", F.coalesce("weight", F.lit(0)).cast(_EXACT).alias("weight"))
    micros = F.unix_micros(F.to_timestamp("date"))
    return _picked(rows, F.struct(-micros if latest else micros, -F.col("weight"), "provider"), "date")


def pick_rating_lifted(claims: DataFrame) -> DataFrame:
    """claims (entity, provider, rating, votes, weight): the greatest weight by number of votes, then the first name; confidence as for dates."""
    weight = F.coalesce("weight", F.lit(0)) * votes_scale(F.col("votes"))
    rows = claims.where("rating is not null").select("entity", "provider", "rating", weight.cast(_EXACT).alias("weight"))
    return _picked(rows, F.struct(-F.col("weight"), "provider", "rating"), "rating")


def union_links(claims: DataFrame) -> DataFrame:
    """claims (entity, rank, site, url) to entity, site, url: each pair once in any case, as the first claim writes it; blank ones are left out."""
    site, url = F.trim("site"), F.trim("url")
    rows = claims.select("entity", "rank", site.alias("site"), url.alias("url")).where("site <> '' and url <> ''")
    first = F.min(F.struct("rank", "site", "url")).alias("f")
    return rows.groupBy("entity", F.lower("site"), F.lower("url")).agg(first).select("entity", "f.site", "f.url")


def union_gallery(claims: DataFrame) -> DataFrame:
    """claims (entity, rank, url) to entity, url: each http or https address once in any case, as the first claim writes it."""
    rows = claims.select("entity", "rank", F.trim("url").alias("url")).where(F.col("url").rlike("^(?i)https?://"))
    return rows.groupBy("entity", F.lower("url")).agg(F.min(F.struct("rank", "url")).alias("f")).select("entity", "f.url")


def list_key(item: Column, field: Column) -> Column:
    """What entries of a list are told apart by: people by their names' parts, synonyms as titles are, others in lower case with single spaces, genres and tags by one name of several."""
    low = F.trim(F.regexp_replace(F.lower(item), r"[\s_-]+", " "))
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.when(field.isin(*PEOPLE), person_key(item)).when(field == "synonyms", synonym_key(item)).when(field.isin(*ALIASED), F.coalesce(F.try_element_at(alias, low), low)).otherwise(low)


def union_lists(claims: DataFrame) -> DataFrame:
    """claims (entity, field, provider, rank, item, weight) to entity, field, item, share, place, confidence.

    Entries of one key add their weights up; the heaviest stay, as many as the field keeps, then the first named. People are
    written as the heaviest source writes them, others as the first. The confidence is the mean share of those that stay, with a
    floor for one or two sources; lists below 0.3 are left out. Blank entries are no claims.
    """
    rows = claims.withColumn("item", F.trim("item")).withColumns({"key": list_key(F.col("item"), F.col("field")), "w": F.coalesce("weight", F.lit(0)).cast(_EXACT)}).where("item <> '' and key <> ''")
    sources = rows.groupBy("entity", "field").agg(F.count_distinct("provider").alias("sources"))
    heavy = F.when(F.col("field").isin(*PEOPLE), -F.col("w")).otherwise(F.lit(0).cast(_EXACT))
    turn = F.when(F.col("field").isin(*PEOPLE), 0).otherwise(F.col("rank"))
    sums = rows.groupBy("entity", "field", "key").agg(F.sum("w").alias("w"), F.min("rank").alias("first"), F.min_by("item", F.struct(heavy, turn, "item")).alias("item"))
    every = Window.partitionBy("entity", "field")
    kept = F.coalesce(*(F.when(F.col("field") == k, n) for k, n in LIMITS.items()), F.lit(LIMIT))
    total = F.sum("w").over(every).cast("double")
    sums = sums.withColumns({"share": F.when(total > 0, F.col("w").cast("double") / total).otherwise(0.0), "place": F.row_number().over(every.orderBy(F.desc("w"), "first", "key"))})
    sums = sums.where(F.col("place") <= kept).withColumn("mean", F.avg("share").over(every))
    floor = F.lit(0.0)
    for most, least in reversed(LIST_FLOORS):
        floor = F.when(F.col("sources") <= most, least).otherwise(floor)
    found = sums.join(sources, ["entity", "field"]).withColumn("confidence", F.round(F.greatest("mean", floor), 6))
    return found.where(F.col("confidence") >= LIST_REJECT).select("entity", "field", "item", F.round("share", 6).alias("share"), "place", "confidence")


def without_stubs(claims: DataFrame, stub: str = "wikipedia", enough: int = 3) -> DataFrame:
    """claims (entity, provider, value) without the stub source's count of 1 where another source of the entity counts `enough` or more."""
    rich = F.max(F.when(F.col("provider") != stub, F.col("value"))).over(Window.partitionBy("entity"))
    rows = claims.withColumn("__rich", rich)
    return rows.where(~((F.col("provider") == stub) & (F.col("value") == 1) & F.coalesce(F.col("__rich") >= enough, F.lit(False)))).drop("__rich")


def relink(items: DataFrame, parts: DataFrame) -> DataFrame:
    """items (entity, item, number, part, link) to the same with part and link made right; parts (entity, part, id, first, last).

    Passes in order: a link to a part whose range lacks the number goes, and the part's number with it; without a link, the part
    named is linked, unless its range lacks the number's whole part, then its name goes too; what is still without a link takes
    the first part, by number, whose range holds the number. Parts without a range are trusted. An entity's parts are one array,
    an item meets them in one join; repeated ids or numbers of parts count as the first by (part, id).
    """
    span = F.struct("part", "id", "first", "last")
    lists = parts.groupBy("entity").agg(F.sort_array(F.collect_list(span)).alias("__parts"))
    rows = items.join(lists, "entity", "left")
    outside = lambda p, n: F.coalesce((n < p["first"]) | (n > p["last"]), F.lit(False)) & p["first"].isNotNull() & p["last"].isNotNull()
    first = lambda test: F.get(F.filter("__parts", test), F.lit(0))
    linked = first(lambda p: p["id"] == F.col("link"))
    rows = rows.withColumn("__wrong", F.coalesce(outside(linked, F.col("number")), F.lit(False)))
    rows = rows.withColumns({"link": F.when(~F.col("__wrong"), F.col("link")), "part": F.when(~F.col("__wrong"), F.col("part"))}).drop("__wrong")
    named = first(lambda p: p["part"] == F.col("part"))
    rows = rows.withColumn("__named", F.when(F.col("link").isNull(), named))
    rows = rows.withColumn("__stale", F.coalesce(outside(F.col("__named"), F.floor("number")), F.lit(False)))
    rows = rows.withColumns({"link": F.coalesce("link", F.when(~F.col("__stale"), F.col("__named.id"))), "part": F.when(~F.col("__stale"), F.col("part"))})
    hit = first(lambda p: F.col("number").between(p["first"], p["last"]))
    rows = rows.withColumn("__hit", F.when(F.col("link").isNull(), hit))
    return rows.withColumns({"link": F.coalesce("link", F.col("__hit.id")), "part": F.coalesce(F.col("__hit.part"), F.col("part"))}).select(*items.columns)
