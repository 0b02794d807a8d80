"""Releases judged by rules, and the quality of labelled pages from six factors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.functions.columns import safe_ratio

# Points of the rules, weights and bands of the factors, tiers.
BLOCKED, FEW_SEEDERS, TOO_SMALL, TOO_LARGE = -1000, -50, -50, -20
FORMAT, FORMAT_STEP, OFFICIAL, COMPLETE, VOLUME, MOST_SEEDERS, LANGUAGE, LANGUAGE_STEP = 100, 20, 50, 30, 40, 100, 30, 10
RECENT = ((30, 20), (90, 10), (365, 5))
VOLUMES = r"volume| vol[ .]|\sv\d+"
OTHER_SCRIPT = r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{AC00}-\x{D7AF}\x{4E00}-\x{9FFF}]"
FACTORS = {"tokens": 0.15, "labelled": 0.25, "diversity": 0.20, "confidence": 0.15, "structure": 0.10, "richness": 0.15}
TOKENS, LABELLED = (50, 2000), (0.05, 0.30)
STRUCTURE = {"infobox": 0.4, "table": 0.3, "header": 0.2, "list": 0.1}
TIERS = {"high": 0.75, "medium": 0.50, "low": 0.25}
MB = 1024 * 1024


@dataclass(frozen=True)
class Criteria:
    """What is asked of a release; lists are in order of preference."""

    formats: tuple[str, ...] = ("CBZ", "CBR", "PDF", "EPUB")
    languages: tuple[str, ...] = ("English", "Japanese")
    official: bool = True
    complete: bool = True
    min_seeders: int = 1
    seeder_points: int = 2
    max_days: int = 365
    min_mb: float = 10
    max_mb: float = 500
    only_languages: bool = True
    skip_blocked: bool = True


def _rank(x: Column, names: tuple[str, ...]) -> Column:
    """The place of x in names, from 0; null for others."""
    return F.coalesce(F.lit(None).cast("int"), *(F.when(x == n, k) for k, n in enumerate(names)))


def decide(releases: DataFrame, criteria: Criteria, now: Column) -> DataFrame:
    """releases with rejected (the first rule that refuses, or null), points (struct of ten parts), total.

    Columns read: title, protocol, seeders, size (bytes), format, language, languages (array), official, blocked, tags (array),
    published, base. Any of them may be null: a null says nothing, it neither refuses nor gives points (a null size counts as 0).
    Rules come in three groups. The first that refuses ends it: a blocked release, a torrent without seeders, a language that is
    not asked for (or, without one, a title in another script). Then points are taken off, then given.
    """
    c, torrent = criteria, F.coalesce(F.lower("protocol") == "torrent", F.lit(False))
    known = F.transform(F.filter(F.concat(F.array("language"), F.coalesce("languages", F.array().cast("array<string>"))), lambda x: F.coalesce(x != "", F.lit(False))), F.lower)
    wanted = F.array(*(F.lit(x.lower()) for x in c.languages)).cast("array<string>")
    foreign = ~F.arrays_overlap(known, wanted) & ((F.size(known) > 0) | F.coalesce(F.col("title").rlike(OTHER_SCRIPT), F.lit(False)))
    blocked = F.coalesce("blocked", F.lit(False)) & F.lit(c.skip_blocked)
    rejected = F.when(blocked, "blocklist").when(torrent & (F.col("seeders") == 0), "seeders").when(foreign & F.lit(c.only_languages and bool(c.languages)), "language")
    mb = F.coalesce("size", F.lit(0)) / MB
    least = F.coalesce(*(F.when(F.array_contains(known, x.lower()), LANGUAGE - LANGUAGE_STEP * k) for k, x in enumerate(c.languages)), F.lit(0))
    days = (F.unix_micros(F.to_timestamp(now)) - F.unix_micros(F.to_timestamp("published"))) / 86400e6
    recent = F.when(days > c.max_days, 0)
    for bound, points in RECENT:
        recent = recent.when(days < bound, points)
    many = F.when(F.col("seeders") >= c.min_seeders, F.least(F.col("seeders") * c.seeder_points, F.lit(MOST_SEEDERS))).when(F.col("seeders") > 0, FEW_SEEDERS)
    given = {
        "base": F.col("base"), "format": FORMAT - FORMAT_STEP * _rank(F.col("format"), c.formats), "official": F.when(F.col("official") & F.lit(c.official), OFFICIAL),
        "complete": F.when(F.array_contains("tags", "Complete") & F.lit(c.complete), COMPLETE), "volume": F.when(F.lower("title").rlike(VOLUMES), VOLUME),
        "seeders": F.when(torrent, many), "recency": recent, "language": least, "size": F.when(mb < c.min_mb, TOO_SMALL).when(mb > c.max_mb, TOO_LARGE),
    }
    taken = releases.withColumn("rejected", rejected)
    parts = {k: F.when(F.col("rejected").isNull(), F.coalesce(v.cast("double"), F.lit(0.0))).otherwise(0.0) for k, v in given.items()}
    parts["blocklist"] = F.when(F.col("rejected") == "blocklist", float(BLOCKED)).otherwise(0.0)
    taken = taken.withColumn("points", F.struct(*(v.alias(k) for k, v in parts.items())))
    return taken.withColumn("total", sum((F.col(f"points.{k}") for k in parts), F.lit(0.0)))


def best_releases(decided: DataFrame, keys: list[str], link: str, tie: list[Column], most: int = 1) -> DataFrame:
    """Of each group the accepted releases with a link and the highest totals, then by `tie`; `place` from 1.

    The window over one group keeps only its first rows on each task before the shuffle, as Spark limits ranks of a window."""
    order = Window.partitionBy(*keys).orderBy(F.desc("total"), *tie)
    fit = decided.where(F.col("rejected").isNull() & F.col(link).isNotNull())
    return fit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def page_factors(pages: DataFrame, kinds: int) -> DataFrame:
    """pages (tokens array<struct<kind, marks array>>, tags array of BIO tags, confidence) with words, entities and the six factors.

    Null arrays count as empty, a null confidence as 0.5. `kinds` is the number of entity types that exist. An entity is a B tag.
    Token kinds are word, image and others; marks are infobox, table, header, list, link, bold, italic.
    """
    empty = "array<struct<kind:string,marks:array<string>>>"
    tokens, tags = F.coalesce("tokens", F.array().cast(empty)), F.coalesce("tags", F.array().cast("array<string>"))
    marked = lambda *names: F.exists(F.col("__t"), lambda t: F.coalesce(F.arrays_overlap(t["marks"], F.array(*map(F.lit, names))), F.lit(False)))
    of_kind = lambda k: F.filter(F.col("__t"), lambda t: t["kind"] == k)
    begun = F.filter(F.col("__l"), lambda x: x.startswith("B-"))
    count, share = F.size("__t"), F.coalesce(safe_ratio(F.size(F.filter(F.col("__l"), lambda x: x != "O")), F.size("__l")), F.lit(0.0))
    points = lambda x, of: F.when(x, of).otherwise(0.0)
    length = F.when(count < TOKENS[0], count / TOKENS[0]).when(count > TOKENS[1], F.greatest(F.lit(0.5), 1 - (count - TOKENS[1]) / TOKENS[1])).otherwise(1.0)
    labelled = F.when(share < LABELLED[0], share * 10).when(share > LABELLED[1], F.greatest(F.lit(0.5), 1 - (share - LABELLED[1]) * 2)).otherwise(1.0)
    rich = points(F.size(of_kind("image")) > 0, 0.3) + points(marked("link"), 0.3) + points(marked("bold", "italic"), 0.2) + F.col("tokens_factor") * 0.2
    out = pages.withColumns({"__t": tokens, "__l": tags})
    out = out.withColumns({"n_tokens": count.cast("long"), "n_words": F.size(of_kind("word")).cast("long"), "n_entities": F.size(begun).cast("long"), "labelled_share": share, "tokens_factor": length, "labelled_factor": labelled})
    out = out.withColumns({
        "diversity_factor": F.size(F.array_distinct(begun)) / kinds,
        "confidence_factor": F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)),
        "structure_factor": F.least(F.lit(1.0), sum((points(marked(k), w) for k, w in STRUCTURE.items()), F.lit(0.0))),
        "richness_factor": F.when(count == 0, 0.0).otherwise(F.least(F.lit(1.0), rich)),
    })
    return out.drop("__t", "__l")


def quality_score(weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of the factors of page_factors, between 0 and 1; weights replace those of the same name."""
    total = sum((F.col(f"{k}_factor") * w for k, w in (FACTORS | (weights or {})).items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def quality_tier(score: Column) -> Column:
    """high, medium, low or exclude."""
    tier = F.lit("exclude")
    for name, least in reversed(TIERS.items()):
        tier = F.when(score >= least, name).otherwise(tier)
    return tier


def advice(tier: Column) -> Column:
    """Names of what a page lacks, in order: short, long, unlabelled, few, uniform, flat, exclude."""
    signs = {
        "short": F.col("n_tokens") < TOKENS[0], "long": F.col("n_tokens") > TOKENS[1], "unlabelled": F.col("labelled_share") < 0.02, "few": F.col("n_entities") < 3,
        "uniform": F.col("diversity_factor") < 0.1, "flat": F.col("structure_factor") < 0.2, "exclude": tier == "exclude",
    }
    return F.array_compact(F.array(*(F.when(x, k) for k, x in signs.items())))


def tier_stats(scored: DataFrame) -> DataFrame:
    """scored (score, tier, n_tokens, n_entities) to a row for each tier, empty ones too, and one for all: n and means (0 without pages)."""
    means = [F.avg(c).alias(f"mean_{c.removeprefix('n_')}") for c in ("score", "n_tokens", "n_entities")]
    found = scored.cube("tier").agg(F.count("*").alias("n"), *means, F.grouping("tier").alias("every"))
    found = found.select(F.when(F.col("every") == 1, "all").otherwise(F.col("tier")).alias("tier"), "n", *(f"mean_{c}" for c in ("score", "tokens", "entities")))
    names = scored.sparkSession.createDataFrame([(x,) for x in (*TIERS, "exclude", "all")], "tier string")
    return names.join(found, "tier", "left").na.fill(0)
