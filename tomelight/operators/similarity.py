"""Similarity joins of strings that compare few pairs and lose none: rarest grams for Dice, segments for edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.functions import columns as C

#: Slack for bounds that are computed in doubles.
EPS = 1e-9


def _bags(df: DataFrame, text: str) -> DataFrame:
    """text and bag of each different text: its bigrams, the second of a kind apart from the first, so that multisets are sets."""
    return df.select(F.col(text).alias("text")).distinct().select("text", C.bigram_bag(F.col("text")).alias("bag"))


def _grams(bags: DataFrame, *columns) -> DataFrame:
    """A row for each gram. The outer form keeps Spark from making the bags in a filter below distinct, of every row instead of every text."""
    return bags.select(*columns, F.explode_outer("bag").alias("gram")).where("gram is not null")


def _rarest(bags: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """The grams of each text that a partner has to share one of: the rarest ones, all but as many as must be shared, less one."""
    must = F.ceil(F.col("size") * (least / (2 - least)) - EPS)
    rank = F.row_number().over(Window.partitionBy("text").orderBy("f", "gram"))
    grams = _grams(bags, "text", F.size("bag").alias("size"))
    return grams.join(frequency, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - must + 1).select("text", "size", "gram")


def _candidates(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    frequency = _grams(x).unionAll(_grams(y))
    frequency = frequency.groupBy("gram").agg(F.count("*").alias("f"))
    y = _rarest(y, frequency, least).select("gram", F.col("text").alias("other"), F.col("size").alias("others"))
    most = (2 - least) / least
    band = (F.col("others") <= F.col("size") * most + EPS) & (F.col("size") <= F.col("others") * most + EPS)
    return _rarest(x, frequency, least).join(y, "gram").where(band).select("text", "other").distinct()


def dice_candidates(a: DataFrame, b: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """Pairs of texts that may have a Dice coefficient of `least` or more (above 0).

    Two sets of x and y grams with that coefficient share least / 2 * (x + y) of them, so their sizes lie in a band, and
    the rarest grams of both, in one order by frequency, meet."""
    return _candidates(_bags(a, left), _bags(b, right), least).toDF(left, right)


def dice_join(a: DataFrame, b: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """left, right, dice of the pairs of texts with a Dice coefficient of bigrams of `least` or more."""
    x, y = _bags(a, left), _bags(b, right)
    found = _candidates(x, y, least).join(x, "text").join(y.select(F.col("text").alias("other"), F.col("bag").alias("bags")), "other")
    found = found.select(F.col("text").alias(left), F.col("other").alias(right), C.bag_dice(F.col("bag"), F.col("bags")).alias("dice"))
    return found.where(F.col("dice") >= least - EPS)


def _edits(longer: Column, least: float) -> Column:
    return F.floor(longer * (1 - least) + EPS).cast("int")


def _segments(longer: Column, edits: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i (a column) of edits + 1 parts of a text, the last ones a sign longer."""
    i, base = F.col("i"), F.floor(longer / (edits + 1)).cast("int")
    short = edits + 1 - (longer - base * (edits + 1))
    return i * base + F.greatest(F.lit(0), i - short), base + (i >= short).cast("int")


def _as_longer(names: DataFrame, least: float) -> DataFrame:
    """long, and a key of each of its segments: for the edits that its length allows there is one that stays whole."""
    n = F.length("name")
    rows = names.select(F.col("name").alias("long"), n.cast("int").alias("m"), F.explode(F.sequence(F.lit(0), _edits(n, least))).alias("i"))
    start, size = _segments(F.col("m"), _edits(F.col("m"), least))
    return rows.select("long", "m", "i", F.substring("long", start + 1, size).alias("part"))


def _as_shorter(names: DataFrame, least: float) -> DataFrame:
    """short, and keys of the parts of it that may be a segment of a text of each length it can be matched with.

    Of the edits before and after a whole segment i of k + 1, some segment has at most i before and k - i after it, so a
    part is moved by no more."""
    n = F.length("name").cast("int")
    rows = names.select(F.col("name").alias("short"), n.alias("l"), F.explode(F.sequence(n, F.floor(n / least + EPS).cast("int"))).alias("m"))
    k, gap = _edits(F.col("m"), least), F.col("m") - F.col("l")
    rows = rows.where(gap <= k).withColumn("i", F.explode(F.sequence(F.lit(0), k)))
    start, size = _segments(F.col("m"), k)
    i = F.col("i")
    low = F.greatest(F.lit(0), start - i, start - gap - (k - i))
    high = F.least(F.col("l") - size, start + i, start - gap + (k - i))
    rows = rows.withColumns({"low": low, "high": high, "size": size}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    return rows.select("short", "m", "i", F.substring("short", F.col("at") + 1, F.col("size")).alias("part")).distinct()


def edit_candidates(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(x, y) of the names in a and b (columns `name`) that may be as like as `least`, by edit distance over the longer length."""
    a, b = a.select("name").distinct(), b.select("name").distinct()
    on = ["m", "i", "part"]
    one = _as_longer(a, least).join(_as_shorter(b, least), on).select(F.col("long").alias("x"), F.col("short").alias("y"))
    other = _as_shorter(a, least).join(_as_longer(b, least), on).select(F.col("short").alias("x"), F.col("long").alias("y"))
    return one.union(other).distinct()


def edit_join(a: DataFrame, b: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """left, right, score of the pairs of texts with a similarity (see columns.similarity) of `least` or more, above 0."""
    plain = lambda df, c, own: df.select(F.col(c).alias(own)).where(F.col(own).isNotNull()).distinct().withColumn("name", F.lower(F.trim(own)))
    one, other = plain(a, left, "one"), plain(b, right, "other")
    pairs = edit_candidates(one, other, least).withColumn("score", C.similarity(F.col("x"), F.col("y"))).where(F.col("score") >= least - EPS)
    pairs = pairs.join(one.withColumnRenamed("name", "x"), "x").join(other.withColumnRenamed("name", "y"), "y")
    return pairs.select(F.col("one").alias(left), F.col("other").alias(right), "score")
