"""Sort modes, best matches and duplicates of titles; similar titles are found by the joins of operators/similarity.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.functions import columns as C

from .similarity import dice_join, edit_join

#: What an equal year adds to a match.
SAME_YEAR = 1.15


def sort_modes(rows: DataFrame, key: str, id_col: str, title: str) -> DataFrame:
    """key, id and the place of each row within its key in seven orders; ties by id. rows has added, last_read, progress and n."""
    order = {
        "alphabetical": F.col(title).asc(), "alphabetical_desc": F.col(title).desc(), "date_added": F.col("added").desc(), "date_added_desc": F.col("added").asc(),
        "last_read": F.col("last_read").desc(), "progress": F.col("progress").desc(), "rating": F.col("n").desc(),
    }
    places = [F.row_number().over(Window.partitionBy(key).orderBy(by, id_col)).cast("long").alias(name) for name, by in order.items()]
    return rows.select(key, id_col, *places)


def first_by_key(values: Column, key: Callable[[Column], Column]) -> Column:
    """Of the entries of an array with one key, the first, in the order of the array."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, k: F.array_position(keys, F.get(keys, k)) == k + 1)


def _grams(df: DataFrame, text: str) -> DataFrame:
    """text, gram, n: the bigrams of each different text and how often it has them."""
    rows = df.select(text).distinct().select(text, F.explode(C.ngrams(F.col(text), 2)).alias("gram"))
    return rows.groupBy(text, "gram").agg(F.count("*").alias("n"))


def dice_pairs(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, dice of all pairs of texts with a common bigram: other pairs have 0."""
    x, y = _grams(a, left), _grams(b, right).withColumnRenamed("n", "m")
    shared = x.join(y, "gram").groupBy(left, right).agg(F.sum(F.least("n", "m")).alias("shared"))
    return shared.select(left, right, (2 * F.col("shared") / (F.length(left) + F.length(right) - 2)).alias("dice"))


def best_match(asked: DataFrame, names: DataFrame, least: float = 0.3) -> DataFrame:
    """asked, id, score: the best entity for each text asked for, none below `least`.

    names: id, titles, synonyms, popularity, adult, novel. The score is the greatest Dice coefficient of its titles and
    synonyms; halved for adult ones, 0.25 less where only one word of a longer title is shared, a fifth less for
    novels. Ties: a title before a synonym, then popularity, then id.
    """
    title = lambda c, main: names.select("id", F.explode(c).alias("name"), F.lit(main).alias("main"))
    known = title("titles", True).union(title("synonyms", False))
    scored = dice_join(asked, known, "asked", "name", least - 1e-6).join(known, "name")  # no factor raises a score
    own = scored.groupBy("asked", "id").agg(F.max(F.struct("dice", "main", "name")).alias("best")).select("asked", "id", "best.*")
    ask, name = F.split("asked", " "), F.split("name", " ")
    lone = (F.size(ask) >= 2) & (F.size(name) >= 3) & (F.size(F.filter(ask, lambda w: F.array_contains(name, w))) <= 1)
    score = (F.col("dice") * F.when(F.col("adult"), 0.5).otherwise(1.0) - F.when(lone, 0.25).otherwise(0.0)) * F.when(F.col("novel"), 0.8).otherwise(1.0)
    rows = own.join(names.select("id", "popularity", "adult", "novel"), "id").withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.desc("main"), F.desc("popularity"), "id"))
    return rows.withColumn("rn", rank).where("rn = 1").select("asked", "id", "score")


def fuzzy_duplicates(new: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """path, id, score: the known entity that each new one repeats, by an equal path, else by a similarity of `least` or more.

    new: path, title; known: path, title, id. The similarity is 1 - edits / longer length.
    """
    same = new.join(known.select("path", "id"), "path").select("path", "id", F.lit(2.0).alias("score"))
    other = known.withColumnRenamed("title", "name")
    pairs = edit_join(new, other, "title", "name", least)
    like = new.join(pairs, "title").join(other.select("name", "id"), "name").select("path", "id", "score")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "id"))
    return same.union(like).withColumn("rn", rank).where("rn = 1").select("path", "id", F.least(F.round("score", 6), F.lit(1.0)).alias("score"))


def _signals(pairs: DataFrame) -> DataFrame:
    """pairs (asked, name, dice, and of both sides counts c and chapters and years y and year) with gap and score; unknown counts and years do not weigh."""
    x, y = F.length("asked"), F.length("name")
    close = F.when((F.col("c") > 0) & (F.col("chapters") > 0), 0.7 + 0.3 * F.least("c", "chapters") / F.greatest("c", "chapters")).otherwise(1.0)
    years = F.abs(F.col("y") - F.col("year"))
    years = F.when(years.isNull(), 1.0).when(years == 0, SAME_YEAR).when(years <= 2, 1.0).otherwise(0.8)
    return pairs.withColumns({"gap": F.abs(x - y), "score": F.round(F.col("dice") * F.least(x, y) / F.greatest(x, y) * close * years, 6)})


def multi_signal_match(asked: DataFrame, names: DataFrame, least: float = 0.4) -> DataFrame:
    """asked, id, score: the best entity by Dice coefficient, ratio of lengths, closeness of counts and of years.

    asked: asked, chapters, year; names: id, name, chapters, year; unknown counts and years do not weigh. Ties: the
    smaller difference of lengths, then id."""
    pairs = dice_join(asked, names, "asked", "name", least / SAME_YEAR - 1e-6)  # no other factor raises a score
    a = asked.select("asked", F.col("chapters").alias("c"), F.col("year").alias("y"))
    rows = _signals(pairs.join(a, "asked").join(names.select("id", "name", "chapters", "year"), "name")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "gap", "id"))
    return rows.withColumn("rn", rank).where("rn = 1").select("asked", "id", "score")


def referenced_match(asked: DataFrame, names: DataFrame, differs: Callable[[Column, Column], Column], least: float = 0.4) -> DataFrame:
    """asked, id, score, how: as multi_signal_match, but entities that refer to the one asked for come first.

    asked: asked, ref (may be null), chapters, year; names: a row for each title of an id, with the id's ref, chapters
    and year. differs(asked, name): whether a title is of another edition; an id is of the right one if any of its
    titles is. how: `edition` (it refers to the one asked for, right edition), `reference` (any edition) or `title`
    (right edition, no reference needed); each needs a score of `least`, and the first that has one wins. Ties: the
    smaller difference of lengths, then id. References are joined by key, titles by their rarest grams."""
    a = asked.select("asked", "ref", F.col("chapters").alias("c"), F.col("year").alias("y"))
    b = names.select("id", "name", "chapters", "year")
    by_ref = a.where("ref is not null").join(names, "ref").select("asked", "name", "id", "c", "y", "chapters", "year", C.dice(F.col("asked"), F.col("name")).alias("dice"), F.lit(True).alias("referred"))
    by_title = dice_join(a, names, "asked", "name", least / SAME_YEAR - 1e-6).join(a, "asked").join(b, "name")
    by_title = by_title.select("asked", "name", "id", "c", "y", "chapters", "year", "dice", F.lit(False).alias("referred"))
    rows = _signals(by_ref.unionByName(by_title)).where(F.col("score") >= least)
    best = rows.groupBy("asked", "id", "referred").agg(F.min(F.struct((-F.col("score")).alias("s"), "gap")).alias("b"))
    own = best.select("asked", "id").distinct().join(names.select("id", "name"), "id").groupBy("asked", "id").agg(F.max(~differs(F.col("asked"), F.col("name"))).alias("fits"))
    how = F.when(F.col("referred") & F.col("fits"), "edition").when(F.col("referred"), "reference").when(F.col("fits"), "title")
    rows = best.join(own, ["asked", "id"]).select("asked", "id", (-F.col("b.s")).alias("score"), F.col("b.gap").alias("gap"), how.alias("how")).where("how is not null")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("how", F.desc("score"), "gap", "id"))  # the names stand in their order
    return rows.withColumn("rn", rank).where("rn = 1").select("asked", "id", "score", "how")
