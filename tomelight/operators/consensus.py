"""Votes over conflicting claims in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.functions.columns import agreement_confidence

# The weight of each provider's claims, and those that count as one witness.
WEIGHTS = {"anilist": 0.95, "mangadex": 0.96, "mal": 0.92, "mangaupdates": 0.95, "kitsu": 0.56, "comicvine": 0.70, "fandom": 0.87, "wikipedia": 0.90}
ANCHORS = ("anilist", "mal")


def categorical_vote(claims: DataFrame) -> DataFrame:
    """claims (entity, provider, value) to entity, value, agreement, confidence: the value with the most weight wins, then the least.

    Claims without a value or of an unknown provider have no vote."""
    weight = F.coalesce(*(F.when(F.col("provider") == k, w) for k, w in WEIGHTS.items()))
    witness = F.when(F.col("provider").isin(*ANCHORS), "anchor").otherwise(F.col("provider"))
    votes = claims.where(F.col("value").isNotNull() & F.col("provider").isin(*WEIGHTS)).withColumn("w", weight.cast("decimal(18,2)"))
    votes = votes.groupBy("entity", "value", witness.alias("witness")).agg(F.sum("w").alias("w"))  # one row a witness, so counting them needs no second expansion
    votes = votes.groupBy("entity", "value").agg(F.sum("w").alias("w"), F.count("*").alias("witnesses"))
    every = Window.partitionBy("entity")
    votes = votes.withColumn("agreement", F.col("w").cast("double") / F.sum("w").over(every).cast("double"))
    first = F.row_number().over(every.orderBy(F.desc("w"), "value"))
    votes = votes.withColumn("rn", first).where("rn = 1")
    return votes.select("entity", "value", "agreement", agreement_confidence(F.col("agreement"), F.col("witnesses")).alias("confidence"))


def strict_plurality(claims: DataFrame) -> DataFrame:
    """entity, value, votes: the value with two votes or more that no other value ties."""
    votes = claims.groupBy("entity", "value").agg(F.count("*").alias("votes"))
    rank = F.rank().over(Window.partitionBy("entity").orderBy(F.desc("votes")))
    best = votes.withColumn("r", rank).where("r = 1 and votes >= 2").groupBy("entity")
    return best.agg(F.count("*").alias("tied"), F.min("value").alias("value"), F.max("votes").alias("votes")).where("tied = 1").drop("tied")


def _claims(claims: DataFrame) -> DataFrame:
    """entity and the claims of known providers (provider, value, w: weight and rank, n: how often); equal claims are one entry."""
    known = F.create_map(*(F.lit(x) for k, (p, w) in enumerate(WEIGHTS.items()) for x in (p, F.struct(F.lit(w).alias("weight"), F.lit(k).alias("rank")))))
    counted = claims.where(F.col("value").isNotNull() & F.col("provider").isin(*WEIGHTS)).groupBy("entity", "provider", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    return counted.groupBy("entity").agg(F.collect_list(F.struct("provider", "value", F.element_at(known, F.col("provider")).alias("w"), "n")).alias("claims"))


def numeric_vote(claims: DataFrame, tolerance: float) -> DataFrame:
    """claims (entity, provider, value) to entity, value, weight, size, confidence: the heaviest cluster of like numbers.

    All claims, by weight (then provider, then value), enter the first cluster whose first value is within the relative
    tolerance, or begin one. The winner has the most weight, then members, then the least first value, which is its result."""
    heavy = F.array_sort(F.transform("claims", lambda c: F.struct((-c["w"]["weight"]).alias("minus"), c["provider"].alias("provider"), c["value"].alias("value"), c["n"].alias("n"))))
    near = lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= tolerance
    cluster = lambda x, w, size, names: F.struct(x.alias("first"), w.alias("weight"), size.alias("size"), names.alias("names"))

    def enter(clusters: Column, c: Column) -> Column:
        fits = F.array_position(F.transform(clusters, lambda k: near(k["first"], c["value"])), True)
        grown = lambda fit: F.transform(clusters, lambda k, i: F.when(i + 1 == fit, cluster(k["first"], k["weight"] - c["minus"] * c["n"], k["size"] + c["n"], F.array_append(k["names"], c["provider"]))).otherwise(k))
        begun = F.array_append(clusters, cluster(c["value"], -c["minus"] * c["n"], c["n"], F.array(c["provider"])))
        # the place is looked for once a claim: as an expression in grown it would be looked for again beside every cluster
        return F.get(F.transform(F.array(fits), lambda fit: F.when(fit > 0, grown(fit)).otherwise(begun)), F.lit(0))

    kind = "array<struct<first:double,weight:double,size:bigint,names:array<string>>>"
    found = _claims(claims).select("entity", F.aggregate(heavy, F.array().cast(kind), enter).alias("k"))
    order = F.transform("k", lambda k: F.struct(-F.round(k["weight"], 9), -k["size"], k["first"].alias("first"), k["weight"].alias("weight"), k["size"].alias("size"), k["names"].alias("names")))
    found = found.select("entity", F.array_min(order).alias("best"), F.aggregate("k", F.lit(0.0), lambda s, k: s + k["weight"]).alias("all"))
    names = F.col("best.names")
    witnesses = F.size(F.array_distinct(F.transform(names, lambda p: F.when(p.isin(*ANCHORS), "anchor").otherwise(p))))
    confidence = agreement_confidence(F.col("best.weight") / F.col("all"), witnesses)
    return found.select("entity", F.col("best.first").alias("value"), F.round("best.weight", 6).alias("weight"), F.col("best.size").alias("size"), F.round(confidence, 6).alias("confidence"))


def count_consensus(claims: DataFrame, window: int, least: bool = False) -> DataFrame:
    """claims (entity, provider, value) to entity, value, level: the median (halves up) of the largest cluster of counts.

    A cluster is the counts within `window` of one of them. Ties: members that are no anchor, then the first provider in
    the list of weights, then the least count. All counts in one cluster: high; two or more: medium, but low against a
    rival of equal size that shares none; no cluster of two: low, with the least count. With `least`, the result is the
    least count of the cluster where that is below its median."""
    row = F.transform("claims", lambda c: F.struct(c["value"].alias("v"), c["w"]["rank"].alias("rank"), c["provider"].alias("p"), c["n"].alias("n")))
    rows = _claims(claims).select("entity", F.array_sort(row).alias("xs"))
    count = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    groups = F.array_distinct(F.transform("xs", lambda s: F.filter("xs", lambda x: F.abs(x["v"] - s["v"]) <= window)))
    scored = F.transform(groups, lambda g: F.struct(-count(g), -count(F.filter(g, lambda x: ~x["p"].isin(*ANCHORS))), F.array_min(F.transform(g, lambda x: x["rank"])), g[0]["v"], g.alias("g")))
    rows = rows.select("entity", "xs", groups.alias("groups"), F.array_min(scored)["g"].alias("g")).withColumn("n", count(F.col("g")))
    rival = F.exists("groups", lambda h: (count(h) == F.col("n")) & ~F.arrays_overlap(h, F.col("g")))

    def at(k: Column) -> Column:
        """The k-th count of the cluster, from 0."""
        none = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["v"], F.when(s["seen"] + x["n"] > k, x["v"])).alias("v"))
        return F.aggregate("g", none, step)["v"]

    median = F.floor((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2 + 0.5)
    median = F.least(median, at(F.lit(0))) if least else median
    level = F.when((F.col("n") >= 2) & (F.col("n") == count(F.col("xs"))), "high").when((F.col("n") >= 2) & ~rival, "medium").otherwise("low")
    return rows.select("entity", F.when(F.col("n") >= 2, median).otherwise(F.col("xs")[0]["v"]).cast("double").alias("value"), level.alias("level"))


def first_claim(claims: DataFrame) -> DataFrame:
    """entity, value, conflicts: the claim of the first provider in the list of weights, and how many other values there are."""
    rank = F.array_position(F.array(*map(F.lit, WEIGHTS)), F.col("provider"))
    known = claims.where(F.col("value").isNotNull() & F.col("provider").isin(*WEIGHTS))
    return known.groupBy("entity").agg(F.min(F.struct(rank, "value"))["value"].alias("value"), (F.count_distinct("value") - 1).alias("conflicts"))


def list_vote(claims: DataFrame, most: int) -> DataFrame:
    """entity, value, share: the values with the most votes, `most` an entity, and their share of all its votes."""
    votes = claims.where("value is not null").groupBy("entity", "value").agg(F.count("*").alias("votes"))
    every = Window.partitionBy("entity")
    votes = votes.withColumns({"share": F.col("votes") / F.sum("votes").over(every), "rn": F.row_number().over(every.orderBy(F.desc("votes"), "value"))})
    return votes.where(F.col("rn") <= most).select("entity", "value", "share")


def weighted_items(claims: DataFrame, most: int) -> DataFrame:
    """claims (entity, provider, item) to entity, item, share: the items with the most weight, `most` an entity, then the least, and their share of all weight."""
    weight = F.coalesce(*(F.when(F.col("provider") == k, w) for k, w in WEIGHTS.items())).cast("decimal(18,2)")
    sums = claims.where(F.col("item").isNotNull() & F.col("provider").isin(*WEIGHTS)).groupBy("entity", "item").agg(F.sum(weight).alias("w"))
    every = Window.partitionBy("entity")
    rows = sums.withColumns({"share": F.round(F.col("w").cast("double") / F.sum("w").over(every).cast("double"), 6), "rn": F.row_number().over(every.orderBy(F.desc("w"), "item"))})
    return rows.where(F.col("rn") <= most).select("entity", "item", "share")
