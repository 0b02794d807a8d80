"""Rules of releases, factors of quality and agreement by type, against plain versions."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tomelight.operators import agreement, scoring

RELEASE = "id int, title string, protocol string, seeders int, size long, format string, language string, languages array<string>, official boolean, blocked boolean, tags array<string>, published timestamp, base double, url string"
NOW = datetime.datetime(2024, 1, 1)


def release(**given):
    usual = {"title": "Tale", "protocol": "torrent", "seeders": 10, "size": 50 * 1024 * 1024, "format": "CBR", "language": "English", "languages": None, "official": False, "blocked": False, "tags": None, "published": NOW - datetime.timedelta(400), "base": 1.0, "url": "u"}
    return usual | given


CASES = [
    ({}, None, 1 + 80 + 20 + 30),
    ({"blocked": True, "seeders": 0}, "blocklist", -1000),  # the first rule ends it
    ({"seeders": 0, "language": "French"}, "seeders", 0),
    ({"seeders": 0, "protocol": "usenet"}, None, 1 + 80 + 30),
    ({"seeders": None}, None, 1 + 80 + 30),
    ({"language": "French"}, "language", 0),
    ({"language": "French", "languages": ["JAPANESE"]}, None, 1 + 80 + 20 + 20),
    ({"language": None}, None, 1 + 80 + 20),
    ({"language": None, "title": "第一話"}, "language", 0),
    ({"language": "", "languages": [None, ""]}, None, 1 + 80 + 20),
    ({"seeders": 80, "format": "ZIP"}, None, 1 + 100 + 30),
    ({"seeders": 2}, None, 1 + 80 - 50 + 30),
    ({"size": 1024}, None, 1 + 80 + 20 + 30 - 50),
    ({"size": None}, None, 1 + 80 + 20 + 30 - 50),
    ({"size": 600 * 1024 * 1024}, None, 1 + 80 + 20 + 30 - 20),
    ({"official": True, "tags": ["x", "Complete"], "title": "Tale v03"}, None, 1 + 80 + 20 + 30 + 50 + 30 + 40),
    ({"title": "Tale Vol. 3", "published": NOW - datetime.timedelta(29)}, None, 1 + 80 + 20 + 30 + 40 + 20),
    ({"title": "Revolver", "published": NOW - datetime.timedelta(30)}, None, 1 + 80 + 20 + 30 + 10),
    ({"published": NOW - datetime.timedelta(365)}, None, 1 + 80 + 20 + 30),
    ({"published": NOW - datetime.timedelta(364)}, None, 1 + 80 + 20 + 30 + 5),
    (dict.fromkeys(release()), None, -50),
]


def test_rules(spark):
    names = RELEASE.replace("array<string>", "x").split(", ")
    names = [n.split()[0] for n in names][1:]
    rows = [(k, *(release(**g)[n] for n in names)) for k, (g, _, _) in enumerate(CASES)]
    found = scoring.decide(spark.createDataFrame(rows, RELEASE), scoring.Criteria(min_seeders=5), F.lit(NOW)).orderBy("id").collect()
    assert [(r.rejected, r.total) for r in found] == [(why, float(total)) for _, why, total in CASES]
    assert all(sum(r.points.asDict().values()) == r.total for r in found)


def test_rules_turned_off(spark):
    off = scoring.Criteria(languages=(), only_languages=True, skip_blocked=False, official=False, complete=False)
    names = [n.split()[0] for n in RELEASE.split(", ")][1:]
    given = release(blocked=True, language="French", official=True, tags=["Complete"])
    [row] = scoring.decide(spark.createDataFrame([(1, *(given[n] for n in names))], RELEASE), off, F.lit(NOW)).collect()
    assert row.rejected is None and row.total == 1 + 80 + 20
    assert scoring.decide(spark.createDataFrame([], RELEASE), off, F.lit(NOW)).count() == 0


def test_best_releases(spark):
    rows = spark.createDataFrame([(1, 1, None, 5.0, "u"), (1, 2, None, 9.0, None), (1, 3, "language", 0.0, "u"), (1, 4, None, 5.0, "u"), (2, 5, "seeders", 0.0, "u")], "g int, id int, rejected string, total double, url string")
    found = scoring.best_releases(rows, ["g"], "url", [F.col("id")], 2).select("g", "id", "place").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1), (1, 4, 2)]


def plain_score(tokens, tags, confidence, kinds):
    """The score, told in plain Python."""
    tokens, tags = tokens or [], tags or []
    marks = {m for _, ms in tokens for m in ms or []}
    n = len(tokens)
    length = n / 50 if n < 50 else max(0.5, 1 - (n - 2000) / 2000) if n > 2000 else 1
    share = sum(x != "O" for x in tags) / len(tags) if tags else 0
    labelled = share * 10 if share < 0.05 else max(0.5, 1 - (share - 0.3) * 2) if share > 0.3 else 1
    kinds_seen = {x[2:] for x in tags if x.startswith("B-")}
    structure = min(1, 0.4 * ("infobox" in marks) + 0.3 * ("table" in marks) + 0.2 * ("header" in marks) + 0.1 * ("list" in marks))
    rich = min(1, 0.3 * any(k == "image" for k, _ in tokens) + 0.3 * ("link" in marks) + 0.2 * bool(marks & {"bold", "italic"}) + 0.2 * length) if tokens else 0
    return 0.15 * length + 0.25 * labelled + 0.2 * len(kinds_seen) / kinds + 0.15 * (0.5 if confidence is None else confidence) + 0.1 * structure + 0.15 * rich


def test_page_factors(spark):
    deal = random.Random(5)
    names = ["infobox", "table", "header", "list", "link", "bold", "italic", "other"]
    pages = [(0, None, None, None), (1, [], [], 1.0), (2, [("word", None)], ["O"], 0.0)]
    for k, n in enumerate((1, 20, 49, 50, 400, 2000, 2001, 3900, 5000)):
        tags = deal.choices(["O", "B-A", "I-A", "B-B", "B-C"], [deal.random() * 30, 1, 1, 1, deal.random()], k=n)
        pages.append((k + 3, [(deal.choice(["word", "word", "image" if k % 2 else "other"]), deal.sample(names, 1) if deal.random() < 3 / n else []) for _ in range(n)], tags, deal.choice([None, deal.random()])))
    df = spark.createDataFrame(pages, "id int, tokens array<struct<kind:string,marks:array<string>>>, tags array<string>, confidence double")
    found = scoring.page_factors(df, 6).withColumn("score", scoring.quality_score()).orderBy("id").collect()
    assert [r.score for r in found] == pytest.approx([plain_score(t, g, c, 6) for _, t, g, c in pages])
    [high] = scoring.page_factors(df.where("id = 1"), 6).select(scoring.quality_score({"confidence": 5.0}).alias("s")).collect()
    assert high.s == 1.0
    tiers = spark.createDataFrame([(0.75,), (0.5,), (0.25,), (0.2,)], "s double").select(scoring.quality_tier(F.col("s")).alias("t")).collect()
    assert [r.t for r in tiers] == ["high", "medium", "low", "exclude"]
    empty = scoring.tier_stats(spark.createDataFrame([], "score double, tier string, n_tokens long, n_entities long")).collect()
    assert len(empty) == 5 and all(tuple(r)[1:] == (0, 0.0, 0.0, 0.0) for r in empty)


def plain_alpha(rows, kind):
    """Alpha of one type by listing every pair of answers of every unit."""
    units = {}
    for unit, _, label in rows:
        if label is not None:
            units.setdefault(unit, []).append(label if label.partition("-")[2] == kind else "O")
    table = {}
    for answers in units.values():
        for a, b in itertools.combinations(answers, 2):
            table[a, b] = table.get((a, b), 0) + 1
            if a != b:
                table[b, a] = table.get((b, a), 0) + 1
    total = sum(table.values())
    margin = {}
    for (a, _), n in table.items():
        margin[a] = margin.get(a, 0) + n
    observed = sum(n for (a, b), n in table.items() if a != b) / total if total else 0
    expected = sum(margin[a] * margin[b] for a, b in itertools.permutations(margin, 2))
    expected /= total * (total - 1) if total > 1 else 1
    return 1 - observed / expected if expected > 0 else 1.0


def test_alpha_by_type(spark):
    deal = random.Random(3)
    rows = [(u, a, deal.choice([true, true, true, "O", "B-A", "I-B", None])) for u in range(200) for true in [deal.choice(["O", "O", "B-A", "I-A", "B-B", "B-C"])] for a in range(deal.randint(0, 4))]
    rows += [(500, 0, "B-ONCE"), (501, 0, "B-ALL"), (501, 1, "B-ALL")]
    found = {r.entity: r for r in agreement.alpha_by_type(spark.createDataFrame(rows, "unit int, annotator int, label string"), 0).collect()}
    assert set(found) == {"A", "B", "C", "ONCE", "ALL"}
    for kind, row in found.items():
        assert row.alpha == pytest.approx(plain_alpha(rows, kind), abs=1e-6), kind
        assert row.n == sum(a == 0 and (label or "").partition("-")[2] == kind for _, a, label in rows)
    assert found["ALL"].alpha == 1.0 and found["ALL"].level == "excellent"
    alone = agreement.alpha_by_type(spark.createDataFrame([(1, 0, "B-A"), (1, 1, None)], "unit int, annotator int, label string"), 0).collect()
    assert [tuple(r) for r in alone] == [("A", 1, 0.0, 0.0, 1.0, "excellent")]
    assert agreement.alpha_by_type(spark.createDataFrame([], "unit int, annotator int, label string"), 0).count() == 0


def test_alpha_of_answers(spark):
    deal = random.Random(7)
    rows = [(u, a, deal.choice(["O", "O", "B-A", "I-A", "B-B", None])) for u in range(300) for a in range(3)]
    by_row = sorted(tuple(r) for r in agreement.alpha_by_type(spark.createDataFrame(rows, "unit int, annotator int, label string"), 0).collect())
    units = [([(label, 1, int(a == 0)) for v, a, label in rows if v == u],) for u in range(300)]
    df = spark.createDataFrame(units, "answers array<struct<label:string,n:long,own:long>>")
    assert sorted(tuple(r) for r in agreement.alpha_of_answers(df).collect()) == by_row
