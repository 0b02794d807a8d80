"""Picks, unions and relinking against plain versions."""

import datetime
import math
import random

import pytest

from tomelight.operators import picks


def floor_of(n):
    return 0.75 if n == 1 else 0.55 if n <= 4 else 0.45


def test_pick_date(spark):
    deal = random.Random(1)
    day = lambda: deal.choice([None, datetime.date(2000, 1, deal.randint(1, 9))])
    claims = [(e, f"p{k}", day(), deal.choice([0.0, 0.5, 0.9, None])) for e in range(80) for k in range(deal.randint(1, 7))]
    df = spark.createDataFrame(claims, "entity int, provider string, date date, weight double")
    for latest in (False, True):
        found = {r.entity: r for r in picks.pick_date(df, latest).collect()}
        for e in range(80):
            rows = [(d, w or 0.0, p) for x, p, d, w in claims if x == e and d]
            if not rows:
                assert e not in found
                continue
            edge = (max if latest else min)(d for d, _, _ in rows)
            d, w, p = min((r for r in rows if r[0] == edge), key=lambda r: (-r[1], r[2]))
            total = sum(r[1] for r in rows)
            share = w / total if total else 0.0
            sure = max(share, floor_of(len(rows))) if w > 0 else share
            assert (e in found) == (sure >= 0.5), e
            if e in found:
                assert (found[e].date, found[e].provider, found[e].sources) == (d, p, len(rows)) and found[e].confidence == pytest.approx(sure, abs=1e-6)
    assert picks.pick_date(df.limit(0)).count() == 0


def test_pick_rating(spark):
    rows = [(1, "a", 8.0, 10, 0.9), (1, "b", 7.0, 100000, 0.9), (1, "c", None, 10**9, 1.0), (2, "a", 5.0, None, 0.4), (3, "a", 5.0, 4, 0.0)]
    found = picks.pick_rating_lifted(spark.createDataFrame(rows, "entity int, provider string, rating double, votes long, weight double")).collect()
    assert sorted((r.entity, r.provider, r.rating) for r in found) == [(1, "b", 7.0), (2, "a", 5.0)]
    assert {r.entity: r.confidence for r in found} == {1: pytest.approx(1.1 / 1.8, abs=1e-6), 2: 1.0}


def test_unions(spark):
    links = [(1, 2, "Wiki", "http://A/"), (1, 1, " wiki ", "HTTP://a/ "), (1, 3, "", "http://b"), (1, 4, None, "x"), (1, 5, "other", "http://a/"), (2, 1, "w", "  ")]
    found = picks.union_links(spark.createDataFrame(links, "entity int, rank int, site string, url string")).collect()
    assert sorted(map(tuple, found)) == [(1, "other", "http://a/"), (1, "wiki", "HTTP://a/")]
    images = [(1, 2, "https://x/1.png"), (1, 1, " HTTPS://X/1.PNG"), (1, 3, "ftp://x"), (1, 4, None), (1, 5, "see http://x")]
    assert [tuple(r) for r in picks.union_gallery(spark.createDataFrame(images, "entity int, rank int, url string")).collect()] == [(1, "HTTPS://X/1.PNG")]


def test_union_lists(spark):
    claims = [
        (1, "genres", "a", 1, "Sci Fi", 0.9), (1, "genres", "b", 2, "Science_Fiction ", 0.9), (1, "genres", "b", 3, "Drama", 0.9), (1, "genres", "c", 4, " ", 0.9), (1, "genres", "c", 5, None, 0.9),
        (2, "authors", "a", 1, "Oda Eiichiro", 0.5), (2, "authors", "b", 2, "Eiichirou ODA", 0.9), (2, "authors", "c", 3, "ODA Eiichiro", 0.9), (2, "authors", "a", 4, "---", 0.9),
        (3, "publishers", "a", 1, "One", 0.5), (4, "synonyms", "a", 1, "Ａ-B", 0.5), (4, "synonyms", "b", 2, "a b", 0.5),
    ]
    claims += [(5, "genres", f"p{k}", k, f"kind {k:02d}", 1.0) for k in range(20)] + [(6, "publishers", "a", k, f"house {k}", 1.0) for k in range(20)]
    found = picks.union_lists(spark.createDataFrame(claims, "entity int, field string, provider string, rank int, item string, weight double")).collect()
    rows = {}
    for r in found:
        rows.setdefault(r.entity, []).append((r.place, r.item, r.share, r.confidence))
    assert sorted(rows[1]) == [(1, "Sci Fi", 0.666667, 0.5), (2, "Drama", 0.333333, 0.5)]
    assert rows[2] == [(1, "Eiichirou ODA", 1.0, 1.0)]  # the heaviest spelling, of two the least
    assert rows[3] == [(1, "One", 1.0, 1.0)]
    assert rows[4] == [(1, "Ａ-B", 1.0, 1.0)]
    assert 5 not in rows  # twenty sources that name twenty kinds agree on nothing
    assert sorted(x[:2] for x in rows[6]) == [(k + 1, f"house {k}") for k in range(6)] and rows[6][0][3] == 0.5


def test_without_stubs(spark):
    rows = [(1, "wikipedia", 1), (1, "mal", 3), (2, "wikipedia", 1), (2, "mal", 2), (3, "wikipedia", 2), (3, "mal", 9), (4, "wikipedia", 1), (5, "wikipedia", 1), (5, "mal", None)]
    found = picks.without_stubs(spark.createDataFrame(rows, "entity int, provider string, value int")).collect()
    assert sorted(map(tuple, found), key=str) == sorted((r for r in rows if r != (1, "wikipedia", 1)), key=str)


def plain_relink(number, part, link, parts):
    """The three passes over one item; parts by number, each (part, id, first, last)."""
    out = lambda p, n: None not in (p[2], p[3], n) and not p[2] <= n <= p[3]
    own = next((p for p in parts if link is not None and p[1] == link), None)
    if own and out(own, number):
        part = link = None
    if link is None and part is not None:
        named = next((p for p in parts if p[0] == part), None)
        if named:
            if out(named, None if number is None else math.floor(number)):
                part = None
            else:
                link = named[1]
    if link is None and number is not None:
        hit = next((p for p in parts if None not in (p[2], p[3]) and p[2] <= number <= p[3]), None)
        if hit:
            part, link = hit[0], hit[1]
    return part, link


def test_relink(spark):
    deal = random.Random(2)
    parts = [(e, k, e * 10 + k, *(deal.choice([(None, None), (k * 5, k * 5 + deal.randint(3, 7)), (k * 5, None)]))) for e in range(1, 9) for k in range(6)]
    items = [(e, k, deal.choice([None, deal.randint(0, 32), deal.randint(0, 31) + 0.5]), deal.choice([None, deal.randint(0, 7)]), deal.choice([None, e * 10 + deal.randint(0, 7)])) for e in range(10) for k in range(60)]
    items = [(e, k, None if n is None else float(n), p, x) for e, k, n, p, x in items]
    a = spark.createDataFrame(items, "entity int, item int, number double, part int, link int")
    b = spark.createDataFrame(parts, "entity int, part int, id int, first int, last int")
    found = {(r.entity, r.item): (r.part, r.link) for r in picks.relink(a, b).collect()}
    assert len(found) == len(items)
    for e, k, n, p, x in items:
        assert found[e, k] == plain_relink(n, p, x, [q[1:] for q in parts if q[0] == e]), (e, k, n, p, x)
    assert picks.relink(a, b.limit(0)).count() == len(items) and picks.relink(a.limit(0), b).count() == 0
