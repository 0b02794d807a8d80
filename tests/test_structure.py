"""Range repair, span merges, coverage, page structure and buckets against plain versions."""

import random

from pyspark.sql import functions as F

from tomelight.functions import html as H, titles as T
from tomelight.functions.text import page_meta
from tomelight.operators import curation as K, validation as V
from tomelight.streaming import events as E


def repaired(ranges, most, trusted=False):
    """The ranges of one entity: (number, first, last, confidence)."""
    ranges = sorted(ranges)
    if len(ranges) <= 1:
        return ranges
    counts = sorted(b - a + 1 for _, a, b, _ in ranges)
    median, kept = counts[len(counts) // 2], []
    ceiling = most * (1.0 if trusted else 1.1) if most else None
    for n, a, b, c in ranges:
        if ceiling and a > ceiling or b - a + 1 > median * 3 and len(ranges) > 3:
            continue
        if not kept:
            kept.append((n, a, b, max(0.1, c - 0.2) if n == 1 and a > 3 else c))
            continue
        last = kept[-1][2]
        gap = a - last - 1
        if gap > max(15, median * 4):
            continue
        if gap == 1:
            a = last + 1
        if gap > 3:
            c = max(0.1, c - 0.2)
        if gap < -1:
            a, c = last + 1, max(0.1, c - 0.15)
            if a > b:
                continue
        kept.append((n, a, b, c))
    return kept


def test_validated_ranges(spark):
    rng, held = random.Random(8), {}
    for e in range(120):
        at, own = rng.randint(1, 6), []
        for n in range(1, rng.randint(2, 9)):
            a = at + rng.choice([-6, -1, 0, 0, 0, 0, 1, 2, 5, 40])
            b = a + rng.choice([3, 5, 8, 8, 9, 60])
            own.append((n, a, b, rng.choice([0.9, 0.2])))
            at = b + 1
        held[e] = (own, rng.choice([None, 40, 60]))
    df = spark.createDataFrame([(e, *r, most) for e, (own, most) in held.items() for r in own], "entity long, number long, first long, last long, confidence double, expected long")
    for trusted in (False, True):
        got = {}
        for r in V.validated_ranges(df, "expected", trusted).collect():
            got.setdefault(r.entity, []).append((r.number, r.first, r.last, r.confidence))
        assert {e: sorted(x) for e, x in got.items()} == {e: [(*x[:3], round(x[3], 6)) for x in repaired(own, most, trusted)] for e, (own, most) in held.items() if repaired(own, most, trusted)}
    assert V.validated_ranges(df.where("false"), "expected").count() == 0


def test_merged_spans(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(6), rng.randrange(3), a := rng.randrange(40), a + rng.randrange(6), rng.choice("xy")) for _ in range(150)]
    want = set()
    for doc in range(6):
        claimed = set()
        for _, p, a, b, k in sorted(r for r in rows if r[0] == doc):
            if not claimed & set(range(a, b + 1)):
                claimed |= set(range(a, b + 1))
                want.add((doc, p, a, b, k))
    assert {tuple(r) for r in V.merged_spans(spark.createDataFrame(rows, "doc long, priority long, start long, end long, kind string")).collect()} == want


def test_release_coverage(spark):
    cases = {
        "Name v01-v03 (2019)": ([1, 2, 3], []), "第01-04巻": ([1, 2, 3, 4], []), "Name Vol. 5": ([5], []), "Tome 2 à 4": ([2, 3, 4], []), "Name c001-c003.5": ([], [1, 2, 3]), "Name Chapter 12": ([], [12]),
        "Name (1999-2001) 041-043 x": ([], [41, 42, 43]), "Name (041-043)": ([], [41, 42, 43]), "[0041-043]": ([], [41, 42, 43]), "Name (1999-2001)": ([], []), "Name S01E03 v1": ([], []), "Name 720p v2": ([], []), "v5-v2": ([], []), "": ([], []), "第50話": ([], [50]),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.release_coverage(F.col("t")).alias("c"))
    assert {r.t: (r.c.volumes, r.c.chapters) for r in df.collect()} == cases


def test_first_spans(spark):
    cases = [("red red bolt", ["bolt", "red", "red", "red", "", "no"]), ("aaaa", ["aa", "aaa", "aa"]), ("", ["x"]), ("abc", [])]
    got = [r.s for r in spark.createDataFrame(cases, "t string, w array<string>").select(K.first_spans(F.col("t"), F.col("w")).alias("s")).collect()]
    assert [[(s.start, s.end, s.term) for s in x] for x in got] == [[(0, 3, "red"), (4, 7, "red"), (8, 12, "bolt")], [(0, 2, "aa"), (2, 4, "aa")], [], []]


def test_foreign_and_matches(spark):
    rows = [(["berserk", "deluxe"], [["berserk"]]), (["berserk", "gluttony"], [["berserk"]]), (["berserk", "gluttony"], [["berserk"], ["berserk", "gluttony"]]), ([], [["x"]]), (["y"], []), (["y"], [["averyveryverylongname"]])]
    df = spark.createDataFrame(rows, "w array<string>, a array<array<string>>").select(T.foreign(F.col("w"), F.col("a")).alias("r"))
    assert [r.r for r in df.collect()] == [False, True, False, False, False, False]
    pairs = [("red bolt", "red bolt", 1.0), ("a red bolt x", "red bolt", 0.9), ("redbolts", "bolt", 0.7), ("x", "y", 0.0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(T.match_confidence(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == [p[2] for p in pairs]


PAGE = """<html><head><script type="application/ld+json">{"name": "N", "n": {"x": 1}}</script><script type="application/ld+json">{bad</script><style>p {}</style></head><body>
<p>short</p><p>A first paragraph that has clearly more than fifty characters in it.<h2>Summary</h2><p>One <b>two</b></p><p>three</p><h3>Next</h3><p>no</p><span itemprop="author">Ann &amp; B</span><meta itemprop="year" content="2001">
<table><tr><th>Author:</th><td>Ann</td></tr><tr><th>Genre</th><td>a<br>b</td></tr></table><table><tr><th>No.</th><th>Title</th><th>Release date</th><th>Extra</th></tr><tr><td>1</td><td>First</td><td>2001</td><td>e</td></tr><tr><td>2</td><td>Second</td></tr></table><script>var x</script></body>"""


def test_page_structure(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",), ("<p>unclosed <b>tag",)], "h string")
    rows = df.select(H.strip_html("h").alias("t"), H.section_text("h", F.lit("summary")).alias("s"), H.section_text("h", F.lit("none")).alias("f"), H.structured_data("h").alias("d"), H.infobox("h").alias("i"), H.table_rows("h").alias("r")).collect()
    assert rows[0].s == "One two three" and rows[0].f.startswith("A first paragraph") and "var x" not in rows[0].t and "Ann & B" in rows[0].t
    assert rows[0].d == {"name": "N", "n": '{"x": 1}', "author": "Ann & B", "year": "2001"} and rows[0].i == {"Author": "Ann", "Genre": "ab"}
    assert rows[0].r == [{"number": "1", "title": "First", "date": "2001", "extra": "e"}, {"number": "2", "title": "Second"}]
    assert [(r.t, r.s, r.d, r.i, r.r) for r in rows[1:3]] == [("", None, {}, {}, [])] * 2 and rows[3].t == "unclosed tag"
    found = spark.createDataFrame([("é",), ("e",), (None,)], "w string").select(H.folded_variants("w").alias("v")).collect()
    assert [r.v for r in found] == [["é", "e"], ["e"], None]


def test_token_bucket_batch(spark):
    rows = [(1, k, s) for k, s in enumerate([0, 0, 0, 10, 3600, 3600, 9000])] + [(2, 50, 100)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(s) as ts")
    got = {r.event_id: r.admitted for r in E.token_bucket_batch(df, "user_id", "ts", 2.0, 1 / 3600).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 50: True}


def test_jsonl_sink(spark, tmp_path):
    spark.range(50).selectExpr("id", "concat('x', id) as t").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = E.event_stream(spark, f"{tmp_path}/in", "id long, t string")
        E.jsonl_sink(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/out").collect()) == list(range(50))


def test_alpha(spark):
    rows = [(u, a, v) for u, values in enumerate([["x", "x"], ["x", "y"], ["y", "y"], ["y", "y"], ["x", None]]) for a, v in enumerate(values)]
    r = K.alpha(spark.createDataFrame(rows, "unit long, annotator long, label string")).first()
    # equal pairs count once, unequal ones each way: x-x 1, x-y 1, y-x 1, y-y 2
    expected = 2 * 2 * 3 / (5 * 4)
    assert (r.units, r.observed, r.expected, r.alpha) == (5, 0.4, expected, round(1 - 0.4 / expected, 6)) and r.level == "poor"
    assert K.alpha(spark.createDataFrame([(1, 1, "x")], "unit long, annotator long, label string")).first().alpha == 1.0


def test_page_meta(spark):
    page = '<html><head><title> A  page </title><meta name="description" content="D"><meta property="og:image" content="i.png"></head><body><h1>The <b>head</b></h1><a href="/x">x</a><a>y</a></body>'
    og = '<meta property="og:title" content="OG"><title>T</title><meta name="twitter:description" content="TD">'
    got = spark.createDataFrame([(page,), (og,), (None,)], "h string").select(page_meta("h").alias("m")).collect()
    assert [tuple(r.m) for r in got] == [("A page", "D", "i.png", "The head", 1), ("OG", "TD", None, None, 0), (None, None, None, None, 0)]
