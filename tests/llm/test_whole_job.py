"""Places where an operator once did less than its whole job."""

import math
import random

import numpy as np
import zstandard

import corpus_pipeline
from tomelight.llm import quality_classifier, store
from tomelight.llm.decontaminate import decontaminate
from tomelight.llm.html_extract import extract_text, main_text
from tomelight.llm.quality_classifier import fit_quality, score_quality
from tomelight.llm.suffix_dedup import suffix_dedup


def test_quality_reads_whole_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    plain, signs = [word() for _ in range(400)], [[word() for _ in range(200)] for _ in range(2)]
    text = lambda y: " ".join(rng.choices(plain, k=100) + rng.choices(signs[y], k=30) + rng.choices(plain, k=40))
    found = [(k, text(k // 2 % 2), k // 2 % 2) for k in range(2600)]
    table = spark.createDataFrame(found, "doc_id long, text string, quality int")
    model = fit_quality(table.select("doc_id", "text"), table.where("doc_id < 2200").select("doc_id", "quality"))
    assert all(t.encode() in (model.good if y else model.bad) for k, t, y in found if k < 2200)
    scores = {r.doc_id: r.quality_score for r in score_quality(table.where("doc_id >= 2200"), model).collect()}
    good, bad = ([s for k, s in scores.items() if k // 2 % 2 == y] for y in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_quality_when_labels_follow_ids(spark):
    rng = random.Random(4)
    signs = [[f"{y}{k}sign" for k in range(60)] for y in "bg"]
    for n in (40, 4, 3):  # with 3 rows of which one is good, nothing can be compared
        found = [(k, " ".join(rng.choices(signs[k % 2], k=60)), k % 2) for k in range(n)]
        table = spark.createDataFrame(found, "doc_id long, text string, quality int")
        model = fit_quality(table, table)
        fresh = [[" ".join(rng.choices(signs[y], k=60)).encode() for _ in range(30)] for y in (0, 1)]
        bad, good = (model.score(t) for t in fresh)
        if n > 3:
            assert bad.max() < good.min(), n
        else:
            assert set(bad) == set(good) == {2 / 5}
        if n == 40:
            assert bad.max() < 0.3 < 0.7 < good.min()


def test_quality_with_long_texts(spark):
    rng = random.Random(5)
    signs = [[f"{y}{k}sign" for k in range(900)] for y in "bg"]
    text = lambda y, n: " ".join(rng.choices(signs[y], k=n))
    found = [(k, text(k % 2, 80), k % 2) for k in range(60)] + [(100 + y, text(y, 4000) + " middle%d " % y * 300_000 + text(y, 4000), y) for y in (0, 1)]
    assert max(len(t) for _, t, _ in found) > 2_000_000
    table = spark.createDataFrame(found, "doc_id long, text string, quality int")
    model = fit_quality(table, table)
    taught = {t for c in (model.good, model.bad) for t in c.decode().split("\n")}
    assert all(t in taught for k, t, _ in found if k < 100)  # none is shut out
    assert len(model.good) < 300_000 and b"middle1" in model.good and text(1, 1).encode()[:1] in model.good
    bad, good = (model.score([text(y, 80).encode() for _ in range(30)]) for y in (0, 1))
    assert bad.max() < good.min()
    scores = {r.doc_id: r.quality_score for r in score_quality(table, model).collect()}
    assert scores[101] > 0.5 > scores[100]  # the whole of 3 MB is scored


def test_quality_bound_passes_over_what_does_not_fit(monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 100)
    assert quality_classifier._fitting([(1, 60), (2, 90), (3, 30), (4, 11), (5, 10)]) == [1, 3, 5]


def test_quality_scores_by_hand(spark):
    rng = random.Random(6)
    signs = [[f"{y}{k}sign" for k in range(90)] for y in "bg"]
    found = [(k, " ".join(rng.choices(signs[k % 3 % 2], k=rng.randrange(200))), k % 3 % 2) for k in range(90)] + [(200, None, 1), (201, "", 0), (202, "x" * 40_000, 1)]
    table = spark.createDataFrame(found, "doc_id long, text string, quality int")
    model = fit_quality(table, table)
    for r in score_quality(table, model).collect():
        raw, size = (r.text or "").encode(), []
        for book in (model.bad, model.good):
            bits = max(16, len(book.ljust(16)).bit_length())
            how = zstandard.ZstdCompressionParameters.from_level(3, window_log=max(21, bits), hash_log=bits, chain_log=bits - 1, write_checksum=False, write_content_size=False, write_dict_id=False)
            parts = [raw[a : a + 16384] for a in range(0, len(raw), 16384)] or [b""]
            size.append(sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(book.ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(p)) for p in parts))
        weight = len(raw) / (len(raw) + 48)
        z = model.offset + model.weights[0] * weight * (size[0] - size[1]) / max(1, len(raw)) + model.weights[1] * weight
        assert abs(r.quality_score - 1 / (1 + math.exp(-z))) < 0.02, r  # tables that are not prepared may find other matches


def test_stages_keep_columns_of_any_name(spark):
    rows = [(k, " ".join(f"w{(k // 2) * 100 + j}" for j in range(40)), k, "a", 0.5) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row int, __row_ string, __score double")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r["__row"] == r.doc_id and r["__row_"] == "a" for r in out.collect())
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_items_without_an_id_are_found(spark):
    asked = spark.createDataFrame([(None, "one two three four five six seven eight"), (2, "a b c d e f g h i j k")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight y"), (2, "clean text of other words"), (3, "a b c d e f g h i j k")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate(docs, asked).collect()] == [2]


def test_quality_of_repeated_rows_and_labels(spark):
    rng = random.Random(9)
    signs = [[f"{y}{k}sign" for k in range(60)] for y in "bg"]
    text = lambda y: " ".join(rng.choices(signs[y], k=60))
    found = [(k, text(k % 2), k % 2) for k in range(400)]
    table = spark.createDataFrame([(k, t) for k, t, _ in found] * 3 + [(None, text(0)), (7, None)], "doc_id long, text string")
    labels = [(k, y) for k, _, y in found] * 2 + [(10, 1), (11, 0), (None, 1), (3, None), (5000, 1)]  # 10 and 11 have both labels
    model = fit_quality(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    taught = (model.good + b"\n" + model.bad).split(b"\n")
    assert sorted(taught) == sorted(t.encode() for k, t, _ in found if k not in (10, 11))  # each row once
    again = fit_quality(table.repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, quality int").repartition(3))
    assert (again.good, again.bad, again.weights) == (model.good, model.bad, model.weights)
    x = score_quality(table.where("doc_id < 2"), model).collect()
    assert all((r.quality_score > 0.5) == (r.doc_id % 2 == 1) for r in x) and len(x) == 6
    plain = [model.score([r.text.encode()])[0] for r in x]  # by itself as in a batch
    assert plain == [r.quality_score for r in x]


def test_stages_decide_by_row(spark):
    rng = random.Random(4)
    text = lambda n=60: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d, e, f, g, h = (text() for _ in range(8))
    left = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    want = lambda rows: sorted((i is None, i or 0, t) for i, t in rows)
    stay = [(None, b), (5, d), (9, a), (None, e)]
    assert left(corpus_pipeline.exact(spark, frame([*stay, (None, a), (5, a), (None, None), (3, "")]), "")) == want([*stay, (3, "")])
    near = lambda t: t + " more"
    stay = [(None, a), (5, b), (2, c), (None, d), (1, g), (6, h)]
    gone = [(5, near(c)), (None, near(c)), (5, c), (None, a), (6, h)]
    assert left(corpus_pipeline.near(spark, frame(stay + gone), "")) == want(stay)
    assert len(left(corpus_pipeline.near(spark, frame([(None, e), (None, near(e)), (None, f)]), ""))) == 2
    asked = spark.createDataFrame([(1, g)], "item_id long, text string")
    stay = [(None, a), (4, b), (7, c)]
    assert left(decontaminate(frame([*stay, (None, f"x {g} y"), (4, g)]), asked)) == want(stay)


def test_suffix_dedup_keeps_unique_texts_of_shared_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e, f = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(700)) for _ in range(6))
    rows = [(None, a), (None, b), (8, b), (None, c), (None, c), (5, d), (5, e), (9, e), (None, f)]
    found = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    got = sorted((r.doc_id or 0, bytes(r.kept).decode()) for r in found)
    assert got == sorted((i or 0, t if t in (a, d, f) else "") for i, t in rows)


def test_html_copies_are_one_page(spark):
    page = lambda k: f"<body><div class=x>Same line</div><article><h1>Title {k}</h1><p>Own {k} text</p></article></body>"
    rows = [(k, "http://copies.example/a", page(0)) for k in range(20)] + [(100 + k, "http://mixed.example/a", page(min(k, 2))) for k in range(40)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert len(got) == 60 and all(got[k] == "Title 0 Own 0 text" for k in range(20))
    assert all(got[100 + k] == f"Title {min(k, 2)} Own {min(k, 2)} text" for k in range(40))


def test_html_legal_pages_keep_their_article():
    text = lambda page: main_text(page, frozenset())
    assert text("<head><title>t</title><meta charset=utf-8><body><article><p>One</p></article>") == "One"
    assert text("<head><title>t</title><style>p {}</style></head><body><article><p>One</p></article>") == "One"
    assert text('<article><p>One <svg class="i"/> two</p><svg><text>no</text></svg><p>three</p></article>') == "One two three"
    assert text("<div class='layout has-sidebar'><article>One</article><div class='sidebar'>no</div></div>") == "One"
    assert text("<form id=f><main>One<div class='site-footer'>no</div></main></form>") == "One"
    assert text("<article>One<div class='comments'><article>no</article></div></article>") == "One"


def test_sets_of_ids_stay_small_in_the_driver(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d"), (4, None)], "id long, text string")

    def kept(ids, how):
        return sorted((r.id is None, r.id or 0, r.text or "") for r in store.restrict(docs, spark.createDataFrame([(x,) for x in ids], "id long"), "id", how).collect())

    one, two, none, four = (False, 1, "a"), [(False, 2, "b"), (False, 2, "d")], (True, 0, "c"), (False, 4, "")
    assert kept([2, 2, 7], "left_semi") == two
    assert kept([2, None, None], "left_semi") == [*two, none]
    assert kept([2, 7], "left_anti") == [one, four, none]
    assert kept([2, None], "left_anti") == [one, four]
    many = spark.range(600_000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(store.restrict(docs, many, "id"))
    small = plan(store.restrict(docs, many.limit(1000), "id", "left_anti"))
    assert "HashedRelationBroadcastMode(List(input[0, bigint, " in small  # one number: a table of longs, half as large
