"""Templates of hosts: which classes are valid, and what they change on pages with and without an article."""

from tomelight.llm.html_extract import extract_text, host_templates, place_classes

SCHEMA = "page_id long, url string, html string, __key string, __host string, __tokens string, host string, html2 string"


def texts(spark, pages):
    rows = [(k, f"http://{h}/p{k}", page, "a", "b", "c", "d", "e") for k, (h, page) in enumerate(pages)]
    out = extract_text(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")] + ["text"]
    found = {r.page_id: r for r in out.collect()}
    assert all(tuple(found[k])[3:8] == ("a", "b", "c", "d", "e") for k in found)
    return [found[k].text for k in range(len(pages))]


def test_classes_in_order_and_nested():
    sizes = {1: 2, 2: 2, 3: 3}
    classes = {10: 1, 11: 1, 20: 2, 21: 2, 30: 3, 31: 3, 32: 3}
    good = place_classes([10, 20, 5, 21, 20, 6, 21, 11], classes, sizes)
    assert set(good) == {1, 2} and None not in good.values()
    assert good == place_classes([10, 20, 7, 21, 8, 11], classes, sizes)  # occurs as often as the page has it
    assert place_classes([11, 10], classes, sizes)[1] != good[1]  # another order
    assert place_classes([20, 20, 21, 21], classes, sizes)[2] is None  # not one order
    crossed = place_classes([30, 10, 31, 32, 11], classes, sizes)
    assert crossed[1] is None and crossed[3] is not None  # of two that cross, the smaller goes


def test_hosts_of_any_number_of_pages(spark):
    page = lambda k: f"<body><div id=top>Site name</div><p>Own {k} text</p><div>All rights</div></body>"
    pages = [(f"h{n}.example", page(k)) for n in range(1, 10) for k in range(n)]
    want = ["Site name Own 0 text All rights"] + [f"Own {k} text" for n in range(2, 10) for k in range(n)]
    assert texts(spark, pages) == want


def test_copies_are_one_page(spark):
    one = "<body><div>Menu</div><p>Text</p></body>"
    assert texts(spark, [("a.example", one)] * 10) == ["Menu Text"] * 10


def test_shared_sentences_stay(spark):
    article = lambda k: f"<body><p>Menu</p><article><p>Standard words.</p><p>Own {k}.</p><p>The end.</p></article><div>Foot</div></body>"
    frame = lambda k: f"<body><p>Menu</p><div><p>Standard words.</p><p>Own {k}.</p><p>The end.</p></div><div>Foot</div></body>"
    want = [f"Standard words. Own {k}. The end." for k in range(12)]
    assert texts(spark, [("a.example", article(k)) for k in range(12)]) == want
    assert texts(spark, [("b.example", frame(k)) for k in range(12)]) == want


def test_order_must_agree_everywhere(spark):
    page = lambda k: "<body>" + "".join(f"<div>{x}</div>" for x in (("One", "Two") if k % 2 else ("Two", "One"))) + f"<p>Own {k}</p></body>"
    rows = [("c.example", page(k)) for k in range(8)]
    found = host_templates(spark.createDataFrame(rows, "host string, html string"))
    assert found.count() == 0
    assert texts(spark, rows)[1] == "One Two Own 1"
