"""Cells and facts of tables and galleries: fixtures of each shape, broken pages, and the grid against a plain one."""

from hypothesis import given, settings, strategies as st

from tomelight.operators import tables as T


def cells(html):
    return [c for c in T._Cells().eval(html) if c[0] >= 0]


def grid(html):
    out = {}
    for t, r, c, *_, value in cells(html):
        assert (t, r, c) not in out
        out[t, r, c] = value
    return out


def facts(spark, html):
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "id long, html string")
    rows = T.table_facts(T.page_cells(pages, "id", "html")).collect()
    assert all(r.page == 1 for r in rows)
    return {r.shape for r in rows}, sorted((r.tbl, r.line, r.role, r.value) for r in rows)


def test_spans():
    html = "<table><tr><td rowspan=2 colspan=2>A<td>B<tr><td rowspan=0>C<tr><td>D<td>E<td>skipped<tr></table>"
    assert grid(html) == {(0, 0, 0): "A", (0, 0, 1): "A", (0, 0, 2): "B", (0, 1, 0): "A", (0, 1, 1): "A", (0, 1, 2): "C", (0, 2, 0): "D", (0, 2, 1): "E", (0, 2, 2): "C", (0, 2, 3): "skipped"}
    assert grid("<table><tr><td colspan=x>A<td colspan=-1>B<td colspan=0>C</table>") == {(0, 0, 0): "A", (0, 0, 1): "B", (0, 0, 2): "C"}
    assert len(grid("<table><tr><td colspan=99999>A</table>")) == 1000


def test_broken_and_nested_pages():
    assert grid("<td>no table</td><tr>") == {} and grid("") == {} and grid(None) == {}
    assert grid("<table><td>no row</td></table>") == {}
    html = "<table><tr><td>out <table><tr><td>in</td></tr></table> side</td><td>x</table><table><tr><td>next"
    assert grid(html) == {(0, 0, 0): "out side", (0, 0, 1): "x", (1, 0, 0): "in", (2, 0, 0): "next"}
    assert grid("<table><tr><td>a<script>if (x) { '<td>' }</script><style>td {}</style> b &amp; c&nbsp;</table>") == {(0, 0, 0): "a b & c"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 4)), min_size=1, max_size=4), min_size=1, max_size=6))
def test_grid_against_a_plain_one(rows):
    """Cells go to the first free place of their row; a wide one ends before a place that a cell above holds."""
    taken, want = set(), {}
    for r, row in enumerate(rows):
        above, c = {x for y, x in taken if y == r}, 0
        for k, (wide, deep) in enumerate(row):
            while c in above:
                c += 1
            for x in range(c, c + wide):
                if x in above:
                    break
                for y in range(r, min(len(rows), r + deep)):
                    taken.add((y, x))
                    want[0, y, x] = f"{r}.{k}"
                last = x
            c = last + 1
    html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={d}>{r}.{k}" for k, (w, d) in enumerate(row)) for r, row in enumerate(rows)) + "</table>"
    assert grid(html) == want


def test_standard_and_generic_shapes(spark):
    html = "<table><tr><th>Vol.</th><th>Title</th><th>Other name</th><th>Release date</th><th>ISBN</th></tr><tr><td>Volume 3</td><td>One</td><td>Uno</td><td>May 2001</td><td>ISBN 978-4-08-872509-3</td></tr><tr><td>special</td><td>Two</td></tr></table>"
    assert facts(spark, html) == ({"standard"}, sorted([(0, 1, "volume", "3"), (0, 1, "title", "One"), (0, 1, "date", "May 2001"), (0, 1, "isbn", "978-4-08-872509-3"), (0, 2, "title", "Two")]))
    html = "<table><tr><td>a<td>b<tr><td>c</table><table><tr><th>Place<th>Height<tr><td>Hill<td>300</table>"
    assert facts(spark, html) == ({"generic"}, sorted([(0, 0, "column_1", "a"), (0, 0, "column_2", "b"), (0, 1, "column_1", "c"), (1, 1, "place", "Hill"), (1, 1, "height", "300")]))


def test_rowspan_shape_and_nested_table(spark):
    html = "<table><thead><tr><th>Volume<th>Chapter<th>Chapter title</thead><tr><td rowspan=2>Vol. 1<td>Ch. 1<td>A<table><tr><td>Volume 9</table><tr><td>2.5<td>B<tr><td>Volume 2<td>Chapter 3<td>C</table>"
    shapes, rows = facts(spark, html)
    assert shapes == {"rowspan", "generic"}
    assert [r for r in rows if r[0] == 0] == sorted((0, k, role, v) for k, own in ((1, ("1", "1", "A")), (2, ("1", "2.5", "B")), (3, ("2", "3", "C"))) for role, v in zip(("volume", "chapter", "chapter_title"), own, strict=True))
    assert [r for r in rows if r[0] == 1] == [(1, 0, "column_1", "Volume 9")]


def test_multi_column_shape(spark):
    html = "<table><tr><th>Japanese volume<th>JP ISBN<th>English volume<th>English ISBN<tr><td>Vol 1 Dawn<td>978-4-08-872509-1<td>Volume 2 Dusk<td>978-1-56931-901-2<tr><td>Vol 2 Noon<td>none<td>-<td>-</table>"
    shapes, rows = facts(spark, html)
    assert shapes == {"multi-column"}
    assert rows == sorted([(0, 1, "japanese_title", "Vol 1 Dawn"), (0, 1, "japanese_isbn", "978-4-08-872509-1"), (0, 2, "english_title", "Volume 2 Dusk"), (0, 2, "english_isbn", "978-1-56931-901-2"), (0, 2, "japanese_title", "Vol 2 Noon")])


def test_arc_shape(spark):
    html = "<table><tr><td>Chapter 1<td>Lost<tr><th colspan=2>East Blue Saga<tr><td>Chapter 2<td>Found<tr><td>notes<td>x<tr class=header><td>Sky story<tr><td>Ch. 30<td>30 days<td>Gold</table>"
    shapes, rows = facts(spark, html)
    assert shapes == {"arc"}
    assert rows == sorted([(0, 2, "arc", "East Blue"), (0, 2, "chapter", "2"), (0, 2, "title", "Found"), (0, 5, "arc", "Sky"), (0, 5, "chapter", "30"), (0, 5, "title", "Gold")])


def test_galleries(spark):
    html = (
        "<div class='wds-tab__content'><div class='wikia-gallery-item'><div><img data-src='a.png'></div><div class='lightbox-caption'>Volume 7<br>Chapters 61-70</div></div>"
        "<div class='wikia-gallery-item'><img src='//x/b.png/scale-to-width-down/180'><div class='lightbox-caption'>A poster</div></div></div>outside Volume 8"
        "<li class='gallerybox'><img src='//x/c.png/revision/latest'/><p class='gallerytext'>Vol. 9, ISBN: 1-56931-901-X</p></li>"
    )
    pages = spark.createDataFrame([(5, html)], "id long, html string")
    rows = T.gallery_facts(T.page_cells(pages, "id", "html")).orderBy("item").collect()
    assert [tuple(r) for r in rows] == [(5, 0, 7, "61-70", None, "a.png"), (5, 2, 9, None, "1-56931-901-X", "https://x/c.png")]


def test_cells_in_sql(spark):
    spark.udtf.register("table_cells", T.table_cells)
    spark.createDataFrame([(1, "<table><tr><td>a<td>b</table>")], "id long, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT id, place, value FROM some_pages, LATERAL table_cells(html) ORDER BY place").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a"), (1, 1, "b")]


TAGS = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<thead>", "</thead>", "<TD COLSPAN=2>", "<td rowspan='2'>", "<tr class=header>", '<li class="gallerybox x">', "</li>", "<img src='//a/b.png?x=1&amp;y'>", "<img src=//a/b.png/>", "<br/>", "<td/>", "<p class=caption>", "</p>", "</ td>", "<td a='<'>", "<script>'<td>'</script>", "<title>x<td></title>", "<!-- <td> -->", "<td", "<", "a > b", "&lt;b", "Volume 7 "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(TAGS), max_size=14))
def test_pages_cut_at_plain_tags_read_as_by_the_parser(parts):
    html, whole, cut = "<table><tr>" * (len(parts) % 2) + "".join(parts), T._Reader(), T._Reader()
    whole.feed(html)
    whole.close()
    cut.read(html)
    assert cut.tables == whole.tables and cut.items == whole.items


def test_facts_are_told_in_one_deal_and_one_sort(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a</table>")], "id long, html string")
    plan = T.table_facts(T.page_cells(pages, "id", "html"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("RepartitionByExpression") + plan.count("Exchange") == 1
    done = T.table_facts(T.page_cells(pages, "id", "html"))._jdf.queryExecution().executedPlan().toString()
    assert done.count("Sort [") == 1
