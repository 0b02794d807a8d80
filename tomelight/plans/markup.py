"""Queries over tables, galleries, boxes and embedded data of HTML; Spark writes the pages from the given tables first, so the facts are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.functions import html as H
from tomelight.operators import tables as T

from .registry import Tables, query

_LINES = "WITH l AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, (n + 1) // 2 AS v, row_number() OVER (PARTITION BY page ORDER BY n) AS k FROM l)"


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _lines(t: Tables) -> DataFrame:
    """Lines of orders as chapters n of volumes v, with the number of chapters of their volume."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    rows = rows.repartition("page").groupBy("page", "n").agg(F.min("p").alias("p"))  # lines, volumes and pages are made where a page's rows are
    rows = rows.withColumn("v", F.floor((F.col("n") + 1) / 2).cast("long"))
    volume = Window.partitionBy("page", "v")
    return rows.withColumn("own", F.count("*").over(volume)).withColumn("first", F.row_number().over(volume.orderBy("n")) == 1)


def _page(rows: DataFrame, line: Column, before: str, after: str) -> DataFrame:
    """A page for each key, of its lines in order of n."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("x")))), lambda r: r.x), "")
    return rows.groupBy("page").agg(body.alias("b")).select("page", _text(before, F.col("b"), after).alias("html"))


@query(f"{_LINES}, s AS (SELECT page, max(c) AS c FROM (SELECT page, v, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1) SELECT page, k AS line, CASE WHEN c > 1 THEN 'rowspan' ELSE 'standard' END AS shape, unnest(['volume', 'chapter', 'title']) AS role, unnest([cast(v AS VARCHAR), cast(n AS VARCHAR), 'Part ' || p]) AS value FROM r JOIN s USING (page)")
def q_table_rowspan(t: Tables) -> DataFrame:
    """Tables whose volume cells stand beside several chapters: every row gets its volume."""
    n, v = F.col("n"), F.col("v")
    cell = F.when(F.col("first"), _text('<td rowspan="', F.col("own"), '">Vol. ', v, "</td>")).otherwise("")
    pages = _page(_lines(t), _text("<tr>", cell, "<td>Ch. ", n, "</td><td>Part ", F.col("p"), "</td></tr>"), "<p>x</p><table><tr><th>Volume</th><th>Chapter</th><th>Title</th></tr>", "</table>")
    return T.table_facts(T.page_cells(pages, "page", "html")).select("page", F.col("line").cast("long").alias("line"), "shape", "role", "value")


@query(f"{_LINES}, d AS (SELECT *, k + dense_rank() OVER (PARTITION BY page ORDER BY v) - 1 AS line, CASE WHEN NOT contains('Part ' || p, cast(n AS VARCHAR)) THEN 'Part ' || p END AS title FROM r) SELECT * FROM (SELECT page, line, unnest(['arc', 'chapter', 'title']) AS role, unnest(['Flag ' || v, cast(n AS VARCHAR), title]) AS value FROM d) WHERE value IS NOT NULL")
def q_table_arcs(t: Tables) -> DataFrame:
    """Tables whose rows of one wide cell name the arc of the chapters below them; a cell that holds the chapter's number is no title."""
    arc = F.when(F.col("first"), _text("<tr><td colspan=2>Flag ", F.col("v"), " Saga</td></tr>")).otherwise("")
    pages = _page(_lines(t), _text(arc, "<tr><td>Chapter ", F.col("n"), "<td>Part ", F.col("p"), "</tr>"), "<table>", "</table>")
    return T.table_facts(T.page_cells(pages, "page", "html")).select("page", F.col("line").cast("long").alias("line"), "role", "value")


@query("""WITH r AS (SELECT p_partkey // 20 AS page, p_partkey AS jp, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS en FROM part), f AS (
SELECT page, jp AS volume, unnest(['japanese_title', 'japanese_isbn']) AS role, unnest(['Volume ' || jp, '978-4-' || lpad(cast(jp AS VARCHAR), 9, '0')]) AS value FROM r UNION ALL
SELECT page, en, unnest(['english_title', 'english_isbn']), unnest(['Vol. ' || en, '978-1-' || lpad(cast(en AS VARCHAR), 9, '0')]) FROM r) SELECT page, volume, role, value FROM f""")
def q_table_columns(t: Tables) -> DataFrame:
    """Tables with two rows of headers and the releases of two languages side by side, brought together by volume."""
    jp = F.col("p_partkey")
    en = jp + F.when(jp % 2 == 0, 1).otherwise(-1)
    isbn = lambda lead, n: _text(lead, F.lpad(n.cast("string"), 9, "0"))
    row = _text("<tr><td>Volume ", jp, "</td><td>ISBN ", isbn("978-4-", jp), "</td><td>Vol. ", en, "</td><td>", isbn("978-1-", en), "</td></tr>")
    rows = t.part.select(F.floor(jp / 20).alias("page"), jp.alias("n"), row.alias("row"))
    head = "<table><thead><tr><th colspan=2>Japanese<th colspan=2>English<tr><th>Volume<th>ISBN<th>Volume<th>ISBN</thead>"
    facts = T.table_facts(T.page_cells(_page(rows, F.col("row"), head, "</table>"), "page", "html"))
    return facts.select("page", F.col("line").cast("long").alias("volume"), "role", "value")


@query(f"{_LINES} SELECT page, k - 1 AS item, p AS volume, n || '-' || (n + 3) AS chapters, '978-4-' || lpad(cast(p AS VARCHAR), 9, '0') AS isbn, 'https://img.example/' || p || '.png' AS image FROM r")
def q_gallery_volumes(t: Tables) -> DataFrame:
    """Galleries of covers: number, chapters and ISBN from each caption, the address of the picture without its thumbnail part."""
    n, p = F.col("n"), F.col("p")
    item = _text('<li class="gallerybox x"><img src="//img.example/', p, '.png/revision/latest?cb=2"><div class="gallerytext"><b>Volume ', p, "</b> Chapters ", n, "-", n + 3, " ISBN: 978-4-", F.lpad(p.cast("string"), 9, "0"), "</div></li>")
    return T.gallery_facts(T.page_cells(_page(_lines(t), item, '<ul class="gallery">', "</ul>"), "page", "html")).select("page", F.col("item").cast("long").alias("item"), "volume", "chapters", "isbn", "image")


@query("SELECT p_partkey, unnest(['name', 'size', 'Brand', 'sku']) AS key, unnest([p_name, cast(p_size AS VARCHAR), p_brand, 'S' || p_partkey]) AS value FROM part")
def q_page_facts(t: Tables) -> DataFrame:
    """Embedded JSON (a second block is broken), microdata and a key-value box of a page for each part."""
    data = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    box = _text("<table class=infobox><tr><th>Brand:<td>", F.col("p_brand"), "</table>")
    html = _text('<script type="application/ld+json">', data, '</script><script type="application/ld+json">{"name": </script><p itemprop=sku>S', F.col("p_partkey"), "</p>", box)
    found = t.part.select("p_partkey", html.alias("html")).select("p_partkey", H.structured_data("html").alias("d"), H.infobox("html").alias("b"))
    return found.select("p_partkey", F.explode(F.map_concat("d", "b")))
