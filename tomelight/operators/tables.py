"""Tables and galleries of HTML pages as rows: a grid of cells that fills row and column spans, and rules for the shapes of tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Spans that HTML allows, elements without an end, classes of gallery items and captions, and what headers and cells say.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ITEMS = ("wikia-gallery-item", "lightbox", "gallerybox")
CAPTIONS = ("lightbox-caption", "caption", "gallerytext", "thumbcaption")
ROLES = (
    ("chapter_title", r"(?i)(chapter|episode).*title"), ("volume", r"(?i)volume|vol\.?(\s|$)"), ("title", r"(?i)title|name"), ("chapter", r"(?i)chapter|ch\.?(\s|$)|episode|ep\.?(\s|$)"),
    ("isbn", r"(?i)isbn"), ("date", r"(?i)date|release"), ("cover", r"(?i)cover|image"),
)
LANGUAGES = (("japanese", r"(?i)japanese|\bjp\b"), ("english", r"(?i)english|\ben\b"))
VOLUME, CHAPTER = r"(?i)\bvol(?:ume|\.)?\s*(\d+)", r"(?i)\bch(?:apters?|\.)?\s*(\d+(?:\.\d+)?)"
RANGE, ISBN = r"(?i)chapters?\s+(\d[\d.]*(?:\s*[-–]\s*\d[\d.]*)?)", r"(?i)(?:isbn[:\s]*)?((?:97[89]-)?\d[\d-]{8,}[\dxX])"
ARC, ARC_NAME = r"(?i)\b(arc|saga|story)\b", r"(?i)\s+(arc|saga|story)$"

CELLS = "tbl int, line int, place int, head boolean, own boolean, spans boolean, kind string, value string"
_CELL = {"place": pa.int32(), "own": pa.bool_(), "spans": pa.bool_(), "th": pa.bool_(), "value": pa.string()}
ROWS = "tbl int, line int, head boolean, cells array<struct<place:int,own:boolean,spans:boolean,th:boolean,value:string>>"
#: Cells that leave a task's worker at a time, and pages whose HTML Python holds.
BATCH, PAGES = 10_000, 64
# A tag that ends at its first > and whose attributes are written plainly; elements whose content is not read as HTML.
_PLAIN = re.compile(r"""(</?[a-zA-Z][a-zA-Z0-9]*(?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9_]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'`=<>/&]+))?)*[ \t\n]*/?>)""")
_PART = re.compile(r"""([a-zA-Z][-a-zA-Z0-9_]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext")


class _Start:
    """What a start tag says."""

    __slots__ = ("tag", "names", "entry", "wide", "deep", "styled", "source", "item", "void", "closed")

    def __init__(self, tag: str, attributes: list):
        a = {k: v or "" for k, v in attributes}
        self.tag, self.names = tag, frozenset(a.get("class", "").split())
        self.entry = (tag, bool(self.names & set(CAPTIONS)))
        self.wide, self.deep = self._span(a, "colspan", MOST_COLUMNS), self._span(a, "rowspan", MOST_ROWS)
        self.styled = any("header" in n for n in self.names) if self.names else False
        self.source = a.get("src") or a.get("data-src") or ""
        self.item, self.void, self.closed = bool(self.names & set(ITEMS)), tag in VOID, False

    @staticmethod
    def _span(a: dict, name: str, most: int) -> int:
        raw = a.get(name, "").strip()
        return min(int(raw), most) if raw.isdecimal() else 1


class _Tags(HTMLParser):
    """The events of one tag."""

    def __init__(self):
        super().__init__()
        self.seen: list = []

    def handle_starttag(self, tag, attributes):
        self.seen.append(_Start(tag, attributes))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        self.seen[-1].closed = True

    def handle_endtag(self, tag):
        self.seen.append(tag)

    def handle_data(self, data):
        self.seen.append(None)


@lru_cache(maxsize=10_000)
def _tag(raw: str) -> _Start | str | None:
    """What the library's parser reads in a plain tag: a start, the name of an element that ends, or None if the whole page has to be read by it."""
    if raw[1] != "/" and raw[-2] != "/" and "&" not in raw:
        (name, *_), *attributes = _PART.findall(raw)
        one = _Start(name.lower(), [(k.lower(), a or b or c) for k, a, b, c in attributes])
    else:
        tags = _Tags()
        tags.feed(raw)
        one = tags.seen[0] if len(tags.seen) == 1 and not tags.rawdata else None
    return None if (one.tag if isinstance(one, _Start) else one) in _RAW else one


class _Reader(HTMLParser):
    """Collects the cells of every table, nested ones by themselves, and the items of galleries."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, bool]] = []
        self.tables: list[dict] = []
        self.inner: list[dict] = []
        self.items: list[dict] = []

    def read(self, html: str) -> None:
        """The whole page. The same tags come again and again, so pages of plain tags are cut at them and each different tag is read once."""
        parts = _PLAIN.split(html)
        tags = [_tag(raw) for raw in parts[1::2]] if html.count("<") == len(parts) // 2 else [None]
        if None in tags:
            self.feed(html)
            self.close()
            return
        inner, items = self.inner, self.items
        for tag, data in zip(tags, parts[2::2], strict=True):  # text before the first tag belongs to nothing
            if isinstance(tag, str):
                self.handle_endtag(tag)
            else:
                self.start(tag)
                if tag.closed:
                    self.handle_endtag(tag.tag)
            if data and (items or (inner and inner[-1]["cell"])):
                self.handle_data(unescape(data) if "&" in data else data)

    def handle_starttag(self, tag, attributes):
        self.start(_Start(tag, attributes))

    def start(self, a: _Start) -> None:
        tag, inner = a.tag, self.inner
        if tag == "td" or tag == "th":
            if inner:
                self._close(("td", "th"))
                if inner[-1]["rows"]:
                    cell = {"tag": tag, "wide": a.wide, "deep": a.deep, "text": []}
                    inner[-1]["rows"][-1]["cells"].append(cell)
                    inner[-1]["cell"] = cell
        elif tag == "tr":
            if inner:
                self._close(("td", "th", "tr"))
                inner[-1]["rows"].append({"cells": [], "head": self._within("thead"), "styled": a.styled})
        elif tag == "table":
            inner.append({"rows": [], "cell": None})
            self.tables.append(inner[-1])
        elif tag == "img" and self._item() is not None:
            self._item().setdefault("image", a.source)
        if a.item and self._item() is None:
            self.items.append({"caption": [], "depth": len(self.open)})
        if not a.void:
            self.open.append(a.entry)

    def handle_endtag(self, tag):
        stack = self.open
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] == tag:
                break
        else:
            return
        if self.inner:
            if tag == "table":
                self.inner.pop()
            elif tag in ("td", "th", "tr"):
                self.inner[-1]["cell"] = None
        del stack[at:]

    def handle_data(self, data):
        for t, _ in self.open:
            if t == "script" or t == "style":
                return
        if self.inner and self.inner[-1]["cell"]:
            self.inner[-1]["cell"]["text"].append(data)
        item = self._item()
        if item is not None and any(caption for _, caption in self.open[item["depth"] :]):
            item["caption"].append(data)

    def _item(self) -> dict | None:
        """The gallery item that is open."""
        return self.items[-1] if self.items and self.items[-1]["depth"] < len(self.open) else None

    def _within(self, tag: str) -> bool:
        """Whether such an element is open in the innermost open table."""
        for t, _ in reversed(self.open):
            if t == tag or t == "table":
                return t == tag
        return False

    def _close(self, tags: tuple[str, ...]) -> None:
        """End cells and rows of the innermost table that were left open."""
        at = None
        for k in range(len(self.open) - 1, -1, -1):
            t = self.open[k][0]
            if t == "table":
                break
            if t in tags:
                at = k
        if at is not None:
            del self.open[at:]
        self.inner[-1]["cell"] = None


def _text(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _grid(rows: list[dict]) -> Iterator[list[tuple]]:
    """The places of each row that a cell fills, in order, as (column, own, spans, kind, value); own only where the cell begins."""
    held: dict[int, list] = {}
    for r, row in enumerate(rows):
        taken, at, out = held, 0, []
        held = {c: [left - 1, kind, value] for c, (left, kind, value) in taken.items() if left > 1}
        for cell in row["cells"]:
            while at in taken:
                at += 1
            kind, value, wide, deep = cell["tag"], _text(cell["text"]), cell["wide"], cell["deep"] or len(rows) - r
            for c in range(at, at + max(1, wide)):
                if c in taken:
                    break
                out.append((c, c == at, wide > 1 or row["styled"], kind, value))
                if deep > 1:
                    held[c] = [deep - 1, kind, value]
            at = c + 1
        if taken:
            out += [(c, False, row["styled"], kind, value) for c, (_, kind, value) in taken.items()]
            out.sort()
        yield out


def _rows(html: str | None) -> Iterator[tuple]:
    """(table, row, head, cells) of each row with cells, the cells (place, own, spans, kind, value) in order; items of galleries as rows of table -1."""
    reader = _Reader()
    reader.read(html or "")
    for t, table in enumerate(reader.tables):
        rows = [r for r in table["rows"] if r["cells"]]
        lead = True
        heads = []
        for r in rows:
            lead = lead and all(c["tag"] == "th" for c in r["cells"])
            heads.append(r["head"] or lead)
        for r, cells in enumerate(_grid(rows)):
            yield t, r, heads[r], cells
    for k, item in enumerate(reader.items):
        yield -1, k, False, [(0, True, False, "caption", _text(item["caption"])), (1, True, False, "image", item.get("image", ""))]


class _Cells:
    def eval(self, html: str):
        for t, r, head, cells in _rows(html):
            for c, own, spans, kind, value in cells:
                yield t, r, c, head, own, spans, kind, value


#: One row for each place of each table of a page (tbl counts from 0), and for caption and image of each gallery item (tbl -1).
table_cells = F.udtf(_Cells, returnType=CELLS, useArrow=True)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of tables of each page, in batches of about BATCH cells; a page's rows may lie in several."""
    for batch in batches:
        for k in range(0, batch.num_rows, PAGES):
            part = batch.slice(k, PAGES)
            rows, n = [], 0
            for at, html in enumerate(part.column(1).to_pylist()):
                for row in _rows(html):
                    rows.append((at, *row))
                    n += len(row[3])
                    if n >= BATCH:
                        yield _packed(part.column(0), rows)
                        rows, n = [], 0
            if rows:
                yield _packed(part.column(0), rows)


def _packed(pages: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, tbl, line, head, cells = zip(*rows, strict=True)
    place, own, spans, kind, value = zip(*chain.from_iterable(cells), strict=True)
    flat = [pa.array(c, t) for c, t in zip((place, own, spans, [k == "th" for k in kind], value), _CELL.values(), strict=True)]
    ends = pa.array([0, *accumulate(map(len, cells))], pa.int32())
    nested = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, list(_CELL)))
    columns = [pages.take(pa.array(at, pa.int32())), pa.array(tbl, pa.int32()), pa.array(line, pa.int32()), pa.array(head, pa.bool_()), nested]
    return pa.RecordBatch.from_arrays(columns, ["page", "tbl", "line", "head", "cells"])


def page_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """page, tbl, line, head, cells: the rows of tables (ROWS) that table_cells reads, a row's cells as one array in order of place; pages without tables have no rows."""
    pages = pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html"))
    return pages.mapInArrow(_rows_of, f"page {pages.schema['page'].dataType.simpleString()}, {ROWS}")


def _found(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def _first(x: Column, rules: tuple) -> Column:
    """The name of the first rule whose pattern x has."""
    return F.coalesce(*(F.when(x.rlike(p), name) for name, p in rules))


def table_facts(rows: DataFrame) -> DataFrame:
    """page, tbl, line, shape, role, value: what the rows of tables (see page_cells) say.

    Rows of headers are those of a thead or, first in a table, of th cells only; a column's header is that of all such
    rows. Its role is told by patterns, the first column of a role counts, and a generic table has its headers (else
    column_1, ...) for roles. Shapes: multi-column (volumes of two languages: line is the volume's number, so releases of
    one volume meet), arc (rows that name an arc head the rows below them), rowspan (a volume's cell stands beside several
    rows), standard (a column of volumes), generic. A row of a table is one row here: what lies in it is told by its array
    of cells, and all windows are over the rows of a table, dealt and sorted once.
    """
    rows = rows.where("tbl >= 0").repartition("page", "tbl")
    ordered = Window.partitionBy("page", "tbl").orderBy("line")
    table = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = F.array_join(F.transform(F.filter("cells", lambda c: c["own"]), lambda c: c["value"]), " ")
    marked = F.exists("cells", lambda c: c["own"] & (c["th"] | c["spans"]))
    rows = rows.withColumn("names", names)
    rows = rows.withColumn("names_arc", F.col("names").rlike(ARC) & (marked | ~F.col("names").rlike(CHAPTER))).drop("names")
    is_arc = lambda c: F.col("names_arc") & (~F.col("head") | c["spans"])
    heads = F.filter("cells", lambda c: F.col("head") & ~is_arc(c))
    heads = F.map_from_arrays(F.transform(heads, lambda c: c["place"]), F.transform(heads, lambda c: c["value"]))
    rows = rows.withColumn("heads", F.collect_list(F.when(F.col("head"), heads)).over(table))
    # the columns are told once a table, beside its first row
    place = F.array_distinct(F.flatten(F.transform("heads", F.map_keys)))
    header = lambda p: F.array_join(F.array_distinct(F.transform("heads", lambda h: F.element_at(h, p))), " ")
    told = F.transform(F.transform(place, lambda p: F.struct(p.alias("place"), header(p).alias("header"))), lambda c: F.struct(c["place"], F.struct(c["header"].alias("header"), _first(c["header"], ROLES).alias("role"), _first(c["header"], LANGUAGES).alias("speech"))))
    rows = rows.withColumn("columns", F.when(F.row_number().over(ordered) == 1, F.map_from_entries(told))).drop("heads")
    rows = rows.withColumn("columns", F.first("columns").over(table))
    cells = F.transform("cells", lambda c: F.struct(c["place"].alias("place"), c["own"].alias("own"), c["value"].alias("value"), F.element_at("columns", c["place"]).alias("in"), is_arc(c).alias("arc"), (F.col("head") & ~is_arc(c)).alias("head")))
    name = F.regexp_replace(F.get(F.filter("cells", lambda c: c["arc"] & c["own"]), F.lit(0))["value"], ARC_NAME, "")
    rows = rows.select("page", "tbl", "line", cells.alias("cells"))
    kind = lambda c: F.concat(c["in"]["role"], F.lit(" "), F.coalesce(c["in"]["speech"], F.lit("")))  # noqa: E731  null without a role
    rows = rows.withColumn("kinds", F.transform("cells", kind))
    again = lambda c, k: F.array_position("kinds", F.get("kinds", k)) != k + 1
    cells = F.transform("cells", lambda c, k: F.struct(*(c[x].alias(x) for x in ("place", "own", "value", "arc", "head")), F.coalesce(c["in"]["header"], F.lit("")).alias("header"), F.when(~again(c, k), c["in"]["role"]).alias("role"), c["in"]["speech"].alias("speech")))
    rows = rows.select("page", "tbl", "line", name.alias("name"), cells.alias("cells"))
    volume = lambda c: F.coalesce(c["role"] == "volume", F.lit(False))
    has = lambda f: F.max(F.exists("cells", f)).over(table)
    shape = (
        F.when(has(lambda c: volume(c) & c["speech"].isNotNull()), "multi-column").when(has(lambda c: c["arc"]), "arc")
        .when(has(lambda c: volume(c) & ~c["own"] & ~c["head"]), "rowspan").when(has(volume), "standard").otherwise("generic")
    )
    above = F.last("name", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("page", "tbl", "line", shape.alias("shape"), above.alias("arc"), F.filter("cells", lambda c: ~c["head"] & ~c["arc"]).alias("cells"))
    fact = lambda line, role, value: F.struct(line.cast("int").alias("line"), role.alias("role"), value.alias("value"))
    line = F.col("line")

    def number(c: Column) -> Column:
        v = c["value"]
        return F.when(c["role"] == "volume", _found(v, VOLUME)).when(c["role"] == "chapter", F.coalesce(_found(v, CHAPTER), _found(v, r"^(\d+(?:\.\d+)?)$"))).when(c["role"] == "isbn", _found(v, ISBN)).otherwise(v)

    plain = F.transform(F.filter("cells", lambda c: c["role"].isNotNull()), lambda c: fact(line, c["role"], number(c)))
    other = F.transform("cells", lambda c: fact(line, F.when(c["header"] != "", F.lower(c["header"])).otherwise(F.concat(F.lit("column_"), c["place"] + 1)), c["value"]))
    key = lambda speech: F.array_max(F.transform(F.filter("cells", lambda c: volume(c) & (c["speech"] == speech)), lambda c: _found(c["value"], VOLUME).cast("int")))
    spoken = F.filter("cells", lambda c: c["role"].isNotNull() & c["speech"].isNotNull())
    both = F.transform(spoken, lambda c: fact(key(c["speech"]), F.concat(c["speech"], F.lit("_"), F.when(volume(c), "title").otherwise(c["role"])), F.when(volume(c), c["value"]).otherwise(number(c))))
    own = F.transform(F.filter("cells", lambda c: c["own"]), lambda c: F.struct(c["place"].alias("place"), c["value"].alias("value"), _found(c["value"], CHAPTER).alias("n")))
    rows = rows.withColumn("own", F.when((F.col("shape") == "arc") & F.col("arc").isNotNull(), own))
    rows = rows.withColumn("chapter", F.get(F.filter("own", lambda c: c["n"].isNotNull()), F.lit(0)))
    title = F.get(F.filter("own", lambda c: (c["place"] > F.col("chapter.place")) & (c["value"] != "") & ~F.contains(c["value"], F.col("chapter.n"))), F.lit(0))["value"]
    arcs = F.when(F.col("chapter").isNotNull(), F.array(fact(line, F.lit("arc"), F.col("arc")), fact(line, F.lit("chapter"), F.col("chapter.n")), fact(line, F.lit("title"), title)))
    facts = F.when(F.col("shape").isin("rowspan", "standard"), plain).when(F.col("shape") == "generic", other).when(F.col("shape") == "multi-column", both).otherwise(arcs)
    found = rows.select("page", "tbl", "shape", F.inline(facts))
    return found.select("page", "tbl", "line", "shape", "role", "value").where("line is not null and value is not null")


def gallery_facts(rows: DataFrame) -> DataFrame:
    """page, item, volume, chapters, isbn, image of the gallery items (see page_cells) whose caption names a volume; addresses without their thumbnail part, by https."""
    items = rows.where("tbl = -1").select("page", F.col("line").alias("item"), F.get("cells", F.lit(0))["value"].alias("caption"), F.get("cells", F.lit(1))["value"].alias("image"))
    image = F.regexp_replace(F.regexp_replace(F.regexp_replace("image", r"/revision/latest.*", ""), r"/scale-to-width-down/\d+", ""), "^//", "https://")
    caption = F.col("caption")
    out = items.select("page", "item", _found(caption, VOLUME).cast("long").alias("volume"), _found(caption, RANGE).alias("chapters"), _found(caption, r"(?i)isbn[:\s]*([\dxX-]+)").alias("isbn"), image.alias("image"))
    return out.where("volume is not null")
