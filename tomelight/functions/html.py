"""Structure of HTML pages as Arrow-batched UDFs: plain text, sections, embedded JSON, key-value boxes and tables."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .batches import mapped

# Elements whose text is not shown, headings that begin a section, and the roles of table columns.
_HIDDEN = ("script", "style", "textarea", "option")
_HEADS = ("h2", "h3")
ROLES = {"number": r"^(#|no\.?|num(ber)?|vol(ume)?|ch(apter)?)", "title": r"^(title|name)", "date": r"(date|released?|published)", "isbn": r"isbn"}


class _Tree(HTMLParser):
    """Text runs with the element they stand in, the rows of each table, and JSON of script elements."""

    def __init__(self):
        super().__init__()
        self.open: list[str] = []
        self.runs: list[tuple[str, str]] = []
        self.json: list[str] = []
        self.tables: list[list[list[tuple[str, str]]]] = []
        self.props: list[tuple[str, str]] = []
        self.prop = ""
        self.in_json = False

    def handle_starttag(self, tag, attributes):
        a = dict(attributes)
        self.open.append(tag)
        self.in_json = tag == "script" and (a.get("type") or "").lower() == "application/ld+json"
        if a.get("itemprop"):
            self.prop = a["itemprop"]
            if a.get("content"):
                self.props.append((self.prop, a["content"]))
                self.prop = ""
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append((tag, ""))
        elif tag in ("p", *_HEADS):
            self.runs.append((tag, ""))

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        self.in_json = False

    def handle_data(self, data):
        if self.in_json:
            self.json.append(data)
        if any(t in self.open for t in _HIDDEN):
            return
        if self.prop and data.strip():
            self.props.append((self.prop, " ".join(data.split())))
            self.prop = ""
        if self.runs and self.runs[-1][0] in self.open:
            self.runs[-1] = (self.runs[-1][0], self.runs[-1][1] + data)
        if self.tables and self.tables[-1] and self.tables[-1][-1] and "table" in self.open:
            kind, text = self.tables[-1][-1][-1]
            self.tables[-1][-1][-1] = (kind, text + data)


def _read(page: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    return tree


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attributes):
        self.hidden += tag in _HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in _HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.arrow_udf(T.StringType())
def strip_html(x: pa.Array) -> pa.Array:
    """The shown text of a page, white space collapsed; unclosed elements do no harm."""

    def text(s):
        p = _Text()
        p.feed(s or "")
        p.close()
        return " ".join("".join(p.parts).split())

    return mapped(text, pa.string(), x)


def excerpt(x: Column, limit: int, suffix: str = "...") -> Column:
    """A text of more than `limit` characters as its first ones, trimmed, and the suffix, which the limit does not count."""
    return F.when(F.length(x) > limit, F.concat(F.trim(F.substring(x, 1, limit)), F.lit(suffix))).otherwise(x)


@F.pandas_udf(T.StringType())
def section_text(x: pd.Series, heading: pd.Series) -> pd.Series:
    """The paragraphs after a heading (h2 or h3, in any case) until the next one; without it, the first of more than 50 characters; else null."""

    def text(page, name):
        out, inside, first = [], False, None
        for tag, run in _read(page).runs:
            run = " ".join(run.split())
            if tag in _HEADS:
                if inside:
                    break
                inside = run.lower() == (name or "").lower()
            elif run:
                first = first or (run if len(run) > 50 else None)
                if inside:
                    out.append(run)
        return " ".join(out) or first

    return pd.Series([text(p, n) for p, n in zip(x, heading, strict=True)])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def structured_data(x: pd.Series) -> pd.Series:
    """Top-level fields of embedded JSON-LD and of microdata, the first of each name; JSON that does not parse is ignored."""

    def fields(page):
        tree, out = _read(page), {}
        for text in tree.json:
            try:
                found = json.loads(text)
            except ValueError:
                continue
            for item in found if isinstance(found, list) else [found]:
                for k, v in item.items() if isinstance(item, dict) else ():
                    out.setdefault(k, v if isinstance(v, str) else json.dumps(v))
        for k, v in tree.props:
            out.setdefault(k, v)
        return out

    return x.map(fields)


def _clean(cells: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(kind, " ".join(text.split())) for kind, text in cells]


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def infobox(x: pd.Series) -> pd.Series:
    """Keys and values of table rows of one header cell and one other, the first of each key."""

    def pairs(page):
        out = {}
        for table in _read(page).tables:
            for row in map(_clean, table):
                if [k for k, _ in row] == ["th", "td"] and row[0][1]:
                    out.setdefault(row[0][1].rstrip(":"), row[1][1])
        return out

    return x.map(pairs)


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def table_rows(x: pd.Series) -> pd.Series:
    """Rows of the tables with a row of headers, as maps by the role of each column (its first match, else its header)."""

    def rows(page):
        out = []
        for table in _read(page).tables:
            cells = [_clean(r) for r in table if r]
            if not cells or any(kind != "th" for kind, _ in cells[0]):
                continue
            roles: list[str] = []
            for _, head in cells[0]:
                role = next((r for r, p in ROLES.items() if r not in roles and re.search(p, head.lower())), head.lower())
                roles.append(role)
            out += [{r: text for r, (_, text) in zip(roles, row, strict=False)} for row in cells[1:]]
        return out

    return x.map(rows)


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_variants(x: pd.Series) -> pd.Series:
    """A string and the same without diacritics, once if they are equal."""
    import unicodedata

    def variants(s):
        bare = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return [s] if bare == s else [s, bare]

    return x.map(variants, na_action="ignore")
