"""Text functions that need Unicode tables or a parser, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F, types as T

# Short forms whose full stop ends no sentence.
_SHORT = frozenset("mr mrs ms dr prof st vs etc e.g i.e no vol ch".split())


@F.pandas_udf(T.StringType())
def title_key(x: pd.Series) -> pd.Series:
    """Compatibility-decomposed, without marks, lower case, letters a-z and digits only."""

    def key(s):
        bare = "".join(c for c in unicodedata.normalize("NFKD", s) if not "̀" <= c <= "ͯ")
        return re.sub("[^a-z0-9]", "", bare.lower())

    return x.map(key, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(x: pd.Series) -> pd.Series:
    """Sentences of a text: split after . ! ? and their closing quotes, not after short forms, initials and ellipses."""

    def split(s):
        out, start = [], 0
        for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s|$)", s or ""):
            last = re.split(r"\s", s[start : m.start()])[-1].lower().lstrip("(\"'")
            if m[0].startswith(".") and (last in _SHORT or (len(last) == 1 and last.isalpha()) or m[0].startswith("...")):
                continue
            out.append(s[start : m.end()].strip())
            start = m.end()
        rest = (s or "")[start:].strip()
        return out + ([rest] if rest else [])

    return x.map(split)


class _Meta(HTMLParser):
    def __init__(self):
        super().__init__()
        self.meta: dict[str, str] = {}
        self.inside = ""
        self.parts: dict[str, list[str]] = {"title": [], "h1": []}
        self.links = 0

    def handle_starttag(self, tag, attributes):
        a = dict(attributes)
        if tag == "meta" and (name := a.get("property") or a.get("name")) and a.get("content"):
            self.meta.setdefault(name.lower(), a["content"])
        elif tag == "a" and a.get("href"):
            self.links += 1
        if tag in self.parts:
            self.inside = tag

    def handle_endtag(self, tag):
        if tag == self.inside:
            self.inside = ""

    def handle_data(self, data):
        if self.inside:
            self.parts[self.inside].append(data)


@F.pandas_udf(T.StructType([*(T.StructField(n, T.StringType()) for n in ("title", "description", "image", "heading")), T.StructField("links", T.IntegerType())]))
def page_meta(x: pd.Series) -> pd.DataFrame:
    """Title (og:title first), description, image, first-level heading and number of links of an HTML page."""

    def read(s):
        p = _Meta()
        p.feed(s or "")
        first = lambda *names: next((p.meta[n] for n in names if n in p.meta), None)
        title, heading = (" ".join("".join(p.parts[k]).split()) or None for k in ("title", "h1"))
        return first("og:title", "twitter:title") or title, first("og:description", "description", "twitter:description"), first("og:image", "twitter:image"), heading, p.links

    return pd.DataFrame([read(s) for s in x], columns=["title", "description", "image", "heading", "links"])
