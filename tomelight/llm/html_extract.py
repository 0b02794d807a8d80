"""Main text of web pages: host templates from equivalence classes of tokens, then the slots that hold the article."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .store import durable, restrict
from .textkit import as_binary

#: A class of tokens can be part of a host's template if this share of the host's different pages has it, and more than one.
SHARE = 0.9
#: Template tokens that are sent to every executor at most; more are joined by a shuffle, a host's pages dealt to so many parts.
BROADCAST_TOKENS, PARTS = 200_000, 32

# Fixed values of HTML: elements without content, of raw text, that hold no article, and that part blocks.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script style noscript template textarea svg math iframe object canvas select title".split()
_AWAY = frozenset("nav header footer aside form menu dialog button fieldset".split())
_FRAME = frozenset("html body main article section div nav header footer aside form menu dialog button fieldset ul ol dl table figure blockquote details".split())
_BLOCK = _FRAME | frozenset("address br caption center dd dt figcaption h1 h2 h3 h4 h5 h6 head hr legend li option p pre summary tbody td tfoot th thead tr".split())
#: Class, id and role names (whole ones) of parts that are not the article.
_NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments comment-list cookie cookies disclaimer footer form header masthead menu nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())

_NAMES |= frozenset(f"{a}-{b}" for a in "site page main global top primary left right bottom post entry article cookie user blog social share sharing related ad promo newsletter breadcrumb comment comments side".split() for b in "ad ads banner bar box breadcrumb breadcrumbs buttons comments consent container footer form header links list menu nav navbar navigation notice posts section sidebar signup widget wrapper".split() if a in _NAMES or b in _NAMES)
#: Of these, parts whose own articles are not the page's either.
_ASIDE_NAMES = frozenset(x for x in _NAMES if {"comment", "comments", "related", "respond"} & set(x.split("-")))

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
# A head needs no end tag, so only its elements of raw text are skipped; an svg or math that ends in /> is empty.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>]){_ATTRIBUTES}(?<=/)>|<(" + "|".join(_RAW) + rf")(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES}|[^>]*)>|<[!?/][^>]*(?:>|\Z)", re.I | re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HEAD = re.compile(r"<head\b[^>]*>", re.I)


def _unwanted(tag: str, attributes: str) -> int:
    """0: may hold the article, 1: only in an article or main inside, 2: not at all."""
    found = 2 if tag in ("nav", "footer", "aside", "menu", "dialog") else int(tag in _AWAY)
    if "=" not in attributes or tag in ("html", "body", "article", "main"):
        return found
    for m in _NAMED.finditer(attributes):
        names = (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split()
        found = max([found, *(1 + (x in _ASIDE_NAMES) for x in names if x in _NAMES)])
    return found


def blocks(page: str) -> list[tuple[str, bool, str, int]]:
    """(path of frames, whether it may hold the article, text, number of the innermost frame) of each block with text, in page order."""
    out: list[tuple[str, bool, str, int]] = []
    stack: list[tuple[str, int, int]] = []  # frame, how far it or one round it is unwanted, its number
    run: list[str] = []
    frames = 0

    def end() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                away = bool(stack) and stack[-1][1] > 0
                out.append((">".join(t for t, _, _ in stack), not away, text, stack[-1][2] if stack else 0))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            if m[1].lower() == "title":
                end()
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag not in _BLOCK:
            continue
        if tag == "br" or tag == "hr":
            run.append(" ") if tag == "br" else end()
            continue
        end()
        if tag not in _FRAME:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif not m[4].endswith("/"):
            inner = stack[-1][1] if stack else 0
            inner = 0 if inner == 1 and tag in ("article", "main") else inner
            kept_head = tag == "header" and any(t in ("article", "main") for t, _, _ in stack)
            frames += 1
            stack.append((tag, inner if kept_head else max(inner, _unwanted(tag, m[4])), frames))
    if at < len(page):
        run.append(page[at:])
    end()
    return out


def _key(path: str, text: str) -> int:
    """A signed 64-bit hash of a token of a page."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - 2**63


def _tokens(batches):
    """Per host and token of a batch: pages, occurrences, and the sum of 31-bit hashes of its pages, by which equal occurrence vectors are told."""
    import xxhash

    for batch in batches:
        found: dict[tuple[str, int], list[int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)), strict=True):
            page = page.as_py().decode("utf-8", "replace")
            mark = xxhash.xxh3_64_intdigest(page) >> 33
            own: dict[int, int] = {0: 1}
            for path, _, text, _ in blocks(page):
                for k in (_key(path, ""), _key(path, text)):
                    own[k] = own.get(k, 0) + 1
            for k, n in own.items():
                x = found.setdefault((host, k), [0, 0, 0])
                x[0] += 1
                x[1] += n
                x[2] += n * mark
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([h for (h, _), _ in rows], pa.string()), pa.array([k for (_, k), _ in rows], pa.int64()), *(pa.array([x[c] for _, x in rows], pa.int64()) for c in range(3))], ["host", "token", "pages", "n", "vector"])


def _distinct(pages: DataFrame) -> DataFrame:
    """Each page (host, html) once; only pages that come again are shuffled."""
    pages = pages.select("host", "html", F.xxhash64("host", "html").alias("key"))
    again = durable(pages.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    if again.isEmpty():
        return pages
    return restrict(pages, again, "key", "left_anti").unionByName(restrict(pages, again, "key").dropDuplicates(["host", "html"]))


def _joined(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """pages (a column __key: host) with the columns of hosts (one durable row a host, with an array of tokens), null without one."""
    small = (hosts.agg(F.coalesce(F.sum(F.size("__tokens")), F.lit(0))).first()[0] or 0) <= BROADCAST_TOKENS
    if small:
        return pages.join(F.broadcast(hosts), F.col("__key") == F.col("__host"), "left").drop("__host")
    pages = pages.withColumn("__part", F.pmod(F.xxhash64(*[c for c in pages.columns if c != "__key"]), F.lit(PARTS)))
    hosts = hosts.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return pages.join(hosts, (F.col("__key") == F.col("__host")) & (F.col("__part") == F.col("__of")), "left").drop("__host", "__part", "__of")


def place_classes(tokens: list[int], classes: dict[int, int], sizes: dict[int, int]) -> dict[int, int | None]:
    """For the classes on one page: a hash of the order of their tokens, None if a class cannot be part of a template here.

    The tokens of a class must come in one order, as often as the class occurs; and its occurrences must lie inside or
    outside those of every other class: of two that cross, the class with fewer tokens goes.
    """
    places: dict[int, list[tuple[int, int]]] = {}
    for at, token in enumerate(tokens):
        if token in classes:
            places.setdefault(classes[token], []).append((at, token))
    found: dict[int, int | None] = {}
    spans = []
    for c, own in places.items():
        n, order = sizes[c], [t for _, t in own]
        if len(set(order[:n])) < n or order != order[:n] * (len(order) // n):
            found[c] = None
            continue
        found[c] = hash(tuple(order[:n]))
        spans += [(own[k][0], -own[k + n - 1][0], c) for k in range(0, len(own), n)]
    open_spans: list[tuple[int, int]] = []  # end and class of those that hold the place
    for start, end, c in sorted(spans):
        while open_spans and open_spans[-1][0] < start:
            open_spans.pop()
        if open_spans and open_spans[-1][0] < -end and open_spans[-1][1] != c:
            found[min((open_spans[-1][1], c), key=lambda x: (sizes[x], x))] = None
        open_spans.append((-end, c))
    return found


def _places(batches):
    """Per host and class of a batch: the least and greatest hash of its order on a page, and whether it is valid on all of them."""
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        for host, page, tokens, classes in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not tokens:
                continue
            of = dict(zip(tokens, classes, strict=True))
            own = [k for path, _, text, _ in blocks(page.as_py().decode("utf-8", "replace")) for k in (_key(path, ""), _key(path, text))]
            for c, order in place_classes(own, of, Counter(classes)).items():
                x = found.setdefault((host, c), [2**63 - 1, -(2**63), True])
                x[:] = [min(x[0], order or 0), max(x[1], order or 0), x[2] and order is not None]
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([h for (h, _), _ in rows], pa.string()), pa.array([c for (_, c), _ in rows], pa.int64()), *(pa.array([x[k] for _, x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], ["host", "class", "least", "most", "valid"])


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, token): the tokens of each host's template.

    Tokens of a host with equal occurrence vectors over its different pages are one class. Classes of more than one
    token that nearly all pages have are placed on every page: those whose tokens come in one order everywhere and
    that nest with the others are the template. A host with one page, whatever its copies, has none.
    """
    tokens = _distinct(pages).select("host", "html").mapInArrow(_tokens, "host string, token long, pages long, n long, vector long")
    tokens = tokens.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "vector"))).where("pages > 1")
    tokens = durable(tokens, "tokens")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("total"))
    classes = tokens.where("token <> 0").groupBy("host", "vector", "n").agg(F.count("*").alias("size"), F.max("pages").alias("support"))
    shared = classes.join(hosts, "host").where((F.col("size") > 1) & (F.col("support") >= SHARE * F.col("total"))).select("host", "vector", "n")
    shared = tokens.where("token <> 0").join(shared, ["host", "vector", "n"]).select("host", "token", F.xxhash64("vector", "n").alias("class"))
    shared = durable(shared, "classes")
    asked = shared.groupBy(F.col("host").alias("__host")).agg(F.collect_list("token").alias("__tokens"), F.collect_list("class").alias("__classes"))
    asked = durable(asked, "asked")
    placed = _joined(pages.withColumn("__key", F.col("host")), asked).select("host", "html", "__tokens", "__classes").where("__tokens is not null")
    placed = placed.mapInArrow(_places, "host string, class long, least long, most long, valid boolean").groupBy("host", "class").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("valid").alias("valid"))
    return shared.join(placed.where("valid and least = most").select("host", "class"), ["host", "class"], "left_semi").select("host", "token")


def main_text(page: str, template: frozenset) -> str:
    """The article's blocks, in page order.

    With an <article>, or else a <main>, all of it that is not set apart. Without, the slots: blocks that are no part
    of the template, and those of it that stand in one frame with a slot, unless that frame is the whole page.
    """
    found = blocks(page)
    for frame in ("article", "main"):
        if any(frame in path.split(">") for path, _, _, _ in found):
            return " ".join(text for path, ok, text, _ in found if ok and frame in path.split(">"))
    if template:
        slots = [_key(path, text) not in template for path, _, text, _ in found]
        own = {number for (path, ok, _, number), slot in zip(found, slots, strict=True) if slot and ok and path not in ("", "html", "body", "html>body")}
        found = [x for x, slot in zip(found, slots, strict=True) if slot or x[3] in own]
    return " ".join(text for _, ok, text, _ in found if ok)


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with one more column (replaced if there): the main text of the whole page, empty for null and empty pages.

    Blocks inside the article that are not set apart as menu, header, footer, sidebar, notice, advert, form, script,
    style or comments are joined in page order; on pages without an article, the slots of the host's template are.
    Pages of a null or unreadable url form one host; repeated rows each come back and count as one page; an empty
    table gives an empty result; other columns stay, whatever their names.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    pages = pages.drop(out_col)
    names = host_templates(pages.select(host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")))
    names = durable(names.groupBy(F.col("host").alias("__host")).agg(F.collect_list("token").alias("__tokens")), "templates")
    names_of = {f"__{k}": c for k, c in enumerate(pages.columns)}  # the names of a table may be those used here
    both = pages.toDF(*names_of).withColumn("__key", F.coalesce(F.regexp_extract(F.lower(F.col(f"__{pages.columns.index(url_col)}")), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    at, last, columns = pages.columns.index(html_col), len(pages.columns), pages.columns
    both = _joined(both, names).select(*names_of, "__tokens")

    def run(batches):
        kept: dict[tuple, frozenset] = {}
        for batch in batches:
            texts = []
            for page, tokens in zip(as_binary(batch.column(at)), batch.column(last).to_pylist(), strict=True):
                key = tuple(tokens or ())
                if key not in kept:
                    kept = {} if len(kept) > 1000 else kept
                    kept[key] = frozenset(key)
                texts.append(main_text(page.as_py().decode("utf-8", "replace"), kept[key]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(texts, pa.string())], [*columns, out_col])

    return both.mapInArrow(run, StructType([*pages.schema.fields, StructField(out_col, StringType())]))
