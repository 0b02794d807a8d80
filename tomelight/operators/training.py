"""Tagged pages as training records, one JSON line or one CoNLL block each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tomelight.functions.columns import truncated
from tomelight.operators.curation import placed_spans
from tomelight.operators.labelling import bio_entities

# Characters of an instruction's input, words of context on each side of an entity.
INPUT, INPUT_CONTEXT, ANSWER_CONTEXT = 2000, 75, 100
_META = "metadata struct<source:string,pageId:string,title:string,entityType:string>"
#: Fields of the records of each form, as a reader needs them.
SCHEMAS = {
    "jsonl": "id string, url string, title string, source string, tokens array<struct<text:string,label:string>>, entities array<struct<type:string,text:string,startIndex:int,endIndex:int>>, markdown string, plainText string, quality struct<autoScore:double,tier:string>",
    "alpaca": f"instruction string, input string, output string, {_META}",
    "sharegpt": "conversations array<struct<from:string,value:string>>, metadata struct<source:string,pageId:string,title:string,conversationType:string>",
    "qa": "question string, answer string, context string, metadata struct<source:string,pageId:string,title:string,entityType:string,answerStart:int,answerEnd:int>",
    "markdown": "id string, title string, markdown string, plainText string",
    "ner": "text string, entities array<struct<text:string,label:string,start:int,end:int>>, metadata struct<source:string,pageId:string,title:string,entityCount:int>",
    "spacy": "text string, ents array<struct<start:int,end:int,label:string>>",
    "huggingface": "id string, tokens array<string>, ner_tags array<string>",
    "conll": "tokens array<string>, tags array<string>",
}
#: Columns of a page that may be missing.
OPTIONAL = {"url": "string", "title": "string", "source": "string", "markdown": "string", "plain": "string", "score": "double", "tier": "string"}


def _named(kind: Column) -> Column:
    return F.replace(F.lower(kind), F.lit("_"), F.lit(" "))


def _about(kind: Column, title: Column) -> Column:
    return F.concat(F.lit("What is the "), _named(kind), F.coalesce(F.concat(F.lit(' of "'), title, F.lit('"')), F.lit("")), F.lit("?"))


def _turn(who: str, value: Column) -> Column:
    return F.struct(F.lit(who).alias("from"), value.alias("value"))


def _once(f: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """f of two values that are made once a row, however often f uses them in a lambda."""
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: f(x["a"], x["b"])), F.lit(0))


def _context(e: Column, words: int) -> Column:
    since = F.greatest(F.lit(0), e["first"] - words)
    return F.trim(F.array_join(F.slice("tokens", since + 1, F.greatest(F.lit(0), e["last"] + words + 1 - since)), " "))


def _chats(groups: dict[str, tuple[str, ...]]) -> Column:
    """Conversations of a page: one for each entity, one for each group of kinds with two entities or more, one over three or more."""
    told = lambda es: F.array_join(F.transform(es, lambda e: F.concat(_named(e["type"]), F.lit(": "), e["text"])), "\n")
    subject = F.coalesce(F.concat(F.lit('"'), F.col("title"), F.lit('"')), F.lit("this page"))
    chat = lambda turns, kind: F.struct(turns.alias("turns"), F.lit(kind).alias("kind"))
    single = F.transform("entities", lambda e: chat(F.array(_turn("human", _about(e["type"], F.col("title"))), _turn("gpt", e["text"])), "single_turn"))
    several = []
    for name, kinds in groups.items():
        own = F.filter("entities", lambda e: e["type"].isin(*kinds))  # noqa: B023  read at once
        opening = F.array(_turn("human", F.concat(F.lit(f"Tell me about the {name.lower()} of "), subject, F.lit("."))), _turn("gpt", told(own)))
        more = F.flatten(F.transform(F.slice(own, 1, 2), lambda e: F.array(_turn("human", F.concat(F.lit("Can you tell me more about the "), _named(e["type"]), F.lit("?"))), _turn("gpt", e["text"]))))
        several.append(F.when(F.size(own) >= 2, chat(F.concat(opening, more), "multi_turn")))
    whole = F.array(_turn("human", F.concat(F.lit("What is known of "), subject, F.lit("?"))), _turn("gpt", told("entities")))
    several.append(F.when(F.size("entities") >= 3, chat(whole, "overview")))
    return F.concat(single, F.array_compact(F.array(*several)))


def records(pages: DataFrame, form: str, kinds: list[str] | None = None, groups: dict[str, tuple[str, ...]] | None = None, metadata: bool = True) -> DataFrame:
    """pages (id, tokens array<string>, tags array of BIO tags, and those of OPTIONAL) to id, place, line: the records of a page in order.

    Forms are the keys of SCHEMAS. jsonl, markdown, ner, spacy, huggingface and conll make one record a page; alpaca, sharegpt
    and qa one for each entity, sharegpt more (see _chats). With `kinds`, entities of other kinds are left out and their tags are
    O. Null arrays count as empty, null words as "", tags beyond the words have no text, words beyond the tags are O. White space
    inside a word becomes a space in conll, which parts words by lines. Entities come from one Arrow batch at a time, all else
    is built in; a page stays a row until its records are dealt out."""
    if form not in SCHEMAS:
        raise ValueError(f"{form!r} is no form of records: {', '.join(SCHEMAS)}")
    pages = pages.withColumns({k: F.lit(None).cast(v) for k, v in OPTIONAL.items() if k not in pages.columns})
    words = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    rows = pages.select(F.col("id").cast("string").alias("id"), *OPTIONAL, words.alias("tokens"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    named = lambda x: F.regexp_replace(x, "^[BI]-", "")
    kept = lambda x: F.when((x == "O") | named(x).isin(*kinds), x).otherwise("O") if kinds is not None else x
    if form in ("huggingface", "conll"):
        tag = F.transform("tokens", lambda _, k: F.coalesce(kept(F.get("tags", k)), F.lit("O")))
        if form == "huggingface":
            return rows.select("id", F.lit(0).alias("place"), F.to_json(F.struct("id", "tokens", tag.alias("ner_tags"))).alias("line"))
        clean = F.transform("tokens", lambda x: F.regexp_replace(x, r"[\t\r\n]+", " "))
        block = F.zip_with(clean, tag, lambda x, y: F.concat_ws("\t", x, y))
        return rows.select("id", F.lit(0).alias("place"), F.array_join(block, "\n").alias("line"))
    rows = rows.withColumn("found", bio_entities("tags"))
    own = F.filter("found", lambda e: e["type"].isin(*kinds)) if kinds is not None else F.col("found")
    text = lambda tokens, e: F.trim(F.array_join(F.slice(tokens, e["first"] + 1, e["last"] - e["first"] + 1), " "))
    told = lambda tokens, es: F.transform(es, lambda e: F.struct(e["type"].alias("type"), text(tokens, e).alias("text"), e["first"].alias("first"), e["last"].alias("last")))
    # chats use the words here only, so Spark would put their expression into the lambda and split the whole text again for each entity
    rows = rows.withColumn("entities", _once(told, F.col("tokens"), own) if form == "sharegpt" else told(F.col("tokens"), own))
    whole = F.trim(F.array_join("tokens", " "))
    about = [F.col("source"), F.col("id").alias("pageId"), F.col("title")]
    meta = lambda *more: [F.struct(*about, *more).alias("metadata")] if metadata else []
    line = lambda *fields: F.to_json(F.struct(*fields)).alias("line")
    if form == "sharegpt":
        chats = rows.select("id", "source", "title", F.posexplode(_chats(groups or {})).alias("place", "c"))
        return chats.select("id", "place", line(F.col("c.turns").alias("conversations"), *meta(F.col("c.kind").alias("conversationType"))))
    if form in ("alpaca", "qa"):
        near = F.transform("entities", lambda e: e.withField("context", _context(e, INPUT_CONTEXT if form == "alpaca" else ANSWER_CONTEXT)))
        each = rows.select("id", "source", "title", F.posexplode(near).alias("place", "e"))  # the page's words do not go with each entity
        e, kind = F.col("e"), F.col("e.type").alias("entityType")
        if form == "alpaca":
            order = F.concat(F.lit("Extract the "), _named(e["type"]), F.coalesce(F.concat(F.lit(' of "'), F.col("title"), F.lit('"')), F.lit("")), F.lit("."))
            return each.select("id", "place", line(order.alias("instruction"), truncated(e["context"], INPUT).alias("input"), e["text"].alias("output"), *meta(kind)))
        places = (e["first"].alias("answerStart"), e["last"].alias("answerEnd"))
        return each.select("id", "place", line(_about(e["type"], F.col("title")).alias("question"), e["text"].alias("answer"), e["context"], *meta(kind, *places)))
    if form in ("ner", "spacy"):
        terms = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["type"].alias("label")))
        spans = rows.withColumn("text", whole).withColumn("spans", placed_spans(F.col("text"), terms))
        if form == "spacy":
            ents = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
            return spans.select("id", F.lit(0).alias("place"), line("text", ents.alias("ents")))
        ents = F.transform("spans", lambda s: F.struct(s["term"].alias("text"), s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))
        return spans.select("id", F.lit(0).alias("place"), line("text", ents.alias("entities"), *meta(F.size("spans").alias("entityCount"))))
    marked, plain = F.coalesce("markdown", whole).alias("markdown"), F.coalesce("plain", whole).alias("plainText")
    if form == "markdown":
        return rows.select("id", F.lit(0).alias("place"), line("id", "title", marked, plain))
    tokens = F.transform("tokens", lambda x, k: F.struct(x.alias("text"), F.coalesce(F.get("tags", k), F.lit("O")).alias("label")))
    entities = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["text"].alias("text"), e["first"].alias("startIndex"), e["last"].alias("endIndex")))
    quality = F.when(F.col("score").isNotNull() | F.col("tier").isNotNull(), F.struct(F.col("score").alias("autoScore"), "tier")).alias("quality")
    return rows.select("id", F.lit(0).alias("place"), line("id", "url", "title", "source", tokens.alias("tokens"), entities.alias("entities"), "markdown", F.col("plain").alias("plainText"), quality))
