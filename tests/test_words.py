"""Folding against the character database, words against their places, redaction at any depth."""

import json
import unicodedata

from pyspark.sql import functions as F

from tomelight.functions import folding, words
from tomelight.functions.titles import comparison_key, synonym_key

SF = "/root/testdata/sf0.001"


def test_folding_of_every_character(spark):
    chars = [c for c in (chr(k) for k in range(1, 0x10000)) if unicodedata.category(c) != "Cs" and not "가" <= c <= "힣"]
    rows = spark.createDataFrame([(f"x{c}y",) for c in chars], "t string").select("t", folding.without_marks(F.col("t")).alias("d"), folding.compatible(F.col("t")).alias("c")).collect()
    bad = [r.t for r in rows if r.d != folding.plain(r.t, "NFKD")]
    assert not [t for t in bad if unicodedata.category(t[1])[0] != "M"], bad[:20]
    assert not [r.t for r in rows if r.c != "".join(unicodedata.normalize("NFKC", c) for c in r.t) and unicodedata.category(r.t[1])[0] != "M"]


def test_keys(spark):
    row = lambda *c: tuple(spark.range(1).select(*(x.alias(f"c{k}") for k, x in enumerate(c))).first())
    lit = F.lit
    assert row(folding.person_key(lit("ODA, Eiichirō")), folding.person_key(lit("Eiichirou Oda")), folding.person_key(lit("Oohba Tsugumi")), folding.person_key(lit("Ohara Yuu"))) == ("eiichiro oda", "eiichiro oda", "ohba tsugumi", "ohara yu")
    assert row(comparison_key(lit("Ｎａｒｕｔｏ： ﬁn!")), synonym_key(lit("Ａ・Ｂ -_ c")), folding.without_marks(lit("Ⅻ ½ Ñandú 한글")), comparison_key(lit(None))) == ("naruto fin", "a・b c", "XII 1⁄2 Nandu 한글", None)


def test_words_give_back_their_places(spark):
    spark.udtf.register("word_tokens", words.word_tokens)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "第12巻 of One-Piece, v2 naïve 한글😀x"), (-2, ""), (-3, None), (-4, "w " * 5_000)], "doc_id long, text string")
    docs.unionByName(extra).createOrReplaceTempView("some_docs")
    rows = spark.sql("SELECT d.*, t.*, substring(d.text, t.first + 1, t.end - t.first) AS again FROM some_docs d, LATERAL word_tokens(d.text, '', false) t")
    assert rows.where("word <> again or lower <> lower(word)").count() == 0 and rows.where("doc_id = -4").count() == 5_000
    own = [(r.place, r.word, r.kind) for r in rows.where("doc_id = -1").orderBy("place").collect()]
    assert own == list(zip(range(13), ["第", "12", "巻", "of", "One", "Piece", "v2", "naïve", "한", "글", "x"], ["cjk", "number", "cjk", "word", "word", "word", "mixed", "word", "cjk", "cjk", "word"], strict=False))
    image = spark.sql("SELECT * FROM word_tokens('ab', 'Cover', true) UNION ALL SELECT * FROM word_tokens('', '', true)").collect()
    assert [(r.first, r.end, r.kind, r.word) for r in image] == [(0, 2, "image", "[IMAGE: Cover]"), (0, 0, "image", "[IMAGE]")]


def test_redaction(spark):
    deep = "[" * 400 + '{"Api Key": {"a": [1]}, "x": 10000000000000000000001}' + "]" * 400
    given = ['{"a": {"PASS-WORD": 1, "list": [{"jwt": null}, 2.5, true, null, "token"]}, "authors": ["x"]}', deep, '["é", {"sessionID": [1, 2]}]', "not json", "password=1", '"text"', "7", None, '{"a": 1, ' * 3, "[" * 100_000]
    rows = [r.s for r in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, g string").orderBy("k").select(words.redacted("g").alias("s")).collect()]
    assert json.loads(rows[0]) == {"a": {"PASS-WORD": "[REDACTED]", "list": [{"jwt": "[REDACTED]"}, 2.5, True, None, "token"]}, "authors": "[REDACTED]"}  # it has auth in it
    assert rows[1] == "[" * 400 + '{"Api Key":"[REDACTED]","x":10000000000000000000001}' + "]" * 400
    assert rows[2:] == ['["é",{"sessionID":"[REDACTED]"}]', "not json", "[REDACTED]", '"text"', "7", None, '{"a": 1, ' * 3, "[" * 100_000]
