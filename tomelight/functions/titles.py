"""Titles: numbers, ranges and noise in them, comparison keys and gates, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .folding import compatible

# Patterns of numbers and ranges in titles, in the order in which they are tried.
NUMBER = r"\d+(?:\.\d+)?"
PREQUEL = (r"(?i)chapter\s*0+-(\d+)", r"^0+-(\d+)(?:\.|$|\s)", r"\b0+-(\d+)\b")
NUMBERED = (rf"^({NUMBER})\.\s", rf"(?i)Chapter\s+({NUMBER})", rf"^({NUMBER})")
VOLUME = r"v(?:ol(?:ume)?s?\.?\s*)?"
RANGES = (
    r"第\s*(\d+)\s*[-–—~〜]\s*(\d+)\s*巻",
    rf"(?i){VOLUME}(\d+)\s*[-–—~]\s*{VOLUME}(\d+)",
    rf"(?i){VOLUME}(\d+)\s+(?:to|through|thru|-)\s+v?(?:ol(?:ume)?s?\.?\s*)?(\d+)",
    rf"(?i){VOLUME}(\d+)\s*[-–—~]\s*(\d+)",
    r"\b(\d{1,3})\s*[-–—]\s*(\d{1,3})\b",
)
SINGLES = (r"第\s*(\d+)\s*巻", rf"(?i){VOLUME}(\d+)", r"\b(\d{1,2})\b")
VOLUME_WORD = r"(?i)v(?:ol(?:ume)?s?)"
NOISE = (
    r"\[[^\]]*\]",
    r"\([^)]*\)",
    r"(?i)\bv(?:ol(?:ume)?s?\.?)?\s*\d+(?:[-–]\d+)?\b",
    r"(?i)\btomes?\s*\d+(?:[-–]\d+)?\b",
    r"(?i)\bch(?:apter)?s?\.?\s*\d+(?:[-–]\d+)?\b",
    r"(?i)\bc\.?\s*\d+(?:[-–]c?\d+)?\b",
    r"\b\d{1,4}\s*[-–]\s*\d{1,4}\b",
    r"\b(?:18|19|20)\d{2}\b",
)
# Signs of another edition or a spin-off.
EDITIONS = (r"(?i)\bcolou?r(?:ed)?\b", r"(?i)\bdigital\s*colou?r(?:ed)?\b", r"(?i)\bofficial\s*colou?r(?:ed)?\b", r"(?i)\bomnibus\b", r"(?i)\bbox\s*set\b", r"(?i)\bdeluxe\b", r"(?i)\bfull\s*colou?r\b", "カラー", "完全版")
SPINOFFS = (r"(?i)\bshin\b", r"(?i)\bgaiden\b", r"(?i)\bpart\s*\d", r"(?i)\b4-?koma\b", r"(?i)\bantho(logy)?\b", r"(?i)\b\w+-bu!?\b", r"(?i)\bgt\b", r"(?i)\br2\b", r"(?i)\bkai\b", r"(?i)\bshippuu?den\b", r"(?i)\b\d+(?:st|nd|rd|th)\b", r"(?i)\bx\d{2,}\b")
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}"


_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with \b between an ASCII word character and any other; Java's own counts letters of all scripts."""
    return pattern.replace(r"\b", _EDGE)


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(x, ascii_edges(pattern), group), F.lit(""))


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _plausible(number: Column) -> Column:
    return bound(number, lambda n: F.when((n >= 0) & (n < 10_000), n))


def sequence_number(x: Column) -> Column:
    """The number of an entry from its text: 0-N is 0.N, then "N. title", "Chapter N", a number in front. Null unless 0 <= n < 10000."""
    minor = F.coalesce(*(found(x, p) for p in PREQUEL))
    return _plausible(F.coalesce(F.concat(F.lit("0."), minor), *(found(x, p) for p in NUMBERED)).try_cast("double"))


def volume_range(x: Column) -> Column:
    """struct(start, end, single) of the volumes in a title: the first range pattern that holds, else the first single one; null without one."""

    def pick(a: Column, b: Column, single: bool, ok) -> Column:
        own = F.struct(a.try_cast("int").alias("start"), b.try_cast("int").alias("end"), F.lit(single).alias("single"))
        return bound(own, lambda r: F.when(ok(r), r))

    def first(bare: Column) -> Column:
        short = lambda r: (r["start"] >= 1) & r["end"].between(r["start"], 999) & (r["end"] - r["start"] <= 100)
        ranges = [pick(found(bare, p, 1), found(bare, p, 2), False, short if p == RANGES[-1] else lambda r: r["end"] >= r["start"]) for p in RANGES]
        alone = lambda r: r["start"].between(1, 99) & ~bare.rlike(VOLUME_WORD)
        singles = [pick(found(bare, p), found(bare, p), True, alone if p == SINGLES[-1] else lambda r: r["start"].isNotNull()) for p in SINGLES]
        return F.coalesce(*ranges, *singles)

    return bound(F.trim(F.regexp_replace(x, r"[\[\](){}<>]", " ")), first)


def volume_label(r: Column) -> Column:
    """v01 for one volume, v01-v05 for a range; numbers of more than two digits stay whole."""
    padded = lambda n: F.concat(F.lit("v"), F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0")))
    return F.when(r["single"], padded(r["start"])).otherwise(F.concat_ws("-", padded(r["start"]), padded(r["end"])))


def without_noise(x: Column) -> Column:
    """A release title without brackets, markers of volumes and chapters, ranges and years; white space collapsed."""
    for p in NOISE:
        x = F.regexp_replace(x, ascii_edges(p), " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def comparison_key(x: Column) -> Column:
    """Compatibility forms replaced, lower case, signs other than ASCII letters, digits and _ dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(compatible(x)), r"[^\w\s]", ""), r"\s+", " "))


def synonym_key(x: Column) -> Column:
    """Compatibility forms replaced, lower case, runs of separators as one space."""
    return F.trim(F.regexp_replace(F.lower(compatible(x)), r"[\s_\-:/.,;!?'\"]+", " "))


def edition_mismatch(a: Column, b: Column) -> Column:
    """Whether one of two titles, and not the other, names an edition or a spin-off."""
    out = F.lit(False)
    for p in (*EDITIONS, *SPINOFFS):
        out = out | (a.rlike(ascii_edges(p)) != b.rlike(ascii_edges(p)))
    return out


def overlap(a: Column, b: Column) -> Column:
    """Length ratio if one string contains the other, else the Jaccard similarity of their characters."""
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), a).otherwise(b)
    x, y = (F.array_distinct(F.filter(F.split(v, ""), lambda c: c != "")) for v in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(F.contains(long, short), F.try_divide(F.length(short), F.length(long))).otherwise(F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0))


def cjk_tokens(x: Column) -> Column:
    """Single CJK characters, and runs of other signs that are not white space."""
    return F.regexp_extract_all(x, F.lit(rf"[{CJK}]|[^\s{CJK}]+"), F.lit(0))


def token_type(x: Column) -> Column:
    """cjk, number, word or mixed."""
    return F.when(x.rlike(rf"^[{CJK}]$"), "cjk").when(x.rlike(r"^\d+(?:[.,]\d+)?$"), "number").when(x.rlike(r"^\p{L}+$"), "word").otherwise("mixed")


def match_confidence(text: Column, name: Column) -> Column:
    """1 for equal strings, 0.9 if the words of name stand in text one after the other, 0.7 if it is part of text, else 0."""
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.when(F.trim(text) == name, 1.0).when(F.contains(padded(text), padded(name)), 0.9).when(F.contains(text, name), 0.7).otherwise(0.0)


# Words that a release may add to a title.
QUALIFIERS = ("deluxe", "part", "omnibus", "digital")
#: Accepted titles of one word of more characters than this are told from others by their length alone.
SHORT_NAME = 12


def foreign(words: Column, accepted: Column) -> Column:
    """Whether a release's words reject it: no accepted title (an array of words each) passes.

    A title of several words, or of one long word, passes; one short word allows only itself and qualifiers beside it."""
    extra = lambda title: F.size(F.filter(words, lambda w: ~F.array_contains(title, w) & ~w.isin(*QUALIFIERS)))
    passes = lambda title: (F.size(F.array_distinct(title)) != 1) | (F.length(F.get(title, F.lit(0))) > SHORT_NAME) | (extra(title) == 0)
    return (F.size(words) > 0) & (F.size(accepted) > 0) & ~F.exists(accepted, passes)


# Ranges and single numbers of volumes and chapters in release titles, and signs of audio and video.
VOLUME_SPANS = (r"第\s*(\d{1,3})\s*[-–—~〜]\s*(\d{1,3})\s*巻", r"(?i)v(\d{1,3})\s*[-~]\s*v?(\d{1,3})", r"(?i)vol\.?\s*(\d{1,3})\s*[-~]\s*(?:vol\.?\s*)?(\d{1,3})", r"(?i)\btomes?\s+(\d{1,3})\s+(?:[àa]|&agrave;)\s+(\d{1,3})\b")
VOLUME_ONES = (r"第\s*(\d{1,3})\s*巻", r"(?i)\bv(\d{1,3})\b", r"(?i)\bvol\.?\s*(\d{1,3})\b")
CHAPTER_SPANS = (r"(?i)\bc(\d{1,4})\s*[-~]\s*c?(\d{1,4})(?:\.\d+)?\b", r"(?i)\bch\.?\s*(\d{1,4})\s*[-~]\s*(?:ch\.?\s*)?(\d{1,4})(?:\.\d+)?\b", r"(?i)\bchapters?\s*(\d{1,4})\s*[-~]\s*(\d{1,4})(?:\.\d+)?\b", r"第\s*(\d{1,4})\s*[-–—~〜]\s*(\d{1,4})\s*話")
CHAPTER_ONES = (r"(?i)\bc(\d{1,4})\b", r"(?i)\bch\.?\s*(\d{1,4})\b", r"(?i)\bchapter\s*(\d{1,4})\b", r"第\s*(\d{1,4})\s*話")
BARE_SPANS = (r"\(\s*(0\d{2,3}|\d{3,4})\s*[-~]\s*(\d{2,4})(?:\.\d+)?\s*\)", r"\[\s*(0\d{2,3}|\d{3,4})\s*[-~]\s*(\d{2,4})(?:\.\d+)?\s*\]", r"(?:^|[\s_])(0\d{2,3}|\d{3,4})\s*[-~]\s*(\d{2,4})(?:\.\d+)?(?=[\s_({}\[\].]|$)")
OTHER_MEDIA = (r"(?i)\bseason\s+\d+\b", r"(?i)\bs\d{1,2}\s*[-~]\s*s\d{1,2}\b", r"(?i)\bs\d{1,2}e\d{1,3}\b", r"(?i)\bepisodes?\s+\d+", r"(?i)\b\d{2,3}p\b", r"(?i)\bost\b", r"(?i)\boriginal\s+soundtrack\b", r"(?i)\bmp3\b", r"(?i)\bflac\b")


def release_coverage(x: Column) -> Column:
    """struct(volumes, chapters) that a release title covers, each an array of numbers; both empty for audio and video.

    The first pattern of a range that matches, else the first of a single number; chapters also by a bare range in
    brackets or between blanks that is no pair of years. A reversed range covers nothing."""
    none = F.array().cast("array<int>")
    number = lambda s: s.try_cast("int")

    def span(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, b)).otherwise(none)

    def first(spans: tuple, ones: tuple, otherwise: Column) -> Column:
        ranges = [F.when(found(x, p, 1).isNotNull(), span(number(found(x, p, 1)), number(found(x, p, 2)))) for p in spans]
        return F.coalesce(*ranges, *(F.when(found(x, p).isNotNull(), F.array(number(found(x, p)))) for p in ones), otherwise)

    pairs = F.flatten(F.array(*(F.arrays_zip(*(F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(g)), number).alias(n) for g, n in ((1, "a"), (2, "b")))) for p in (BARE_SPANS[0], BARE_SPANS[1], BARE_SPANS[2]))))
    pair = F.get(F.filter(pairs, lambda q: ~(q["a"].between(1900, 2099) & q["b"].between(1900, 2099))), F.lit(0))
    chapters = first(CHAPTER_SPANS, CHAPTER_ONES, F.when(pair.isNotNull(), span(pair["a"], pair["b"])).otherwise(none))
    other = F.lit(False)
    for p in OTHER_MEDIA:
        other = other | x.rlike(ascii_edges(p))
    pick = lambda c: F.when(other, none).otherwise(c)
    return F.struct(pick(first(VOLUME_SPANS, VOLUME_ONES, none)).alias("volumes"), pick(chapters).alias("chapters"))


def likely_english(x: Column, lang: Column) -> Column:
    """Text that is declared as English or not at all, without accents of other languages and CJK characters."""
    foreign_signs = x.rlike("(?iu)[àâãäåçéèêëìíîïñòóôõöùúûüýÿœæ]") | x.rlike(r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7af}]")
    return (F.coalesce(x, F.lit("")) != "") & (F.coalesce(lang, F.lit("en")) == "en") & ~foreign_signs


# Markers of an entry in a list of links, and numbers in front that are pages, dates or ISBNs.
MARKERS = (rf"(?i)\bchapter\s*({NUMBER})", rf"(?i)\bch\.?\s*({NUMBER})")
MARKED_PREQUEL = r"(?i)\bchapter\s*0+-(\d+)"
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
NO_ENTRY = (r"(?i)^\d[\d,]*\s*(?:pages?|pp?\.)(?:[^a-z]|$)", rf"(?i)^\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH}\b\.?,?\s*(?:(?:19|20)\d{{2}}\b|$)", r"^(?:19|20)\d{2}[-/.]\d{1,2}(?:[-/.]\d{1,2})?(?:\D|$)", r"^\d{1,2}/\d{1,2}/\d{2,4}(?:\D|$)", r"^\d{1,2}\.\d{1,2}\.(?:19|20)\d{2}(?:\D|$)", r"^\d{1,5}[-‐-―]\d{1,7}[-‐-―]\d{1,7}")
ISBN = r"(?i)\bISBN\b|\b97[89][-‐-―\s]?\d{1,5}[-‐-―\s]?\d{2,7}"
IN_FRONT = (r"^(\d+)[\s:.\-–—]", r"^(\d+)$")


def listed_number(x: Column) -> Column:
    """The number of an entry in a list of links: an explicit marker, else a bare number in front that is no date, page count or ISBN."""
    minor = lambda p: F.concat(F.lit("0."), found(x, p)).try_cast("double")
    marked = F.coalesce(found(x, MARKED_PREQUEL), *(found(x, p) for p in MARKERS)).isNotNull()
    explicit = F.coalesce(minor(MARKED_PREQUEL), F.coalesce(*(found(x, p) for p in MARKERS)).try_cast("double"))
    other = x.rlike(ascii_edges(ISBN))
    for p in NO_ENTRY:
        other = other | x.rlike(ascii_edges(p))
    bare = F.coalesce(*(minor(p) for p in PREQUEL[1:]), F.coalesce(*(found(x, p) for p in IN_FRONT)).try_cast("double"))
    return F.coalesce(F.when(marked, _plausible(explicit)), F.when(~other, _plausible(bare)))
