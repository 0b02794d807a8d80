"""Byte-pair encoding of whole texts by a pair occurrence index, for tokenizers.json vocabularies with word ends."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import struct
import unicodedata
from functools import cached_property
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .textkit import as_binary, give_back

#: White space of the normaliser: Unicode's White_Space.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches, and words, that a process keeps the ids of, twice: the latest, and those before.
KEPT = 150_000
_CUT = regex.compile(f"[{_WHITE}]+")


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, other = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in names:
            names[b], other = chr(other), other + 1
    return [names[b] for b in range(256)]


class Vocabulary:
    """A vocabulary file: BPE with an end-of-word suffix, byte-level, over NFC, lower-cased text."""

    def __init__(self, spec: str):
        self.kept: dict[bool, tuple[Kept, Kept]] = {}
        self.file = spec
        spec = json.loads(spec)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        if len({new for *_, new in self.merges}) < len(pairs):
            raise ValueError("two merges make one token; merging by rank would not follow the library")
        key = np.array([(a + 2 << 32) | (b + 2) for a, b, _ in self.merges], np.int64)
        order = np.argsort(key)
        self.keys, self.key_ranks, self.none = key[order], order, len(pairs)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", _WHITE))
        names = byte_names()
        self.byte_names, self.bytes = names, {n: b for b, n in enumerate(names)}
        self.odd = any("<|" not in t for t in self.special)
        self.inner = np.array([self.ids[n] for n in names], np.int32)
        self.last = np.array([self.ids[n + self.suffix] for n in names], np.int32)

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, for characters that our tables do not have yet; most processes never need its tables."""
        return Tokenizer.from_str(self.file)

    @cached_property
    def model(self):
        return self.library.model

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a whole text; a special token in it is an entry of its own."""
        if "<|" not in text and not (self.odd and self.cut.search(text)):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.plain(text[at:])

    def stretch(self, text: str) -> list[str]:
        """The pre-tokens of a text without white space; most are one run of letters, maybe with a sign."""
        last = text[-1:] if text[-1:] in ".,;:!?" else ""
        word = text[: len(text) - len(last)]
        if word.isalpha() and "Σ" not in word and (word.isascii() or unicodedata.is_normalized("NFC", word)) and (low := word.lower()).isalpha():
            return [low, last] if last else [low]
        return self.words(text)

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        text, whole = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower(), text
        if any(unicodedata.category(c) == "Cn" for c in set(text)):  # newer than our tables: let the library tell letters from signs
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(whole))
            return [bytes(self.bytes[c] for c in w).decode() for w, _ in found]
        return self.pattern.findall(text)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one row, and where each word's ids begin (and the end).

        All words of the batch lie in one row of symbols. An index maps each pair (by its rank) to all
        places where it occurs; active ranks are taken in ascending order, a rank's places are merged at
        once, and the pairs that arise enter the lists of their ranks, which are always higher."""
        raw = "\0".join(words).encode() + b"\0"
        data = np.frombuffer(raw, np.uint8)
        symbol = self.inner[data]
        gap = np.flatnonzero(data == 0)
        symbol[gap] = -1  # between words; no pair has it
        symbol[gap - 1] = self.last[data[gap - 1]]
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ranks = self.rank(symbol[:-1], symbol[1:])
        at = np.flatnonzero(ranks < self.none).astype(np.int32)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, first = np.unique(ranks[at], return_index=True)
        places: dict[int, list[np.ndarray]] = {r: [x] for r, x in zip(found.tolist(), np.split(at, first[1:]), strict=True)} if len(at) else {}
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            here = places.pop(rank)
            here = np.unique(np.concatenate(here)) if len(here) > 1 else here[0]
            x, y, new = self.merges[rank]
            here = here[symbol[here] == x]
            other = after[here]
            ok = symbol[other] == y
            here, other = here[ok], other[ok]
            if x == y and len(here) > 1 and (here[1:] == other[:-1]).any():  # aaa: from the left
                keep, taken = [], -1
                for k, (p, q) in enumerate(zip(here.tolist(), other.tolist(), strict=True)):
                    if p != taken:
                        keep.append(k)
                        taken = q
                here, other = here[keep], other[keep]
            if not len(here):
                continue
            symbol[here], symbol[other] = new, -2
            right = after[other]
            after[here], before[right] = right, here
            left = before[here]
            left = left[left >= 0]
            spots = np.concatenate([here, left])
            ranks = self.rank(symbol[spots], symbol[after[spots]])
            ok = ranks < self.none
            spots, ranks = spots[ok], ranks[ok]
            if not len(spots):
                continue
            order = np.argsort(ranks, kind="stable")
            spots, ranks = spots[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r = int(ranks[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(spots[a:b])
        left = symbol >= 0
        ends = np.cumsum(left)[gap]
        return symbol[left], np.concatenate([[0], ends])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, self.none where there is no merge."""
        key = (a.astype(np.int64) + 2 << 32) | (b.astype(np.int64) + 2)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.key_ranks[k], self.none)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct pre-tokens and special tokens."""
        own = [w for w in words if w not in self.special and "\0" not in w]
        if len(own) == len(words):
            ids, at = self.merge(words) if words else (np.zeros(0, np.int32), [0])
            ids, at = ids.tolist(), np.asarray(at).tolist()
            return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        of = dict(zip(own, self.encode_words(own), strict=True))
        for w in words:
            if w in self.special:
                of[w] = [self.special[w]]
            elif w not in of:  # NUL, which parts the words here
                of[w] = self.library_word(w)
        return [of[w] for w in words]

    def library_word(self, word: str) -> list[int]:
        """The ids of a pre-token or special token by the library's own model."""
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize(word if word.isalnum() and word.isascii() else word.encode().decode("latin-1").translate(self.byte_names))]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as the library does for a file without a decoder; ids outside the vocabulary are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(spec: str) -> Vocabulary:
    key = hash(spec)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(spec)
    return _vocabularies[key]


class Kept:
    """What has been found for strings: the latest ones, about `most`, and as many before, which move up when asked for again."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, strings: list[str]) -> list[str]:
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        out = []
        for x in strings:
            if x not in self.new:
                if x in self.old:
                    self.new[x] = self.old[x]
                else:
                    out.append(x)
        return out


class Encoder:
    """Encodes batches of texts to packed token ids; what it finds for a word serves all later texts of the process."""

    def __init__(self, spec: str, by_library: bool = False, kept: int = KEPT):
        self.vocabulary, self.by_library = _vocabulary(spec), by_library
        self.kind = "H" if max(self.vocabulary.names) < 1 << 16 else "I"
        self.stretches, self.words = self.vocabulary.kept.setdefault(by_library, (Kept(kept), Kept(kept)))

    def forget(self) -> None:
        """Give back what was kept, for the stages that come after in the same process."""
        self.vocabulary.kept.clear()
        give_back()

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space, which no pre-token crosses."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the normaliser
            return [x for x in _CUT.split(text) if x]
        return text.split()

    def ids(self, stretches: list[str]) -> list[bytes]:
        """The packed ids of distinct stretches without white space."""
        v = self.vocabulary
        fresh = self.stretches.missing(stretches)
        cut = [v.stretch(c) for c in fresh]
        words = self.words.missing(list({w for ws in cut for w in ws}))
        for w, ids in zip(words, map(v.library_word, words) if self.by_library else v.encode_words(words), strict=True):
            self.words.new[w] = struct.pack(f"<{len(ids)}{self.kind}", *ids)
        known, of = self.stretches.new, self.words.new
        for c, ws in zip(fresh, cut, strict=True):
            known[c] = of[ws[0]] if len(ws) == 1 else b"".join([of[w] for w in ws])
        return [known[c] for c in stretches]

    def batch(self, texts: list[str], view=None) -> list[list]:
        """Of each text, the packed ids of its stretches between white space in order, or the view of each."""
        collecting = gc.isenabled()
        gc.disable()  # millions of strings and no cycles
        try:
            rows = [self.chunks(t) for t in texts]
            coded = pa.array(list(chain.from_iterable(rows)), pa.large_string()).dictionary_encode()
            views = self.ids(coded.dictionary.to_pylist())
            if view:
                views = [view(x) for x in views]
            found = [views[k] for k in coded.indices.to_numpy().tolist()]
            cuts = [0, *accumulate(map(len, rows))]
            return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        finally:
            if collecting:
                gc.enable()


def groups(column, limit: int = 4 << 20):
    """The texts of an Arrow column, null as empty, in runs of about `limit` bytes."""
    run, size = [], 0
    for t in as_binary(column):
        t = t.as_py()
        run.append(t.decode("utf-8", "replace"))
        size += len(t)
        if size > limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _shared(df: DataFrame, spec: str):
    return df.sparkSession.sparkContext.broadcast(spec)  # the vocabulary file: a few MB, whatever the corpus


def encode(docs: DataFrame, spec: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with one more column (replaced if there), the token ids of each whole text: array<int>, empty for null and empty texts."""
    docs = docs.drop(ids_col)
    shared, at, names = _shared(docs, spec), docs.columns.index(text_col), docs.columns

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [np.frombuffer(b"".join(row), f"<u{struct.calcsize(encoder.kind)}").tolist() for run in groups(batch.column(at)) for row in encoder.batch(run)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*names, ids_col])

    return docs.mapInArrow(run, _with(docs, ids_col, "array<int>"))


def decode(docs: DataFrame, spec: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with one more column (replaced if there), the text of the ids; null ids give an empty text."""
    docs = docs.drop(text_col)
    shared, at, names = _shared(docs, spec), docs.columns.index(ids_col), docs.columns

    def run(batches):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            texts = [vocabulary.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text_col])

    return docs.mapInArrow(run, _with(docs, text_col, "string"))


def _with(df: DataFrame, name: str, kind: str):
    return df.select("*", F.lit(None).cast(kind).alias(name)).schema


def digests(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", run: int = 4 << 20) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256.

    Encodes and decodes each whole text in one pass and keeps neither; null counts as empty. Repeated rows
    and null ids come back as they are; an empty table gives an empty result. Texts are taken in runs of about
    `run` bytes: smaller runs hold less memory and format more often what they share.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    shared = _shared(docs, spec)
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches):
        encoder, sha = Encoder(shared.value, kept=KEPT // 6), hashlib.sha256
        size = struct.calcsize(encoder.kind)

        def view(packed: bytes):
            ids = struct.unpack(f"<{len(packed) // size}{encoder.kind}", packed)
            return len(ids), " ".join(map(str, ids)), encoder.vocabulary.decode(ids)

        for batch in batches:
            n, ids, text = [], [], []
            for some in groups(batch.column(1), run):
                for row in encoder.batch(some, view):
                    n.append(sum(x[0] for x in row))
                    ids.append(sha(" ".join([x[1] for x in row]).encode()).hexdigest())
                    text.append(sha(" ".join([x[2] for x in row]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.forget()

    return docs.mapInArrow(encoded, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
