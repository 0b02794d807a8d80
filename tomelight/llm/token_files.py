"""Token ids in files of length-delimited records with masked checksums, and an index for shuffled reads."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import Encoder
from .store import scratch, shards
from .textkit import ragged

#: Bytes of text of one file, and of the texts that are encoded at a time, about.
FILE, RUN = 16 << 20, 4 << 20
#: Files whose counts are added up by one task, at most.
FILES = 4096
#: Signs that are a pre-token of their own at the end of a word, and words of ASCII and Latin-1 letters: composed, and with one lower case each.
_SIGNS = ".,;:!?"
_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$"
# Fixed values of the format: the mask of a checksum, and the byte that ends a record.
_MASK, _END = 0xA282EAD8, b"\n"


def masked(data: bytes) -> int:
    """A CRC-32 that is safe to store beside data that holds CRCs: turned by 15 bits and shifted by a constant."""
    x = zlib.crc32(data)
    return ((x >> 15 | x << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """length (8 bytes), its masked checksum (4), payload, the payload's masked checksum (4), a line feed.

    Payload: id (8 bytes), whether there is one (1), bytes of a token id (1), token ids; all little-endian."""
    payload = struct.pack("<qBB", doc_id or 0, doc_id is not None, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload)) + _END


def frames(data: bytes):
    """(offset, id, token ids as uint32) of each record; a wrong checksum raises ValueError."""
    at = 0
    while at < len(data):
        length = data[at : at + 8]
        n = struct.unpack("<Q", length)[0]
        payload = data[at + 12 : at + 12 + n]
        if struct.unpack_from("<I", data, at + 8)[0] != masked(length) or len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, known, width = struct.unpack_from("<qBB", payload)
        yield at, doc_id if known else None, np.frombuffer(payload, "<u2" if width == 2 else "<u4", -1, 10).astype("<u4")
        at += 12 + n + 4 + len(_END)


class Packer:
    """Token ids of whole texts by the tokenizers library, which is asked for each distinct word once."""

    def __init__(self, spec: str):
        self.encoder = Encoder(spec, by_library=True)
        self.kind = f"<u{struct.calcsize(self.encoder.kind)}"
        self.signs = self.encoder.ids(list(_SIGNS))
        self.tokenize = self.encoder.vocabulary.library.model.tokenize

    def words(self, words: list[str]) -> list[bytes]:
        """The packed ids of distinct words of lower-case letters."""
        kept, kind, tokenize, names = self.encoder.words, self.encoder.kind, self.tokenize, self.encoder.vocabulary.byte_names
        for w in kept.missing(words):
            ids = [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(names))]
            kept.new[w] = struct.pack(f"<{len(ids)}{kind}", *ids)
        new = kept.new
        return [new[w] for w in words]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of a column of texts, and where those of each text end.

        Texts are cut at ASCII white space, which no pre-token crosses. Of the distinct pieces, letters with at most
        one sign at the end are taken apart as columns; the encoder cuts the others."""
        pieces = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = pieces.flatten().dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        word = pc.ascii_rtrim(distinct, characters=_SIGNS)
        signed = pc.subtract(pc.binary_length(distinct), pc.binary_length(word))
        plain = pc.match_substring_regex(distinct, _WORD)
        own = pc.utf8_lower(word.filter(plain)).dictionary_encode()
        other = self.encoder.ids(distinct.filter(pc.invert(plain)).to_pylist())
        words = self.words(own.dictionary.to_pylist())
        pool = [b"", *self.signs, *other, *words]
        ids = np.frombuffer(b"".join(pool), self.kind)
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // ids.itemsize
        start = np.cumsum(size) - size
        plain = plain.to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        first[~plain] = 1 + len(_SIGNS) + np.arange(len(other))
        first[plain] = 1 + len(_SIGNS) + len(other) + own.indices.to_numpy()
        for k, sign in enumerate(_SIGNS):
            second[plain & (signed.to_numpy(zero_copy_only=False) > 0) & pc.ends_with(distinct, sign).to_numpy(zero_copy_only=False)] = 1 + k
        parts = np.stack([first[at], second[at]], 1).ravel()
        size = size[parts]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids[ragged(start[parts], size)], total[2 * ends]


def _runs(column, limit: int):
    """(first row, array) of runs of whole texts of about `limit` bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, column.slice(a, b - a)
        a = b


def write_tokens(docs: DataFrame, spec: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append end_id and write the records to files in `path`, ids ascending.

    Files hold ranges of ids (null first; rows of one id stay together, in the order of their texts). Spark's own
    writer commits them, so a lost executor leaves no half file, on whatever store the path is."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = shards(docs.sparkSession, size, FILE)
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # the vocabulary file: a few MB, whatever the corpus

    def run(batches):
        packer = Packer(shared.value)
        width = struct.calcsize(packer.encoder.kind)
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, texts in _runs(batch.column(1), RUN):
                ids, ends = packer.column(texts)
                raw, cuts = memoryview(ids.tobytes()), [0, *(ends * width).tolist()]
                out = [frame(i, b"".join((raw[x:y], end)), width)[:-1] for i, x, y in zip(names[a : a + len(texts)], cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    ordered = docs.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", _END.decode()).text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """file, offset (of the record), id, before (ids in the file before it), n_tokens, ids_crc32 and (with_ids) ids: array<long>; every checksum is held against its record."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, before = [], 0
                for at, doc_id, ids in frames(content.as_py()):
                    rows.append((at, doc_id, before, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                    before += len(ids)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *columns], ["file", "offset", "id", "before", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, id long, before long, n_tokens long, ids_crc32 long, ids array<long>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per record: file, offset, id, start (token ids of all records before it), n_tokens, ids_crc32.

    Counts of files are added up in groups of FILES files, then one row of each group meets in one task."""
    rows = read_tokens(spark, path, with_ids=False).drop("ids")
    rows.write.parquet(f"{path}-records")
    rows = spark.read.parquet(f"{path}-records")
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", "n", number.alias("number"), F.floor(number / FILES).alias("group"))
    before = Window.partitionBy("group").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    files = files.select("file", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("own"))
    starts = files.join(groups, "group").select("file", (F.col("base") + F.col("own")).alias("base"))
    return rows.join(starts, "file").select("file", "offset", "id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_at(wanted: DataFrame, path: str) -> DataFrame:
    """The records at wanted (file, offset), in no order: file, offset, id, ids. Only files with a wanted record are
    parsed, only at these offsets, and each checksum is held against its record; a wrong offset raises ValueError."""
    spark = wanted.sparkSession
    offsets = wanted.select("file", "offset").groupBy("file").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))  # a file has FILE bytes of text, about
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")

    def run(batches):
        for batch in batches:
            for name, content, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, rows = memoryview(content.as_buffer()), []
                for at in places:
                    _, doc_id, ids = next(frames(bytes(data[at : at + 16 + struct.unpack_from("<Q", data, at)[0]])))
                    rows.append((name, at, doc_id, ids.tolist()))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "offset", "id", "ids"])

    return files.join(offsets, "file").select("file", "content", "offsets").mapInArrow(run, "file string, offset long, id long, ids array<long>")


def token_store(docs: DataFrame, spec: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write documents as token files with an index beside them (Parquet in <path>-index), and return the index read back.

    One row per document: id, start, n_tokens (with the end id), ids_crc32, file, offset. Null texts are empty (the end
    id alone); null ids come first; repeated rows are records of their own; an empty table gives an empty result; other
    columns are not looked at. Without a path, files go to the shared folder of the session.
    """
    spark = docs.sparkSession
    path = path or f"{scratch(spark)}/tomelight/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, spec, end_id, path, id_col, text_col)
    token_index(spark, path).withColumnRenamed("id", id_col).write.parquet(f"{path}-index")
    return spark.read.parquet(f"{path}-index")
