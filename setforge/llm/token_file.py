"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents, cut in blocks of 256: of each block the minimum is subtracted, the
rest is packed at the width that holds ``percentile`` percent of the values, and the larger values go to an exception
list (position, high bits). The segment carries the byte-size header, the blocks' minima, widths and word starts (the
index: a block is read without those before it), the packed words and the exceptions.

Segments are binary values of a Parquet table in the shared folder, so Spark's committer leaves only whole files of
tasks that succeeded, whatever the store. A row has part and first (ids before it in its part), doc_ids and lengths.

Defined results: null text counts as empty, and leaves one end id; documents with the same doc_id follow each other in
the order of their texts' hash; a null doc_id comes first; an empty table gives an empty file and an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import shared_path
from setforge.llm.tokens import is_plain, load, parts

BLOCK = 256
_HEAD = struct.Struct("<4sIIII")


@dataclass(frozen=True)
class FileParams:
    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 0
    percentile: int = 90
    segment_ids: int = 1 << 19
    memo: int = 800_000
    max_parts: int = 1 << 20


def pack(ids: np.ndarray, percentile: int = 90) -> bytes:
    """A segment of ids (uint32)."""
    n, nb = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return _HEAD.pack(b"PFR1", 0, 0, 0, 0)
    rows = np.full(nb * BLOCK, ids[-1], np.uint32)
    rows[:n] = ids
    rows = rows.reshape(nb, BLOCK)
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.frexp(np.partition(delta, at, axis=1)[:, at].astype(np.float64))[1].astype(np.uint8)
    words = width.astype(np.int64) * (BLOCK // 64)
    starts = np.concatenate(([0], np.cumsum(words)))
    packed = np.zeros(int(starts[-1]), np.uint64)
    big = delta >> width[:, None].astype(np.uint32) if width.max() < 32 else np.where(width[:, None] > 31, 0, delta >> np.minimum(width, 31)[:, None].astype(np.uint32))
    block, place = np.nonzero(big)
    high = big[block, place]
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            lanes = np.ascontiguousarray(delta[own].T).astype(np.uint64) & np.uint64((1 << w) - 1)
            out = np.zeros((w * BLOCK // 64, len(own)), np.uint64)
            for i in range(BLOCK):
                word, bit = divmod(i * w, 64)
                out[word] |= lanes[i] << np.uint64(bit)
                if bit + w > 64:
                    out[word + 1] |= lanes[i] >> np.uint64(64 - bit)
            packed[starts[own][:, None] + np.arange(len(out))] = out.T
    return b"".join((_HEAD.pack(b"PFR1", n, nb, len(packed), len(high)), low.astype("<u4").tobytes(), width.tobytes(), starts[:-1].astype("<u4").tobytes(), packed.astype("<u8").tobytes(), (block * BLOCK + place).astype("<u4").tobytes(), high.astype("<u4").tobytes()))


def unpack(data: bytes) -> np.ndarray:
    """The ids of a segment."""
    magic, n, nb, nw, ne = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a segment")
    at, fields = _HEAD.size, []
    for kind, size in (("<u4", nb), ("u1", nb), ("<u4", nb), ("<u8", nw), ("<u4", ne), ("<u4", ne)):
        fields.append(np.frombuffer(data, kind, size, at))
        at += fields[-1].nbytes
    low, width, starts, packed, place, high = fields
    delta = np.zeros((nb, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            words = np.ascontiguousarray(packed[starts[own].astype(np.int64)[:, None] + np.arange(w * BLOCK // 64)].T)
            lanes = np.empty((BLOCK, len(own)), np.uint32)
            mask = np.uint64((1 << w) - 1)
            for i in range(BLOCK):
                word, bit = divmod(i * w, 64)
                v = words[word] >> np.uint64(bit)
                if bit + w > 64:
                    v = v | words[word + 1] << np.uint64(64 - bit)
                lanes[i] = v & mask
            delta[own] = lanes.T
    if ne:
        delta.reshape(-1)[place] |= high << width[place // BLOCK].astype(np.uint32)
    return (delta + low[:, None]).reshape(-1)[:n]


class Pieces(dict):
    """Memo: pre-token -> its ids as little-endian bytes, found by the library's model; emptied when it is full."""

    def __init__(self, model, most: int):
        self.model, self.most = model, most
        # the byte-level alphabet: bytes that print stand for themselves, the others follow from U+0100 on, in order
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in own else next(rest)) for b in range(256)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        self[piece] = out = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return out


class Encoder:
    """Ids of texts as little-endian bytes, through the tokenizers library, each distinct pre-token once while it is kept.

    Texts of characters up to U+024F (assigned long ago) are cut in the byte-level pre-tokenizer's pieces here and the
    library's model finds the ids of each piece. Any other text, one with an added token's string, and all texts where the
    tokenizer is not a plain byte-level one, go to the library whole.
    """

    #: The published byte-level pattern, for characters up to U+024F.
    LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    DIGIT = "0-9²³¹¼-¾"
    SPACE = r"\t-\r \x85\xa0"
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    OTHER = re.compile(r"[^\t-\r -~\x85\xa0-ɏ]")

    def __init__(self, p: FileParams):
        self.tok = load(p.tokenizer)
        self.memo = Pieces(self.tok.model, p.memo)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.plain = is_plain(self.tok)

    def whole(self, text: str) -> bytes:
        got = self.tok.encode_batch_fast(parts(text, 1 << 16) if self.plain else [text], add_special_tokens=False)
        return b"".join(np.array(x.ids, "<u4").tobytes() for x in got)

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(a in text for a in self.added) or not text.isascii() and self.OTHER.search(text):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.PIECES.findall(text)))


@lru_cache(maxsize=2)
def encoder(p: FileParams) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(p)


_SEGMENT = "part long, first long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def write_ids(ordered: DataFrame, path: str, p: FileParams) -> None:
    """Write the ids of doc_id, text rows, in the order of partitions and of rows inside them."""

    def run(batches):
        encode, part = encoder(p), TaskContext.get().partitionId()
        end = np.array([p.end_id], "<u4").tobytes()
        ids, lengths, blobs, size, first = [], [], [], 0, 0

        def segment():
            data = np.frombuffer(b"".join(blobs), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first]), pa.array([len(data)]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(data, p.percentile)], pa.binary())], ["part", "first", "n_ids", "doc_ids", "lengths", "data"])

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    blob = encode(t.as_py() or "")
                    ids.append(i)
                    lengths.append(len(blob) // 4 + 1)
                    blobs += [blob, end]
                    size += lengths[-1]
                    if size >= p.segment_ids:
                        yield segment()
                        ids, lengths, blobs, size, first = [], [], [], 0, first + size
        if ids:
            yield segment()

    ordered.mapInArrow(run, _SEGMENT).write.option("compression", "none").parquet(path)


def read_ids(spark, path: str, p: FileParams) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the file; start counts the ids of all documents before it."""
    segments = spark.read.schema(_SEGMENT).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first").alias("low")).orderBy("part").limit(p.max_parts + 1).collect()
    if len(totals) > p.max_parts:  # a row for each task of the writer, never for each document
        raise ValueError("more parts than max_parts; write fewer, larger partitions")
    base, at = [], 0
    for r in totals:
        base.append((r["part"], at))
        at += r["n"]
    base = F.broadcast(spark.createDataFrame(base, "part long, base long"))

    def run(batches):
        for whole in batches:
            for row in range(whole.num_rows):
                batch = whole.slice(row, 1)
                data = unpack(batch.column("data")[0].as_py()).astype("<u4", copy=False).tobytes()
                lengths = np.array(batch.column("lengths")[0].as_py(), np.int64)
                stops = np.cumsum(lengths)
                starts = stops - lengths
                crcs = [zlib.crc32(memoryview(data)[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                zero = batch.column("base")[0].as_py() + batch.column("first")[0].as_py()
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[0].values, pa.array(starts + zero), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(base, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(ordered: DataFrame, p: FileParams = FileParams(), path: str | None = None) -> DataFrame:
    """Write the rows (doc_id, text) in the order they stand in and read the file back."""
    spark = ordered.sparkSession
    path = path or shared_path(spark, "ids")
    write_ids(ordered, path, p)
    return read_ids(spark, path, p)


def by_doc_id(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    return token_file(by_doc_id(table(spark, sf_dir, "documents")))
