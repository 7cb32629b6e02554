"""Token-id files: fixed-width bit packing with block offsets.

Every id takes the least number of bits that the vocabulary needs. Ids are packed in
blocks of BLOCK ids, each starting on a byte, and a table of block offsets leads to any of
them, so ids a..b of a file are had by unpacking the blocks that they touch, in numpy.

An image (all little-endian): magic TFTK, then u32 version, bits, ids a block, n_docs,
u64 n_ids; i64 document ids, a byte for each that is null, u64 document starts (n_docs + 1),
u64 block offsets, packed blocks. Images are written by Spark as rows of a Parquet table
(shard, part, first_doc, n_docs, n_ids, image), since that gives each file an atomic commit in
any store. Shards are ranges of document ids in ascending order; the manifest has the
number of ids before each shard.

Defined results: null text is an empty text and gets the end id alone; null document ids
come first; rows that repeat an id are in order of their text; texts of any length are
encoded whole; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import checked_broadcast, only, read_table, sliced, texts_of, written
from tallyforge.llm.tokens import encoder, vocabulary_path, vocabulary_size

BLOCK = 4096
#: An image is closed at so many ids (a longer document has one of its own).
IMAGE_IDS = 1 << 19
MOST_SHARDS = 200_000
_HEAD = struct.Struct("<4s4IQ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    starts = np.concatenate([[0], np.cumsum(counts, dtype=np.uint64)]).astype("<u8")
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)]).astype("<u8")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([_HEAD.pack(b"TFTK", 1, bits, block, len(doc_ids), len(ids)), names.tobytes(), null.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Image:
    """Random access to an image."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, n, self.n_ids = _HEAD.unpack_from(data)
        if magic != b"TFTK" or version != 1:
            raise ValueError("not a token-id image")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        at += 9 * n
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.data = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a..b, from the blocks that hold them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        parts = [unpack(self.data[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(i, j)]
        return np.concatenate(parts)[a - i * self.block : b - i * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


FILES = "shard int, part int, first_doc long, n_docs long, n_ids long, image binary"


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """Encodes docs into a file set; (files, manifest), both read back from what was written."""
    bits = bits_for(vocabulary_size(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, part = encoder(path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], code.dtype).tobytes()
        docs_in: list = []
        counts: list[int] = []
        held: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), code.dtype)
            row = ([shard], [part], [docs_in[0]], [len(docs_in)], [len(ids)], [image(docs_in, counts, ids, bits)])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["shard", "part", "first_doc", "n_docs", "n_ids", "image"])

        for whole in batches:
            for batch in sliced(whole):
                for doc, got in zip(batch.column(0).to_pylist(), code.encode(texts_of(batch)), strict=True):
                    got += end
                    n = len(got) // code.dtype.itemsize
                    if docs_in and total + n > IMAGE_IDS:
                        yield close()
                        part += 1
                        docs_in, counts, held, total = [], [], [], 0
                    docs_in.append(doc)
                    counts.append(n)
                    held.append(got)
                    total += n
        if docs_in:
            yield close()

    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    files = written(ranged.mapInArrow(run, FILES), "token-files")
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files, written(shards.select("shard", "n_ids", before.alias("before")), "token-manifest")


def read_documents(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    # ids before each image: those before its shard, and those before it in the shard
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = files.select("shard", "part", "n_ids").select("shard", "part", inner.alias("inner"))
    places = places.join(manifest.select("shard", "before"), "shard").select("shard", "part", (F.col("before") + F.col("inner")).alias("base"))
    located = files.select("shard", "part", "image").join(checked_broadcast(places, MOST_SHARDS), ["shard", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                im = Image(data.as_py())
                all_ids = im.ids(0, im.n_ids).astype("<u4")
                crc = [zlib.crc32(all_ids[a:b]) for a, b in zip(im.starts[:-1], im.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(im.doc_ids, pa.int64(), mask=im.null), pa.array(im.starts[:-1] + base), pa.array(np.diff(im.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return located.select("base", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return read_documents(*write_ids(docs, vocabulary_path("word_bpe_49k.json"), end_id=1))
