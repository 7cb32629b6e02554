"""BPE encoding and decoding over a table of distinct words.

1. Texts are split into words in Spark. Tasks pack documents into parts of some megabytes: a
   part has its distinct words with their counts, most frequent first, and for each
   document the place of each of its words among them. Parts are stored, by part.
2. The parts' words make the table of distinct words (a part's word is one row, however
   often it stands), and each is encoded once, with the tokenizers library.
3. The most frequent words (HEAD at most, of HEAD_CHARS at most: a fixed bound) go to every
   task; a part's other words are joined with the word table and come back to the part, and
   every word of a document takes its ids by position. The texts do not move.
4. Decoding joins ids with the vocabulary's pieces, a table bounded by the vocabulary.

Defined results: null text is an empty text with no ids and an empty decoded text; any
length of text is encoded whole; repeated rows each get their row; an empty table gives an
empty result; other columns are ignored, under whatever names. Lone surrogates cannot occur.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import drop_written, new_path, only, read_table, sliced, written
from tallyforge.llm.tokens import SAFE_CLASS, SPACES, SPECIAL, WORDS, encode_words, id_type, tokenizer, vocabulary_path, vocabulary_size

#: Words that every task holds: at most so many, of at most so many characters.
HEAD, HEAD_CHARS = 1 << 19, 32
#: Word bytes of a part.
PART_BYTES = 12 << 20


def split_words(text: Column) -> Column:
    """tokens.words_of as a column."""
    plain = text.rlike(f"^[{SAFE_CLASS}{SPACES}]*$") & ~F.contains(text, F.lit(SPECIAL))
    fine = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    rough = F.filter(F.split(text, f"[{SPACES}]+"), lambda c: c != "")
    return F.when(plain, fine).otherwise(rough)


def word_table(parts: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): every distinct word of the parts, how often it stands, its ids as bytes."""
    dtype = id_type(vocabulary_size(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(encode_words(path, words, dtype), pa.binary())], ["word", "n", "ids"])

    each = parts.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    counted = each.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n"))
    return written(counted.mapInArrow(run, "word string, n long, ids binary"), "words")


def head_of(words: DataFrame) -> DataFrame:
    """The most frequent short words: those of whole frequency classes, HEAD rows at most."""
    short = words.where(F.length("word") <= HEAD_CHARS).withColumn("c", F.floor(F.log2("n") * 16).cast("int"))
    total, least = 0, None
    for r in sorted(short.groupBy("c").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["c"]):  # 16 rows per doubling
        if total + r["k"] > HEAD:
            break
        total, least = total + r["k"], r["c"]
    return short.where(F.col("c") >= (least if least is not None else 1 << 30)).select("word", "ids")


def _shared_head(spark: SparkSession, words: DataFrame):
    rows = head_of(words).toArrow()
    return spark.sparkContext.broadcast((rows.column("word").combine_chunks(), rows.column("ids").combine_chunks()))


_heads: dict = {}


def _head(key: str, shared) -> dict[str, bytes]:
    """The head as a dict, built once in each worker process."""
    if key not in _heads:
        _heads.clear()
        words, ids = shared.value
        _heads[key] = dict(zip(words.to_pylist(), ids.to_pylist(), strict=True))
    return _heads[key]


def _packed(codes: np.ndarray) -> bytes:
    """Codes as compressed byte planes: most are small, so the upper planes are nearly free."""
    planes = np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.Codec("zstd", compression_level=6).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    flat = pa.Codec("zstd").decompress(data, decompressed_size=4 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, n).T).view("<u4").ravel()


PART = "part string, words array<string>, counts array<int>, sizes array<int>, codes binary"


def _make_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, words) rows: PART rows with the documents' ids."""
    for whole in batches:
        for batch in sliced(whole, PART_BYTES):
            lists = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0)
            coded = lists.flatten().dictionary_encode()
            own = np.asarray(coded.indices)
            counts = np.bincount(own, minlength=len(coded.dictionary)).astype(np.int32)
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            cols = [pa.array([uuid.uuid4().hex]), one(coded.dictionary.take(pa.array(order))), one(pa.array(counts[order])), one(sizes.cast(pa.int32())), pa.array([_packed(place[own])], pa.binary()), one(batch.column(0))]
            yield pa.RecordBatch.from_arrays(cols, ["part", "words", "counts", "sizes", "codes", "docs"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per document: its id and ids (array<int>); with digest, what op6 reports instead."""
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col)
    id_name = rows.schema["doc_id"].dataType.simpleString()
    dtype = id_type(vocabulary_size(path))

    # stored by part: the join below then moves words and ids, not documents
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path_of_parts = f"parts_{uuid.uuid4().hex}", new_path(spark, "parts")
    made = rows.select("doc_id", split_words(F.col("text")).alias("words")).mapInArrow(_make_parts, f"{PART}, docs array<{id_name}>")
    made.write.format("parquet").option("path", path_of_parts).option("compression", "zstd").bucketBy(n, "part").saveAsTable(name)
    parts = spark.table(name)

    words = word_table(parts, path)
    shared, key = _shared_head(spark, words), uuid.uuid4().hex

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = _head(key, shared)
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = [w for w in own.values.to_pylist() if w not in head]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.string()), pa.array(out, pa.string())], ["part", "word"])

    asked = parts.select("part", "words").mapInArrow(rare, "part string, word string")
    answered = asked.join(words.select("word", "ids").hint("shuffle_hash"), "word").groupBy("part").agg(F.collect_list(F.struct("word", "ids")).alias("got"))
    joined = parts.select("part", "words", "sizes", "codes", "docs").join(answered, "part", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, pieces = _head(key, shared), Pieces(path)
        for whole in batches:
            for k in range(whole.num_rows):
                own_words, sizes, data, doc_ids, got = (whole.column(c)[k] for c in range(5))
                own = {} if not got.is_valid else dict(zip(got.values.field("word").to_pylist(), got.values.field("ids").to_pylist(), strict=True))
                # a word that did not come back is a KeyError, never a gap
                ids = [head[w] if w in head else own[w] for w in own_words.values.to_pylist()]
                to = np.cumsum(np.asarray(sizes.values)).tolist()
                codes = _unpacked(data.as_py(), to[-1] if to else 0)
                out = _digests(ids, codes, to, dtype, pieces) if digest else _ids(ids, codes, to, dtype)
                yield pa.RecordBatch.from_arrays([doc_ids.values, *out], ["doc_id", *(("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("ids",))])

    schema = f"doc_id {id_name}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    done = written(joined.select("words", "sizes", "codes", "docs", "got").mapInArrow(finish, schema), "encoded")
    spark.sql(f"DROP TABLE {name}")
    parts._written_to = path_of_parts
    drop_written(parts, words)
    return done


def _ids(ids: list[bytes], codes: np.ndarray, to: list[int], dtype: np.dtype) -> list[pa.Array]:
    """Each document's ids: its words' ids, one word after another."""
    texts = [b"".join(map(ids.__getitem__, codes[a:b].tolist())) for a, b in zip([0, *to], to, strict=False)]
    flat = np.frombuffer(b"".join(texts), dtype).astype(np.int32)
    ends = np.cumsum([0, *(len(t) // dtype.itemsize for t in texts)])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]


def _digests(ids: list[bytes], codes: np.ndarray, to: list[int], dtype: np.dtype, pieces: Pieces) -> list[pa.Array]:
    """Each document's token count and the digests of its ids and of their pieces; words are put in text form once."""
    numbers = [np.frombuffer(x, dtype).tolist() for x in ids]
    size = np.array([len(x) for x in numbers], np.int64)
    decimal = [" ".join([pieces.decimal[i] for i in x]) for x in numbers]
    decoded = [" ".join([pieces.piece[i] for i in x]) for x in numbers]
    n, shas = [], ([], [])
    for a, b in zip([0, *to], to, strict=False):
        own = codes[a:b]
        n.append(int(size[own].sum()))
        own = own[size[own] > 0].tolist()  # odd white space can be a word without ids
        for out, texts in zip(shas, (decimal, decoded), strict=True):
            out.append(hashlib.sha256(" ".join(map(texts.__getitem__, own)).encode()).hexdigest())
    return [pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in shas)]


class Pieces:
    """The vocabulary as a table from id to piece, and from id to its decimal form."""

    def __init__(self, path: str):
        t = tokenizer(path)
        n = max(t.get_vocab(with_added_tokens=True).values()) + 1
        self.piece = [t.id_to_token(i) or "" for i in range(n)]
        self.decimal = [str(i) for i in range(n)]


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: each id's piece from the vocabulary table, by position.

    The vocabulary has no decoder of its own, so pieces are joined by a space, as the
    library's decode(ids, skip_special_tokens=False) does. Null ids give null.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path).piece
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if r is None else " ".join([pieces[i] for i in r]) for r in rows], pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return encode(docs, vocabulary_path("word_bpe_49k.json"), digest=True)
