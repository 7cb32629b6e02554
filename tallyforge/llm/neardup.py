"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

1. Every document becomes its set of five-word shingles (64-bit hashes), a fingerprint of
   that set and HASHES MinHash values. Documents with one set are one class of copies and go on as
   one representative with a weight.
2. Values in bands of ROWS hashed together are bucket keys; representatives that share one
   are candidates. At similarity 0.8 all BANDS differ with probability 5e-8. A bucket makes
   an edge from each member to its least, so a bucket of any size costs as many rows as it has
   members; connected candidates are a family.
3. Families are dealt in blocks of about BLOCK members and BLOCK_BYTES of text, and every two
   blocks of a family meet in one task. There MinHash values are compared STEP at a time; a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold (uniform prior, so a
   binomial tail) is below TOLERANCE; the others' shingle sets are intersected exactly. A
   task returns, per member, how many documents it links to and one edge to its group in
   the task: no pairs.
4. The edges' connected components are the classes.

A result row is a document with the least document id of its class and its number of links:
the other documents with a similarity of 0.8 or more, copies included.

Defined results: null text is an empty text; a text without words has no shingles, links
to nothing and is a class of its own; one to four words are one shingle of all words; texts
of any length count whole; rows that repeat an id are documents of their own; a class
of documents without ids has a null class id; an empty table gives an empty result; other
columns are ignored, under whatever names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, only, read_table, sliced, texts_of, written
from tallyforge.llm.graph import connected, roots
from tallyforge.llm.quality import _MULT, _SPACE, inverse_powers, mix64, prefix_hashes

SHINGLE, THRESHOLD = 5, (4, 5)
ROWS, BANDS = 4, 32
HASHES, STEP = ROWS * BANDS, 16
TOLERANCE = 1e-6
#: A block holds about so many members and so many bytes of text; one longer text is a block of its own.
BLOCK, BLOCK_BYTES = 512, 16 << 20

_rng = np.random.Generator(np.random.PCG64(77))
_A = (_rng.integers(1, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND_SALT = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingles(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    sums = prefix_hashes(buf)
    edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True))
    a, b = edge[::2], edge[1::2]
    word = mix64((sums[b] - sums[a]) * inverse_powers(a) ^ (b - a).astype(np.uint64) * _MULT)
    first = np.searchsorted(a, starts)
    last = np.append(first[1:], len(a))
    gram = word
    for k in range(1, n):
        gram = gram[: max(0, len(word) - k)] * _MULT + word[k:]
    gram = mix64(gram)
    out = []
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        if j - i >= n:
            out.append(np.unique(gram[i : j - n + 1]))
        elif j > i:
            h = np.array([j - i], np.uint64)
            for k in range(i, j):
                h = h * _MULT + word[k : k + 1]
            out.append(mix64(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES values for each set; all ones for an empty one."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    for k, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 4096):
            v = x[None, at : at + 4096] * _A[:, None]
            v += _B[:, None]
            v ^= v >> np.uint32(15)
            np.minimum(out[k], v.min(axis=1), out=out[k])
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each signature and band."""
    v = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(_BAND_SALT, v.shape[:2]).copy()
    for k in range(ROWS):
        h = mix64(h * _MULT + v[:, :, k])
    return h.view(np.int64)


@cache
def least_matches(n: int, threshold=THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of n matches with which P(similarity >= threshold) is not below the tolerance.

    With a uniform prior the posterior is a beta distribution, whose tail is
    P(Binomial(n + 1, threshold) <= matches).
    """
    t = threshold[0] / threshold[1]
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that pruning keeps; with same, those of a's rows i < j."""
    hits = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        hits += a[:, k, None] == b[None, :, k]
    keep = hits >= least_matches(STEP)
    if same:
        keep &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(keep)
    m = hits[i, j].astype(np.int32)
    for at in range(STEP, HASHES, STEP):
        if not len(i):
            break
        need = least_matches(at + STEP)
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            m[s] += (a[i[s], at : at + STEP] == b[j[s], at : at + STEP]).sum(axis=1, dtype=np.int32)
        keep = m >= need
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def overlaps(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of x[i] and y[j]."""
    if len(i) < 256:
        return np.array([len(np.intersect1d(x[p], y[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    rows_x, rows_y = np.unique(i), np.unique(j)
    flat_x, flat_y = (np.concatenate([z[k] for k in rows]) for z, rows in ((x, rows_x), (y, rows_y)))
    common = np.intersect1d(flat_x, flat_y)
    total = np.zeros((len(rows_x), len(rows_y)), np.float32)

    def placed(z, rows, flat):
        at = np.searchsorted(common, flat)
        at[at == len(common)] = 0
        fit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        own = np.repeat(np.arange(len(rows)), [len(z[k]) for k in rows])
        order = np.argsort(at[fit], kind="stable")
        return own[fit][order], at[fit][order]

    (rx, cx), (ry, cy) = placed(x, rows_x, flat_x), placed(y, rows_y, flat_y)
    for lo in range(0, len(common), 4096):
        hi = min(lo + 4096, len(common))
        mx, my = np.zeros((len(rows_x), hi - lo), np.float32), np.zeros((len(rows_y), hi - lo), np.float32)
        s, e = np.searchsorted(cx, [lo, hi])
        mx[rx[s:e], cx[s:e] - lo] = 1
        s, e = np.searchsorted(cy, [lo, hi])
        my[ry[s:e], cy[s:e] - lo] = 1
        total += mx @ my.T
    return total[np.searchsorted(rows_x, i), np.searchsorted(rows_y, j)].astype(np.int64)


def linked(x: list[np.ndarray], y: list[np.ndarray], sx: np.ndarray, sy: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with a similarity of the threshold or more."""
    i, j = surviving(sx, sy, same)
    both = overlaps(x, y, i, j)
    union = np.array([len(x[p]) for p in i], np.int64) + np.array([len(y[q]) for q in j], np.int64) - both
    fit = both * THRESHOLD[1] >= union * THRESHOLD[0]
    return i[fit], j[fit]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, sig, size) of (doc_id, th, text), written. fp is null for a text without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps, sigs, sizes = [], [], []
            for piece in sliced(batch, 1 << 20):
                texts = texts_of(piece)
                sets = shingles(texts)
                sizes += map(len, texts)
                fps += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs += [r.tobytes() for r in minhash(sets)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "th", "fp", "sig", "size"])

        return f

    return written(map_batches(docs.select("doc_id", "th", "text"), make, f"doc_id {kind}, th long, fp binary, sig binary, size long"), "signatures")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group of rows is two blocks of a family (or one with itself)."""
    for t in _grouped(batches, ["family", "i", "j"]):
        seen: dict[int, int] = {}
        for k, rid in enumerate(t.column("rid").to_pylist()):
            seen.setdefault(rid, k)
        t = t.take(list(seen.values()))
        rid, copies, block = (np.asarray(t.column(c)) for c in ("rid", "copies", "block"))
        sets = shingles(["" if x is None else x for x in t.column("text").to_pylist()])
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        p, q = linked([sets[k] for k in left], [sets[k] for k in right], sig[left], sig[right], i == j)
        p, q = left[p], right[q]
        links = np.bincount(p, weights=copies[q], minlength=len(rid)) + np.bincount(q, weights=copies[p], minlength=len(rid))
        some = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(links[some].astype(np.int64)), pa.array(rid[roots(len(rid), p, q)][some])], ["rid", "links", "other"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, class_id, n_links, kept): kept is true for one row of each class, of least id.

    th is the text's xxhash64, which with the id tells apart rows that repeat an id.
    """
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("th", F.xxhash64("text"))
    signed = signatures(rows)
    one = signed.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.max("size").alias("size"))
    reps = written(one.select("fp", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"), "copies", "sig", "size").withColumn("rid", F.monotonically_increasing_id()), "representatives")

    def bands():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            return pa.RecordBatch.from_arrays([pa.array(band_keys(sig).ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], ["key", "rid"])

        return f

    banded = map_batches(reps.select("rid", "sig"), bands, "key long, rid long")
    # written first: a join straight from tables is one whose hot keys Spark can split
    least = written(banded.groupBy("key").agg(F.min("rid").alias("b"), F.count("*").alias("m")).where(F.col("m") > 1).select("key", "b"), "buckets")
    families = connected(banded.join(least, "key").select(F.col("rid").alias("a"), "b"))
    families = written(reps.join(families.select(F.col("id").alias("rid"), F.col("root").alias("family")), "rid"), "families")
    sizes = families.groupBy("family").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).where(F.col("m") > 1)
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.least(F.col("m"), F.col("bytes") / BLOCK_BYTES))).cast("int")
    members = families.join(sizes, "family").select("rid", "family", "rep", "th", "copies", "sig", blocks.alias("n")).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
    texts = rows.select(F.col("doc_id").alias("t_id"), F.col("th").alias("t_th"), "text")
    found = members.join(texts, (members["th"] == texts["t_th"]) & members["rep"].eqNullSafe(texts["t_id"])).drop("t_id", "t_th")
    meet = found.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("family", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rid", "copies", "sig", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = written(meet.repartition(tasks, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_compare, "rid long, links long, other long"), "links")

    links = compared.groupBy("rid").agg(F.sum("links").alias("links"))
    root = connected(compared.select(F.col("rid").alias("a"), F.col("other").alias("b")))
    placed = reps.join(root, reps["rid"] == root["id"], "left").join(links, "rid", "left").select("fp", "rep", "th", "copies", F.coalesce("root", "rid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least_id = placed.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "th")).alias("c"))
    by_fp = placed.join(least_id, "root").select("fp", F.col("c.rep").alias("class_id"), F.col("c.th").alias("class_th"), "n_links")
    # rows without words are classes of their own, and so are spread out by their ids
    alone = signed.where(F.col("fp").isNull()).select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    known = signed.where(F.col("fp").isNotNull()).select("doc_id", "th", "fp").join(by_fp, "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))
    return known.select("doc_id", "th", "class_id", "n_links", kept.alias("kept")).unionByName(alone)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM documents d
"""
