"""Exact top-k inner products with block-at-a-time pruning.

Vectors become whole numbers, floor(scale * x). Runs of vectors in id order form blocks; a block
keeps the least and greatest value of every dimension and a forward index, the matrix of its
vectors. A query's bound for a block is the sum over the dimensions of the most that the
dimension can add. A task holds the blocks of one shard and, for a block of queries at a
time, takes them in order of falling bound; a query stops as soon as the next bound lies
below the k-th score it has (equal scores still count, since the smaller id wins a tie). One
shard is searched first, and its k-th scores are floors in every other. The k best of each shard then meet per query.

Query blocks go to every shard (a stated query set against all rows, in blocks); a shard's
answers are at most k rows a query.

Defined results: null vectors and those with a null or non-finite component take no part;
vectors of different length are not comparable, each length is searched by itself (the
empty vector scores 0); rows that repeat an id are each a candidate, other than to queries of that
id; scores beyond a long are held at its limits; fewer candidates than k give fewer rows;
an empty table gives an empty result; other columns are ignored, under whatever names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import only, read_table, written

BLOCK, SHARD, QUERIES = 128, 4096, 2048
_SALTS = 16
_MOST = (1 << 63) - 1


def best(q: np.ndarray, q_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, known: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(query row, id, score) of each query's k best, and how many vectors were scored.

    blocks: (ids, matrix) pairs. known: for each query a score that k vectors somewhere reach. Sums must be exact in doubles, or the arrays hold Python ints.
    """
    high = np.stack([m.max(axis=0) for _, m in blocks])
    low = np.stack([m.min(axis=0) for _, m in blocks])
    zero = q.dtype.type(0) if q.dtype != object else 0
    bounds = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    floor = np.full(len(q), -np.inf) if q.dtype != object else np.array([-(10**400)] * len(q), object)
    if known is not None:
        floor = np.maximum(floor, known.astype(floor.dtype))
    found: list[tuple[list, list]] = [([], []) for _ in q]
    active, scored = np.arange(len(q)), 0
    for step in range(len(blocks)):
        at = order[active, step]
        keep = bounds[active, at] >= floor[active]
        active, at = active[keep], at[keep]
        if not len(active):
            break
        for b in np.unique(at):
            rows = active[at == b]
            ids, m = blocks[b]
            scores = q[rows] @ m.T
            scored += scores.size
            for r, s in zip(rows, scores, strict=True):
                fit = np.flatnonzero((s >= floor[r]) & (ids != q_ids[r]))
                if not len(fit):
                    continue
                i, v = np.concatenate([np.asarray(found[r][0], np.int64), ids[fit]]), np.concatenate([np.asarray(found[r][1], s.dtype), s[fit]])
                top = np.lexsort((i, -v))[:k] if v.dtype != object else np.array(sorted(range(len(i)), key=lambda x: (-v[x], i[x]))[:k])
                found[r] = (i[top], v[top])
                if len(top) == k:
                    floor[r] = max(floor[r], v[top][-1])
    return [(r, int(i), max(-_MOST - 1, min(_MOST, int(v)))) for r, (ids, vs) in enumerate(found) for i, v in zip(ids, vs, strict=True)], scored


def _matrices(d: int, q_ids: bytes, q_data: bytes, ids: bytes, data: bytes, scale: int) -> tuple[np.ndarray, ...]:
    """(query ids, queries, ids, vectors) in whole numbers: as doubles where sums are exact, else as Python's."""
    q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
    q = np.floor(np.frombuffer(q_data, "<f8").reshape(len(q_ids), d) * scale)
    m = np.floor(np.frombuffer(data, "<f8").reshape(len(ids), d) * scale)
    if float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(d, 1) >= 2.0**53:
        q, m = (np.array([[int(x) for x in r] for r in y], object).reshape(len(y), d) for y in (q, m))
    return q_ids, q, ids, m


def _blocks(ids: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(ids[a : a + BLOCK], m[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score). is_query is a condition over __id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"))
    limit = float(np.finfo(np.float64).max)
    fit = rows.where(F.col("__id").isNotNull() & F.col("__v").isNotNull()).where(F.forall("__v", lambda x: F.coalesce(x.between(-limit, limit), F.lit(False)) & F.coalesce((x * scale).between(-limit, limit), F.lit(False))))
    fit = written(fit.withColumn("__d", F.size("__v")), "vectors")

    def dealt(rows: DataFrame, size: int) -> DataFrame:
        """Ranges of ids in so many partitions that each has about size rows."""
        return rows.repartitionByRange(max(1, -(-rows.count() // size)), "__d", "__id").sortWithinPartitions("__d", "__id")

    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = np.asarray(batch.column(2))
                edges = [0, *(np.flatnonzero(np.diff(d)) + 1), len(d)]
                for a, b in zip(edges, edges[1:], strict=False):
                    for at in range(a, b, size):
                        part = batch.slice(at, min(size, b - at))
                        flat = np.asarray(part.column(1).flatten(), "<f8").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([int(d[a])], pa.int32()), pa.array([np.asarray(part.column(0), "<i8").tobytes()], pa.binary()), pa.array([flat], pa.binary())], ["d", "ids", "data"])

        return run

    packed = "d int, ids binary, data binary"
    documents = written(dealt(fit, SHARD).mapInArrow(pack(SHARD), packed).withColumn("shard", F.monotonically_increasing_id()), "shards")
    queries = written(dealt(fit.where(is_query), QUERIES).mapInArrow(pack(QUERIES), packed), "queries")
    # one shard of each length first: the k-th score there is a floor in all others
    first = documents.groupBy("d").agg(F.min("shard").alias("shard"))
    one = documents.join(first, ["d", "shard"]).select("d", "ids", "data")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                q_ids, q, ids, m = _matrices(*(batch.column(c)[j].as_py() for c in range(5)), scale)
                known = np.full(len(q_ids), -np.inf)
                if q.dtype != object:
                    tops: dict[int, list[int]] = {}
                    for r, _, v in best(q, q_ids, _blocks(ids, m), k)[0]:
                        tops.setdefault(r, []).append(v)
                    for r, v in tops.items():
                        known[r] = v[-1] if len(v) == k else -np.inf
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(j, 1), batch.column(1).slice(j, 1), batch.column(2).slice(j, 1), pa.array([known.tobytes()], pa.binary())], ["d", "ids", "data", "known"])

    asking = queries.select("d", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).join(one, "d").select("d", "q_ids", "q_data", "ids", "data")
    queries = written(asking.mapInArrow(floors, "d int, ids binary, data binary, known binary"), "floors")
    # every query block to every shard of its length; salted, since all vectors may have one length
    places = documents.select("d", "shard", (F.xxhash64("shard") % _SALTS).alias("salt"))
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(1 - _SALTS, _SALTS)])).alias("salt")
    asked = queries.select("d", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "known", salts)
    pairs = places.join(asked, ["d", "salt"]).join(documents.drop("d"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                q_ids, q, ids, m = _matrices(*(batch.column(c)[j].as_py() for c in range(5)), scale)
                known = None if q.dtype == object else np.frombuffer(batch.column(5)[j].as_py(), np.float64)
                out, _ = best(q, q_ids, _blocks(ids, m), k, known)
                rows_, i, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[list(rows_)] if rows_ else [], pa.int64()), pa.array(list(rows_), pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array([q_ids.tobytes()] * len(out), pa.binary())], ["query_id", "q_row", "vec_id", "score", "q_block"])

    scored = pairs.select("d", "q_ids", "q_data", "ids", "data", "known").mapInArrow(run, "query_id long, q_row int, vec_id long, score long, q_block binary")
    # rows that repeat a query's id are queries of their own with the same answer
    w = Window.partitionBy("query_id", "q_row", "q_block").orderBy(F.col("score").desc(), "vec_id")
    ranked = scored.withColumn("q_block", F.xxhash64("q_block")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = only(read_table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding")
    return search(vectors, F.col("__id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
