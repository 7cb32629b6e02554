"""Quantiles and ranks.

Numbers go through Spark's own KLL aggregates. Items of any order (strings), relative-error
quantiles and t-digests are built in each task over Arrow batches, shipped as bytes, and merged per
group in rounds of a bounded number of summaries, so no task holds more than a few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.kernels.quantile import Kll, Req, TDigest

KINDS = {"kll": Kll, "req": Req, "tdigest": TDigest}
#: Summaries that one merge takes, and rounds of merges.
FAN_IN, ROUNDS = 64, 3
#: Groups whose summaries a task holds at a time.
MOST_GROUPS = 4096


def kll(col: Column | str, k: int = 200, kind: str = "double") -> Column:
    """Spark's aggregate for bigint, float or double."""
    return getattr(F, f"kll_sketch_agg_{kind}")(col, F.lit(k))


def kll_quantiles(sketch: Column | str, ranks: list[float], kind: str = "double") -> Column:
    return getattr(F, f"kll_sketch_get_quantile_{kind}")(sketch, F.array(*[F.lit(r) for r in ranks]))


def kll_cdf(sketch: Column | str, splits: list[float], kind: str = "double") -> Column:
    """Ranks at the splits, and 1."""
    ranks = getattr(F, f"kll_sketch_get_rank_{kind}")(sketch, F.array(*[F.lit(s) for s in splits]))
    return F.concat(ranks, F.array(F.lit(1.0)))


def kll_pmf(sketch: Column | str, splits: list[float], kind: str = "double") -> Column:
    cdf = kll_cdf(sketch, splits, kind)
    return F.transform(cdf, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(cdf, i)))


def kll_boundaries(sketch: Column | str, parts: int, kind: str = "double") -> Column:
    """The ends of so many parts of equal weight."""
    return kll_quantiles(sketch, [i / parts for i in range(parts + 1)], kind)


def summarise(df: DataFrame, col: str, keys: list[str] | None = None, what: str = "kll", **how) -> DataFrame:
    """(keys, sketch) of a column; nulls and NaN are ignored."""
    keys = keys or []
    make = KINDS[what]
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("sketch", T.BinaryType())])
    values = df.select(*keys, F.col(col).alias("__v")).where(F.col("__v").isNotNull())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def done(names: list[pa.Field]) -> pa.RecordBatch:
            arrays = [pa.array([g[i] for g in held], f.type) for i, f in enumerate(names)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([s.to_bytes() for s in held.values()], pa.binary())], [*keys, "sketch"])

        for batch in batches:
            values = batch.column(batch.schema.get_field_index("__v"))
            plain = values.to_pylist() if what == "kll" else values.to_numpy(zero_copy_only=False)
            group = np.zeros(batch.num_rows, np.int64)
            for c in keys:
                own = batch.column(batch.schema.get_field_index(c)).dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.unique(group * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(group[order])) + 1).tolist(), len(order)] if len(order) else []
            fields = [batch.schema.field(c) for c in keys]
            for a, b in zip(edges, edges[1:], strict=False):
                rows = order[a:b]
                key = tuple(batch.column(batch.schema.get_field_index(c))[int(rows[0])].as_py() for c in keys)
                held.setdefault(key, make(**how)).extend([plain[i] for i in rows.tolist()] if what == "kll" else plain[rows])
            if len(held) > MOST_GROUPS:
                yield done(fields)
                held.clear()
        if held:
            yield done(fields)

    return merge(values.mapInArrow(partial, schema), keys, what)


def merge(sketches: DataFrame, keys: list[str] | None = None, what: str = "kll") -> DataFrame:
    """One sketch per group of (keys, sketch) rows, in ROUNDS rounds.

    In a round a group's summaries are dealt out among FAN_IN times fewer merges than in the round
    before, the last of which is one. So none takes more than about FAN_IN, up to FAN_IN ** ROUNDS tasks.
    """
    keys = keys or []
    make = KINDS[what]
    schema = sketches.schema

    def all_of(t: pa.Table) -> pa.Table:
        out = make.from_bytes(t.column("sketch")[0].as_py())
        for other in t.column("sketch")[1:]:
            out.merge(make.from_bytes(other.as_py()))
        first = t.select(keys).slice(0, 1).combine_chunks()
        return pa.Table.from_arrays([*first.columns, pa.array([out.to_bytes()], pa.binary())], names=[*keys, "sketch"])

    for left in range(ROUNDS - 1, 0, -1):
        salted = sketches.withColumn("__salt", F.pmod(F.xxhash64("sketch"), F.lit(FAN_IN**left)).cast("int"))
        sketches = salted.groupBy(*keys, "__salt").applyInArrow(all_of, schema)
    return sketches.groupBy(*keys).applyInArrow(all_of, schema)


def quantile(sketch: Column | str, ranks: list[float], what: str = "kll", returns: str = "double", inclusive: bool = True) -> Column:
    make, extra = KINDS[what], {} if what == "tdigest" else {"inclusive": inclusive}

    @F.pandas_udf(f"array<{returns}>")
    def of(s: pd.Series) -> pd.Series:
        out = []
        for data in s:
            q = make.from_bytes(data)
            out.append([q.quantile(r, **extra) for r in ranks])
        return pd.Series(out)

    return of(sketch)


def rank(sketch: Column | str, items: list, what: str = "kll", inclusive: bool = True) -> Column:
    make, extra = KINDS[what], {} if what == "tdigest" else {"inclusive": inclusive}

    @F.pandas_udf("array<double>")
    def of(s: pd.Series) -> pd.Series:
        out = []
        for data in s:
            q = make.from_bytes(data)
            out.append([q.rank(x, **extra) for x in items])
        return pd.Series(out)

    return of(sketch)


def distribution(sketch: Column | str, splits: list, what: str = "kll", cumulative: bool = True) -> Column:
    make = KINDS[what]

    @F.pandas_udf("array<double>")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([(lambda q: q.cdf(splits) if cumulative else q.pmf(splits))(make.from_bytes(x)) for x in s])

    return of(sketch)


def rank_bounds(rank: Column | str, n: Column | str, k: int = 12, kappa: int = 2, high: bool = True) -> Column:
    """struct<low, high>: where the true rank of a relative-error summary's rank lies."""
    from tallyforge.kernels.intervals import req_rank_bounds

    @F.pandas_udf("struct<low: double, high: double>")
    def of(r: pd.Series, seen: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([req_rank_bounds(float(a), k, int(b), kappa, high) for a, b in zip(r, seen, strict=True)], columns=["low", "high"])

    return of(rank, n)
