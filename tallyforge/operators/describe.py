"""What a stored sketch holds, as columns and as rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.kernels.intervals import kll_rank_error
from tallyforge.operators.quantiles import KINDS
from tallyforge.sources.store import theta_image

INFO = "struct<family: string, n: long, retained: int, low: string, high: string, estimating: boolean, rank_error: double, text: string>"


def _quantiles(data: bytes, what: str) -> dict:
    q = KINDS[what].from_bytes(data)
    if what == "tdigest":
        n, kept, low, high, error = q.n, len(q.means), q.low, q.high, None
    else:
        view = q.view()
        n, kept, error = q.n, len(view.items), kll_rank_error(q.min_k) if what == "kll" else None
        low, high = (q.low, q.high) if what == "kll" else (q.low_item, q.high_item)
    show = lambda v: None if n == 0 else str(v)
    out = {"family": what, "n": n, "retained": kept, "low": show(low), "high": show(high), "estimating": kept < n, "rank_error": error}
    return out | {"text": json.dumps(out)}


def _theta(data: bytes) -> dict:
    theta, hashes = theta_image(data)
    out = {"family": "theta", "n": None, "retained": len(hashes), "low": None, "high": None, "estimating": theta < (1 << 63) - 1, "rank_error": None}
    return out | {"text": json.dumps(out | {"theta": theta / ((1 << 63) - 1)})}


def describe(sketch: Column | str, what: str) -> Column:
    """INFO of a sketch: kll, req, tdigest (of quantiles.summarise) or theta (Spark's own). Null gives null."""
    f = _theta if what == "theta" else lambda data: _quantiles(data, what)
    names = ["family", "n", "retained", "low", "high", "estimating", "rank_error", "text"]

    @F.pandas_udf(INFO)
    def of(s: pd.Series) -> pd.DataFrame:
        rows = [dict.fromkeys(names) if x is None else f(bytes(x)) for x in s]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"n": "Int64", "retained": "Int32"})

    return of(sketch)


def weighted_items(sketch: Column | str, what: str, returns: str = "double") -> Column:
    """array of (item, upto): a quantile sketch's items in order with their cumulative weight, to be exploded."""

    @F.pandas_udf(f"array<struct<item: {returns}, upto: long>>")
    def of(s: pd.Series) -> pd.Series:
        out = []
        for data in s:
            q = KINDS[what].from_bytes(bytes(data))
            if what == "tdigest":
                pairs = zip(q.means.tolist(), q.weights.cumsum().tolist(), strict=True)
            else:
                v = q.view()
                pairs = zip(v.items, v.upto, strict=True)
            out.append([{"item": a, "upto": b} for a, b in pairs])
        return pd.Series(out)

    return of(sketch)


def theta_hashes(sketch: Column | str) -> Column:
    """array of the hashes that Spark's theta sketch retains."""

    @F.pandas_udf("array<long>")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([theta_image(bytes(x))[1].tolist() for x in s])

    return of(sketch)


def theta_from_rows(hashes: Column, theta: Column) -> Column:
    """Rows of a relational sketch, as (array of hashes, theta), to an image for Spark's theta functions."""
    from tallyforge.sources.images import theta_to_image

    @F.pandas_udf("binary")
    def of(h: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([theta_to_image(int(b), a) for a, b in zip(h, t, strict=True)])

    return of(hashes, theta.cast("long"))


@F.udtf(returnType="item double, upto bigint")
class ItemsTable:
    """A table function over a numeric quantile sketch and its kind: (item, upto), in order.

    For lateral joins; in SQL after spark.udtf.register(name, ItemsTable).
    """

    def eval(self, sketch: bytes, what: str):
        if sketch is None:
            return
        q = KINDS[what].from_bytes(bytes(sketch))
        if what == "tdigest":
            yield from zip(q.means.tolist(), q.weights.cumsum().tolist(), strict=True)
        else:
            v = q.view()
            yield from zip(map(float, v.items), v.upto, strict=True)
