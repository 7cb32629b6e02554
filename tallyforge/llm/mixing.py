"""Mixing sources to target weights, with DataFrame functions only.

Word counts are summed per source, a target per source is derived by filling up to a cap,
and each document is taken floor(rate) times plus once more with the probability of the
fraction, decided by a hash of its id. Only one row per source ever leaves the aggregation.

Defined results: null text counts 0 words; a null source is a source of its own, last in
order; a row without an id draws by its text; rows that repeat an id (or, without one, a text)
share its draw; an empty table gives an empty result; a source without words has target 0 and is taken 0
times. Other columns of the input are carried or ignored, under whatever names.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD_PATTERN, checked_broadcast, only, read_table, written

#: Up to so many sources the rates are broadcast (a row has a name and five numbers).
MOST_BROADCAST_SOURCES = 20_000
_BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share=(3, 2), cap: int = 2) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    sizes: (source, size). Sources in code point order, null last, weigh weights, repeated.
    share (as a fraction) of all words is dealt by weight; a target stops at cap times its
    source's size and the excess goes to the rest by weight. That is a water level: sorted by
    size over weight, the capped sources are a prefix, found with running sums.
    """
    num, den = share
    unit = lcm(*weights)
    big = "decimal(38,0)"
    by_source = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % n + 1).cast("int"))
    weighed = by_source.select("source", "source_size", pick.cast("long").alias("w"))
    order = Window.orderBy((F.col("source_size").cast(big) * (F.lit(unit) / F.col("w")).cast(big)), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0).cast(big)
    with_sums = weighed.select(
        "*",
        F.coalesce(F.sum("source_size").over(before).cast(big), zero).alias("c_before"),
        F.coalesce(F.sum("w").over(before).cast(big), zero).alias("w_before"),
        F.sum("source_size").over(every).cast(big).alias("all_size"),
        F.sum("w").over(every).cast(big).alias("all_w"),
    )
    # cap * size_i <= level_i * w_i, with level_i = (num/den * S - cap * C) / (W - W_before)
    full = (F.col("source_size") * F.lit(cap * den)).cast(big) * (F.col("all_w") - F.col("w_before")) <= F.col("w").cast(big) * (F.lit(num) * F.col("all_size") - F.lit(cap * den) * F.col("c_before")).cast(big)
    flagged = with_sums.select("*", full.alias("full"))
    c_full = F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(every), F.lit(0)).cast(big)
    w_full = F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0)).cast(big)
    left = (F.col("w").cast(big) * (F.lit(num) * F.col("all_size") - F.lit(cap * den) * c_full).cast(big)).cast("double")
    target = F.when(F.col("full"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(left / (F.lit(den) * F.greatest(F.col("all_w") - w_full, F.lit(1).cast(big))).cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return flagged.select("source", "source_size", target.alias("target")).select("*", rate.alias("rate"))


def copies_of(doc_id: Column, text: Column, rate: Column, seed: str = "mix") -> Column:
    """floor(rate), and one more if the hash of the id, or of the text of a row without one, falls below the fraction."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))))
    draw = F.conv(F.substring(F.md5(name), 1, _BITS // 4), 16, 10).cast("long")
    whole = F.floor(rate).cast("long")
    more = draw.cast("double") < (rate - whole.cast("double")) * F.lit(float(1 << _BITS))
    return whole + F.when(more, F.lit(1)).otherwise(F.lit(0))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=(3, 2), cap: int = 2, seed: str = "mix") -> DataFrame:
    """docs with __size, __source_size, __target and __copies; no row is dropped or added here."""
    sizes = docs.select(docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    rates = written(source_targets(sizes, weights, share, cap), "rates").select(F.col("source").alias("__src"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    joined = docs.join(checked_broadcast(rates, MOST_BROADCAST_SOURCES), docs[source_col].eqNullSafe(rates["__src"]))
    return joined.withColumns({"__size": word_count(docs[text_col]), "__copies": copies_of(docs[id_col], docs[text_col], F.col("__rate"), seed)}).drop("__src", "__rate")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    return mix(docs, **how).withColumn("__k", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*[docs[c] for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source")
    m = mix(docs)
    return m.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w FROM s
), r AS (
  SELECT *,
    coalesce(sum(source_size) OVER o, 0)::HUGEINT AS c_before, coalesce(sum(w) OVER o, 0)::HUGEINT AS w_before,
    sum(source_size) OVER ()::HUGEINT AS all_size, sum(w) OVER ()::HUGEINT AS all_w
  FROM w
  WINDOW o AS (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, 4 * source_size * (all_w - w_before) <= w * (3 * all_size - 4 * c_before) AS is_full FROM r
), g AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN source_size END) OVER (), 0)::HUGEINT AS c_full,
    coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0)::HUGEINT AS w_full FROM f
), t AS (
  SELECT source, source_size::BIGINT AS source_size,
    CASE WHEN is_full THEN (2 * source_size)::DOUBLE
         ELSE (w * (3 * all_size - 4 * c_full))::DOUBLE / (2 * greatest(all_w - w_full, 1))::DOUBLE END AS target FROM g
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || d.name), 1, 13))::BIGINT AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN draw::DOUBLE < (rate - floor(rate)) * 4503599627370496.0::DOUBLE THEN 1 ELSE 0 END) AS taken
FROM x
"""
