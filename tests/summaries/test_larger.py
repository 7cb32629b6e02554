"""Registered queries on tables unlike the test data: values that repeat, more keys than one sketch holds."""

import duckdb
import numpy as np
import pytest

from tallyforge.operators import membership
from tallyforge.operators.bottom import least_hashes
from tallyforge.plans import QUERIES, SQL


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(cols).collect())))
    assert got == sorted(map(repr, con.execute(f"""SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({SQL[name]})""").fetchall()))


def test_a_median_among_equal_values(spark, tmp_path):
    values = "[1.0, 2.0, 3.0]::DOUBLE[]"  # 100 of each: a third is below the median and two thirds are up to it
    duckdb.execute(f"COPY (SELECT (i % 2)::BIGINT AS user_id, unnest({values}) AS value FROM range(200) r(i)) TO '{tmp_path}/events.parquet'")
    same_as_sql(spark, tmp_path, "stream_running_digest", ["events"])


def test_a_filter_reaches_the_driver_as_its_bytes(spark, monkeypatch):
    n, sent = 50_000, []
    kind = type(spark.range(1))
    whole = kind.toArrow

    def counted(df):
        got = whole(df)
        sent.append(got.nbytes)
        return got

    set_bits = membership.build(spark.range(n), "id", n)
    bits, _ = membership.capacity(n, 0.01)
    want = np.zeros(bits, bool)
    want[[r.bit for r in set_bits.collect()]] = True
    monkeypatch.setattr(kind, "toArrow", counted)
    got = membership.packed(set_bits, bits)
    assert np.array_equal(np.unpackbits(got, count=bits, bitorder="little").astype(bool), want)
    assert sum(sent) <= 2 * bits / 8


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Tables of more keys than a sketch of 2 ** 20 holds."""
    folder = tmp_path_factory.mktemp("many")
    put = lambda name, sql: duckdb.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
    put("orders", """SELECT i AS o_orderkey, i % 2199999 AS o_custkey, CASE WHEN i % 20 = 0 THEN '2-HIGH' ELSE '1-URGENT' END AS o_orderpriority, CASE WHEN i % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus,
        (i % 1000)::DOUBLE AS o_totalprice FROM range(2300000) r(i)""")
    put("lineitem", """SELECT i AS l_orderkey, i % 1500000 AS l_partkey, (i // 1500000)::INT AS l_linenumber, (i % 50)::DOUBLE AS l_quantity, (i % 1000)::DOUBLE AS l_extendedprice,
        CASE WHEN i % 2 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(4600000) r(i)""")
    return folder


@pytest.mark.parametrize("name", ["theta_a_not_b", "theta_intersection", "theta_sampling_p", "tuple_array_sum", "theta_distinct_by_priority", "theta_union_agg_rollup", "theta_jaccard", "tuple_array_intersection", "tuple_spend_per_customer", "tuple_intersection_policy"])
def test_more_keys_than_one_sketch_holds(spark, many, name):
    same_as_sql(spark, many, name, ["orders", "lineitem"])


def test_hashes_of_tasks_that_cut_nothing_are_distinct(spark):
    n = 2_400_000
    twice = spark.range(n).union(spark.range(n)).toDF("hash")
    assert least_hashes(twice, [], 1 << 22).count() == n
