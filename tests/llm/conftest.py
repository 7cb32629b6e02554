import pytest

from pyspark.sql import types as T

#: An id more than once, nulls everywhere, empty and long texts, ties, and clashing extra columns.
WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50) + ("\n" if k % 17 == 16 else ""))
    return " ".join(out)


TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two three",
    prose(1, 120),
    prose(1, 120),
    prose(1, 119) + " end",
    prose(2, 60) + "\n" + prose(2, 60),
    "same line here\n" * 40,
    prose(3, 6000),
    "Ünïcödé ßtraße “quoted” 日本語 " + prose(4, 80),
    "*** ### $$$ %%% " * 30,
    "a" * 3000,
    "<|endoftext|> x\u00a0y\x1cz",
    "a \u00a0 b \u200a c",
]


@pytest.fixture(scope="session")
def rows():
    out = [(k, t, "b" if k % 3 else "a", k, "clash", "x") for k, t in enumerate(TEXTS)]
    out += [(5, prose(1, 120), "a", 1, "clash", "x"), (5, prose(9, 70), None, 1, None, None), (None, prose(1, 120), None, None, None, None), (None, None, "\U0001f600", None, None, None)]
    return out


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("th", T.StringType()), T.StructField("word", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory, docs):
    """A folder of small tables with the odd rows in it."""
    d = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory, no_docs):
    d = tmp_path_factory.mktemp("empty")
    no_docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


def key(row):
    return tuple((v is not None, v) if not isinstance(v, (list, dict)) else (True, str(v)) for v in row)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=key)
