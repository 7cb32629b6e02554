"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    A folder of our own stands in only where the session names none and runs in this one process
    (local tests); on a cluster a missing setting is an error, since each machine would write to its own disk.
    """
    global _own_dir
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        kept = tempfile.TemporaryDirectory(prefix="tallyforge-")
        atexit.register(kept.cleanup)
        _own_dir = f"file://{kept.name}"
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back.

    This cuts the lineage: a later stage that loses an executor reads the files again
    instead of recomputing, and what was non-deterministic is fixed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more, and the shuffles of ended jobs.

    Spark removes a shuffle's files when the driver's garbage is collected, which a driver with
    memory to spare puts off until the disks are full.
    """
    context = tables[0].sparkSession.sparkContext
    for t in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    context._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **cols: str) -> DataFrame:
    """Just the named columns, under fixed names, whatever else the table holds."""
    return df.select(*[df[old].alias(new) for new, old in cols.items()])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with one state per task: make() runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in sliced(batch):
                yield f(part)

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of about most_bytes, so that memory follows bytes and not rows."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(col)).to_pylist()]


def checked_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most most_rows rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
