"""Windowed sketches under Structured Streaming: Spark's aggregates keep the sketches as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.store import scratch

__all__ = ["deduplicated", "drained", "running", "sessions", "stream_table", "windowed"]


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def windowed(events: DataFrame, time: str, width: str, sketches: dict[str, Column], keys: list[str] | None = None, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """A row per window and keys with the sketches; rows later than the watermark are dropped once their window is closed."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(F.window(time, width, slide), *(keys or [])).agg(*[c.alias(n) for n, c in sketches.items()])


def sessions(events: DataFrame, time: str, gap: str, sketches: dict[str, Column], keys: list[str], late: str = "1 day") -> DataFrame:
    """A row per session of each key, which ends after a gap without events, with the sketches."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(F.session_window(time, gap), *keys).agg(*[c.alias(n) for n, c in sketches.items()])


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder; its state is checkpointed there, too."""
    spark = stream.sparkSession
    path = scratch(spark, "drained")

    def keep(rows: DataFrame, batch: int) -> None:
        # a batch that is run again replaces what it wrote; complete output replaces all before
        rows.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = f"{path}/rows"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(whole if mode == "complete" else f"{whole}/batch=none")
    return spark.read.schema(stream.schema).parquet(whole).select(stream.columns)


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; the state holds keys only as long as late rows may come."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.dropDuplicatesWithinWatermark(keys)


def running(events: DataFrame, value: str, keys: list[str], what: str = "tdigest", **how) -> DataFrame:
    """(keys, n, sketch) of all rows so far, for keys with new rows: a summary kept as state, for what Spark has no aggregate."""
    from tallyforge.operators.quantiles import KINDS

    make = KINDS[what]
    fields = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    def update(key, frames, state):
        s = make.from_bytes(bytes(state.get[0])) if state.exists else make(**how)
        for frame in frames:
            s.extend(frame[value].dropna().tolist())
        data = s.to_bytes()
        state.update((data,))
        yield pd.DataFrame([[*key, s.n, data]], columns=[*keys, "n", "sketch"])

    return events.select(*keys, value).groupBy(*keys).applyInPandasWithState(update, f"{fields}, n long, sketch binary", "sketch binary", "update", "NoTimeout")
