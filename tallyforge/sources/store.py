"""Reading tables and keeping sketches as Parquet, with what is needed to merge them later."""

from __future__ import annotations

import atexit
import json
import re
import struct
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["load_sketches", "save_sketches", "scratch", "table", "theta_image"]

_own: list[tempfile.TemporaryDirectory] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a folder of our own only in local sessions that set none."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="tallyforge-"))
            atexit.register(_own[0].cleanup)
        top = f"file://{_own[0].name}"
    return f"{top.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}"


def save_sketches(df: DataFrame, path: str, family: str, **parameters) -> None:
    """df of keys and BINARY sketches, marked with family and parameters."""
    df.withColumns({"sketch_family": F.lit(family), "sketch_parameters": F.lit(json.dumps(parameters, sort_keys=True))}).write.mode("overwrite").parquet(path)


def load_sketches(spark: SparkSession, path: str, family: str, **parameters) -> DataFrame:
    """The sketches of a path; other families or parameters than asked for are an error."""
    df = spark.read.parquet(path)
    want = json.dumps(parameters, sort_keys=True)
    odd = df.where((F.col("sketch_family") != family) | (F.col("sketch_parameters") != want)).select("sketch_family", "sketch_parameters").first()
    if odd:
        raise ValueError(f"these are {odd[0]} sketches with {odd[1]}")
    return df.drop("sketch_family", "sketch_parameters")


def theta_image(data: bytes) -> tuple[int, np.ndarray]:
    """(theta, hashes) of a compact theta image, plain (version 3) or packed (version 4)."""
    longs, version, family, flags = data[0], data[1], data[2], data[5]
    if family != 3 or version not in (3, 4):
        raise ValueError("not a compact theta image")
    top = (1 << 63) - 1
    if version == 3:
        if flags & 4:
            return (struct.unpack_from("<q", data, 16)[0] if longs > 2 else top), np.zeros(0, np.int64)
        if longs == 1:
            return top, np.frombuffer(data, "<i8", 1, 8)
        n = struct.unpack_from("<i", data, 8)[0]
        theta = struct.unpack_from("<q", data, 16)[0] if longs > 2 else top
        return theta, np.frombuffer(data, "<i8", n, 8 * longs)
    bits, size = data[3], data[4]
    at = 8
    theta = top
    if longs > 1:
        theta, at = struct.unpack_from("<q", data, 8)[0], 16
    n = int.from_bytes(data[at : at + size], "little")
    at += size
    raw = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 64), np.uint8)
    wide[:, 64 - bits :] = raw
    return theta, np.cumsum(np.packbits(wide, axis=1).view(">u8").ravel().astype(np.int64))
