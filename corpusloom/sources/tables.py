"""Readers and writers: tables, lines, bytes, float16 rows, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt anew to a few tasks a core: a file of many texts may be one scan task."""
    sc = df.sparkSession.sparkContext
    return df.repartition(max(4 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def read_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """A text file as (line) rows; give an ordinal column of your own where order matters."""
    return spark.read.option("lineSep", separator).text(path).withColumnRenamed("value", "line")


def read_half_rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Raw float16 rows of ``width`` values: (path, pos, p array<float>). A file that isn't a whole number of rows fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(raw) % (2 * width):
                    raise ValueError(f"{name}: {len(raw)} bytes aren't rows of {width} half floats")
                p = np.frombuffer(raw, "<f2").astype(np.float32).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(p)), pa.array(np.arange(len(p))), pa.array(list(p), pa.list_(pa.float32()))], names=["path", "pos", "p"])

    files = ship(spark).read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, pos bigint, p array<float>")


def to_half(column: str) -> Column:
    """An array of floats as little-endian float16 bytes, rounded to even."""
    @F.pandas_udf("binary")
    def half(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, np.float32).astype("<f2").tobytes())

    return half(F.col(column))


def header(length: Column, dict_used: Column, vocab: Column) -> Column:
    """The container header as a struct; the vocabulary is kept from 10,000 symbols on."""
    return F.struct(length.cast("bigint").alias("length"), dict_used.alias("dict_used"), F.when(length >= 10000, vocab).alias("vocab"))


def concat_tables(*frames: DataFrame) -> DataFrame:
    """Concatenation in order: rows carry the ordinal of their table."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("part", F.lit(k))
        out = f if out is None else out.unionByName(f)
    return out
