"""Sinks and the ways back: metrics as JSON lines, rows of half floats, tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import shared_dir
from corpusloom.sources.tables import table, to_half


def write_metrics(df: DataFrame, name: str) -> str:
    """JSON lines in the shared folder; returns their path."""
    path = os.path.join(shared_dir(df.sparkSession), "corpusloom", f"{name}-{uuid.uuid4().hex}")
    df.write.json(path)
    return path


@query("metrics_lines", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by type, written as JSON lines and read back."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return spark.read.schema(m.schema).json(write_metrics(m, "metrics"))


@query(
    "half_float_rows",
    """
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), e AS (SELECT vec_id, x, pow(2, greatest(-14, floor(log2(abs(x)))) - 10) AS step FROM x WHERE x <> 0)
SELECT vec_id, round(sum(round_even(x / step, 0) * step), 6) AS total, round(max(abs(x - round_even(x / step, 0) * step)), 9) AS worst FROM e GROUP BY vec_id
""",
)
def half_float_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of half floats (rounded to even) and back: their sums, and the largest change of a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, worst = [], []
            for raw, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = np.array(e or [], np.float64), np.frombuffer(raw or b"", "<f2").astype(np.float64)
                total.append(round(float(y.sum()), 6))
                worst.append(round(float(np.abs(x - y).max(initial=0)), 9))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.float64()), pa.array(worst, pa.float64())], names=["vec_id", "total", "worst"])

    v = table(spark, sf_dir, "embeddings").select("vec_id", to_half("embedding").alias("h"), "embedding")
    return v.mapInArrow(run, "vec_id bigint, total double, worst double")


def store(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A table as it is, without coding; partitioned by columns where asked."""
    out = df.write.mode("errorifexists")
    (out.partitionBy(*by) if by else out).parquet(path)
