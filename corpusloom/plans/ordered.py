"""Global order without a global sort in one task.

Rows are dealt to sampled ranges of (section, key), sorted there and written once with
their place; a second, far smaller window over one row per range and section carries
counts, sums and last values from range to range.

Defined results: a null key or section comes last and is a row like any other; rows
that tie come in the order of a hash of the row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize


def ordered(df: DataFrame, key: str, add: Column | None = None, section: Column | None = None, within: bool = False) -> DataFrame:
    """Add ``pos`` (from 0, by section then key), ``prev`` (the key before) and, of ``add``, ``before`` (the sum over earlier rows). ``within``: each section starts anew."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    line = [F.col("_s").asc_nulls_last(), F.col(key).asc_nulls_last(), F.col("_h")]
    dealt = df.withColumns({"_s": section if section is not None else F.lit(0), "_x": F.coalesce(add, F.lit(0)).cast("bigint") if add is not None else F.lit(0).cast("bigint"), "_h": F.xxhash64(*[F.col(c) for c in names])})
    # the identifier holds the range's number and the place in it; written once, so that ranges are sampled once
    dealt = materialize(dealt.repartitionByRange(parts, *line).sortWithinPartitions(*line).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("_p", F.shiftright("_m", 33))
    per = dealt.groupBy("_s", "_p").agg(F.count("*").alias("_n"), F.sum("_x").alias("_t"), F.max_by(F.struct(key), "_m").alias("_l"))
    by = [F.col("_s").asc_nulls_last(), "_p"]
    runs = Window.partitionBy("_s").orderBy("_p") if within else Window.orderBy(*by)  # one row per range and section
    earlier = runs.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("_s").alias("_s2"), F.col("_p").alias("_p2"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"), F.lag("_l").over(runs).alias("_l0"))
    own = Window.partitionBy("_s", "_p").orderBy("_m")
    out = dealt.join(per, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_p") == F.col("_p2")))
    first = F.row_number().over(own) == 1
    return out.select(
        *names,
        (F.col("_n0") + F.row_number().over(own) - 1).cast("bigint").alias("pos"),
        F.when(first, F.col("_l0").getField(key)).otherwise(F.lag(key).over(own)).alias("prev"),
        (F.col("_t0") + F.coalesce(F.sum("_x").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("bigint").alias("before"),
    )
