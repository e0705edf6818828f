"""Exact dedup by content sort, in DataFrame operations only.

1. One scan counts the 64-bit fingerprints of the normalised texts with map-side
   combine. Fingerprints of more than rows / (4 x partitions) rows are hot; there
   are fewer than 4 x partitions of them, which bounds what is broadcast. The same
   aggregate gives the best row and the size of each hot group.
2. Sampled splitters range-partition the rows by the first bytes of the normalised
   text, its fingerprint and a salt, so that what is sampled stays short; the salt is
   0 but for hot texts, whose rows it deals over all partitions.
3. An external sort places equal texts next to each other. The window operator
   compares full neighbouring keys, so equality is decided on the content.
4. The first row of a run stays: most code points, then the smallest doc_id. For a
   hot text the first rows of its salted runs meet the winner of step 1.

Defined results: a null text counts as empty; a null doc_id loses to any other; of
rows that are alike in text and doc_id exactly one stays; texts are compared whole,
however long; an empty table gives an empty result; carried columns may bear any name
not starting with ``__ed_``, one that has the name of a result is renamed (see
``carried``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import carried

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, "")


def content_sort_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: the id) of every row with keep_id, group_size, kept and text_sha256."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carry = [id_col] if carry is None else carry
    points = F.length(F.coalesce(F.col(text_col), F.lit("")))
    base = df.select(
        F.struct(*[F.col(c) for c in carry]).alias("__ed_row"),
        F.col(id_col).alias("__ed_id"),
        points.alias("__ed_points"),
        normalised(text_col).alias("__ed_norm"),
    )
    prints = base.select("__ed_id", "__ed_points", F.xxhash64("__ed_norm").alias("__ed_h"), F.sha2(F.encode("__ed_norm", "utf-8"), 256).alias("__ed_sha"))
    # smallest struct: most code points, ids before nulls, smallest id
    best = F.min(F.struct((-F.col("__ed_points")).alias("p"), F.col("__ed_id").isNull().alias("n"), F.col("__ed_id").alias("id")))
    groups = prints.groupBy("__ed_h", "__ed_sha").agg(F.count("*").alias("__ed_hot_n"), best.alias("__ed_best"))
    groups = groups.filter(F.col("__ed_hot_n") > 1)
    rows = df.count()
    hot = groups.filter(F.col("__ed_hot_n") > max(64, rows // (4 * parts)))
    # fewer than 4 x partitions rows by the threshold, so the broadcast is bounded
    hot = F.broadcast(hot.withColumnsRenamed({"__ed_h": "__ed_hot_h", "__ed_sha": "__ed_hot_sha"}))

    base = base.withColumn("__ed_sha", F.sha2(F.encode("__ed_norm", "utf-8"), 256))
    base = base.join(hot, (F.xxhash64("__ed_norm") == F.col("__ed_hot_h")) & (F.col("__ed_sha") == F.col("__ed_hot_sha")), "left")
    base = base.withColumn("__ed_salt", F.when(F.col("__ed_hot_n").isNotNull(), 1 + F.pmod(F.xxhash64("__ed_id"), F.lit(parts))).otherwise(0))
    base = base.drop("__ed_hot_h", "__ed_hot_sha")

    base = base.withColumn("__ed_head", F.substring("__ed_norm", 1, 16)).withColumn("__ed_print", F.xxhash64("__ed_norm"))
    dealt = base.repartitionByRange(parts, "__ed_head", "__ed_print", "__ed_salt")
    run = Window.partitionBy("__ed_head", "__ed_print", "__ed_salt", "__ed_norm")
    order = run.orderBy(F.col("__ed_points").desc(), F.col("__ed_id").asc_nulls_last())
    out = (
        dealt.withColumn("__ed_rn", F.row_number().over(order))
        .withColumn("__ed_first", F.first("__ed_id").over(order))
        .withColumn("__ed_n", F.count("*").over(run))
    )
    is_hot = F.col("__ed_hot_n").isNotNull()
    wins = (F.col("__ed_rn") == 1) & (~is_hot | (F.col("__ed_id").eqNullSafe(F.col("__ed_best.id")) & (F.col("__ed_points") == -F.col("__ed_best.p"))))
    return out.select(
        *carried("__ed_row", carry, ("keep_id", "group_size", "kept", "text_sha256")),
        F.when(is_hot, F.col("__ed_best.id")).otherwise(F.col("__ed_first")).alias("keep_id"),
        F.when(is_hot, F.col("__ed_hot_n")).otherwise(F.col("__ed_n")).alias("group_size"),
        wins.alias("kept"),
        F.col("__ed_sha").alias("text_sha256"),
    )
