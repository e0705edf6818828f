"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import join_skewed
from corpusloom.session import materialize, release


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of bigint; returns (node, comp) for every node of an edge, comp the least node that it reaches.

    Large stars hang a node's larger neighbours under its least one, small stars the
    lesser ones; rounds alternate until nothing changes. The least neighbour comes
    from an aggregate with map-side combine, and hubs, which only
    the large stars have, are joined by broadcast.
    """
    cur = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before, n = None, cur.count()
    for _ in range(most_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = join_skewed(both.filter("v > u"), least, ["u"], "c", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # here u is the larger end of each edge, and has few lesser ones left: no hubs
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        nxt = materialize(small, "cc")
        state = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(cur)
        cur, n = nxt, state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    tops = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops)
