"""Online models over sequences of their own: a user's events, a turn's bytes.

Folds that SQL can say run as array aggregates in the JVM. Models whose update depends
on their own output run in Python, users side by side in lanes, turns one at a time; the
unit is a user or a turn, whose rows belong together by meaning.

Defined results: a null event type is a type like any other; a null text counts as
empty; events of one time come in the order of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import attention as A
from corpusloom.functions import online as O
from corpusloom.functions.lanes import code_lengths, lanes_of, numbered
from corpusloom.functions.ppm import Ppm
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

SEQUENCE_SQL = "WITH RECURSIVE e AS (SELECT user_id, event_type, value, CASE WHEN event_type = lag(event_type) OVER w THEN 1 ELSE 0 END AS bit, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and its events in order: an array of (event_type, value, bit); bit tells a repeated type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", F.when(F.col("event_type") == F.lag("event_type").over(w), 1).otherwise(0).alias("bit"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value", "bit"))).alias("a"))
    return g.select("user_id", F.transform("a", lambda x: F.struct(x.event_type.alias("event_type"), x.value.alias("value"), x.bit.alias("bit"))).alias("a"))


STEP_SQL = """least((CASE bit WHEN 0 THEN a ELSE b END) + 1, greatest(3, 40 // (1 + (CASE WHEN (CASE bit WHEN 0 THEN b ELSE a END) > 2 THEN (CASE bit WHEN 0 THEN b ELSE a END) // 2 + 1 ELSE (CASE bit WHEN 0 THEN b ELSE a END) END))))"""
OTHER_SQL = "(CASE WHEN (CASE bit WHEN 0 THEN b ELSE a END) > 2 THEN (CASE bit WHEN 0 THEN b ELSE a END) // 2 + 1 ELSE (CASE bit WHEN 0 THEN b ELSE a END) END)"


@query(
    "history_states",
    SEQUENCE_SQL
    + f""", f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM e WHERE i = 1
  UNION ALL SELECT f.user_id, e.i, CASE bit WHEN 0 THEN {STEP_SQL} ELSE {OTHER_SQL} END, CASE bit WHEN 1 THEN {STEP_SQL} ELSE {OTHER_SQL} END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT f.user_id, CAST(a AS INT) AS zeros, CAST(b AS INT) AS ones FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i AND e.i = e.n""",
)
def history_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discounted counts (zeros, ones) of each user's bits: what the automaton of bit histories ends in."""

    def step(s: Column, x: Column) -> Column:
        def after(own: Column, other: Column) -> tuple[Column, Column]:
            less = F.when(other > 2, F.floor(other / 2).cast("int") + 1).otherwise(other)
            return F.least(own + 1, F.greatest(F.lit(3), F.floor(40 / (1 + less)).cast("int"))), less

        zero, one = after(s.zeros, s.ones), after(s.ones, s.zeros)
        return F.when(x.bit == 0, F.struct(zero[0].alias("zeros"), zero[1].alias("ones"))).otherwise(F.struct(one[1].alias("zeros"), one[0].alias("ones")))

    got = sequences(spark, sf_dir).select("user_id", F.aggregate("a", F.struct(F.lit(0).alias("zeros"), F.lit(0).alias("ones")), step).alias("s"))
    return got.select("user_id", "s.zeros", "s.ones")


@query(
    "stationary_estimates",
    SEQUENCE_SQL
    + """, k AS (SELECT user_id, event_type, bit, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM e),
f AS (SELECT user_id, event_type, CAST(0 AS BIGINT) AS i, CAST(0.5 AS DOUBLE) AS p FROM k WHERE i = 1 UNION ALL SELECT f.user_id, f.event_type, k.i, f.p + (k.bit - f.p) / (least(k.i, 31) + 0.5) FROM f JOIN k ON k.user_id = f.user_id AND k.event_type = f.event_type AND k.i = f.i + 1)
SELECT f.user_id, f.event_type, round(p, 6) AS p FROM f JOIN k ON k.user_id = f.user_id AND k.event_type = f.event_type AND k.i = f.i AND k.i = k.n""",
)
def stationary_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, type)'s probability of a repeat, moved by 1 / (n + 0.5), n up to 31."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type") == F.lag("event_type").over(w), 1).otherwise(0).alias("bit"))
    g = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "bit"))).alias("a"))

    def step(s: Column, x: Column) -> Column:
        n = F.least(s.n + 1, F.lit(31))
        return F.struct((s.p + (x.bit - s.p) / (n + 0.5)).alias("p"), n.alias("n"))

    return g.select("user_id", "event_type", F.round(F.aggregate("a", F.struct(F.lit(0.5).alias("p"), F.lit(0).alias("n")), step).p, 6).alias("p"))


@query("run_priors", "SELECT CAST(r AS INT) AS state, round(CASE WHEN r < 128 THEN 1 / (r + 2.0) ELSE 1 - 1 / (r - 128 + 2.0) END, 6) AS p FROM range(256) t(r)")
def run_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the probability of a 1 begins in each run state: 0 to 127 zeros in a row, or that many ones."""
    r = F.col("id").cast("int")
    return spark.range(256).select(r.alias("state"), F.round(F.when(r < 128, 1 / (r + 2.0)).otherwise(1 - 1 / (r - 128 + 2.0)), 6).alias("p"))


@query(
    "delta_states",
    SEQUENCE_SQL
    + """, x AS (SELECT user_id, i, n, value / 100 AS v, CASE event_type WHEN 'error' THEN 0.5 ELSE 1.0 END AS k, 0.9 + 0.05 * bit AS g FROM e),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS total FROM e WHERE i = 1
  UNION ALL SELECT f.user_id, x.i, x.g * s + 0.3 * (x.v - x.g * s * x.k) * x.k, total + x.g * s + 0.3 * (x.v - x.g * s * x.k) * x.k FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1)
SELECT f.user_id, round(s, 6) AS state, round(total, 6) AS total FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i AND x.i = x.n""",
)
def delta_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gated delta rule with a state of one number: forgotten by a gate, moved towards the value by 0.3 of the error."""

    def step(s: Column, x: Column) -> Column:
        k = F.when(x.event_type == "error", 0.5).otherwise(1.0)
        kept = (F.lit(0.9) + 0.05 * x.bit) * s.s
        now = kept + 0.3 * (x.value / 100 - kept * k) * k
        return F.struct(now.alias("s"), (s.total + now).alias("total"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("total"))
    got = sequences(spark, sf_dir).select("user_id", F.aggregate("a", zero, step).alias("f"))
    return got.select("user_id", F.round("f.s", 6).alias("state"), F.round("f.total", 6).alias("total"))


@query(
    "window_attention",
    """
WITH e AS (SELECT user_id, event_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT q.user_id, q.event_id, round(sum(exp(q.v * k.v) * k.v) / sum(exp(q.v * k.v)), 6) AS y FROM e q JOIN e k ON k.user_id = q.user_id AND k.i BETWEEN q.i - 3 AND q.i GROUP BY ALL
""",
)
def window_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax attention over a user's last four events, keys and values from their value. The frame holds four rows, so nothing is joined."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 100).alias("v"), F.collect_list(F.col("value") / 100).over(w).alias("k"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return e.select("user_id", "event_id", F.round(total(F.transform("k", lambda k: F.exp(F.col("v") * k) * k)) / total(F.transform("k", lambda k: F.exp(F.col("v") * k))), 6).alias("y"))


@query(
    "stream_classes",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN value < 1 THEN 1 WHEN value < 10 AND event_type = 'click' THEN 2 WHEN value < 10 THEN 3 WHEN value < 50 THEN 4 WHEN value < 100 THEN 5 ELSE 6 END AS class, round(CASE WHEN abs(ln((value + 1) / 50)) > 0.5 THEN ln((value + 1) / 50) ELSE 0 END, 6) AS hint FROM events",
)
def stream_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that picks a specialist's weights, and a hint that abstains (0) near the middle."""
    v, t = F.col("value"), F.col("event_type")
    cls = F.when(t == "error", 0).when(v < 1, 1).when((v < 10) & (t == "click"), 2).when(v < 10, 3).when(v < 50, 4).when(v < 100, 5).otherwise(6)
    hint = F.ln((v + 1) / 50)
    return table(spark, sf_dir, "events").select("event_id", cls.alias("class"), F.round(F.when(F.abs(hint) > 0.5, hint).otherwise(0.0), 6).alias("hint"))


def user_bits(types: list, bits: list[int]) -> dict[str, float]:
    """Code lengths of a user's repeats: by the mixers, refined, corrected; and of its types by the recurrent net."""
    known: dict = {}
    ids = [known.setdefault(t, len(known)) for t in types]
    hist, two, still, runs = O.HistoryMap(), O.HistoryMap(), O.StationaryMap(), O.RunHistory()
    mixers, refine, special = O.Layered(5, 2), O.Refiner(), O.Specialist()
    net = O.Lstm(max(2, len(known)), cells=8)
    total = {"mixed": 0.0, "refined": 0.0, "corrected": 0.0, "net": 0.0}
    for i in range(1, len(ids)):
        c1, c2, bit = ids[i - 1], ids[i - 1] * 64 + (ids[i - 2] if i > 1 else 63), bits[i]
        symbol, trust = runs.predict(c1)
        said = 0.5 if symbol is None else 0.5 + (0.5 if symbol == c1 else -0.5) * trust
        x = np.array([O.stretch(p) for p in (hist.predict(c1), two.predict(c2), still.predict(c1), said, 0.3)])
        p = mixers.predict(x, [c1, bits[i - 1]])
        q = refine.predict(p, c1)
        z = special.predict(q, p, c1 % 8)
        dist = net.predict(ids[i - 1])
        for name, v in (("mixed", p), ("refined", q), ("corrected", z)):
            total[name] -= float(np.log2(min(1, max(1e-9, v if bit else 1 - v))))
        total["net"] -= float(np.log2(max(1e-9, dist[ids[i]])))
        mixers.learn(bit)
        refine.learn(p, bit, c1)
        special.learn(bit)
        for m, c in ((hist, c1), (two, c2), (still, c1)):
            m.learn(c, bit)
        runs.learn(c1, ids[i])
        net.learn(ids[i])
    return total


#: Events that may wait in a task for enough users to go side by side.
WAITING = 1 << 21


def users_side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(user_id, types, bits) to ``user_bits`` of each user, worked out for many users at a time."""
    names = ("mixed", "refined", "corrected", "net")
    waiting: dict[int, list[tuple]] = {}  # by the number of symbols, which is the net's size

    def some(symbols: int) -> pa.RecordBatch:
        users, n, ids, bits = zip(*waiting.pop(symbols), strict=True)
        users, n, ids, bits = pa.concat_arrays(users), np.concatenate(n), np.concatenate(ids), np.concatenate(bits)
        starts = np.cumsum(n) - n
        got = np.empty((len(n), 4))
        by = np.argsort(-n, kind="stable")  # users of like lengths go together
        for at in np.split(by, range(lanes_of(symbols), len(by), lanes_of(symbols))):
            places = np.repeat(starts[at] - np.cumsum(n[at]) + n[at], n[at]) + np.arange(n[at].sum())
            got[at] = code_lengths(ids[places], bits[places], n[at], symbols)
        columns = [pa.array([round(x, 4) for x in c], pa.float64()) for c in got.T.tolist()]
        return pa.RecordBatch.from_arrays([users, pa.array(n, pa.int32()), *columns], names=["user_id", "n", *names])

    for batch in batches:
        users, types, bits = batch.columns
        n = pc.list_value_length(types).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = types.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        ids, known = numbered(np.repeat(np.arange(len(n)), n), codes, len(n))
        bits = bits.flatten().to_numpy()
        symbols = np.maximum(2, known)
        for k in np.unique(symbols).tolist():
            mine = symbols == k
            places = np.repeat(mine, n)
            waiting.setdefault(k, []).append((users.filter(pa.array(mine)), n[mine], ids[places].astype(np.int32), bits[places].astype(np.int8)))
            if sum(len(w[1]) for w in waiting[k]) >= lanes_of(k):
                yield some(k)
        if sum(len(w[2]) for ws in waiting.values() for w in ws) >= WAITING:
            yield from map(some, list(waiting))
    yield from map(some, list(waiting))


@query("online_mixture")
def online_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that online models need for each user's repeats and types: the events of many users at a time, one of each."""
    s = sequences(spark, sf_dir).select("user_id", F.col("a.event_type").alias("types"), F.col("a.bit").alias("bits"))
    return s.mapInArrow(users_side_by_side, "user_id bigint, n int, mixed double, refined double, corrected double, net double")


@query("ppm_bits")
def ppm_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each turn by partial matching of orders up to four."""

    @F.pandas_udf("double")
    def bits(s: pd.Series) -> pd.Series:
        # a text that comes again within a batch is worked out once
        once = {t: round(Ppm(4).bits((t or "").encode("utf-8", "surrogatepass")), 3) for t in s.unique()}
        return s.map(lambda t: once[t])

    c = table(spark, sf_dir, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return c.select("conv_id", "turn", F.octet_length("text").alias("n_bytes"), bits("text").alias("bits"))


@query("attention_block")
def attention_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as eight tokens of eight values through a residual block with seeded weights: norms before and after."""
    rng = np.random.default_rng(5)
    shapes = {"q": (8, 8), "k": (8, 8), "v": (8, 8), "up": (8, 16), "down": (16, 8)}
    shared = spark.sparkContext.broadcast({k: rng.normal(0, 0.3, s) for k, s in shapes.items()})

    @F.pandas_udf("double")
    def through(s: pd.Series) -> pd.Series:
        return s.map(lambda e: round(float(np.linalg.norm(A.block(np.asarray(e, float)[: len(e) // 8 * 8].reshape(-1, 8), shared.value, 4))), 5))

    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 5).alias("before"), through("embedding").alias("after"))
