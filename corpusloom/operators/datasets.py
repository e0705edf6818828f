"""Datasets beyond pieces: merging, seeded order, subsets, positions to documents, masks, losses, catalogues, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.operators.batching import block_fold
from corpusloom.operators.symbols import char_counts
from corpusloom.plans.ordered import ordered
from corpusloom.plans.registry import query
from corpusloom.sources.tables import concat_tables, table

MERGED = 4096


@query(
    "merged_documents",
    f"""
WITH RECURSIVE o AS (SELECT doc_id, coalesce(length(text), 0) AS n, row_number() OVER w AS i, CAST(sum(coalesce(length(text), 0)) OVER w AS BIGINT) AS e FROM documents WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT e AS at_, i, CAST(NULL AS BIGINT) AS asks FROM o UNION ALL SELECT e - n + {MERGED}, NULL, i FROM o),
j AS (SELECT asks AS i, greatest(asks, max(i) OVER (ORDER BY at_ RANGE UNBOUNDED PRECEDING)) + 1 AS j FROM v),
x AS (SELECT i, j FROM j WHERE i IS NOT NULL),
f AS (SELECT CAST(1 AS BIGINT) AS i UNION ALL SELECT x.j FROM f JOIN x ON x.i = f.i),
b AS (SELECT o.*, max(f.i) OVER (ORDER BY o.i ROWS UNBOUNDED PRECEDING) AS g FROM o LEFT JOIN f ON f.i = o.i)
SELECT min(doc_id) AS first_doc, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM b GROUP BY g
""",
)
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive documents merged as long as they stay within 4096 characters; a longer one stays alone."""
    placed = block_fold(table(spark, sf_dir, "documents"), MERGED)
    return placed.groupBy("bin").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"), F.sum("length").alias("length")).drop("bin")


def seeded(key: str, seed: Column) -> Column:
    """A value that puts ids into an order of their own for each seed."""
    return F.md5(F.encode(F.concat_ws(":", F.col(key).cast("string"), seed.cast("string")), "utf-8"))


@query(
    "epoch_order",
    "SELECT CAST(e AS INT) AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY md5(concat_ws(':', doc_id, e))) - 1 AS position FROM documents, range(2) t(e)",
)
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation of the documents for each of two epochs, by a hash of id and epoch."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    d = ordered(d.withColumn("h", seeded("doc_id", F.col("epoch"))), "h", section=F.col("epoch"), within=True)
    return d.select("epoch", "doc_id", F.col("pos").alias("position"))


@query(
    "document_subset",
    """
WITH s AS (SELECT doc_id, length(text) AS length FROM documents ORDER BY md5(concat_ws(':', doc_id, 7)) LIMIT 64)
SELECT doc_id, CAST(length AS INT) AS length, CAST(coalesce(sum(length) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s
""",
)
def document_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 documents drawn without replacement by a seed, with offsets of their own. The window runs over these."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("length"), seeded("doc_id", F.lit(7)).alias("h")).orderBy("h").limit(64)
    w = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("doc_id", "length", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("bigint").alias("start"))


BUCKET = 1 << 16


def laid_out(docs: DataFrame) -> DataFrame:
    """doc_id, idx (from 0), start and stop in the stream of all documents."""
    d = ordered(docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n")), "doc_id", add=F.col("n"))
    return d.select("doc_id", F.col("pos").alias("idx"), F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("stop"))


def documents_at(positions: DataFrame, docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Range join: each position (column p) with the document that holds it. Both sides meet by bucket; a document is copied to the buckets it reaches."""
    held = docs.filter("stop > start").withColumn("b", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(stop - 1) div {bucket}"))))
    at = positions.withColumn("b", F.expr(f"p div {bucket}"))
    return at.join(held, "b").filter("p >= start AND p < stop").drop("b")


@query(
    "document_indices",
    """
WITH d AS (SELECT doc_id, row_number() OVER w - 1 AS idx, CAST(sum(coalesce(length(text), 0)) OVER w AS BIGINT) AS stop, coalesce(length(text), 0) AS n FROM documents WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT p, doc_id, idx, p - (stop - n) AS within FROM range(0, (SELECT max(stop) FROM d), 10000) t(p) JOIN d ON p >= stop - n AND p < stop
""",
)
def document_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 10,000th position of the stream of all documents: the document there, its index and the place in it."""
    docs = laid_out(table(spark, sf_dir, "documents"))
    top = docs.agg(F.max("stop").alias("top"))
    # the positions come from the length of the stream, not from the documents
    positions = top.filter("top > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("top") - 1), F.lit(10000).cast("bigint"))).alias("p"))
    return documents_at(positions, docs).select("p", "doc_id", "idx", (F.col("p") - F.col("start")).alias("within"))


@query(
    "causal_pairs",
    """
SELECT q.conv_id, count(*) AS n_pairs, count(*) FILTER (WHERE q.role = k.role) AS n_same_role
FROM conversations q JOIN conversations k ON q.conv_id = k.conv_id AND k.turn <= q.turn AND q.turn - k.turn < 4 GROUP BY q.conv_id
""",
)
def causal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns that a causal window of four lets see each other: same conversation, not later, less than four apart."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    q, k = c.alias("q"), c.alias("k")
    seen = q.join(k, (F.col("q.conv_id") == F.col("k.conv_id")) & (F.col("k.turn") <= F.col("q.turn")) & (F.col("q.turn") - F.col("k.turn") < 4))
    return seen.groupBy(F.col("q.conv_id").alias("conv_id")).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("q.role") == F.col("k.role")).alias("n_same_role"))


@query(
    "attention_blocks",
    """
WITH d AS (SELECT row_number() OVER w - 1 AS idx, CAST(sum(length(text)) OVER w AS BIGINT) AS stop, length(text) AS n FROM documents WHERE text <> '' WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT max(stop) AS total FROM d), s AS (SELECT b, b * 1024 AS lo, least((b + 1) * 1024, total) - 1 AS hi FROM z, range(0, (SELECT (max(stop) + 1023) // 1024 FROM d)) t(b)),
e AS (SELECT s.b, f.idx AS first, l.idx AS last FROM s JOIN d f ON s.lo >= f.stop - f.n AND s.lo < f.stop JOIN d l ON s.hi >= l.stop - l.n AND s.hi < l.stop),
p AS (SELECT q.b AS qb, k.b AS kb, q.first, q.last, k.first AS kf, k.last AS kl FROM e q JOIN e k ON k.b BETWEEN q.b - 3 AND q.b)
SELECT CAST(qb - kb AS INT) AS distance, CASE WHEN qb > kb AND first = last AND kf = kl AND first = kf THEN 'full' ELSE 'partial' END AS kind, count(*) AS n FROM p WHERE kl >= first GROUP BY ALL
""",
)
def attention_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block pairs of a mask (causal, four blocks of 1024, same document): those with any visible pair, full where every pair is."""
    docs = laid_out(table(spark, sf_dir, "documents").filter("text <> ''"))
    top = docs.agg(F.max("stop").alias("top")).filter("top > 0")
    blocks = top.select("top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(top - 1) div 1024"))).alias("b"))
    ends = blocks.select("b", F.inline(F.array(F.struct(F.lit("first").alias("side"), (F.col("b") * 1024).alias("p")), F.struct(F.lit("last").alias("side"), (F.least((F.col("b") + 1) * 1024, "top") - 1).alias("p")))))
    found = documents_at(ends.withColumnRenamed("b", "blk"), docs)
    e = found.groupBy("blk").agg(F.max(F.when(F.col("side") == "first", F.col("idx"))).alias("first"), F.max(F.when(F.col("side") == "last", F.col("idx"))).alias("last"))
    # an equi-join: each query block asks for four key blocks
    q = e.select(F.col("blk").alias("qb"), "first", "last", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("blk") - 3), "blk")).alias("kb"))
    p = q.join(e.select(F.col("blk").alias("kb"), F.col("first").alias("kf"), F.col("last").alias("kl")), "kb").filter("kl >= first")
    full = (F.col("qb") > F.col("kb")) & (F.col("first") == F.col("last")) & (F.col("kf") == F.col("kl")) & (F.col("first") == F.col("kf"))
    return p.groupBy((F.col("qb") - F.col("kb")).cast("int").alias("distance"), F.when(full, "full").otherwise("partial").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "model_and_prior_loss",
    """
WITH t AS (SELECT conv_id, turn, role, lag(role, 1, '') OVER w AS before, lead(role) OVER w IS NULL AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT before, role, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT before, role, n / sum(n) OVER (PARTITION BY before) AS p FROM c), r AS (SELECT role, count(*) AS n FROM t GROUP BY role), g AS (SELECT role, n / sum(n) OVER () AS p FROM r),
x AS (SELECT CASE WHEN last THEN 'prior' ELSE 'model' END AS origin, CASE WHEN last THEN g.p ELSE m.p END AS p FROM t JOIN m ON m.before = t.before AND m.role = t.role JOIN g ON g.role = t.role)
SELECT origin, count(*) AS n, round(avg(-ln(p)), 6) AS nats FROM x GROUP BY origin
""",
)
def model_and_prior_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of the next role: by the role before, but by the prior at the last row of a conversation; the two means."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role", 1, "").over(w).alias("before"), F.lead("role").over(w).isNull().alias("last"))
    m = t.groupBy("before", "role").agg(F.count("*").alias("n"))
    m = m.join(m.groupBy("before").agg(F.sum("n").alias("t")), "before").select("before", "role", (F.col("n") / F.col("t")).alias("model"))
    g = t.groupBy("role").agg(F.count("*").alias("n"))
    g = g.crossJoin(t.agg(F.count("*").alias("t"))).select("role", (F.col("n") / F.col("t")).alias("prior"))  # one row
    x = t.join(m, ["before", "role"]).join(g, "role").select(F.when(F.col("last"), "prior").otherwise("model").alias("origin"), F.when(F.col("last"), F.col("prior")).otherwise(F.col("model")).alias("p"))
    return x.groupBy("origin").agg(F.count("*").alias("n"), F.round(F.avg(-F.ln("p")), 6).alias("nats"))


@query(
    "masked_loss",
    """
WITH b AS (SELECT conv_id // 16 AS batch, length(text) AS n, turn % 2 = 1 AS mask FROM conversations)
SELECT batch, count(*) FILTER (WHERE mask) AS n_masked, round(sum(CASE WHEN mask THEN ln(1 + n) END), 6) AS loss_sum FROM b GROUP BY batch
""",
)
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count over the masked rows (the answers) of each batch of 16 conversations; the loss is that of a unary length code."""
    b = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 16").alias("batch"), F.length("text").alias("n"), (F.col("turn") % 2 == 1).alias("mask"))
    return b.groupBy("batch").agg(F.count_if("mask").alias("n_masked"), F.round(F.sum(F.when(F.col("mask"), F.ln(1 + F.col("n")))), 6).alias("loss_sum"))


@query(
    "loss_overall_and_by_source",
    """
WITH b AS (SELECT source, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT source, c, count(*) AS n FROM b WHERE c <> '' GROUP BY ALL),
t AS (SELECT c, sum(n) AS n FROM n GROUP BY c), a AS (SELECT sum(n) AS n FROM t)
SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE 'source' END AS level, n.source, CAST(sum(n.n) AS BIGINT) AS tokens, round(sum(-n.n * ln(t.n / a.n)) / sum(n.n), 6) AS nats FROM n JOIN t USING (c), a GROUP BY GROUPING SETS ((source), ())
""",
)
def loss_overall_and_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-0 loss of each source and of all together, in one pass of grouping sets."""
    n = char_counts(table(spark, sf_dir, "documents"), "source")
    t = n.groupBy("c").agg(F.sum("n").alias("t"))
    x = n.join(t, "c").crossJoin(t.agg(F.sum("t").alias("a")))  # one row
    g = x.groupingSets([["source"], []], "source").agg(F.grouping("source").alias("g"), F.sum("n").alias("tokens"), F.sum(-F.col("n") * F.ln(F.col("t") / F.col("a"))).alias("s"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise("source").alias("level"), "source", "tokens", F.round(F.col("s") / F.col("tokens"), 6).alias("nats"))


@query(
    "order_without_redirects",
    """
WITH o AS (SELECT l.doc_id, d.text LIKE 'The %' AS redirect FROM labels l JOIN documents d USING (doc_id)),
n AS (SELECT doc_id, redirect, row_number() OVER (ORDER BY doc_id) - 1 AS number, CAST(coalesce(sum(CASE WHEN redirect THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dropped FROM o)
SELECT doc_id, number, number - dropped AS new_number FROM n WHERE NOT redirect
""",
)
def order_without_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order list without the entries that only point elsewhere (here: texts of a set beginning), and new numbers for the rest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.startswith("text", F.lit("The ")).alias("redirect"))
    o = ordered(table(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id"), "doc_id", add=F.col("redirect").cast("int"))
    return o.filter(~F.col("redirect")).select("doc_id", F.col("pos").alias("number"), (F.col("pos") - F.col("before")).alias("new_number"))


@query(
    "block_quantisation",
    """
WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
s AS (SELECT vec_id, p // 8 AS b, greatest(max(abs(x)), 1e-12) / 7 AS top, greatest(avg(abs(x)), 1e-12) / 3.5 AS mean FROM x GROUP BY ALL),
q AS (SELECT label, x, top * greatest(-7, least(7, round_even(x / top, 0))) AS a, mean * greatest(-7, least(7, round_even(x / mean, 0))) AS b FROM x JOIN s ON s.vec_id = x.vec_id AND s.b = x.p // 8)
SELECT label, round(avg(abs(x - a)), 6) AS error_max, round(avg(abs(x - b)), 6) AS error_mean FROM q GROUP BY label
""",
)
def block_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fake quantisation by blocks of eight values, scales from the block's largest or mean value: the mean error of both, by label."""
    v = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    blocks = F.transform(F.sequence(F.lit(0), F.expr("(size(e) - 1) div 8")), lambda k: F.slice("e", k * 8 + 1, 8))
    size = lambda b: F.transform(b, F.abs)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def error(b: Column, scale: Column) -> Column:
        return total(F.transform(b, lambda x: F.abs(x - scale * F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.rint(x / scale))))))

    b = v.select("label", F.explode(blocks).alias("b"))
    b = b.select("label", "b", (F.greatest(F.array_max(size(F.col("b"))), F.lit(1e-12)) / 7).alias("top"), (F.greatest(total(size(F.col("b"))) / F.size("b"), F.lit(1e-12)) / 3.5).alias("mean"))
    return b.groupBy("label").agg(*[F.round(F.sum(error(F.col("b"), F.col(c))) / F.sum(F.size("b")), 6).alias(name) for c, name in (("top", "error_max"), ("mean", "error_mean"))])


@query(
    "activation_scales",
    "SELECT CAST(p AS INT) AS dim, count(*) AS n, round(avg(abs(x)), 6) AS mean_abs, round(max(abs(x)), 6) AS max_abs FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) GROUP BY p",
)
def activation_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest size of each dimension, by partial and final aggregates."""
    x = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.abs(F.col("x").cast("double")))
    return x.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_abs"), F.round(F.max("x"), 6).alias("max_abs"))


#: A model's parameters by name: shape and bits of a value.
CATALOGUE = (("embed", (205, 192), 16), ("blocks.0.attn.q", (192, 192), 4), ("blocks.0.attn.k", (192, 192), 4), ("blocks.0.attn.v", (192, 192), 4), ("blocks.0.mlp.up", (768, 192), 4), ("blocks.0.mlp.down", (192, 768), 4), ("blocks.0.scale", (192,), 32), ("head", (205, 192), 8), ("head.bias", (205,), 32))


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, list(s), b) for n, s, b in CATALOGUE], "name string, shape array<int>, bits int")


CATALOGUE_SQL = "WITH c(name, shape, bits) AS (VALUES " + ", ".join(f"('{n}', {list(s)}, {b})" for n, s, b in CATALOGUE) + "), p AS (SELECT *, list_product(shape)::BIGINT AS n FROM c)"


@query("parameter_counts", CATALOGUE_SQL + " SELECT bits, count(*) AS n_tensors, CAST(sum(n) AS BIGINT) AS n_values, CAST(ceil(sum(n) * bits / 8) AS BIGINT) AS n_bytes FROM p GROUP BY bits")
def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors, values and bytes of each precision."""
    n = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    p = catalogue(spark).withColumn("n", n)
    return p.groupBy("bits").agg(F.count("*").alias("n_tensors"), F.sum("n").alias("n_values"), F.ceil(F.sum("n") * F.first("bits") / 8).alias("n_bytes"))


@query("optimizer_groups", CATALOGUE_SQL + " SELECT CASE WHEN len(shape) = 2 AND name NOT IN ('embed', 'head') THEN 'matrix' ELSE 'rest' END AS grp, name, n FROM p")
def optimizer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden matrices against the rest. Two filters, joined again; an anti-join checks that both cover the catalogue once."""
    p = catalogue(spark).withColumn("n", F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x))
    matrix = (F.size("shape") == 2) & ~F.col("name").isin("embed", "head")
    both = p.filter(matrix).withColumn("grp", F.lit("matrix")).unionByName(p.filter(~matrix).withColumn("grp", F.lit("rest")))
    if p.join(both, "name", "left_anti").count() or both.groupBy("name").count().filter("count > 1").count():
        raise ValueError("the groups don't partition the parameters")
    return both.select("grp", "name", "n")


@query(
    "teraflops_by_hour",
    "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, round(6 * 1e6 * count(*) / 3600 / 1e12, 12) AS training, round(2 * 1e6 * count(*) / 3600 / 1e12, 12) AS inference FROM events GROUP BY 1",
)
def teraflops_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic rate of a model of a million parameters that reads one token an event: six operations a parameter in training, two in inference."""
    e = table(spark, sf_dir, "events").groupBy(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("hour")).agg(F.count("*").alias("n"))
    rate = lambda flops: F.round(F.lit(flops) * 1e6 * F.col("n") / 3600 / 1e12, 12)
    return e.select("hour", rate(6).alias("training"), rate(2).alias("inference"))


@query(
    "alphabet_set_operations",
    """
WITH a AS (SELECT lang, unnest(string_split(text, '')) AS c FROM documents), en AS (SELECT DISTINCT c FROM a WHERE lang = 'en' AND c <> ''), fr AS (SELECT DISTINCT c FROM a WHERE lang = 'fr' AND c <> '')
SELECT 'both' AS side, c FROM (SELECT c FROM en INTERSECT SELECT c FROM fr) UNION ALL SELECT 'en', c FROM (SELECT c FROM en EXCEPT SELECT c FROM fr) UNION ALL SELECT 'fr', c FROM (SELECT c FROM fr EXCEPT SELECT c FROM en)
""",
)
def alphabet_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that two languages share, and those of one alone."""
    c = char_counts(table(spark, sf_dir, "documents"), "lang")
    en, fr = (c.filter(F.col("lang") == x).select("c") for x in ("en", "fr"))
    named = lambda side, d: d.select(F.lit(side).alias("side"), "c")
    return named("both", en.intersect(fr)).unionByName(named("en", en.subtract(fr))).unionByName(named("fr", fr.subtract(en)))


@query(
    "event_properties",
    "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, CAST(max(len(json_keys(props))) AS INT) AS most_keys FROM events GROUP BY event_type",
)
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON properties of events as a map: sums of one, and the most that an event has."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.element_at("m", "k")).alias("sum_k"), F.max(F.size("m")).alias("most_keys"))


@query("concatenated_names", "SELECT 0 AS part, r_name AS name FROM region UNION ALL SELECT 1, n_name FROM nation")
def concatenated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables one after the other, rows with the ordinal of their table."""
    return concat_tables(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query(
    "causal_convolution",
    """
WITH e AS (SELECT user_id, event_id, value, lag(value, 1, 0) OVER w AS v1, lag(value, 2, 0) OVER w AS v2, lag(value, 3, 0) OVER w AS v3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, event_id, 0.5 * value + 0.25 * v1 + 0.125 * v2 - 0.125 * v3 AS z FROM e)
SELECT user_id, event_id, round(z / (1 + exp(-z)), 6) + 0.0 AS y FROM c
""",
)
def causal_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A causal convolution of four taps over each user's values, and x * sigmoid(x) of it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    z = 0.5 * F.col("value") + 0.25 * F.lag("value", 1, 0.0).over(w) + 0.125 * F.lag("value", 2, 0.0).over(w) - 0.125 * F.lag("value", 3, 0.0).over(w)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", z.alias("z"))
    return e.select("user_id", "event_id", (F.round(F.col("z") / (1 + F.exp(-F.col("z"))), 6) + 0.0).alias("y"))


@query(
    "unit_vectors",
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)) + 1e-6))), 6) AS unit_sum FROM v",
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unit length (with an epsilon under the root); their sums."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return v.select("vec_id", F.round(N.total(N.l2_norm(F.col("e"))), 6).alias("unit_sum"))

