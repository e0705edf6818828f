"""Markers in texts and pages: modes, links, numbers, apostrophes, resets, and comparisons of inputs.

Defined results: a null text or page counts as empty; rows that are alike count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.matching import piped_links, title_echo
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

MODES = {"script": "(?s)<script>.*?</script>", "style": "(?s)<style>.*?</style>", "pre": "(?s)<pre>.*?</pre>", "tag": "<[^>]*>"}


def size_of(c: Column) -> Column:
    return F.length(c).cast("bigint")


@query(
    "markup_modes",
    "WITH p AS (SELECT page_id, coalesce(html, '') AS a FROM pages), "
    + ", ".join(f"{name} AS (SELECT *, regexp_replace({prev}, '{rx}', '', 'g') AS {nxt} FROM {src})" for (name, rx), prev, nxt, src in zip(MODES.items(), "abcd", "bcde", ("p", *MODES), strict=False))
    + " SELECT page_id, CAST(length(a) - length(b) AS BIGINT) AS script, CAST(length(b) - length(c) AS BIGINT) AS style, CAST(length(c) - length(d) AS BIGINT) AS pre, CAST(length(d) - length(e) AS BIGINT) AS tags, CAST(length(e) AS BIGINT) AS plain FROM tag",
)
def markup_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a page in scripts, styles, preformatted text and tags, and what is plain; each mode is taken out before the next."""
    d = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("a"))
    for prev, nxt, rx in zip("abcd", "bcde", MODES.values(), strict=True):
        d = d.withColumn(nxt, F.regexp_replace(prev, rx, ""))
    parts = [(size_of(F.col(x)) - size_of(F.col(y))).alias(name) for x, y, name in zip("abcd", "bcde", ("script", "style", "pre", "tags"), strict=True)]
    return d.select("page_id", *parts, size_of(F.col("e")).alias("plain"))


@query(
    "link_kinds",
    """
WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)
SELECT CASE WHEN h LIKE 'http%' THEN 'web' WHEN h LIKE 'mailto:%' THEN 'mail' WHEN h LIKE '#%' THEN 'anchor' WHEN lower(h) LIKE '%.jpg' OR lower(h) LIKE '%.png' THEN 'image' WHEN h LIKE '/%' THEN 'site' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT h) AS n_targets FROM l GROUP BY 1
""",
)
def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages by what they lead to."""
    h = F.col("h")
    low = F.lower(h)
    kind = F.when(h.startswith("http"), "web").when(h.startswith("mailto:"), "mail").when(h.startswith("#"), "anchor").when(low.endswith(".jpg") | low.endswith(".png"), "image").when(h.startswith("/"), "site").otherwise("other")
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("h"))
    # targets are counted once before the kinds are
    once = links.groupBy("h").agg(F.count("*").alias("k"))
    return once.groupBy(kind.alias("kind")).agg(F.sum("k").alias("n"), F.count("*").alias("n_targets"))


@query(
    "number_forms",
    r"""
WITH n AS (SELECT unnest(regexp_extract_all(text, '[0-9]+([.,][0-9]+)*')) AS x FROM documents)
SELECT CASE WHEN regexp_full_match(x, '[0-9]{1,3}([.,][0-9]{3})+') THEN 'thousands' WHEN regexp_full_match(x, '[0-9]+[.,][0-9]+') THEN 'decimal' WHEN regexp_full_match(x, '[0-9]+') THEN 'whole' ELSE 'other' END AS form,
       count(*) AS n, CAST(sum(length(regexp_replace(x, '[^0-9]', '', 'g'))) AS BIGINT) AS n_digits FROM n GROUP BY 1
""",
)
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by their separators, and their digits."""
    x = F.col("x")
    form = F.when(x.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$"), "thousands").when(x.rlike(r"^[0-9]+[.,][0-9]+$"), "decimal").when(x.rlike("^[0-9]+$"), "whole").otherwise("other")
    n = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+([.,][0-9]+)*"), 0)).alias("x"))
    return n.groupBy(form.alias("form")).agg(F.count("*").alias("n"), F.sum(F.length(F.regexp_replace("x", "[^0-9]", ""))).cast("bigint").alias("n_digits"))


@query(
    "apostrophes",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]''[a-z]')) AS BIGINT) AS within, CAST(len(regexp_extract_all(coalesce(text, ''), '(^|[ \n])''[^'']*''')) AS BIGINT) AS quotes FROM documents""",
)
def apostrophes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apostrophes within words, which end none, and pairs that quote."""
    t = F.coalesce("text", F.lit(""))
    count = lambda rx: F.size(F.regexp_extract_all(t, F.lit(rx), 0)).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", count("[A-Za-z]'[a-z]").alias("within"), count(r"(^|[ \n])'[^']*'").alias("quotes"))


RESETS = r"[.!?;:,\n]+|\b(?:and|or|but)\b"


@query(
    "words_between_resets",
    rf"""
WITH s AS (SELECT unnest(string_split_regex(lower(text), '{RESETS}')) AS s FROM documents), n AS (SELECT least(20, len(regexp_extract_all(s, '[a-z]+'))) AS n FROM s)
SELECT CAST(n AS INT) AS n_words, count(*) AS n FROM n WHERE n > 0 GROUP BY 1
""",
)
def words_between_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words since the last mark or conjunction, where word contexts start anew, at the end of each stretch (20 at most)."""
    s = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), RESETS)).alias("s"))
    n = s.select(F.least(F.lit(20), F.size(F.regexp_extract_all("s", F.lit("[a-z]+"), 0))).alias("n_words")).filter("n_words > 0")
    return n.groupBy("n_words").agg(F.count("*").alias("n"))


@query(
    "article_noun_pairs",
    """
WITH t AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents), x AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM t),
l AS (SELECT w, lag(w) OVER (PARTITION BY r ORDER BY p) AS a FROM x)
SELECT a || ' ' || w AS pair, count(*) AS n FROM l WHERE a IN ('the', 'a', 'an') AND w NOT IN ('the', 'a', 'an') GROUP BY 1
""",
)
def article_noun_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article and the word after it as one entry, with counts."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    d = table(spark, sf_dir, "documents").select(ws.alias("ws")).filter(F.size("ws") > 1)
    pairs = F.zip_with(F.slice("ws", 1, F.size("ws") - 1), F.slice("ws", 2, F.size("ws")), lambda a, w: F.when(a.isin("the", "a", "an") & ~w.isin("the", "a", "an"), F.concat_ws(" ", a, w)))
    return d.select(F.explode(pairs).alias("pair")).filter("pair IS NOT NULL").groupBy("pair").agg(F.count("*").alias("n"))


@query(
    "copied_expectations",
    r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages),
p AS (SELECT page_id, count(*) FILTER (WHERE label <> '' AND contains(lower(target), lower(label))) AS c FROM l GROUP BY page_id),
t AS (SELECT page_id, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages), e AS (SELECT page_id, CASE WHEN title = '' THEN 0 ELSE (length(html) - length(replace(html, title, ''))) / length(title) - 1 END AS k FROM t)
SELECT CASE WHEN c > 0 THEN 'label' WHEN k > 0 THEN 'title' ELSE 'none' END AS expectation, count(*) AS n FROM e LEFT JOIN p USING (page_id) GROUP BY 1
""",
)
def copied_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's reader could expect to be copied, in order of priority: a link's label, else the title, else nothing."""
    p = piped_links(spark, sf_dir).select("page_id", "n_copied")
    e = title_echo(spark, sf_dir).select("page_id", "n_echo").join(p, "page_id", "left")
    return e.groupBy(F.when(F.col("n_copied") > 0, "label").when(F.col("n_echo") > 0, "title").otherwise("none").alias("expectation")).agg(F.count("*").alias("n"))


@query(
    "turn_differences",
    """
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS b, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS a FROM conversations),
d AS (SELECT conv_id, turn, min(k) FILTER (WHERE substr(a, k, 1) <> substr(b, k, 1)) AS k FROM c, unnest(range(1, least(length(a), length(b)) + 1)) t(k) GROUP BY ALL)
SELECT c.conv_id, c.turn, CAST(CASE WHEN d.k IS NOT NULL THEN d.k - 1 WHEN length(a) = length(b) THEN -1 ELSE least(length(a), length(b)) END AS INT) AS first_difference FROM c LEFT JOIN d USING (conv_id, turn)
""",
)
def turn_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a turn parts from the one before (a first turn from nothing): a place from 0, or -1 where they are equal."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("b"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("a"))
    chars = lambda x: F.filter(F.split(x, ""), lambda y: y != "")
    least = F.least(F.length("a"), F.length("b"))
    same = F.zip_with(F.slice(chars("a"), 1, F.greatest(least, F.lit(0))), F.slice(chars("b"), 1, F.greatest(least, F.lit(0))), lambda x, y: x != y)
    at = F.array_position(same, True)
    return c.select("conv_id", "turn", F.when(at > 0, at - 1).when(F.length("a") == F.length("b"), -1).otherwise(least).cast("int").alias("first_difference"))


@query(
    "recent_history",
    "SELECT user_id, event_id, count(*) OVER w AS n_kept, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)",
)
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of the last 32 events of each user: how many it holds, and their sum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-31, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(w).alias("n_kept"), F.round(F.sum("value").over(w), 4).alias("total"))


@query(
    "projected_totals",
    """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS t FROM documents),
c AS (SELECT i, t, sum(n) OVER (ORDER BY i) AS upto, sum(n) OVER () AS total FROM d)
SELECT i AS n_read, CAST(upto AS BIGINT) AS read_chars, CAST(upto * t // i AS BIGINT) AS projected, round(abs(upto * t / i - total) / total, 6) AS off_by FROM c WHERE i % greatest(1, t // 10) = 0
""",
)
def projected_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each tenth of the documents: the characters read, what that projects for all, and how far off it is."""
    from corpusloom.plans.ordered import ordered

    d = ordered(table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")), "doc_id", add=F.col("n"))
    total = d.agg(F.count("*").alias("t"), F.sum("n").alias("total"))  # one row
    c = d.select((F.col("pos") + 1).alias("n_read"), (F.col("before") + F.col("n")).alias("read_chars")).crossJoin(total).filter("n_read % greatest(1, t div 10) = 0")
    return c.select("n_read", "read_chars", F.expr("read_chars * t div n_read").alias("projected"), F.round(F.abs(F.col("read_chars") * F.col("t") / F.col("n_read") - F.col("total")) / F.col("total"), 6).alias("off_by"))
