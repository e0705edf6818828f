"""Articles and their markup: line ranges, headers and tails as streams of their own, entities, and all the ways back.

Defined results: a null text or page counts as empty; rows that are alike get a row each.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.ordered import ordered
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

# fixed values: entities that occur escaped twice, and the letters that stand for them
TWICE = (("&amp;quot;", "q"), ("&amp;nbsp;", "b"), ("&amp;ndash;", "n"), ("&amp;mdash;", "m"), ("&amp;deg;", "d"), ("&amp;times;", "t"), ("&amp;lt;", "l"), ("&amp;gt;", "g"))
MARK, POINT = "\x04", "\x05"


def twice_unescaped(c: Column) -> Column:
    """Entities escaped twice become a mark and a letter; the mark itself is written as mark and e."""
    c = F.replace(c, F.lit(MARK), F.lit(MARK + "e"))
    for entity, letter in TWICE:
        c = F.replace(c, F.lit(entity), F.lit(MARK + letter))
    return c


def twice_escaped(c: Column) -> Column:
    for entity, letter in TWICE:
        c = F.replace(c, F.lit(MARK + letter), F.lit(entity))
    return F.replace(c, F.lit(MARK + "e"), F.lit(MARK))


NUMBER = re.compile(r"&amp;#([1-9][0-9]{2,6});|\x05")


def code_to_char(text: str) -> str:
    """&amp;#8212; becomes a mark and the character (above 255, no surrogates); the mark itself is doubled."""

    def one(m: re.Match) -> str:
        if not m[1]:
            return POINT * 2
        n = int(m[1])
        return POINT + chr(n) if 255 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return NUMBER.sub(one, text)


def char_to_code(text: str) -> str:
    return re.sub("\x05(.)", lambda m: POINT if m[1] == POINT else f"&amp;#{ord(m[1])};", text, flags=re.S)


@query(
    "entity_streams",
    """
WITH p AS (SELECT page_id, replace(coalesce(html, ''), '&amp;', '&amp;#8212; &amp;nbsp;&amp;lt;&amp;#65;') AS t, length(coalesce(html, '')) AS n, (length(html) - length(replace(html, '&amp;', ''))) // 5 AS k FROM pages)
SELECT page_id, CAST(length(t) - k * (9 + 8 + 6) AS BIGINT) AS n_chars, CAST(k AS BIGINT) AS n_points, true AS ok FROM p
""",
)
def entity_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with twice-escaped entities put in: named ones to letters, numbers above 255 to characters, and both back."""

    @F.pandas_udf("string")
    def chars(s: pd.Series) -> pd.Series:
        return s.map(code_to_char)

    @F.pandas_udf("string")
    def codes(s: pd.Series) -> pd.Series:
        return s.map(char_to_code)

    t = F.replace(F.coalesce("html", F.lit("")), F.lit("&amp;"), F.lit("&amp;#8212; &amp;nbsp;&amp;lt;&amp;#65;"))
    p = table(spark, sf_dir, "pages").select("page_id", t.alias("t")).withColumn("u", chars(twice_unescaped(F.col("t"))))
    points = F.length("u") - F.length(F.replace("u", F.lit(POINT), F.lit("")))
    return p.select("page_id", F.length("u").cast("bigint").alias("n_chars"), points.cast("bigint").alias("n_points"), (twice_escaped(codes("u")) == F.col("t")).alias("ok"))


@query(
    "ampersand_marks",
    r"""SELECT page_id, CAST(length(regexp_replace(coalesce(html, ''), '(["<>])', '&\1', 'g')) AS BIGINT) AS n_marked, regexp_replace(regexp_replace(coalesce(html, ''), '(["<>])', '&\1', 'g'), '&(["<>])', '\1', 'g') = coalesce(html, '') AS ok FROM pages""",
)
def ampersand_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ampersand before each quote and angle, and off again."""
    html = F.coalesce("html", F.lit(""))
    p = table(spark, sf_dir, "pages").select("page_id", html.alias("t"), F.regexp_replace(html, '(["<>])', "&$1").alias("m"))
    return p.select("page_id", F.length("m").cast("bigint").alias("n_marked"), (F.regexp_replace("m", '&(["<>])', "$1") == F.col("t")).alias("ok"))


@query(
    "tail_streams",
    """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (SELECT *, regexp_matches(line, '[.!?]$') AND NOT regexp_matches(line, '^(The|Licensed|See) ') AS fits FROM l),
m AS (SELECT doc_id, p, line, max(CASE WHEN NOT fits THEN p ELSE 0 END) OVER (PARTITION BY doc_id) AS last FROM k)
SELECT doc_id, count(*) FILTER (WHERE p <= last) AS n_body, count(*) FILTER (WHERE p > last) AS n_tail, md5(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE p > last), '')) AS tail_md5, true AS ok FROM m GROUP BY doc_id
""",
)
def tail_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of a document that fit a pattern and none of the exceptions go to a stream of their own; body and tail joined again give the document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("lines", F.split("t", "\n"))
    fits = lambda x: x.rlike("[.!?]$") & ~x.rlike("^(The|Licensed|See) ")
    d = d.withColumn("k", F.aggregate("lines", F.lit(0), lambda acc, x: F.when(fits(x), acc + 1).otherwise(F.lit(0))))
    n = F.size("lines") - F.col("k")
    part = lambda lo, size: F.when(size > 0, F.slice("lines", lo, size)).otherwise(F.array().cast("array<string>"))
    d = d.select("doc_id", "t", part(F.lit(1), n).alias("body"), part(n + 1, F.col("k")).alias("tail"))
    back = F.array_join(F.concat("body", "tail"), "\n")
    return d.select("doc_id", F.size("body").cast("bigint").alias("n_body"), F.size("tail").cast("bigint").alias("n_tail"), F.md5(F.encode(F.array_join("tail", "\n"), "utf-8")).alias("tail_md5"), (back == F.col("t")).alias("ok"))


@query(
    "header_and_body",
    """
WITH t AS (SELECT page_id, coalesce(html, '') AS h, strpos(coalesce(html, ''), '<title>') AS a FROM pages), u AS (SELECT *, CASE WHEN a > 0 THEN strpos(substr(h, a + 7), '</title>') ELSE 0 END AS n FROM t)
SELECT page_id, CASE WHEN n > 0 THEN substr(h, a + 7, n - 1) END AS title, regexp_extract(h, '<html lang="([a-z]*)"', 1) AS lang, CAST(length(h) - greatest(0, n - 1) AS BIGINT) AS n_body, true AS ok FROM u
""",
)
def header_and_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and language of a page as columns, the rest as its body; put back at its place, the title makes the page."""
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("h")).withColumn("a", F.instr("h", "<title>"))
    p = p.withColumn("n", F.when(F.col("a") > 0, F.instr(F.expr("substr(h, a + 7)"), "</title>")).otherwise(0))
    title = F.when(F.col("n") > 0, F.expr("substr(h, a + 7, n - 1)"))
    body = F.when(F.col("n") > 0, F.concat(F.expr("substr(h, 1, a + 6)"), F.expr("substr(h, a + 6 + n)"))).otherwise(F.col("h"))
    p = p.select("page_id", "h", "a", "n", title.alias("title"), body.alias("body"), F.regexp_extract("h", '<html lang="([a-z]*)"', 1).alias("lang"))
    back = F.when(F.col("n") > 0, F.concat(F.expr("substr(body, 1, a + 6)"), "title", F.expr("substr(body, a + 7)"))).otherwise(F.col("body"))
    return p.select("page_id", "title", "lang", F.length("body").cast("bigint").alias("n_body"), (back == F.col("h")).alias("ok"))


LINES_SQL = "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY doc_id, p) - 1 AS number FROM l)"


def numbered_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p (from 1 in the document), n_chars of the line, number (from 0 over all documents). Lines are put in order by their lengths alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.length).alias("sizes"))
    d = ordered(d, "doc_id", add=F.size("sizes"))
    return d.select("doc_id", "before", F.posexplode("sizes").alias("i", "n_chars")).select("doc_id", (F.col("i") + 1).alias("p"), "n_chars", (F.col("before") + F.col("i")).alias("number"))


@query(
    "line_ranges",
    LINES_SQL + ", t AS (SELECT count(*) AS t FROM n) SELECT CASE WHEN number < 29 THEN 'intro' WHEN number >= t - 100 THEN 'coda' ELSE 'main' END AS part, count(*) AS n_lines, min(number) AS first, max(number) AS last, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM n, t GROUP BY 1",
)
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines by their number: the first 29, the last 100, and what is between. Numbers tell where each part goes back."""
    n = numbered_lengths(spark, sf_dir)
    total = n.agg(F.max("number").alias("top"))  # one row
    part = F.when(F.col("number") < 29, "intro").when(F.col("number") >= F.col("top") - 99, "coda").otherwise("main")
    return n.crossJoin(total).groupBy(part.alias("part")).agg(F.count("*").alias("n_lines"), F.min("number").alias("first"), F.max("number").alias("last"), F.sum("n_chars").alias("n_chars"))


@query(
    "article_index",
    """
WITH d AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) + 3 AS n FROM documents)
SELECT doc_id AS id, CAST(sum(n) OVER w - n AS BIGINT) AS first_line, CAST(sum(n) OVER w - 1 AS BIGINT) AS last_line FROM d WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)
""",
)
def article_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a stream of articles (a line that opens one, its id, its text, a line that closes it) parsed back into (id, first line, last line)."""
    marks = "^(<page>|</page>|<id>.*</id>)$"
    own = F.split(F.coalesce("text", F.lit("")), "\n")
    # a text line that looks like the stream's own is marked, so that the parser takes it for text
    own = F.transform(own, lambda x: F.when(x.rlike(marks), F.concat(F.lit(MARK), x)).otherwise(x))
    lines = F.concat(F.array(F.lit("<page>"), F.concat(F.lit("<id>"), F.col("doc_id").cast("string"), F.lit("</id>"))), own, F.array(F.lit("</page>")))
    # lines that tell the parser nothing are counted, but neither sorted nor written
    telling = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: x.line.rlike(marks))
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").alias("n"), telling.alias("told"))
    d = ordered(d, "doc_id", add=F.col("n"))
    stream = d.select(F.col("before").alias("b"), F.inline("told")).select((F.col("b") + F.col("i")).alias("number"), "line")
    # the parser sees numbers and lines alone: the articles opened so far tell which one a line belongs to
    s = ordered(stream.withColumn("opens", F.when(F.col("line") == "<page>", 1).otherwise(0)), "number", add=F.col("opens"))
    s = s.withColumn("article", F.col("before") + F.col("opens"))
    found = F.regexp_extract("line", "^<id>(-?[0-9]+)</id>$", 1)
    g = s.groupBy("article").agg(F.min_by(F.when(found != "", found), F.when(found != "", F.col("number"))).cast("bigint").alias("id"), F.min("number").alias("first_line"), F.max(F.when(F.col("line") == "</page>", F.col("number"))).alias("last_line"))
    return g.select("id", "first_line", "last_line")


@query("restored_order", "SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS shuffled, row_number() OVER (ORDER BY doc_id) - 1 AS restored FROM documents")
def restored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of a hash, and back in that of their ids, each with both places."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(F.col("doc_id").cast("string"), "utf-8")).alias("h"))
    shuffled = ordered(d, "h").select("doc_id", F.col("pos").alias("shuffled"))
    return ordered(shuffled, "doc_id").select("doc_id", "shuffled", F.col("pos").alias("restored"))


def utf8_hex(cp: Column) -> Column:
    """The UTF-8 bytes of a code point in hexadecimal digits, by arithmetic."""
    tail = lambda k: 128 + F.shiftright(cp, 6 * k).bitwiseAND(63)
    two = F.format_string("%02X%02X", 192 + F.shiftright(cp, 6), tail(0))
    three = F.format_string("%02X%02X%02X", 224 + F.shiftright(cp, 12), tail(1), tail(0))
    four = F.format_string("%02X%02X%02X%02X", 240 + F.shiftright(cp, 18), tail(2), tail(1), tail(0))
    return F.when(cp < 128, F.format_string("%02X", cp)).when(cp < 2048, two).when(cp < 65536, three).otherwise(four)


@query(
    "code_points",
    "WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) SELECT c, unicode(c) AS code_point, strlen(c) AS n_bytes, hex(encode(c)) AS utf8 FROM c WHERE c <> ''",
)
def code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of all texts: code point, length by the first byte, and bytes worked out from the code point."""
    c = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).filter("c <> ''").distinct()
    lead = F.conv(F.substring(F.hex(F.encode("c", "utf-8")), 1, 2), 16, 10).cast("int")
    size = F.when(lead < 0x80, 1).when(lead < 0xE0, 2).when(lead < 0xF0, 3).otherwise(4)
    return c.select("c", F.ascii("c").alias("code_point"), size.alias("n_bytes"), utf8_hex(F.ascii("c")).alias("utf8"))


@query("number_lengths", r"SELECT event_id, CAST(length(regexp_extract(substr(props, 7), '^([0-9]+)\}', 1)) AS INT) AS n_digits FROM events")
def number_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits up to the closing brace in the properties of an event; 0 where something else comes first."""
    return table(spark, sf_dir, "events").select("event_id", F.length(F.regexp_extract(F.expr("substr(props, 7)"), r"^([0-9]+)\}", 1)).alias("n_digits"))
