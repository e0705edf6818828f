"""Word classes: known stems, classes in sentences, words after articles, superlatives.

Defined results: a null text counts as empty and has no words.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import stemmer
from corpusloom.operators.contexts import TYPES
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

# words and their stems, worked out by hand from the published rules
KNOWN = (
    ("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consignment", "consign"), ("consist", "consist"),
    ("consistency", "consist"), ("consistently", "consist"), ("consolation", "consol"), ("consolations", "consol"), ("conspicuously", "conspicu"),
    ("knightly", "knight"), ("knocked", "knock"), ("kneeling", "kneel"), ("knaves", "knave"), ("knives", "knive"),
    ("quickly", "quick"), ("adoption", "adopt"), ("adoptions", "adopt"), ("sky", "sky"), ("skies", "sky"),
    ("proceed", "proceed"), ("proceeds", "proceed"), ("dying", "die"), ("happy", "happi"), ("happiness", "happi"),
    ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("operator", "oper"),
    ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("callousness", "callous"), ("formality", "formal"),
    ("sensitivity", "sensit"), ("sensibility", "sensibl"), ("analogy", "analog"), ("triplicate", "triplic"), ("formative", "format"),
    ("formalize", "formal"), ("electricity", "electr"), ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"),
    ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"),
    ("replacement", "replac"), ("dependent", "depend"), ("communism", "communism"), ("activate", "activ"), ("effective", "effect"),
    ("rate", "rate"), ("cease", "ceas"), ("controlling", "control"), ("rolling", "roll"), ("hopping", "hop"),
    ("hoping", "hope"), ("bled", "bled"), ("agreed", "agre"), ("feed", "feed"), ("ties", "tie"),
    ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("caresses", "caress"),
    ("generate", "generat"), ("general", "general"), ("communication", "communic"), ("yes", "yes"), ("boy", "boy"),
)
VALUES = ", ".join(f"('{w}', '{s}')" for w, s in KNOWN)


@query("known_stems", f"SELECT * FROM (VALUES {VALUES}) t(word, stem)")
def known_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of a list of words, against the list of what they should be."""

    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(lambda w: stemmer.stem(w)[0])

    return spark.createDataFrame([(w,) for w, _ in KNOWN], "word string").select("word", stems("word").alias("stem"))


@query("word_classes")
def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words and occurrences of each class of the English texts; the function runs once a distinct word."""

    @F.pandas_udf("int")
    def number(s: pd.Series) -> pd.Series:
        return s.map(stemmer.class_number).astype("int32")

    words = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w"))
    words = words.groupBy("w").agg(F.count("*").alias("n")).withColumn("class", number("w"))
    return words.groupBy("class").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"))


KIND_SQL = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in ws)}) THEN '{t}'" for t, ws in TYPES.items()) + " WHEN before IN ('a', 'an', 'the') THEN 'noun' ELSE 'other' END"


@query(
    "sentence_word_kinds",
    f"""
WITH t AS (SELECT row_number() OVER () AS doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM t),
l AS (SELECT w, lag(w) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM x)
SELECT {KIND_SQL} AS kind, count(*) AS n FROM l GROUP BY 1
""",
)
def sentence_word_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by kind, those right after an article as nouns. Each text gives counts of its own; words aren't exploded."""
    ws = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), 0)

    def kind(w, before):  # noqa: ANN001, ANN202
        out = None
        for t, own in TYPES.items():
            out = F.when(w.isin(*own), t) if out is None else out.when(w.isin(*own), t)
        return out.when(before.isin("a", "an", "the"), "noun").otherwise("other")

    d = table(spark, sf_dir, "documents").select(ws.alias("ws")).filter(F.size("ws") > 0)
    pairs = F.arrays_zip(F.col("ws").alias("w"), F.concat(F.array(F.lit("")), F.slice("ws", 1, F.size("ws") - 1)).alias("b"))
    kinds = d.select(F.transform(pairs, lambda x: kind(x.w, x.b)).alias("k"))

    def row(name):  # noqa: ANN001, ANN202
        return F.struct(F.lit(name).alias("kind"), F.size(F.filter("k", lambda x: x == name)).cast("bigint").alias("n"))

    each = kinds.select(F.inline(F.array(*[row(n) for n in (*TYPES, "noun", "other")])))
    return each.groupBy("kind").agg(F.sum("n").alias("n")).filter("n > 0")


@query(
    "last_of_each_type",
    """
WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM conversations)
SELECT conv_id, turn, list_filter(ws, lambda w: w IN ('is', 'was', 'be', 'are', 'were', 'has', 'have', 'had'))[-1] AS last_verb, list_filter(ws, lambda w: w IN ('the', 'a', 'an'))[-1] AS last_article,
       list_filter(ws, lambda w: w IN ('of', 'in', 'to', 'for', 'on', 'with', 'at', 'by', 'from'))[-1] AS last_preposition FROM t
""",
)
def last_of_each_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of some classes in each turn; null without one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("ws"))
    last = lambda t: F.try_element_at(F.filter("ws", lambda w: w.isin(*TYPES[t])), F.lit(-1)).alias(f"last_{t}")
    return c.select("conv_id", "turn", last("verb"), last("article"), last("preposition"))


@query(
    "words_outside_brackets",
    r"SELECT page_id, CAST(len(regexp_extract_all(html, '[A-Za-z]+')) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '[A-Za-z]+')) AS BIGINT) AS n_outside FROM pages",
)
def words_outside_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page, and those left when tags and parenthesised spans are dropped."""
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0)).cast("bigint")
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\([^)]*\)", " ")
    return table(spark, sf_dir, "pages").select("page_id", count("html").alias("n_words"), count(plain).alias("n_outside"))


@query(
    "word_surroundings",
    r"""
WITH t AS (SELECT unnest(regexp_extract_all(text, '(^|[^A-Za-z])([A-Za-z]+)', 0)) AS m FROM documents)
SELECT CASE WHEN regexp_full_match(m[1], '[A-Za-z]') THEN 'start' WHEN m[1] IN (' ', chr(10)) THEN 'blank' WHEN unicode(m[1]) < 128 THEN 'mark' ELSE 'other' END AS before,
       regexp_matches(m, '[A-Z][a-z]*$') AND NOT regexp_matches(m, '[A-Z]{2}') AS capital, count(*) AS n FROM t GROUP BY ALL
""",
)
def word_surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by what stands before them and whether one capital begins them."""
    m = F.explode(F.regexp_extract_all("text", F.lit("(^|[^A-Za-z])([A-Za-z]+)"), 0)).alias("m")
    t = table(spark, sf_dir, "documents").select(m).withColumn("c", F.substring("m", 1, 1))
    before = F.when(F.col("c").rlike("[A-Za-z]"), "start").when(F.col("c").isin(" ", "\n"), "blank").when(F.ascii("c") < 128, "mark").otherwise("other")
    capital = F.col("m").rlike("[A-Z][a-z]*$") & ~F.col("m").rlike("[A-Z]{2}")
    return t.groupBy(before.alias("before"), capital.alias("capital")).agg(F.count("*").alias("n"))


@query(
    "superlatives",
    r"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en') SELECT w AS word, count(*) AS n FROM w WHERE length(w) >= 6 AND w LIKE '%est' GROUP BY w",
)
def superlatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words that end like superlatives."""
    w = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return w.filter((F.length("word") >= 6) & F.endswith("word", F.lit("est"))).groupBy("word").agg(F.count("*").alias("n"))
