"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, decontamination, packing.

Each stage gets all rows that its predecessor kept, written as Parquet and read
again; all but the last return the columns of ``documents`` in their order. Texts, not
scores, go on: a stage's decisions take effect by dropping rows.

Defined results, for each stage:

* null text: no evidence of toxicity, no word for the join or the benchmark, so it
  stays there; as an empty text it is a copy of the texts of blanks alone; packed as
  the end id alone;
* null doc_id: a row like any other; it loses against any id among copies;
* empty and very long texts: read whole, never cut but by packing into pieces;
* ties and repeated rows: of rows alike in id and text one stays after exact dedup;
* empty table: an empty result;
* extra columns pass through the first four stages, whatever their names, those of the
  operators' results (``predicted``, ``score``, ``kept``, ``contaminated`` ...) included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import toxicity as tox
from corpusloom.llm.common import learn_rows, table
from corpusloom.llm.decontam import decontaminate
from corpusloom.llm.exact_dedup import content_sort_dedup
from corpusloom.llm.ngram_join import near_dedup
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.queries import tokenizer_path
from corpusloom.session import materialize


def keep(found: DataFrame, which: Column, docs: DataFrame) -> DataFrame:
    """Rows of ``found`` that pass, with the columns of ``docs``; an operator gives the carried columns first, renamed where they clash with its results."""
    return found.filter(which).select(*found.columns[: len(docs.columns)]).toDF(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    lex = tox.learn_lexicon(docs, table(spark, sf_dir, "labels"), learn_rows("doc_id", 4, 2))
    return keep(tox.score_toxicity(docs, lex, carry=docs.columns), F.col("predicted") == 0, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return keep(content_sort_dedup(docs, carry=docs.columns), F.col("kept"), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return keep(decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns), ~F.col("contaminated"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: A learned classifier and a tokenizer aren't SQL; tests compare the stages after the classifier with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
