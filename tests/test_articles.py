from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import articles as A

HARD = ["", "\x04\x04e\x05", "&amp;#8212;&amp;#65;&amp;#55296;&amp;#0400;&amp;#1114112;", "&amp;nbsp;\x04b&amp;amp;quot;", "\x05—&amp;#300", "é&amp;lt;&amp;gt;x"]


@pytest.mark.parametrize("text", HARD)
def test_code_points_come_back(text):
    assert A.char_to_code(A.code_to_char(text)) == text
    assert A.code_to_char("&amp;#8212;") == "\x05—" and A.code_to_char("&amp;#65;") == "&amp;#65;"


def test_named_entities_come_back(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    assert all(r.t == r.b for r in df.select("t", A.twice_escaped(A.twice_unescaped(F.col("t"))).alias("b")).collect())


def test_articles_whose_text_looks_like_the_stream(spark, tmp_path):
    import duckdb

    from corpusloom.plans import registry
    from tests.compare import same_rows

    registry.load()
    rows = [(3, "<page>\n<id>77</id>\na\n</page>"), (-5, "</page>\nb"), (4, None), (9, "<page>"), (11, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("article_index", "line_ranges"):
        same_rows(registry.QUERIES[name](spark, str(tmp_path)), con, registry.ORACLES[name])


def test_texts_are_not_sorted_with_the_articles(spark, sf_dir, monkeypatch):
    seen = []
    plain = A.ordered
    monkeypatch.setattr(A, "ordered", lambda df, *args, **more: seen.append(df) or plain(df, *args, **more))
    A.article_index(spark, sf_dir)
    assert max(seen[0].select(F.aggregate("told", F.lit(0), lambda a, x: a + F.length(x.line)).alias("n")).toPandas()["n"]) < 40
    assert seen[1].count() == 3 * seen[0].count()
