from __future__ import annotations

import duckdb

from corpusloom.plans import registry
from tests.compare import same_rows

registry.load()
ITEM = "one two three four five six seven eight nine"


def test_containment_of_odd_documents_in_one_reading(spark, tmp_path):
    docs = [(1, ITEM), (1, ITEM), (None, "x " + ITEM.upper() + " é y"), (None, "a b c d e f g h"), (2, None), (3, ""), (4, "seven words are not enough for grams"), (5, " ".join(["again"] * 30))]
    items = [(1, ITEM), (2, ITEM + " ten"), (3, None), (4, "again " * 8)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.QUERIES["benchmark_containment"](spark, str(tmp_path))
    same_rows(got, con, registry.ORACLES["benchmark_containment"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1, plan
