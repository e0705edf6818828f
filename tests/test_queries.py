from __future__ import annotations

import pytest

from corpusloom.plans import registry
from tests.compare import same_rows

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLES[name])


def test_codec_sizes(spark, sf_dir):
    from corpusloom.operators.codec import decode_documents, encode_documents
    from corpusloom.sources.tables import table

    docs = table(spark, sf_dir, "documents").filter("length(text) < 3000")
    coded = encode_documents(docs)
    back = {r.doc_id: r.text for r in decode_documents(coded).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    rows = coded.collect()
    assert sum(len(r.payload) for r in rows) < 0.75 * sum(r.raw_len for r in rows)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
