"""Queries over documents with null ids and texts, empty texts, a repeated row and odd characters, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from corpusloom.plans import registry
from tests.compare import same_rows

registry.load()

ROWS = [
    (5, "The cat sat.\nThe cat sat on the mat.", "en", "a", 37),
    (7, None, "en", "a", None),
    (9, "", "de", "b", 0),
    (None, "Null id text. It ends\nhere!", "en", None, 27),
    (12, " private é ü 漢 9A_", "fr", "b", 20),
    (400_000_000_000, "the the the cat the cat " * 50, "en", "c", 1200),
    (12, " private é ü 漢 9A_", "fr", "b", 20),
    (13, "ab\x1b\n\n\nx. y!", "es", "c", 11),
    (14, "x" * 9000, "es", "c", 9000),
]
#: Queries that promise to treat each row on its own, or all of them in one order.
NAMES = (
    "char_vocab_by_lang", "byte_histogram", "absent_bytes", "vocab_index", "order0_entropy_by_lang", "adaptive_order1_bits", "bytes_since_newline", "byte_class_stream", "train_val_split", "boundary_checks",
    "next_fit_pieces", "next_fit_packing", "micro_batch_groups", "payload_checkpoints", "tail_split", "column_above", "word_context_hits", "context_distance", "merged_documents", "document_indices",
    "loss_overall_and_by_source", "line_ranges", "article_index", "code_points", "dictionary_codes", "word_surroundings", "sentence_word_kinds", "alphabet_set_operations", "dictionary_roundtrip", "codec_roundtrip",
)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_awkward_documents(spark, awkward, name):
    folder, con = awkward
    same_rows(registry.QUERIES[name](spark, folder), con, registry.ORACLES[name])
