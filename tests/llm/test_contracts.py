"""What the registered queries return, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "source", "copy"},
    "op2": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op3": {"page_id", "host", "path", "rule", "verdict"},
    "op4": {"page_id", "url", "text", "n_chars"},
    "op5": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op6": {"doc_id", "fingerprint", "component_id"},
    "op7": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op8": {"query_id", "rank", "vec_id", "score"},
    "op9": {"doc_id", "language", "keep"},
    "op10": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op11": {"sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate"},
    "op12": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op13": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns_and_rows(spark, number):
    from strata.llm.registry import queries

    name, query = next((n, q) for n, q in queries().items() if n.startswith(f"{number}_"))
    df = query(spark, SF)
    kinds = dict(df.dtypes)
    assert COLUMNS[number] <= set(kinds), name
    assert all(kinds[c] == "bigint" for c in kinds if c in ("doc_id", "page_id", "vec_id", "query_id", "n_bytes", "n_removed", "n_spans", "n_chars", "payload_bytes", "tail_crc32", "media_bytes", "component_id", "start", "length", "ids_crc32", "sequence_id", "offset", "n_lines", "n_dropped", "error", "label_error", "n_tokens") or number == "op11")
    assert all(kinds[c] == "int" for c in kinds if c in ("piece", "rank"))
    assert number != "op8" or kinds["score"] == "bigint"
    one_each = {"op2": "documents", "op3": "pages", "op4": "pages", "op5": "documents", "op6": "documents", "op9": "documents", "op10": "documents", "op12": "embeddings", "op13": "documents"}
    n = df.count()
    assert n == spark.read.parquet(f"{SF}/{one_each[number]}.parquet").count() if number in one_each else n > 0
