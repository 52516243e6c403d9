"""The operators' queries with SQL against DuckDB, and the thin queries' columns."""

from collections import Counter

import duckdb
import pytest

from lexloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = Counter(map(tuple, got.select(*names).collect()))
    assert rows == Counter(want.fetchall()) and rows


def test_digest_columns(spark):
    kinds = {
        "op11_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
        "op12_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op13_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    }
    for name, want in kinds.items():
        assert ", ".join(map(" ".join, queries.QUERIES[name](spark, SF).dtypes)) == want
