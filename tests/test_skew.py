"""The queries on tables where one key, or one row, makes up a third of all rows."""

from pathlib import Path

import duckdb
import pytest

from oracle import difference

SF_DIR = "/root/testdata/sf0.01"

# The replaced columns of each table; the last ones make hot rows equal as a whole.
SKEWED = {
    "conversations": {"conv_id": "CASE WHEN hash(conv_id, turn) % 3 = 0 THEN 5 ELSE conv_id END"},
    "documents": {
        "doc_id": "CASE WHEN hash(doc_id) % 3 = 0 THEN 500 ELSE doc_id END",
        "text": "CASE WHEN hash(doc_id) % 6 = 0 THEN 'the same   text' ELSE text END",
    },
    "labels": {"quality": "CASE WHEN hash(doc_id) % 3 = 0 THEN 1 ELSE quality END"},
    "orders": {
        "o_orderkey": "CASE WHEN hash(o_orderkey) % 3 = 0 THEN 4000 ELSE o_orderkey END",
        "o_custkey": "CASE WHEN hash(o_orderkey) % 3 = 0 THEN 1 ELSE o_custkey END",
    },
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for file in Path(SF_DIR).glob("*.parquet"):
        changes = [f"{value} AS {name}" for name, value in SKEWED.get(file.stem, {}).items()]
        columns = f"* REPLACE ({', '.join(changes)})" if changes else "*"
        duckdb.sql(f"COPY (SELECT {columns} FROM '{file}') TO '{folder / file.name}'")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "messages_chatml_genprompt", "messages_json_quarantine", "messages_in_parts", "qa_chatml",
        "qa_in_parts", "first_n_many", "holdout_split", "holdout_without_key", "sft_holdout",
        "length_statistics", "pack_wrapped", "pack_ids",
    ],
)
def test_query_on_skewed_tables(spark, skewed, name):
    assert difference(spark, name, skewed) is None
