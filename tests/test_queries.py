import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from oracle import difference

ROOT = Path(__file__).resolve().parent.parent
SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", contract.library_queries())
def test_query_agrees_with_oracle(spark, name):
    assert difference(spark, name, SF_DIR) is None


def test_every_query_has_an_oracle():
    assert contract.library_queries().keys() <= contract.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_contract_without_the_corpus_operators():
    """The entry module and the rest of the library do without their subpackage."""
    hidden = "import sys; sys.modules['turnloom.llm'] = sys.modules['corpus_pipeline'] = None"
    listed = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.library_queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", f"{hidden}; {listed}"], cwd=ROOT, capture_output=True, text=True)
    assert said.stdout.split() == ["True", str(len(contract.library_queries()))], said.stderr


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["conv_id", "part", "content"]
    assert rows.count() > 0


def test_tables_are_spread_by_their_size(spark, tmp_path):
    """A fixed number of tasks would give each more of a larger table."""
    small, large = spark.range(100), spark.range(0, 5000, 1, 40)
    large.write.parquet(str(tmp_path / "large"))
    small.coalesce(1).write.parquet(str(tmp_path / "small"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        few, many = (contract._spread(spark.read.parquet(str(tmp_path / n)), 3) for n in ("small", "large"))
        assert few.rdd.getNumPartitions() == 3 and many.rdd.getNumPartitions() >= 10
        assert sorted(r["id"] for r in many.collect()) == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip_writes_with_more_tasks_for_more_rows(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs.repartition(40).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    written = []
    monkeypatch.setattr(contract.tl, "write_saved_split", lambda df, *_: written.append(df.rdd.getNumPartitions()))
    monkeypatch.setattr(contract.tl, "load_saved_split", lambda *_, **__: docs)
    try:
        contract.saved_round_trip(spark, str(tmp_path))
        contract.saved_round_trip(spark, SF_DIR)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert written[0] > 3 and written[1] >= 3
