import pytest
from pyspark.sql import functions as F

from brute import ODD_TEXTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The small documents and odd ones: repeated rows, repeated ids, NULLs, clashing columns."""
    odd = [(100_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    odd += [(100_005, "another text of a repeated id"), odd[8], odd[8], (None, ODD_TEXTS[8]), (None, None)]
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumn(
        "source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("odd"), F.col("doc_id") % 3))
    )
    clash = ("key", "size", "fp", "line", "pos", "n", "start", "bucket", "n_lines", "kept", "words", "_row", "lines")
    both = small.unionByName(extra).select("*", *[F.lit("clash").alias(c) for c in clash])
    return both.repartition(5).cache()


@pytest.fixture(scope="session")
def doc_rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
