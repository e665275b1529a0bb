"""A corpus pipeline: quality, shared lines, near copies, mixture, tokens.

Each stage takes the table that its predecessor kept. ``run`` writes every stage's result
to the session's shared scratch folder and reads it back for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import bk_tree, decision_list, lines, pieces, queries, systematic
from turnloom.llm.common import table
from turnloom.plans.scratch import scratch_table

#: Learned rules, near copies and pieces have no SQL; tests compare with brute force.
ORACLE_SQL = None


def _own_name(name: str) -> str:
    """A name that no column of the documents has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned rules reject go.

    The rules are learned from the labelled ones among ``docs``.
    """
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    names = [f"`{c}`" for c in docs.columns]
    judged = decision_list.judge(docs.select(F.struct(*names).alias("_row"), "text"), rules)
    return judged.filter("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the one with the largest id only.

    ``n_chars``, where there is one, becomes the length of the new text.
    """
    had_text = _own_name("had_text")
    kept = lines.dedup_lines(docs.withColumn(had_text, F.col("text").isNotNull()))
    kept = kept.withColumn("text", F.when(F.col(had_text), F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select([f"`{c}`" for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Near copies have SimHash fingerprints of three-word shingles that differ in three bits or
    less, also through others.
    Rows without an id come after those with one, and rows with the same id are ordered by the
    md5 of their text, a NULL first. So every group leaves exactly one document, also where ids
    are missing or repeated. Of rows that repeat an id and its text one stays.
    """
    own = _own_name("document")
    document = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.md5("text").alias("mark"))
    marked = docs.withColumn(own, document)
    groups = bk_tree.near_duplicates(marked, key=own)
    stays = groups.filter(F.col(own) == F.col("component_id")).select(own).distinct()
    return marked.join(stays, own, "left_semi").dropDuplicates([own]).drop(own)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    mixed = systematic.mix(docs.withColumn("_row", F.struct(*[f"`{c}`" for c in docs.columns])), keep=["_row"])
    taken = mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("_row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, with a check that they decode to its text."""
    encoded = pieces.encode(docs, pieces.load_vocabulary(queries.VOCABULARY))
    return encoded.select("doc_id", "source", "n_tokens", "ids", "score", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
