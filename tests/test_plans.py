"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as contract
import turnloom as tl

SF_DIR = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = [
    name for name in contract.library_queries()
    if not name.startswith(("batch_infer", "results", "tokenise_ids", "load_", "prompt"))
]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "PythonUDF",
                     "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD"):
        assert operator not in text, operator


@pytest.mark.parametrize(
    "name", ["text_passthrough", "text_field", "sft_holdout", "holdout_split", "sft_test_split",
             "prompt_build", "truncate_tokens", "reasoning_split_ids", "reasoning_split_text"]
)
def test_row_wise_plans_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(contract.queries()[name](spark, SF_DIR))


def test_only_the_needed_columns_are_read(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert "ReadSchema: struct<text:string>" in plan(tl.to_content(docs))
    train, _ = tl.holdout(docs.select("doc_id"), "doc_id")
    assert "ReadSchema: struct<doc_id:bigint>" in plan(train)


def test_first_n_is_a_top_k(spark):
    text = plan(contract.queries()["first_n"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_many_first_rows_are_a_filter(spark):
    text = plan(contract.queries()["first_n_many"](spark, SF_DIR))
    assert "Exchange" not in text and "Limit" not in text and "LessThan(o_orderkey" in text


def test_one_python_stage_for_generation_and_one_for_decoding(spark):
    prompts = tl.build_prompts(spark.read.parquet(f"{SF_DIR}/documents.parquet"), ["doc_id"])
    assert plan(tl.generate(prompts, contract._text_generator)).count("MapInArrow") == 1
    ids = tl.generate(prompts, contract._id_generator, returns="ids")
    assert plan(ids).count("MapInArrow") == 1
    raw = spark.createDataFrame([], ids.schema)
    assert plan(tl.parse_ids(raw, contract._id_decoder)).count("MapInArrow") == 1


def test_messages_need_one_shuffle(spark):
    text = plan(contract.queries()["messages_chatml"](spark, SF_DIR))
    assert text.count("Exchange") == 1
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in text


def test_pairs_need_one_shuffle(spark):
    assert plan(contract.queries()["qa_chatml"](spark, SF_DIR)).count("Exchange") == 1


def test_windows_are_partitioned(spark):
    """Only the few bucket totals are summed in one task, never the rows."""
    text = plan(contract.queries()["pack_wrapped"](spark, SF_DIR))
    singles = re.findall(r"Exchange SinglePartition.*\n.*HashAggregate\(keys=\[bucket", text)
    assert len(singles) == text.count("SinglePartition")


def test_packing_shuffles_the_text_once(spark):
    blocks = contract.queries()["pack_wrapped"](spark, SF_DIR)
    blocks.collect()
    text = plan(blocks)
    final = text[: text.index("== Initial Plan ==")]
    assert "ReusedExchange" in final
