import sys

import pytest
from pyspark.sql import functions as F

from turnloom import chatml, get_template, to_content, zephyr
from turnloom.functions.chat import render_prompt
from turnloom.functions.strings import PYTHON_WHITESPACE, strip, strip_newlines

MESSAGES = "messages array<struct<role:string,content:string>>"
HI_YO = [("user", "Hi"), ("assistant", "Yo")]


def render(spark, messages, template, **kwargs):
    df = spark.createDataFrame([(messages,)], MESSAGES)
    return to_content(df, template, **kwargs).head()["content"]


@pytest.mark.parametrize(
    "messages, template, prompt, expected",
    [
        (HI_YO, "chatml", False, "user\nHi\nassistant\nYo\n"),
        (HI_YO, "chatml", True, "user\nHi\nassistant\nYo\nassistant\n"),
        ([("tool", "x")], "chatml", False, "tool\nx\n"),
        ([("user", " Hi ")], "chatml", False, "user\n Hi \n"),
        (HI_YO, "zephyr", False, "\nHi</s>\n\nYo</s>\n"),
        (HI_YO, "zephyr", True, "\nHi</s>\n\nYo</s>\n\n"),
        ([("tool", "x"), ("user", "Hi")], "zephyr", False, "\nHi</s>\n"),
        ([("tool", None), ("user", "Hi")], "zephyr", False, "\nHi</s>\n"),
        ([("system", "s")], "zephyr", False, "\ns</s>\n"),
    ],
)
def test_golden(spark, messages, template, prompt, expected):
    assert render(spark, messages, template, generation_prompt=prompt) == expected


def test_published_markers_can_be_given(spark):
    template = chatml("<|im_start|>", "<|im_end|>")
    assert render(spark, HI_YO, template, generation_prompt=True) == (
        "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nYo<|im_end|>\n<|im_start|>assistant\n"
    )
    template = zephyr("<|user|>", "<|assistant|>", "<|system|>")
    assert render(spark, HI_YO, template, generation_prompt=True) == (
        "<|user|>\nHi</s>\n<|assistant|>\nYo</s>\n<|assistant|>\n"
    )


def test_special_tokens():
    assert get_template("zephyr").special_tokens == ["", "</s>", "<s>", "<pad>"]
    assert get_template("chatml").special_tokens == [
        "user", "assistant", "system", "", "<s>", "<pad>",
    ]
    assert get_template("chatml").tokens["pad"] == "<pad>"


def test_template_lookup():
    assert get_template("none") is None
    with pytest.raises(ValueError, match="unknown chat template 'own'"):
        get_template("own")


def test_messages_as_maps(spark):
    df = spark.createDataFrame(
        [([{"role": "user", "content": "Hi"}],)], "messages array<map<string,string>>"
    )
    assert to_content(df, "chatml").head()["content"] == "user\nHi\n"


def test_strip_is_python_strip(spark):
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and i != 0]
    expected = [c for c in chars if c.strip() == ""]
    assert sorted(PYTHON_WHITESPACE) == expected
    texts = [f"{c}a{c}b{c}" for c in chars if ord(c) < 0x3100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", strip(F.col("t")).alias("s")).collect():
        assert row["s"] == row["t"].strip()


def test_strip_newlines(spark):
    texts = ["\n a \n\n", "\r\na\n", "", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strip_newlines(F.col("t"))).collect()]
    assert got == [t.strip("\n") for t in texts]


def test_prompt(spark):
    df = spark.createDataFrame([(" Hi",)], "t string")
    chat = df.select(render_prompt(F.col("t"), chatml()).alias("p")).head()["p"]
    assert chat == "user\n Hi\nassistant\n"
    assert df.select(render_prompt(F.col("t"), zephyr()).alias("p")).head()["p"] == "\n Hi</s>\n\n"
    null = df.select(render_prompt(F.lit(None).cast("string"), chatml()).alias("p"))
    with pytest.raises(Exception, match="NULL text"):
        null.collect()
