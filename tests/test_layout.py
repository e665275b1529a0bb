import pytest
from pyspark.sql import functions as F

from turnloom import choose_layout, prepare_sft, to_content

TURNS = "array<struct<role:string,content:string>>"

# (JSON text, rendered as ChatML or None, rendered as Zephyr or None)
JSON_CASES = [
    ('[{"role":"user","content":"x"}]', "user\nx\n", "\nx</s>\n"),
    (' \n[{"role":"user","content":"x","score":1.5}]\t', "user\nx\n", "\nx</s>\n"),
    ('[{"content":"a\\n\\u00e9","role":"tool"}]', "tool\na\né\n", ""),
    ('[{"role":"user","content":"a","content":"b"}]', "user\nb\n", "\nb</s>\n"),
    ('[{"role":"user","content":"x","score":NaN}]', "user\nx\n", "\nx</s>\n"),
    ('[{"role":"user","content":"see [1], \\"two\\""}]', 'user\nsee [1], "two"\n', '\nsee [1], "two"</s>\n'),
    ('[{"role":"tool","content":null}]', None, ""),
    ('[{"role":"user","content":null}]', None, None),
    ('[{"role":"user"}]', None, None),
    ('[{"role":"user","content":5}]', None, None),
    ('[{"role":"user","content":["x"]}]', None, None),
    ('[{"role":"user","content":"x"}] rest', None, None),
    ('[{"role":"user","content":"x"}] [1]', None, None),
    ('[{"role":"user","content":"x"}],"more":[2]', None, None),
    ('[{"role":"user","content":"x"}],[]', None, None),
    ('[{"role":"user","content":"x"}]]', None, None),
    ('[[{"role":"user","content":"x"}]]', None, None),
    ('[{"role":"user","content":"x"}]}', None, None),
    ('[{"role":"user","content":"x"},]', None, None),
    ("[{'role':'user','content':'x'}]", None, None),
    ('{"role":"user","content":"x"}', None, None),
    ("[1]", None, None),
    ("[]", None, None),
    ("null", None, None),
    ("not json", None, None),
    ("", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("template, column", [("chatml", 1), ("zephyr", 2)])
def test_json_messages(spark, template, column):
    df = spark.createDataFrame(
        [(i, case[0]) for i, case in enumerate(JSON_CASES)], "id int, messages string"
    )
    rows = to_content(df, template, key=["id"], on_error="quarantine").orderBy("id").collect()
    assert [r["content"] for r in rows] == [case[column] for case in JSON_CASES]
    assert [r["error"] is None for r in rows] == [case[column] is not None for case in JSON_CASES]


def test_bad_json_raises_by_default(spark):
    df = spark.createDataFrame([("not json",)], "messages string")
    with pytest.raises(Exception, match="messages is not a non-empty JSON array"):
        to_content(df, "chatml").collect()


@pytest.mark.parametrize(
    "messages", [None, [], [("user", None)], [(None, "x")], [("user", "x"), None]]
)
def test_bad_arrays_raise(spark, messages):
    df = spark.createDataFrame([(messages,)], f"messages {TURNS}")
    with pytest.raises(Exception, match="null, empty, or has a null role or content"):
        to_content(df, "chatml").collect()


@pytest.mark.parametrize(
    "question, answer, template, expected",
    [
        ("  Hi\t", "\u001cYo\n", "chatml", "user\nHi\nassistant\nYo\n"),
        (None, "Yo", "chatml", "user\n\nassistant\nYo\n"),
        ("Hi", None, "zephyr", "\nHi</s>\n\n</s>\n"),
    ],
)
@pytest.mark.parametrize("names", [("question", "answer"), ("dialogue", "soap")])
def test_pairs(spark, names, question, answer, template, expected):
    df = spark.createDataFrame([(question, answer)], f"{names[0]} string, {names[1]} string")
    assert to_content(df, template).head()["content"] == expected


def test_pair_columns_must_be_strings(spark):
    df = spark.createDataFrame([(1, "a")], "question int, answer string")
    with pytest.raises(TypeError, match="question must be a string"):
        to_content(df, "chatml")


@pytest.mark.parametrize(
    "kind",
    [
        "array<int>", "array<struct<role:string>>", "array<struct<role:string,content:int>>",
        "array<map<string,int>>", "struct<role:string,content:string>",
    ],
)
def test_messages_must_be_turns(spark, kind):
    df = spark.createDataFrame([], f"messages {kind}")
    with pytest.raises(TypeError, match="messages must be JSON text or an array"):
        to_content(df, "chatml")


@pytest.mark.parametrize(
    "columns, templating, field, expected",
    [
        (["messages", "dialogue", "soap", "question", "answer", "text"], True, None, ("messages",)),
        (["dialogue", "soap", "question", "answer", "text"], True, None, ("dialogue", "soap")),
        (["dialogue", "question", "answer", "text"], True, None, ("question", "answer")),
        (["question", "text"], True, None, ("text",)),
        (["messages", "question", "answer", "text"], False, None, ("text",)),
        (["messages", "body", "text"], False, "body", ("body",)),
    ],
)
def test_layout_priority(columns, templating, field, expected):
    assert choose_layout(columns, templating, field).columns == expected


def test_no_layout_names_what_there_is_and_what_was_tried():
    with pytest.raises(KeyError) as error:
        choose_layout(["question", "id"], True)
    for name in ("question", "id", "messages", "dialogue + soap", "question + answer", "text"):
        assert f"'{name}'" in str(error.value)


def test_null_messages_do_not_fall_through(spark):
    df = spark.createDataFrame([(None, "q", "a")], f"messages {TURNS}, question string, answer string")
    with pytest.raises(Exception, match="null, empty"):
        to_content(df, "chatml").collect()


def test_text_is_copied_unchanged_and_replaces_content(spark):
    df = spark.createDataFrame([(" Hi ", "old"), (None, "old")], "text string, content string")
    rows = to_content(df).collect()
    assert [r.asDict() for r in rows] == [{"content": " Hi "}, {"content": None}]
    assert to_content(df, text_field="content").head()["content"] == "old"


def test_unknown_error_mode(spark):
    with pytest.raises(ValueError, match="on_error"):
        to_content(spark.range(1), on_error="ignore")


# --- prepare_sft ----------------------------------------------------------------


def split_of(spark, texts, column="text"):
    return spark.createDataFrame(list(enumerate(texts)), f"id long, {column} string")


def test_test_split_is_validation_and_other_splits_only_need_a_layout(spark):
    source = {
        "train": split_of(spark, ["a", "b"]),
        "test": split_of(spark, ["c"]),
        "extra": split_of(spark, ["d"]),
    }
    train, valid = prepare_sft(spark, source, "train, test, extra", key="id")
    assert [r["content"] for r in train.orderBy("id").collect()] == ["a", "b"]
    assert [r["content"] for r in valid.collect()] == ["c"]

    source["extra"] = split_of(spark, ["d"], "other")
    with pytest.raises(KeyError, match="no usable columns"):
        prepare_sft(spark, source, "train,test,extra", key="id")


def test_train_is_required(spark):
    with pytest.raises(KeyError, match="train split is required"):
        prepare_sft(spark, {"test": split_of(spark, ["a"])}, "test")


def test_splits_may_have_different_layouts(spark):
    source = {
        "train": spark.createDataFrame([(1, "q", "a")], "id long, question string, answer string"),
        "test": split_of(spark, ["plain"]),
    }
    train, valid = prepare_sft(spark, source, template="chatml", key="id")
    assert train.head()["content"] == "user\nq\nassistant\na\n"
    assert valid.head()["content"] == "plain"


def test_holdout_when_there_is_no_test_split(spark):
    source = {"train": split_of(spark, [str(i) for i in range(25)])}
    train, valid = prepare_sft(spark, source, "train", key="id", seed=3)
    assert (train.count(), valid.count()) == (22, 3)
    assert sorted(r["id"] for r in train.union(valid).collect()) == list(range(25))


def test_rejects_are_written_and_left_out(spark, tmp_path):
    messages = ['[{"role":"user","content":"x"}]'] * 20 + ["bad"]
    source = {"train": split_of(spark, messages, "messages")}
    path = str(tmp_path / "rejects")
    train, valid = prepare_sft(
        spark, source, "train", "chatml", key="id", rejects_path=path
    )
    assert (train.count(), valid.count()) == (18, 2)
    rejected = spark.read.parquet(path).collect()
    assert [(r["id"], r["split"]) for r in rejected] == [(20, "train")]
    assert "JSON" in rejected[0]["error"]
    assert train.columns == ["id", "content"]
    assert train.filter(F.col("content") != "user\nx\n").count() == 0
