import json

import pytest
from pyspark.sql import functions as F

from turnloom import batch_infer, build_prompts, generate, parse_ids, parse_text, write_results
from turnloom.functions.reasoning import split_ids, split_text, strip_prompt_ids
from turnloom.operators.inference import split_generated_ids

M = 151668

ID_CASES = [
    ([], [], []),
    ([1, 2, 3], [], [1, 2, 3]),
    ([1, M, 2], [1, M], [2]),
    ([1, M, 2, M, 3], [1, M, 2, M], [3]),
    ([M, 1], [M], [1]),
    ([1, M], [1, M], []),
    ([M], [M], []),
    ([M, M], [M, M], []),
]


def test_split_ids(spark):
    df = spark.createDataFrame([(c[0],) for c in ID_CASES], "ids array<int>")
    rows = df.select("ids", *[c.alias(n) for c, n in zip(split_ids(F.col("ids")), ("t", "o"))]).collect()
    assert [(r["ids"], r["t"], r["o"]) for r in rows] == ID_CASES


@pytest.mark.parametrize("prompt_len", [0, 1, 2, 3, 9])
def test_strip_prompt(spark, prompt_len):
    df = spark.createDataFrame([([1, 2, 3], prompt_len), ([], prompt_len)], "ids array<int>, n int")
    rows = df.select(strip_prompt_ids(F.col("ids"), F.col("n"))).collect()
    assert [r[0] for r in rows] == [[1, 2, 3][prompt_len:], []]


@pytest.mark.parametrize(
    "raw, keep, expected",
    [
        ("why</think>\n\nbecause\n", True, ("why</think>", "because")),
        ("why</think>\n\nbecause\n", False, ("why", "because")),
        ("\n a </think> b </think> c ", True, (" a </think> b </think>", " c ")),
        ("\n a </think> b </think> c ", False, (" a </think> b ", " c ")),
        ("\n\nplain \n", True, ("", "plain ")),
        ("</think>", True, ("</think>", "")),
        ("é</think>ü", True, ("é</think>", "ü")),
        ("", True, ("", "")),
    ],
)
def test_split_text(spark, raw, keep, expected):
    df = spark.createDataFrame([(raw,)], "raw string")
    thinking, output = split_text(F.col("raw"), keep_marker=keep)
    assert tuple(df.select(thinking, output).head()) == expected
    row = parse_text(df, keep_marker=keep).head()
    assert (row["thinking"], row["output"]) == expected


def make_generator(log=None):
    def generator(max_new_tokens, enable_thinking, **options):
        if log is not None:
            with open(log, "a") as f:
                f.write(json.dumps([max_new_tokens, enable_thinking, options]) + "\n")

        def answer(prompts):
            return [f"\n{len(prompts)}</think>\n{p}" for p in prompts]

        return answer

    return generator


def numbered(spark, n, slices=1):
    return spark.range(0, n, 1, slices).select("id", F.concat(F.lit("t"), "id").alias("text"))


def test_batches_of_four_and_a_short_last_one(spark):
    out = batch_infer(numbered(spark, 50), "id", make_generator()).orderBy("id").collect()
    assert [r["thinking"] for r in out] == ["4</think>"] * 48 + ["2</think>"] * 2
    assert out[7].asDict() == {
        "id": 7, "input": "t7", "thinking": "4</think>", "output": "user\nt7\nassistant",
    }


def test_options_reach_the_generator_once_per_task(spark, tmp_path):
    log = tmp_path / "log"
    out = batch_infer(
        numbered(spark, 40, 2), "id", make_generator(str(log)), options={"max_new_tokens": 9, "seed": 1}
    )
    out.count(), out.count()  # the raw generations are read again, not made again
    assert [json.loads(line) for line in log.read_text().splitlines()] == [[9, True, {"seed": 1}]] * 2


def test_raw_generations_are_kept(spark, tmp_path):
    path = str(tmp_path / "raw")
    batch_infer(numbered(spark, 3), "id", make_generator(), raw_path=path)
    raw = spark.read.parquet(path)
    assert raw.columns == ["id", "input", "raw"]
    assert parse_text(raw, keep_marker=False).orderBy("id").head()["thinking"] == "3"


def test_pieces_that_are_there_are_not_generated_again(spark, tmp_path):
    path, calls = str(tmp_path / "raw"), tmp_path / "calls"
    calls.mkdir()

    def generator(broken):
        def factory(**options):
            def answer(prompts):
                if broken and any("17" in p for p in prompts):
                    raise RuntimeError("no memory")
                for p in prompts:
                    (calls / f"{broken} {p.split()[1]}").touch()
                return [str(len(p)) for p in prompts]

            return answer

        return factory

    rows = spark.range(40).selectExpr("id", "cast(id AS string) AS text").coalesce(1)
    ask = lambda broken, **more: batch_infer(
        rows, "id", generator(broken), raw_path=path, pieces=5, batch_size=1, **more
    )
    with pytest.raises(Exception, match="no memory"):
        ask(True)
    done = sum(spark.read.parquet(str(f.parent)).count() for f in (tmp_path / "raw").glob("*/_SUCCESS"))
    out = ask(False, resume=True).collect()
    assert sorted(r["id"] for r in out) == list(range(40))
    assert len(list(calls.glob("False *"))) == 40 - done < 40
    with pytest.raises(Exception, match="(?i)already exists"):
        ask(False)
    with pytest.raises(ValueError, match="raw_path"):
        batch_infer(rows, "id", generator(False), resume=True)


def test_first_rows_over_several_tasks(spark):
    out = batch_infer(numbered(spark, 500, 8), "id", make_generator(), n=50, tasks=4)
    assert sorted(r["id"] for r in out.collect()) == list(range(50))


def test_null_keys_and_large_keys_survive(spark):
    df = spark.createDataFrame([(2**60 + 1, "a"), (None, "b")], "id long, text string")
    out = batch_infer(df, "id", make_generator()).collect()
    assert {r["id"] for r in out} == {2**60 + 1, None}


def id_generator(padding):
    def generator(**options):
        def answer(prompts):
            width = max(map(len, prompts))
            new = [[len(p), M, 10, len(p)] for p in prompts]
            if not padding:
                return new
            return [(width, [0] * (width - len(p)) + [1] * len(p) + n) for p, n in zip(prompts, new)]

        return answer

    return generator


def decoder():
    def decode(batch):
        return ["".join("\n" if i == 10 else f"<{i}>" for i in ids if i != M) for ids in batch]

    return decode


@pytest.mark.parametrize("padding", [False, True])
def test_ids(spark, padding):
    df = spark.createDataFrame([(1, "a"), (2, "bbb")], "id long, text string").coalesce(1)
    out = batch_infer(df, "id", id_generator(padding), returns="ids", decoder=decoder)
    n = len("user\na\nassistant\n")
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (1, "a", f"<{n}>", f"<{n}>"),
        (2, "bbb", f"<{n + 2}>", f"<{n + 2}>"),
    ]


def test_parse_ids_with_another_marker(spark):
    raw = spark.createDataFrame([(1, [9, 5, 7, 8], 1)], "id long, ids array<int>, prompt_len int")
    row = split_generated_ids(raw, 7).head()
    assert (row["thinking_ids"], row["output_ids"]) == ([5, 7], [8])
    assert tuple(parse_ids(raw, decoder, 7).head()) == (1, "<5><7>", "<8>")


def test_misuse(spark):
    df = numbered(spark, 3)
    with pytest.raises(ValueError, match="needs a decoder"):
        batch_infer(df, "id", id_generator(False), returns="ids")
    with pytest.raises(ValueError, match="returns must be"):
        generate(build_prompts(df, ["id"]), make_generator(), returns="tokens")
    with pytest.raises(ValueError, match="need a chat template"):
        build_prompts(df, ["id"], template="none")
    with pytest.raises(TypeError, match="id must be a string"):
        build_prompts(df, ["text"], text="id")

    def short(**options):
        return lambda prompts: prompts[1:]

    with pytest.raises(Exception, match="3 prompts gave 2 results"):
        batch_infer(df, "id", short)


def test_results_are_json_lines(spark, tmp_path):
    path = tmp_path / "results"
    df = spark.createDataFrame([(1, "é\n", None, "ö")], "id long, input string, thinking string, output string")
    write_results(df, str(path))
    write_results(df, str(path))  # overwrites
    lines = [line for f in path.glob("part-*.json") for line in f.read_text("utf-8").splitlines()]
    assert lines == ['{"id":1,"input":"é\\n","thinking":null,"output":"ö"}']
