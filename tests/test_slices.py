"""Few rows of an Arrow batch are Python objects at a time, whatever the batch holds."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turnloom import batch_infer, parse_ids, tokenise
from turnloom.functions.slices import SLICE_BYTES, grouped, id_bytes, sliced, text_bytes

ROWS, CHARS = 3000, 4000


def long_texts(spark):
    """12 MB of text in one Arrow batch, with a text that is longer than a slice."""
    text = F.when(F.col("id") == 7, F.repeat(F.lit("é"), 700_000)).otherwise(F.rpad(F.col("id").cast("string"), CHARS, "x"))
    return spark.range(0, ROWS, 1, 1).select("id", text.alias("text"))


def counted(kind, path):
    """A class whose objects note in a file how many of them were alive at most."""

    class Counted(kind):
        alive = most = 0

        def __init__(self, *given):
            if kind is list:
                super().__init__(*given)
            Counted.alive += 1
            if Counted.alive > Counted.most:
                Counted.most = Counted.alive
                with open(path, "w") as f:
                    f.write(str(Counted.most))

        def __del__(self):
            Counted.alive -= 1

    return Counted


def test_groups():
    assert list(grouped([[0, 1], [2], [3], [4, 5]], [1, 2, 3, 99, 1, 1], 6)) == [[[0, 1], [2]], [[3]], [[4, 5]]]
    assert list(grouped([], [])) == []
    rows = pa.RecordBatch.from_pydict({"t": ["aé", None, "", "bcd", "e"], "i": [[1, 2], None, [], [3], [4]]})
    assert text_bytes(rows["t"]) == [3, 0, 0, 3, 1] and id_bytes(rows["i"]) == [8, 0, 0, 4, 4]
    assert [s["t"].to_pylist() for s in sliced(rows, text_bytes(rows["t"]), 2, 3)] == [["aé", None], ["", "bcd"], ["e"]]
    assert list(sliced(rows.slice(0, 0), [])) == []


@pytest.mark.parametrize("returns", ["text", "ids"])
def test_generations(spark, tmp_path, returns):
    path = str(tmp_path / "most")

    def generator(**_):
        kind = counted(str if returns == "text" else list, path)
        return lambda prompts: [kind(f"{len(p)}") if returns == "text" else kind([len(p)]) for p in prompts]

    decoder = lambda: lambda batch: [str(i) for (i,) in batch]
    decode = decoder if returns == "ids" else None
    whole = long_texts(spark)
    got = {}
    for by_length in (False, True):
        out = batch_infer(whole, "id", generator, returns=returns, decoder=_last(decode), by_length=by_length)
        got[by_length] = dict(out.select("id", "output").collect())
        assert int((tmp_path / "most").read_text()) <= 2 * SLICE_BYTES // CHARS < ROWS / 5
        (tmp_path / "most").unlink()
    assert got[False] == got[True]
    around = len("user\n\nassistant\n")
    assert got[False] == {i: str(around + (700_000 if i == 7 else CHARS)) for i in range(ROWS)}


def _last(decoder):
    """The reasoning has no ids here."""
    if decoder is None:
        return None
    return lambda: lambda batch: [decoder()([ids])[0] if ids else "" for ids in batch]


def test_tokens_and_texts_of_ids(spark, tmp_path):
    """A slice of texts is encoded and a slice of ids decoded at a time; no call gets more texts than asked for."""
    path, calls = str(tmp_path / "most"), str(tmp_path / "calls")

    def tokenizer():
        kind = counted(list, path)

        def encode(texts):
            with open(calls, "a") as f:
                f.write(f"{len(texts)}\n")
            return [kind([len(t), *[1] * (len(t) // 4)]) for t in texts]

        return encode

    def decoder():
        def decode(lists):
            assert len(lists) <= SLICE_BYTES // CHARS + 1 or not any(lists)
            return [str(ids[0]) if ids else "" for ids in lists]

        return decode

    tokens = tokenise(long_texts(spark), ["id"], tokenizer=tokenizer, batch_size=50)
    raw = tokens.select("id", F.col("tokens").alias("ids"), F.lit(0).alias("prompt_len")).localCheckpoint()
    assert int((tmp_path / "most").read_text()) <= SLICE_BYTES // CHARS + 50 < ROWS / 5
    asked = [int(line) for line in (tmp_path / "calls").read_text().splitlines()]
    assert sum(asked) == ROWS and max(asked) == 50 and min(asked) == 50
    texts = dict(parse_ids(raw, decoder, marker=-1).select("id", "output").collect())
    assert texts == {i: str(700_000 if i == 7 else CHARS) for i in range(ROWS)}


def test_pieces_are_written_in_small_row_groups(spark, tmp_path):
    out = batch_infer(long_texts(spark), "id", lambda **_: lambda p: [f"{len(x)}" for x in p], pieces=2, raw_path=str(tmp_path / "raw"))
    assert out.count() == ROWS
    for file in (tmp_path / "raw").glob("piece-*/*.parquet"):
        about = pq.ParquetFile(file).metadata
        sizes = [about.row_group(i).total_byte_size for i in range(about.num_row_groups)]
        assert len(sizes) > 1 and max(sizes) < 6 << 20
