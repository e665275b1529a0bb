"""Pieces that are committed one by one."""

import pytest
from pyspark.sql import functions as F

from turnloom import batch_infer
from turnloom.sources import pieces as sink


def rows(spark, n=60):
    return spark.range(n).select("id", F.format_string("%03d", "id").alias("text"))


def test_the_input_is_read_once(spark, tmp_path, monkeypatch):
    """One job writes all pieces, and its plan has one scan."""
    source = str(tmp_path / "in")
    rows(spark).write.parquet(source)
    seen = []
    real = sink.write_pieces
    import turnloom.operators.inference as inference

    monkeypatch.setattr(inference, "write_pieces", lambda df, path: seen.append(df) or real(df, path))
    out = batch_infer(spark.read.parquet(source), "id", lambda **_: lambda p: p, pieces=7, raw_path=str(tmp_path / "raw"))
    assert sorted(r["id"] for r in out.collect()) == list(range(60))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 1 and plan.count("FileScan") == 1
    assert len(sink.piece_folders(spark, str(tmp_path / "raw"))) == 7
    assert seen[0].rdd.getNumPartitions() == 7


def test_what_is_done_stays_and_is_not_done_again(spark, tmp_path):
    path, log = str(tmp_path / "raw"), tmp_path / "log"
    log.mkdir()

    def generator(broken):
        def factory(**_):
            def answer(prompts):
                for p in prompts:
                    if broken and "017" in p:
                        raise RuntimeError("lost")
                    (log / f"{broken} {p.split()[1]}").touch()
                return prompts

            return answer

        return factory

    with pytest.raises(Exception, match="1 pieces failed and 5 are done; piece .: RuntimeError: lost"):
        batch_infer(rows(spark), "id", generator(True), pieces=6, raw_path=path)
    done = sink.piece_folders(spark, path)
    assert len(done) == 5  # all but one
    kept = sink.read_pieces(spark, path, "id long, input string, raw string").count()
    out = batch_infer(rows(spark), "id", generator(False), pieces=6, raw_path=path, resume=True)
    assert sorted(r["id"] for r in out.collect()) == list(range(60))
    assert len(list(log.glob("False *"))) == 60 - kept
    again = batch_infer(rows(spark), "id", generator(False), pieces=6, raw_path=path, resume=True)
    assert again.count() == 60 and len(list(log.glob("False *"))) == 60 - kept
    with pytest.raises(ValueError, match="already exists"):
        batch_infer(rows(spark), "id", generator(False), pieces=6, raw_path=path)


def test_several_pieces_in_one_task(spark, tmp_path):
    """A piece is committed when the next one begins."""
    df = rows(spark).withColumn(sink.PIECE, (F.col("id") / 13).cast("int")).coalesce(1)
    sink.write_pieces(df, str(tmp_path / "p"))
    assert sorted(sink.piece_folders(spark, str(tmp_path / "p"))) == [0, 1, 2, 3, 4]
    assert spark.read.parquet(str(tmp_path / "p" / "piece-00004")).count() == 8
    back = sink.read_pieces(spark, str(tmp_path / "p"), df.drop(sink.PIECE).schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.drop(sink.PIECE).collect()))
    sink.write_pieces(df.filter(F.col(sink.PIECE) == 2), str(tmp_path / "p"))  # a second attempt changes nothing
    assert sink.read_pieces(spark, str(tmp_path / "p"), df.drop(sink.PIECE).schema).count() == 60


def test_no_rows(spark, tmp_path):
    out = batch_infer(rows(spark, 0), "id", lambda **_: lambda p: p, pieces=3, raw_path=str(tmp_path / "raw"))
    assert out.columns == ["id", "input", "thinking", "output"] and out.count() == 0


def test_types_survive(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, timestamp'2020-01-01 01:02:03.000004' AS t, date'2020-02-03' AS d, cast(1.5 AS decimal(9,3)) AS x, "
                   "array(1, null) AS a, named_struct('k', 'v') AS s, cast(null AS string) AS n")  # fmt: skip
    sink.write_pieces(df.withColumn(sink.PIECE, F.lit(3)), str(tmp_path / "p"))
    assert sink.read_pieces(spark, str(tmp_path / "p"), df.schema).collect() == df.collect()
