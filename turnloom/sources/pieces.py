"""A sink whose pieces are committed one by one.

Rows carry the number of their piece. A task writes each of its pieces to a file of its own and
commits it as soon as it is complete, so a job that fails later leaves what was done, and a second
run over the other pieces goes on from there. A piece is a Parquet folder with a ``_SUCCESS`` file.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PIECE = "__piece"
ERROR = "__error"  # why a row has no result; its piece is then not committed
_FORMAT = "committed_pieces"
_FOLDER = "piece-{:05d}"
_GROUP_BYTES = 4 << 20  # of a row group, which is encoded in memory


@dataclass
class Written(WriterCommitMessage):
    """The pieces of one task and their rows, and those that failed."""

    rows: dict[int, int] = field(default_factory=dict)
    failed: dict[int, str] = field(default_factory=dict)


class CommittedPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def writer(self, schema, overwrite: bool) -> PiecesWriter:
        return PiecesWriter(self.options["path"])


class PiecesWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of one piece follow each other."""
        system, base = _file_system(self.path)
        done, now = Written(), None

        def finish() -> None:
            if now is not None and now.number in done.failed:
                now.abandon()
            elif now is not None:
                now.commit()
                done.rows[now.number] = now.rows

        try:
            for batch in iterator:
                numbers = batch.column(PIECE).to_numpy()
                errors = batch.column(ERROR).to_pylist() if ERROR in batch.schema.names else [None] * len(numbers)
                batch = batch.drop_columns([c for c in (PIECE, ERROR) if c in batch.schema.names])
                at = 0
                while at < len(numbers):
                    piece, stop = int(numbers[at]), at + 1
                    while stop < len(numbers) and numbers[stop] == piece:
                        stop += 1
                    if now is None or now.number != piece:
                        finish()
                        now = _Piece(system, base, piece, batch.schema)
                    wrong = next((e for e in errors[at:stop] if e is not None), None)
                    if wrong is not None:
                        done.failed.setdefault(piece, wrong)
                    now.write(batch.slice(at, stop - at))
                    at = stop
                del batch, numbers, errors  # before the next one is read
            finish()
        except BaseException:
            if now is not None:
                now.abandon()
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Note how many rows each piece of this run has, and say which failed."""
        rows = {str(p): n for m in messages if m is not None for p, n in m.rows.items()}
        system, base = _file_system(self.path)
        system.create_dir(base)
        with system.open_output_stream(f"{base}/_pieces-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(rows).encode())
        failed = {p: e for m in messages if m is not None for p, e in m.failed.items()}
        if failed:
            first = min(failed)
            raise RuntimeError(f"{len(failed)} pieces failed and {len(rows)} are done; piece {first}: {failed[first]}")

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks have committed stays for the next run."""


class _Piece:
    """One piece while it is written, out of sight of readers."""

    def __init__(self, system, base: str, number: int, schema: pa.Schema) -> None:
        import pyarrow.parquet as pq

        self.system, self.number, self.rows, self.closed = system, number, 0, False
        self.folder = f"{base}/{_FOLDER.format(number)}"
        self.hidden = f"{base}/_unfinished/{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{base}/_unfinished")
        self.stream = system.open_output_stream(self.hidden)
        self.writer = pq.ParquetWriter(self.stream, schema)

    def write(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch, row_group_size=max(1, batch.num_rows * _GROUP_BYTES // max(batch.nbytes, 1)))
        self.rows += batch.num_rows

    def _close(self) -> None:
        if not self.closed:
            self.closed = True
            self.writer.close()
            self.stream.close()

    def commit(self) -> None:
        """The first attempt that gets here wins; a later one leaves its piece as it is."""
        self._close()
        if _exists(self.system, f"{self.folder}/_SUCCESS"):
            self.system.delete_file(self.hidden)
            return
        self.system.create_dir(self.folder)
        self.system.move(self.hidden, f"{self.folder}/part-0.parquet")
        self.system.open_output_stream(f"{self.folder}/_SUCCESS").close()

    def abandon(self) -> None:
        try:
            self._close()
        finally:
            if _exists(self.system, self.hidden):
                self.system.delete_file(self.hidden)


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _exists(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


def piece_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The committed pieces below ``path``."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/piece-*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    folders = [f.getPath().getParent().toString() for f in found]
    return {int(folder.rsplit("-", 1)[1]): folder for folder in folders}


def write_pieces(df: DataFrame, path: str) -> None:
    """Write the rows of ``df``, in whose tasks those of one ``__piece`` follow each other."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = df.sparkSession
    spark.dataSource.register(CommittedPieces)
    df.write.format(_FORMAT).mode("append").save(path)


def read_pieces(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed pieces below ``path``."""
    folders = sorted(piece_folders(spark, path).values())
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def in_pieces(df: DataFrame, piece: Column, pieces: int) -> DataFrame:
    """``df`` with the number of each row's piece; every piece is one task."""
    return df.withColumn(PIECE, piece.cast("int")).repartitionById(pieces, F.col(PIECE))
