"""A Spark reader and writer for a dataset split saved to disk as Arrow stream files.

Such a folder holds a ``state.json`` that lists the data files, or else ``data-*.arrow`` files;
other Arrow files in it, caches say, are not data. A large file is cut between its record batches,
which a job over the files finds by the sizes in their headers. Record batches are brought to the
schema of the split: columns by name, values by a cast that must not fail. Columns that are not
wanted are not decoded, and simple filters are applied before rows leave the reader.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from turnloom.plans.scratch import scratch_path

FORMAT = "saved_split"
SPLIT_BYTES = 128 << 20
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Section(ds.InputPartition):
    """The record batches of a file between two offsets, and how long its head is; all of it if ``stop`` is 0."""

    file: str
    head: int = 0
    start: int = 0
    stop: int = 0


@dataclass
class SavedFile(ds.WriterCommitMessage):
    name: str
    rows: int


class SavedSplit(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        fs, files = _list_files(self.options["path"])
        with fs.open_input_stream(files[0]) as stream:
            return from_arrow_schema(_plain_schema(_open(stream).schema))

    def reader(self, schema) -> SavedSplitReader:
        return SavedSplitReader(self.options["path"], self.options.get("sections"), schema)

    def writer(self, schema, overwrite: bool) -> SavedSplitWriter:
        return SavedSplitWriter(self.options["path"], schema, overwrite)


class SavedSplitReader(ds.DataSourceReader):
    def __init__(self, path: str, sections: str | None, schema):
        self.path, self.sections, self.wanted = path, sections, schema
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Keep those that Arrow decides as Spark does, and hand the others back."""
        for f in filters:
            if _known(f, self.wanted):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        if self.sections is None:
            return [Section(file) for file in _list_files(self.path)[1]]
        fs, place = _file_system(self.sections)
        with fs.open_input_stream(place) as stream:
            return [Section(*s) for s in json.loads(stream.read())]

    def read(self, partition: Section):
        fs, _ = _file_system(self.path)
        schema = to_arrow_schema(self.wanted)
        with fs.open_input_file(partition.file) as file:
            for batch in _open(_Part(file, partition) if partition.stop else file, schema.names):
                declared = _as_declared(batch, schema, partition.file)
                for f in self.filters:
                    declared = declared.filter(_mask(declared, f))
                if declared.num_rows:
                    yield declared


class SavedSplitWriter(ds.DataSourceArrowWriter):
    """One file per task; ``state.json``, written at the end, makes them the split."""

    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.declared, self.overwrite = path, schema, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator) -> SavedFile | None:
        import pyarrow as pa
        from pyspark import TaskContext

        system, folder = _file_system(self.path)
        system.create_dir(folder)
        name = f"part-{self.run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.arrow"
        rows, schema = 0, to_arrow_schema(self.declared)
        with system.open_output_stream(f"{folder}/{name}") as out, pa.ipc.new_stream(out, schema) as writer:
            for batch in iterator:
                writer.write_batch(_as_declared(batch, schema, name))
                rows += batch.num_rows
        if rows or TaskContext.get().partitionId() == 0:  # an empty split has one file, which tells its schema
            return SavedFile(name, rows)
        system.delete_file(f"{folder}/{name}")
        return None

    def commit(self, messages: list[SavedFile | None]) -> None:
        system, folder = _file_system(self.path)
        before = _state(system, folder)
        if before is not None and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} already holds a split")
        files = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        state = {
            "_data_files": [{"filename": m.name} for m in files], "_fingerprint": self.run[:16], "_format_columns": None,
            "_format_kwargs": {}, "_format_type": None, "_output_all_columns": False, "_split": None,
        }
        for name, content in (("dataset_info.json", {}), (f"_state-{self.run}.json", state)):
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(json.dumps(content, indent=2).encode())
        system.move(f"{folder}/_state-{self.run}.json", f"{folder}/state.json")
        for old in (before or {}).get("_data_files") or []:
            system.delete_file(f"{folder}/{old['filename']}")

    def abort(self, messages: list[SavedFile | None]) -> None:
        """Nothing of this run stays."""
        from pyarrow import fs

        system, folder = _file_system(self.path)
        for file in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if file.base_name.startswith(f"part-{self.run}-"):
                system.delete_file(file.path)


def register_saved_split(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it; executors get this module by value, not by import."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(SavedSplit)
    spark.conf.set(_PUSHDOWN, "true")


def write_saved_split(df: DataFrame, base: str, split: str, overwrite: bool = False) -> None:
    """Save ``df`` as the folder ``base/split`` of Arrow files, one per task that has rows.

    The split is there once its ``state.json`` is; a job that fails leaves none of its files. A split
    that is there already raises, or is replaced with ``overwrite=True``.
    """
    register_saved_split(df.sparkSession)
    path = f"{base.rstrip('/')}/{split}"
    system, folder = _file_system(path)
    if not overwrite and _state(system, folder) is not None:
        raise FileExistsError(f"{path} already holds a split")
    df.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def find_sections(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Cut the files of ``path`` that are larger than ``split_bytes`` into sections of about that size.

    A job reads the headers of their record batches. The sections, of which there are about as many as
    the split has times ``split_bytes``, go through the driver to a file, whose name is returned.
    """
    import pyarrow as pa

    system, files = _list_files(path)
    large = [f.path for f in system.get_file_info(files) if f.size > split_bytes]
    small = [[file, 0, 0, 0] for file in files if file not in set(large)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for file in batch.column("file").to_pylist() for s in _sections(_file_system(path)[0], file, split_bytes)]
            columns = [pa.array([getattr(s, c) for s in found], t) for c, t in _SECTION]
            yield pa.RecordBatch.from_arrays(columns, [c for c, _ in _SECTION])

    _SECTION = (("file", pa.string()), ("head", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()))
    cut: list[list] = []
    if large:
        todo = spark.createDataFrame([(f,) for f in large], "file string").repartition(min(len(large), 10_000))
        cut = [list(r) for r in todo.mapInArrow(scan, "file string, head long, start long, stop long").collect()]
    place = f"{scratch_path(spark, 'sections')}.json"
    system, name = _file_system(place)
    system.create_dir(name.rsplit("/", 1)[0])
    with system.open_output_stream(name) as out:
        out.write(json.dumps(sorted(small + cut)).encode())
    return place


# --- inside a file -----------------------------------------------------------------

# Fixed values of the Arrow stream format: what precedes a message, and the kinds of messages.
_CONTINUATION = b"\xff\xff\xff\xff"
_END = _CONTINUATION + bytes(4)
_RECORD_BATCH = 3


def _header(file, at: int) -> tuple[int, int] | None:
    """The kind of the message at an offset, and where the next one begins; None at the end."""
    file.seek(at)
    start = file.read(8)
    long = start[:4] == _CONTINUATION
    size = int.from_bytes(start[4:8] if long else start[:4], "little")
    if len(start) < 8 or size == 0:
        return None
    at += 8 if long else 4
    file.seek(at)
    data = file.read(size)

    def number(place: int, width: int) -> int:
        return int.from_bytes(data[place : place + width], "little", signed=True)

    # A table starts with the distance back to the places of its fields: kind is the second, body length the fourth.
    table = number(0, 4)
    fields = table - number(table, 4)
    last = number(fields, 2)
    place = lambda i: number(fields + 4 + 2 * i, 2) if 4 + 2 * i < last else 0
    kind = number(table + place(1), 1) if place(1) else 0
    body = number(table + place(3), 8) if place(3) else 0
    return kind, at + size + body


def _sections(system, file: str, split_bytes: int) -> list[Section]:
    with system.open_input_file(file) as source:
        head, at, out, start = 0, 0, [], 0
        while found := _header(source, at):
            kind, stop = found
            if kind == _RECORD_BATCH:
                if not head:
                    head = start = at
                if stop - start >= split_bytes:
                    out.append(Section(file, head, start, stop))
                    start = stop
            elif head:  # a dictionary that changes on the way: the file is one piece
                return [Section(file)]
            at = stop
        if head and start < at:
            out.append(Section(file, head, start, at))
    return out or [Section(file)]


class _Part(io.RawIOBase):
    """The head of a file, some of its messages, and the mark of an end."""

    def __init__(self, file, section: Section) -> None:
        self.file, self.at = file, 0
        self.spans = [(0, section.head), (section.start, section.stop)]
        self.size = section.head + section.stop - section.start

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        wanted = len(buffer)
        if self.at >= self.size:
            rest = _END[self.at - self.size :][:wanted]
            buffer[: len(rest)] = rest
            self.at += len(rest)
            return len(rest)
        head = self.spans[0][1]
        place = self.at if self.at < head else self.spans[1][0] + self.at - head
        left = (head if self.at < head else self.size) - self.at
        self.file.seek(place)
        data = self.file.read(min(wanted, left))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


# --- filters -----------------------------------------------------------------------

_COMPARISONS = {ds.EqualTo: "equal", ds.GreaterThan: "greater", ds.GreaterThanOrEqual: "greater_equal",
                ds.LessThan: "less", ds.LessThanOrEqual: "less_equal"}
_EXACT = (T.IntegralType, T.StringType, T.BooleanType, T.DateType)


def _known(f: ds.Filter, schema) -> bool:
    if isinstance(f, ds.Not):
        return not isinstance(f.child, ds.Not) and _known(f.child, schema)
    kinds = (*_COMPARISONS, ds.In, ds.IsNull, ds.IsNotNull, ds.StringStartsWith)
    if not isinstance(f, kinds) or len(f.attribute) != 1 or f.attribute[0] not in schema.names:
        return False
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return True
    return isinstance(schema[f.attribute[0]].dataType, _EXACT) and getattr(f, "value", 0) is not None


def _mask(batch, f: ds.Filter):
    """Which rows a filter keeps; an undecided one (NULL) goes, as it does in Spark."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(f, ds.Not):
        return pc.invert(_mask(batch, f.child))
    column = batch.column(f.attribute[0])
    if isinstance(f, ds.IsNull):
        return pc.is_null(column)
    if isinstance(f, ds.IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, ds.StringStartsWith):
        return pc.starts_with(column, f.value)
    if isinstance(f, ds.In):
        known = pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
        undecided = pc.or_(pc.is_null(column), pc.and_(pc.invert(known), pa.scalar(None in f.value)))
        return pc.if_else(undecided, pa.scalar(None, pa.bool_()), known)
    return getattr(pc, _COMPARISONS[type(f)])(column, pa.scalar(f.value, column.type))


# --- files -------------------------------------------------------------------------


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _state(system, folder: str) -> dict | None:
    from pyarrow import fs

    if system.get_file_info(f"{folder}/state.json").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{folder}/state.json") as stream:
        return json.loads(stream.read())


def _list_files(path: str):
    from pyarrow import fs

    system, root = _file_system(path)
    found = system.get_file_info(fs.FileSelector(root))  # raises when the folder is missing
    names = {f.base_name: f.path for f in found if f.is_file}
    listed = []
    if "state.json" in names:
        listed = [f["filename"] for f in _state(system, root).get("_data_files") or []]
        missing = [name for name in listed if name not in names]
        if missing:
            raise FileNotFoundError(f"state.json of {path} lists {missing}, which are not there")
    files = [names[n] for n in listed or sorted(n for n in names if fnmatch(n, "data-*.arrow"))]
    if not files:
        raise FileNotFoundError(f"no data-*.arrow files in {path}")
    return system, files


def _as_declared(batch, schema, file: str):
    import pyarrow as pa

    missing = [name for name in schema.names if name not in batch.schema.names]
    if missing:
        raise ValueError(f"{file} has no columns {missing}")
    columns = [batch.column(f.name).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _open(stream, names: list[str] | None = None):
    """The batches of a stream; of other columns than these nothing is decoded."""
    import pyarrow as pa

    if names is None:
        return pa.ipc.open_stream(stream)
    at = stream.tell() if not isinstance(stream, _Part) else 0
    known = pa.ipc.open_stream(stream).schema.names
    if isinstance(stream, _Part):
        stream.at = 0
    else:
        stream.seek(at)
    wanted = [i for i, name in enumerate(known) if name in names]
    return pa.ipc.open_stream(stream, options=pa.ipc.IpcReadOptions(included_fields=wanted or [0]))


def _plain_schema(schema):
    """The schema without its metadata, which may hold library-specific notes."""
    return schema.remove_metadata()
