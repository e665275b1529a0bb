"""The order in which rows lie in their files, for data without a key.

Files come in order of their paths, rows as they lie in a file. In Parquet a row's index is part of
the file's metadata, so the positions need only the row counts of the files; rows of other formats
are numbered while they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.plans.ordered import with_running_start
from turnloom.plans.scratch import scratch_table

POSITION = "position"
_FILE, _BLOCK, _ROW = "__file", "__block", "__row"
_MAX_BROADCAST = 100_000  # files whose starts go to every task, about 30 MB
_SMALL = 10_000


def _marked(df: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with their file and what orders them in it, and whether that is the row's index."""
    try:
        known = df.select("_metadata").schema["_metadata"].dataType.names
    except AnalysisException as error:
        raise ValueError("rows have positions only in a table that is read from files") from error
    indexed = "row_index" in known
    block, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    if not indexed:
        block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return df.select("*", F.col("_metadata.file_path").alias(_FILE), block.alias(_BLOCK), row.alias(_ROW)), indexed


def _starts(marked: DataFrame) -> DataFrame:
    """``__file, n, last, start`` of every file with rows, in order of the paths."""
    counts = marked.groupBy(_FILE).agg(F.count("*").alias("n"), F.max(_ROW).alias("last"))
    placed = with_running_start(scratch_table(counts, "file-counts"), [_FILE], "n")
    return scratch_table(placed.select(_FILE, "n", "last", "start"), "file-starts")


def with_position(df: DataFrame, name: str = POSITION) -> DataFrame:
    """Add the number of each row, from 0, in file order.

    ``df`` must come straight from files: columns may be chosen, computed or left out, rows must not. Of
    Parquet files only the row counts are read first. Files of other formats are read
    once and written as Parquet to the shared scratch folder, with the place that each row has in its file.
    """
    if name in df.columns:
        raise ValueError(f"there is already a column {name!r}")
    marked, indexed = _marked(df)
    if not indexed:
        order = F.struct(_BLOCK, _ROW)
        marked = scratch_table(marked, "read-in-order")
        first = marked.groupBy(_FILE, _BLOCK).agg(F.min(_ROW).alias("low"), F.count("*").alias("rows"))
        blocks = scratch_table(
            with_running_start(scratch_table(first, "block-counts"), [_FILE, _BLOCK], "rows")
            .select(F.col(_FILE).alias("file"), F.col(_BLOCK).alias("block"), "low", "start"),
            "block-starts",
        )
        same = (F.col(_FILE) == F.col("file")) & (F.col(_BLOCK) == F.col("block"))
        position = F.col("start") + F.col(_ROW) - F.col("low")
        return _joined(marked, blocks, same, position.alias(name))
    starts = _starts(marked)
    if not starts.filter(F.col("last") + 1 != F.col("n")).isEmpty():
        raise ValueError("rows were left out of some file before they got their positions")
    named = starts.select(F.col(_FILE).alias("file"), "start")
    return _joined(marked, named, F.col(_FILE) == F.col("file"), (F.col("start") + F.col(_ROW)).alias(name))


def _joined(marked: DataFrame, starts: DataFrame, same: Column, position: Column) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in marked.columns if c not in (_FILE, _BLOCK, _ROW)]
    side = F.broadcast(starts) if starts.count() <= _MAX_BROADCAST else starts
    return marked.join(side, same).select(*kept, position)


def first_with_position(df: DataFrame, n: int, name: str = POSITION) -> DataFrame:
    """The first ``n`` rows in file order with their numbers; of Parquet files only those needed are read."""
    if _marked(df)[1]:
        return with_position(first_in_files(df, n, None), name)
    return with_position(df, name).filter(F.col(name) < n)


def first_in_files(df: DataFrame, n: int, first: Callable[[DataFrame, int, list[str]], DataFrame] | None) -> DataFrame:
    """The first ``n`` rows in file order; all rows if there are fewer.

    The rows per file are counted and summed up, so that only the files that are needed are
    read then, all but the last of them whole. In the last one a filter on the row's index is enough if
    no rows were left out before; else ``first`` takes the rows with the smallest places.
    """
    if n <= 0:
        return df.limit(0)
    marked, indexed = _marked(df)
    border = _starts(marked).filter((F.col("start") < n) & (F.col("start") + F.col("n") >= n)).head()
    if border is None:
        return df
    columns = [f"`{c}`" for c in df.columns]
    path = F.col("_metadata.file_path")
    taken = n - border["start"]
    if taken == border["n"]:
        return df.filter(path <= border[_FILE])
    if indexed and border["last"] + 1 == border["n"]:
        # The files are chosen by the first filter alone, when the plan is made.
        return df.filter(path <= border[_FILE]).filter((path < border[_FILE]) | (F.col("_metadata.row_index") < taken))
    if first is None:
        raise ValueError("rows were left out of some file before they got their positions")
    last = _marked(df.filter(path == border[_FILE]))[0]
    if taken > _SMALL:
        last = scratch_table(last, "last-file")
    rows = first(last, taken, [_BLOCK, _ROW])
    return df.filter(path < border[_FILE]).unionByName(rows.select(*columns))
