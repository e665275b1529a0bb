"""Arrow batches in parts of bounded size, so that few of their rows are Python objects at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20


def text_bytes(texts: pa.Array) -> list[int]:
    """UTF-8 bytes of each text."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def id_bytes(ids: pa.Array) -> list[int]:
    """Bytes of each list of 32-bit ids."""
    return pc.fill_null(pc.multiply(pc.list_value_length(ids), 4), 0).to_pylist()


def grouped(batches: Sequence[Sequence[int]], sizes: Sequence[int], most: int = SLICE_BYTES) -> Iterator[list[Sequence[int]]]:
    """Batches of row numbers in groups of at most ``most`` bytes; a larger batch is a group of its own."""
    group: list[Sequence[int]] = []
    held = 0
    for batch in batches:
        size = sum(sizes[i] for i in batch)
        if group and held + size > most:
            yield group
            group, held = [], 0
        group.append(batch)
        held += size
    if group:
        yield group


def sliced(rows: pa.RecordBatch, sizes: Sequence[int], step: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``rows`` in runs of at most ``most`` bytes, each but the last with a multiple of ``step`` rows."""
    steps = [range(at, min(at + step, rows.num_rows)) for at in range(0, rows.num_rows, step)]
    for group in grouped(steps, sizes, most):
        yield rows.slice(group[0][0], sum(map(len, group)))
