"""Blocks: consecutive rows of a partition with a bounded number of text bytes and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from winnowline.llm.kernel import utf8


def text_blocks(batches, text: str, most_bytes: int = 16 << 20, most_rows: int = 65_535):
    """Tables of consecutive rows of the batches: each ends before the row that would take it over a bound (one row is never cut)."""
    held, size, rows = [], 0, 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends, at = utf8(table.column(text))[1][1:], 0
        while at < len(ends):
            begun = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, begun + most_bytes - size, side="right")), at + most_rows - rows, len(ends))
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(table.slice(at, to - at))
                size, rows, at = size + int(ends[to - 1]) - begun, rows + to - at, to
            if at < len(ends):
                yield pa.concat_tables(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.concat_tables(held)


def block_names():
    """Numbers for the blocks of this task, the same whenever the task is run on the same rows."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def spans_of(data: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes that ``parts`` marks as separators (True) do not break."""
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(parts[data], out=inside[1:-1].view(bool))
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def ended(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line feed behind each, and where each of them now starts (and, last, where all end)."""
    return np.insert(data, offsets[1:], 10), offsets + np.arange(len(offsets))
