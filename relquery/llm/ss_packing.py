"""Packing: sum-of-squares online packing of documents into token windows.

Each partition packs its own documents in the order in which it reads them.
A document that fits a window goes, whole, to the fill level for which the sum
of the squared counts of partly filled windows grows least; ties take the
fullest. The counts and the open windows stand in an array by fill level, so
a placement looks at no window by itself. A longer document first fills windows
of its own and its rest is placed so. Windows left open at the end of a
partition are emptied into each other by cutting, so a partition leaves one
window that is not full at most.

State is bounded by the open windows; no shuffle takes place. A window's id is
made from the partition's number and a counter, so a task that runs again after
a lost executor gives the same rows (the input plan must be deterministic, as
a table scan is).

Defined results: a null or empty text is the closing id alone; equal rows are
packed as often as they occur; an empty table gives no rows; other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.llm.common import chunks, in_arrow, table, texts_of
from relquery.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, fill long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "fill")])


class Packer:
    """Windows of ``capacity`` ids. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int = 0) -> None:
        self.capacity = capacity
        self.next_id = first_id
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(capacity + 1)]
        self.rows: list[tuple] = []

    def level(self, size: int) -> int:
        """Fill level (0: a new window) that takes ``size`` ids at the least sum of squares."""
        top = self.capacity - size
        grow = self.count[size:] - self.count[: top + 1] + 1.0
        grow[top] = 0.5 - self.count[top]  # the window gets full and counts no longer
        grow[0] = self.count[size] + 0.5 if top else 0.0
        grow[1:][self.count[1 : top + 1] == 0] = np.inf
        return top - int(np.argmin(grow[::-1]))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._close([(doc, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if start < total:
            self._place((doc, start, ids[start:].copy(), total))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        at = self.level(size)
        window = self.open[at].pop() if at else []
        if at:
            self.count[at] -= 1
        window.append(piece)
        if at + size == self.capacity:
            self._close(window)
        else:
            self.open[at + size].append(window)
            self.count[at + size] += 1

    def _close(self, window: list[tuple]) -> None:
        offset, fill = 0, sum(len(p[2]) for p in window)
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset, fill))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Empty the open windows into each other, cutting pieces at the windows' ends."""
        window, fill = [], 0
        for at in range(self.capacity - 1, 0, -1):
            for doc, start, ids, total in (p for w in self.open[at] for p in w):
                while len(ids):
                    cut = min(len(ids), self.capacity - fill)
                    window.append((doc, start, ids[:cut], total))
                    start, ids, fill = start + cut, ids[cut:], fill + cut
                    if fill == self.capacity:
                        self._close(window)
                        window, fill = [], 0
            self.open[at] = []
            self.count[at] = 0
        if window:
            self._close(window)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def pack(documents: DataFrame, capacity: int = 1024, end_id: int = 0, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """Pieces of all documents in windows of ``capacity`` ids; see the module for the rules.

    Columns as in ``SCHEMA``; ``fill`` is how many ids the piece's window holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, rank_path).encode
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        closing = np.array([end_id], np.uint32)
        for batch in batches:
            for part in chunks(batch):
                ids, first = encode(*texts_of(part.column(1)))
                for k, doc in enumerate(part.column(0).to_pylist()):
                    packer.add(doc, np.concatenate([ids[first[k] : first[k + 1]], closing]))
                yield packer.taken()
        packer.finish()
        yield packer.taken()

    return in_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def op8_ss_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
