"""Best-fit packing of documents into sequences of a fixed capacity.

Documents become pieces in one narrow pass: longer ones are cut into full pieces, behind a first piece with what is over.
The pieces' lengths, a few bytes each, are then packed by bounded-space online best-fit, task by task. The open bins of
a task are kept by free space: a bitset tells which amounts occur, so the tightest bin that fits is one shift and one
lowest bit away. When more bins are open than allowed, the fullest closes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import materialise, prepare
from .tokens import encode, units

BYTE_BPE, END = "byte_bpe_50k.json", 2
CAPACITY, OPEN_BINS = 1024, 4096
#: Arrivals that a task looks ahead; of these the longest are placed first. No more than the open bins.
AHEAD = 4096
#: Pieces that one task packs; the part-filled bins at its end are few against them.
PIECES_A_TASK = 1 << 18


class Packer:
    """Online best-fit with a fixed number of open bins; place() gives a bin and an offset."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free = 0, [[] for _ in range(capacity + 1)]
        self.bins = self.opened = 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} in bins of {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self.by_free[free].pop()
            if not self.by_free[free]:
                self.bits ^= 1 << free
            self.opened -= 1
        else:
            free, bin_ = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.opened += 1
            if self.opened > self.open_bins:  # the fullest closes
                least = (self.bits & -self.bits).bit_length() - 1
                self.by_free[least].pop()
                if not self.by_free[least]:
                    self.bits ^= 1 << least
                self.opened -= 1
        return bin_, self.capacity - free


def piece_bounds(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, behind a first one with what is over."""
    over = total % capacity or capacity
    return [(0, over)] + [(s, capacity) for s in range(over, total, capacity)]


def pieces(docs: DataFrame, name: str = BYTE_BPE, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces; every document has one at least."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def run(batches):
        for table in units(batches):
            ids, ends = encode(table["text"], name)
            ids = np.insert(ids, ends, end).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            out, begin = [], 0
            for row, stop in enumerate(ends.tolist()):
                for k, (s, n) in enumerate(piece_bounds(stop - begin, capacity)):
                    out.append((row, k, s, n, zlib.crc32(ids[begin + s : begin + s + n])))
                begin = stop
            row, k, s, n, crc = map(np.array, zip(*out))
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks().take(pa.array(row)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, n, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Adds sequence_id and offset to pieces that a table holds. A sequence has pieces of one task, gapless from 0."""
    tasks = -(-cut.count() // pieces_a_task)

    def run(batches):
        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40

        def placed(held):
            table = pa.Table.from_batches(held).combine_chunks().sort_by([("length", "descending")])
            bins, offsets = (np.array(x, np.int64) for x in zip(*map(packer.place, table["length"].to_pylist())))
            columns = [*(c.combine_chunks() for c in table.columns), pa.array(bins + base), pa.array(offsets)]
            return pa.RecordBatch.from_arrays(columns, names=[*table.column_names, "sequence_id", "offset"])

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, AHEAD - rows))
                batch = batch.slice(held[-1].num_rows)
                rows += held[-1].num_rows
                if rows == AHEAD:
                    yield placed(held)
                    held, rows = [], 0
        if held:
            yield placed(held)

    types = ", ".join(f"{c} {t}" for c, t in cut.dtypes)
    return cut.coalesce(max(1, tasks)).mapInArrow(run, f"{types}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, name: str = BYTE_BPE, end: int = END, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs.

    A null or empty text is one piece with the end id alone. Rows that repeat an id are packed each; a null id stays
    null. Other columns are ignored; an empty table gives no rows. The pieces are written to the shared folder between
    the two passes, so that no text is tokenised twice.
    """
    return pack(materialise(pieces(docs, name, end, capacity)), capacity, open_bins)
