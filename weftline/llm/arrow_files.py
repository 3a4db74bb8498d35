"""Token ids as Arrow stream files of equal-length sequences.

Documents are dealt out by ranges of their ids and sorted; each task writes its ids, one document after another, to
files in Arrow's stream format, and begins another file after a bounded number of ids. A file's batches hold two columns
of fixed-size lists, ids and mask, and all but the last have the same number of sequences and so of bytes: a sequence's
batch is found by multiplication, only that batch is read, and from a mapped file without a copy. The mask is false on
the padding at the end of a file. A second file has the documents' places.

Each attempt of a task writes under names of its own, and the driver takes those that successful attempts report and
deletes the others; nothing is ever renamed or replaced, so lost executors and file systems without renaming do no harm.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, shared_folder
from .tokens import UNIT_BYTES, encode, load_tokenizer, units

BYTE_BPE, END = "byte_bpe_50k.json", 0
LENGTH, SEQUENCES = 1024, 256
#: Ids after which a file is closed at the next unit of documents.
FILE_IDS = 128 << 20
#: Bytes of input, by the plan's estimate, that a task is given; the bound on tasks is for estimates that are far off.
TASK_BYTES, MOST_TASKS = 256 << 20, 100_000


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def schema(length: int, kind) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Writes ids to a stream file of sequences of one length."""

    def __init__(self, sink, length: int, kind, sequences: int = SEQUENCES):
        self.length, self.kind, self.sequences = length, kind, sequences
        self.schema = schema(length, kind)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.held, self.count = [], 0

    def write(self, ids: np.ndarray):
        self.held.append(ids)
        self.count += len(ids)
        most = self.length * self.sequences
        if self.count >= most:
            joined = np.concatenate(self.held)
            for k in range(0, len(joined) - most + 1, most):
                self._batch(joined[k : k + most])
            rest = joined[len(joined) - len(joined) % most :]
            self.held, self.count = [rest.copy()], len(rest)

    def _batch(self, ids: np.ndarray):
        n = -(-len(ids) // self.length) * self.length
        padded = np.zeros(n, self.kind.to_pandas_dtype())
        padded[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(padded), pa.array(np.arange(n) < len(ids)))]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self):
        if self.count:
            self._batch(np.concatenate(self.held))
        self.stream.close()


class SequenceFile:
    """A stream file of sequences, opened for random access: a batch at a time is read. A local file is mapped, and
    nothing is copied. `source` is a file's URI or an Arrow file that can seek."""

    def __init__(self, source):
        from pyarrow import fs

        if isinstance(source, str):
            system, path = _place(source)
            source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.source = source
        self.schema = pa.ipc.read_schema(source)
        self.length = self.schema.field("ids").type.list_size
        self.begin = source.tell()
        self.held = None
        self.batches, self.stride, self.size = 0, 1, 1
        if source.size() - self.begin > 8:  # more than the mark of the end
            first = self._read(self.begin)
            self.stride, self.size = source.tell() - self.begin, len(first[0])
            self.batches = -(-(source.size() - 8 - self.begin) // self.stride)
            self.held = 0, first

    def _read(self, at: int) -> tuple[pa.Array, pa.Array]:
        self.source.seek(at)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return batch.column("ids").flatten(), batch.column("mask").flatten()

    def batch(self, b: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of batch b; the last one that was asked for is held."""
        if not 0 <= b < self.batches:
            raise IndexError(f"batch {b} of {self.batches}")
        if self.held[0] != b:
            self.held = b, self._read(self.begin + b * self.stride)
        return self.held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of sequence k."""
        b, at = divmod(k * self.length, self.size)
        ids, mask = self.batch(b)
        return ids.slice(at, self.length).to_numpy(zero_copy_only=True), mask.slice(at, self.length)

    def parts(self, start: int, n: int):
        """Ids start to start + n as views, batch by batch."""
        while n:
            b, at = divmod(start, self.size)
            ids = self.batch(b)[0].slice(at, n)
            yield ids.to_numpy(zero_copy_only=True)
            start, n = start + len(ids), n - len(ids)

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n; a view where they lie in one batch."""
        parts = list(self.parts(start, n))
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _tasks(docs: DataFrame) -> int:
    """As many tasks as the plan's estimate of its bytes asks for, and no fewer than the session's shuffles have."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, estimate // TASK_BYTES))


def write_files(
    docs: DataFrame, folder: str, name: str = BYTE_BPE, end: int = END, length: int = LENGTH, partitions: int | None = None, most: int = FILE_IDS, unit: int = UNIT_BYTES,
) -> list:
    """Writes the files to a folder that all machines share and that holds nothing else; returns (part, number, data uri,
    index uri, documents, ids) of each file.

    Files and documents are in ascending order of doc_id; equal ids are ordered by text, null ids come first. A file is
    closed after the unit of documents (about `unit` bytes of text, or one text) with which it reaches `most` ids.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions or _tasks(rows), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches):
        held = units(batches, most=unit)
        table = next(held, None)
        context = TaskContext.get()
        part, number = context.partitionId(), 0
        system, root = _place(folder)
        while table is not None:
            system.create_dir(root)
            kind = pa.uint16() if load_tokenizer(name).get_vocab_size() <= 1 << 16 else pa.uint32()
            file = f"part-{part:06d}-{number:06d}-{context.taskAttemptId()}"
            documents = total = 0
            with system.open_output_stream(f"{root}/{file}.arrows") as sink, system.open_output_stream(f"{root}/{file}.index.arrows") as places:
                writer = SequenceWriter(sink, length, kind)
                columns = pa.schema([("doc_id", table.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                listing = pa.ipc.new_stream(places, columns)
                while table is not None and total < most:
                    ids, ends = encode(table["text"], name)
                    ids = np.insert(ids, ends, end)
                    ends = ends + np.arange(1, len(ends) + 1)
                    writer.write(ids.astype(kind.to_pandas_dtype()))
                    lengths = np.diff(ends, prepend=0)
                    listing.write_batch(pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(total + ends - lengths), pa.array(lengths)], schema=columns))
                    documents, total = documents + len(ends), total + len(ids)
                    table = next(held, None)
                writer.close()
                listing.close()
            told = {"part": [part], "number": [number], "data": [f"{folder}/{file}.arrows"], "index": [f"{folder}/{file}.index.arrows"], "documents": [documents], "ids": [total]}
            yield pa.RecordBatch.from_pydict(told)
            number += 1

    found = dealt.mapInArrow(run, "part long, number long, data string, index string, documents long, ids long")
    files = sorted(found.collect())  # one row for each file
    _sweep(folder, {f[k].rpartition("/")[2] for f in files for k in ("data", "index")})
    return files


def _sweep(folder: str, kept: set) -> None:
    """Deletes the files of attempts that failed."""
    from pyarrow import fs

    system, root = _place(folder)
    for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith("part-") and found.base_name not in kept:
            system.delete_file(found.path)


def read_files(spark, files: list, id_type: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    listed, before = [], 0
    for f in files:
        listed.append((f["data"], f["index"], before))
        before += f["ids"]
    told = spark.createDataFrame(listed, "data string, index string, base long").repartition(max(1, len(listed)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = SequenceFile(row["data"])
                system, path = _place(row["index"])
                with system.open_input_file(path) as source:
                    for places in pa.ipc.open_stream(source):
                        starts, lengths, crcs = places.column("start").to_pylist(), places.column("n_tokens").to_pylist(), []
                        for s, n in zip(starts, lengths, strict=True):
                            crc = 0
                            for ids in file.parts(s, n):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [places.column("doc_id"), pa.array([row["base"] + s for s in starts], pa.int64()), places.column("n_tokens"), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return told.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def store_documents(docs: DataFrame, folder: str | None = None, name: str = BYTE_BPE) -> DataFrame:
    """Writes the ids of all rows to files in the shared folder and returns what reading them back gives.

    A null or empty text is the end id alone. Rows that repeat an id are stored each. Other columns are ignored; an
    empty table gives no files and no rows.
    """
    spark = docs.sparkSession
    files = write_files(docs, folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}", name)
    return read_files(spark, files, dict(docs.dtypes)["doc_id"])
