"""One ZIP archive of a project, written by many tasks.

Tasks deflate files in ranges of their paths and write them as segments. Running sums over the segments, in blocks of which
the driver gets one row each, tell where a segment and its part of the central directory begin. Tasks then copy every
segment to its place in the archive and write its part of the directory. That is the same bytes at the same place whenever
it is done, so a task that runs again does no harm. Offsets and counts beyond 32 and 16 bits have ZIP64 records.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise, prepare, remove, scratch_folder

#: Bytes of files that one segment holds, about.
SEGMENT_BYTES = 64 << 20
#: Bytes that are held at once while a segment is copied, and about those of bodies that are read back at once.
BLOCK = 4 << 20
#: Segments that are summed up in one row for the driver.
BLOCK_SEGMENTS = 1_024

# Fixed values of the format: signatures, the version that reads it, flags (names in UTF-8), deflate, and the least date.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_VERSION, _FLAGS, _DEFLATE, _TIME, _DATE = 45, 0x800, 8, 0, 0x21
_MOST, _MOST_FILES = 0xFFFFFFFF, 0xFFFF
#: Bytes of a local header without its name, of an offset of 64 bits, and of both headers of a file.
_LOCAL_BYTES, _WIDE, _HEADERS = 30, 12, 76

_WRITTEN = "part int, segment string, at long, size long, local_path string, crc long, packed long, bytes long"


def local_entry(name: bytes, body: bytes) -> tuple[bytes, int, int]:
    """Header and deflated body of a file, its checksum and its deflated size."""
    deflate = zlib.compressobj(wbits=-15)
    data, crc = deflate.compress(body) + deflate.flush(), zlib.crc32(body)
    return struct.pack("<L5H3L2H", _LOCAL, _VERSION, _FLAGS, _DEFLATE, _TIME, _DATE, crc, len(data), len(body), len(name), 0) + name + data, crc, len(data)


def central_entry(name: bytes, crc: int, packed: int, size: int, offset: int, most: int = _MOST) -> bytes:
    extra = struct.pack("<2HQ", 1, 8, offset) if offset >= most else b""
    return struct.pack(
        "<L6H3L5H2L", _CENTRAL, _VERSION, _VERSION, _FLAGS, _DEFLATE, _TIME, _DATE, crc, packed, size, len(name), len(extra), 0, 0, 0, 0, _MOST if extra else offset) + name + extra


def end_records(files: int, size: int, offset: int, most: int = _MOST) -> bytes:
    """What closes an archive whose central directory has that many files and that size, at that offset."""
    out = b""
    if files >= _MOST_FILES or size >= most or offset >= most:
        out += struct.pack("<LQ2H2L4Q", _END64, 44, _VERSION, _VERSION, 0, 0, files, files, size, offset) + struct.pack("<LLQL", _LOCATOR, 0, offset + size, 1)
        files, size, offset = _MOST_FILES, _MOST, _MOST
    return out + struct.pack("<L4H2LH", _END, 0, 0, files, files, size, offset, 0)


def _segments(root: str):
    """A task's files as a segment of its own; gives (part, segment, at, size, local_path, crc, packed, bytes) of each."""
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        part, out, at = TaskContext.get().partitionId(), None, 0
        name = f"{part:08d}-{uuid.uuid4().hex}"
        system, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            told = []
            for path, body in zip(batch.column("local_path").to_pylist(), batch.column("body"), strict=True):
                if out is None:
                    system.create_dir(top)
                    out = system.open_output_stream(f"{top}/{name}")
                body = body.as_py()
                data, crc, packed = local_entry(path.encode(), body)
                out.write(data)
                told.append((part, name, at, len(data), path, crc, packed, len(body)))
                at += len(data)
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*told), kinds, strict=True)], names=_WRITTEN.split()[::2])
        if out is not None:
            out.close()

    return run


def _running(sizes: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """The rows, one for a part, with the sum of a column over all parts before; and the sum over all. discard() takes it."""
    sizes = materialise(sizes)
    block = F.floor(F.col("part") / BLOCK_SEGMENTS).cast("int")
    sums, begins, end = dict(sizes.groupBy(block).agg(F.sum(column)).collect()), [], 0
    for k in range(max(sums, default=-1) + 1):
        begins.append(end)
        end += sums.get(k, 0)
    before = F.sum(column).over(Window.partitionBy(block).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    out = sizes.withColumn(name, F.get(F.from_json(F.lit(str(begins)), "array<bigint>"), block) + F.coalesce(before, F.lit(0)))
    out._weftline_path = sizes._weftline_path
    return out, end


def write_archive(files: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, most: int = _MOST) -> DataFrame:
    """Writes files (local_path, body) into one archive at a path that all machines share; local_path, offset, bytes, packed.

    Files are in order of path. A null body counts as empty; paths that repeat have an entry each. An empty table gives
    an archive without entries. Where the path is on a file system that machines mount, tasks write their places in
    parallel; a store without writes in the middle of a file is refused. There is a task for each segment; segments over
    the session's shuffle partitions are only made while they are larger than SEGMENT_BYTES. `most` is the offset from
    which ZIP64 is used.
    """
    spark = prepare(files.sparkSession)
    place = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if not place.startswith("/"):
        raise ValueError(f"{path} is on no mounted file system; write archives in parts there")
    scratch = scratch_folder(spark)
    rows = files.select(F.col("local_path"), F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body"))
    total = rows.agg(F.sum(F.octet_length("body").cast("long") + 2 * F.octet_length("local_path") + _HEADERS)).first()[0] or 0
    parts = min(total // segment_bytes + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SEGMENT_BYTES + 1))
    dealt = rows.repartitionByRange(parts, "local_path").sortWithinPartitions("local_path")
    written = materialise(dealt.mapInArrow(_segments(scratch), _WRITTEN))

    segments, start = _running(written.groupBy("part", "segment").agg(F.sum("size").alias("length")), "length", "begin")
    placed = written.drop("segment", "size").join(segments, "part").withColumn("offset", F.col("begin") + F.col("at"))
    listed = F.octet_length("local_path") + F.lit(len(central_entry(b"", 0, 0, 0, 0, 1))) + F.when(F.col("offset") >= most, _WIDE).otherwise(0)
    lists, directory = _running(placed.groupBy("part").agg(F.sum(listed).alias("listed"), F.count("*").alias("files")), "listed", "listed_at")
    tail = end_records(lists.agg(F.sum("files")).first()[0] or 0, directory, start, most)
    draft = f"{place}.{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        out.truncate(start + directory)
        out.seek(start + directory)
        out.write(tail)
    ordered = placed.join(lists.select("part", F.col("listed_at") + start), "part").repartition(parts, "part").sortWithinPartitions("part", "at")
    entries = materialise(ordered.toDF(*placed.columns, "listed_at").mapInArrow(_places(scratch, draft, most), "local_path string, offset long, bytes long, packed long"))
    fs.LocalFileSystem().move(draft, place)
    for table in (written, segments, lists):
        discard(table)
    remove(spark, scratch)
    return entries


def _places(root: str, draft: str, most: int):
    """Copies the segments of a task's rows, in blocks, and writes what the central directory has of them."""
    def run(batches):
        part, at = None, 0
        system, top = fs.FileSystem.from_uri(root)
        with open(draft, "r+b") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["part"] != part:
                        part, at = row["part"], row["listed_at"]
                        with system.open_input_stream(f"{top}/{row['segment']}") as told:
                            out.seek(row["begin"])
                            while block := told.read(BLOCK):
                                out.write(block)
                        if out.tell() != row["begin"] + row["length"]:
                            raise OSError(f"{row['segment']} has not the bytes that were written")
                        out.seek(at)
                    out.write(central_entry(row["local_path"].encode(), row["crc"], row["packed"], row["bytes"], row["offset"], most))
                yield batch.select(["local_path", "offset", "bytes", "packed"])

    return run


def body_at(told, name: bytes, offset: int, packed: int) -> bytes:
    """The body of a file that write_archive() has put there."""
    told.seek(offset)
    head, data = told.read(_LOCAL_BYTES + len(name)), told.read(packed)
    signature, *_, crc, held, size, length, extra = struct.unpack("<L5H3L2H", head[:_LOCAL_BYTES])
    if (signature, held, length, extra, head[_LOCAL_BYTES:]) != (_LOCAL, packed, len(name), 0, name):
        raise ValueError(f"{name!r} is not at {offset}")
    body = zlib.decompress(data, -15)
    if (zlib.crc32(body), len(body)) != (crc, size):
        raise ValueError(f"{name!r} is damaged")
    return body


def read_archive(names: DataFrame, path: str) -> DataFrame:
    """local_path and body of each file of one archive. Files that write_archive() gave (local_path, offset, packed) are
    read at their places; for those that are only named (local_path), each task reads the whole directory once."""
    prepare(names.sparkSession)
    known = {"offset", "packed"} <= set(names.columns)

    def run(batches):
        system, place = fs.FileSystem.from_uri(path)
        with system.open_input_file(place) as told:
            held = None if known else zipfile.ZipFile(told)
            for batch in batches:
                paths, bodies, size = [], [], 0
                for row in batch.to_pylist():
                    name = row["local_path"]
                    body = body_at(told, name.encode(), row["offset"], row["packed"]) if known else held.read(name)
                    paths.append(name)
                    bodies.append(body)
                    if (size := size + len(body)) >= BLOCK:
                        yield pa.RecordBatch.from_pydict({"local_path": paths, "body": pa.array(bodies, pa.binary())})
                        paths, bodies, size = [], [], 0
                if paths:
                    yield pa.RecordBatch.from_pydict({"local_path": paths, "body": pa.array(bodies, pa.binary())})

    return names.select("local_path", *["offset", "packed"] * known).mapInArrow(run, "local_path string, body binary")
