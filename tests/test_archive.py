"""One archive of many tasks, read by the standard library."""

import random
import zipfile

import pytest

from weftline.plans.queries import QUERIES
from weftline.sources import archive

FILES = "local_path string, body binary"


def written(spark, tmp_path, rows, **options):
    path = f"{tmp_path}/site.zip"
    entries = archive.write_archive(spark.createDataFrame(rows, FILES).repartition(3), path, **options)
    return path, entries


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 3_000}, {"segment_bytes": 3_000, "most": 5_000}, {"most": 0}])
def test_contents(spark, tmp_path, options):
    rng = random.Random(1)
    rows = [(f"pages/{k % 7}/{chr(233 + k)}{k}.html", rng.randbytes(rng.randrange(400)) + b"same text " * k) for k in range(60)] + [("empty.css", b""), ("null.css", None)]
    path, entries = written(spark, tmp_path, rows, **options)
    with zipfile.ZipFile(path) as told:
        assert told.testzip() is None
        assert told.namelist() == sorted(n for n, _ in rows)
        assert {n: told.read(n) for n in told.namelist()} == {n: b or b"" for n, b in rows}
        offsets = {i.filename: (i.header_offset, i.file_size, i.compress_size) for i in told.infolist()}
    assert offsets == {r.local_path: (r.offset, r.bytes, r.packed) for r in entries.collect()}
    back = {r.local_path: bytes(r.body) for r in archive.read_archive(entries, path).collect()}
    assert back == {n: b or b"" for n, b in rows}


def test_nothing_and_repeats(spark, tmp_path):
    path, entries = written(spark, tmp_path, [])
    assert zipfile.ZipFile(path).namelist() == [] and entries.count() == 0
    path, _ = written(spark, tmp_path, [("a", b"1"), ("a", b"2")])
    with zipfile.ZipFile(path) as told:
        assert sorted(told.read(i) for i in told.infolist()) == [b"1", b"2"]


def test_many_files_have_wide_counts():
    end = archive.end_records(70_000, 10, 20)
    assert end[:4] == b"PK\x06\x06" and len(end) == 56 + 20 + 22 and len(archive.end_records(1, 10, 20)) == 22


def test_a_place_that_is_not_mounted_is_refused(spark):
    with pytest.raises(ValueError):
        archive.write_archive(spark.createDataFrame([("a", b"")], FILES), "s3://bucket/site.zip")


def test_paths_that_repeat_are_read_back_each(spark, tmp_path):
    path, entries = written(spark, tmp_path, [("a", b"1"), ("a", b"2"), ("b", b"3")])
    back = archive.read_archive(entries, path)
    assert sorted((r.local_path, bytes(r.body)) for r in back.collect()) == [("a", b"1"), ("a", b"2"), ("b", b"3")]


def test_files_by_name_alone(spark, tmp_path):
    path, entries = written(spark, tmp_path, [(f"{k}", b"x" * k) for k in range(9)])
    back = archive.read_archive(entries.select("local_path"), path)
    assert {r.local_path: len(r.body) for r in back.collect()} == {f"{k}": k for k in range(9)}


def test_bodies_are_not_broadcast(spark, sf_dir):
    """Only names are counted where the plan is made, so a join would have sent all bodies through the driver."""
    plan = QUERIES["io11_one_archive"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_segments_follow_the_partitions_until_they_are_large(spark, tmp_path, monkeypatch):
    rows = [(f"{k:03d}", bytes([k]) * 50) for k in range(200)]
    for most, few in ((64 << 20, True), (2_000, False)):
        monkeypatch.setattr(archive, "SEGMENT_BYTES", most)
        path, entries = written(spark, tmp_path, rows, segment_bytes=200)
        assert entries.count() == 200 and (len(entries.inputFiles()) <= 4) == few
        with zipfile.ZipFile(path) as told:
            assert [(n, told.read(n)) for n in told.namelist()] == rows


def test_running_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(archive, "BLOCK_SEGMENTS", 3)
    told, end = archive._running(spark.createDataFrame([(k, 10 + k) for k in range(20) if k not in (3, 4, 5, 11)], "part int, length long"), "length", "begin")
    begin = 0
    for r in sorted(told.collect()):
        assert r.begin == begin
        begin += r.length
    assert begin == end


def test_a_file_at_another_place_is_an_error(spark, tmp_path):
    path, _ = written(spark, tmp_path, [("a", b"1" * 99), ("b", b"2")])
    with zipfile.ZipFile(path) as told, open(path, "rb") as file:
        a, b = told.infolist()
        assert archive.body_at(file, b"a", a.header_offset, a.compress_size) == b"1" * 99
        with pytest.raises(ValueError):
            archive.body_at(file, b"a", b.header_offset, b.compress_size)
