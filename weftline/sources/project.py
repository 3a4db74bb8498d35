"""A project's state as tables in one folder, JSON for people, and export as files or an archive."""

from __future__ import annotations

import io
import time
import zipfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import FALLBACK_NAME, POLICIES, CrawlConfig
from ..functions.paths import project_name, zone

VERSION = "1"
#: Tables of a project; the crawl's log is JSON lines, and so can be appended to and streamed.
TABLES = {"visited": schemas.VISITED, "failed": schemas.FAILED, "frontier": schemas.FRONTIER, "url_map": schemas.URL_MAP, "blobs": schemas.BLOBS}
ZONES = ("pages", "assets", "external", "_meta")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, nulls and non-ASCII letters as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By schema: unknown keys are passed over and missing ones null. A missing file is an empty table."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings of any number of projects, an object of JSON a line, as CrawlConfig.from_dict reads each.

    Unknown names are passed over, names that are missing or null get their defaults, an unknown policy is the first, and
    project names are made safe.
    """
    rows, defaults = read_json(spark, path, schemas.SETTINGS), CrawlConfig().to_dict()
    known = rows.select(*(F.coalesce(F.col(c), F.lit(defaults[c]).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns))
    return known.withColumns({
        "project_name": project_name(F.col("project_name"), FALLBACK_NAME), "asset_filter": F.when(F.col("asset_filter").isin(*POLICIES), F.col("asset_filter")).otherwise(POLICIES[0])})


class Project:
    """Reads and writes a project's tables. Saving twice writes twice the same."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.meta = spark, root.rstrip("/"), f"{root.rstrip('/')}/_meta"

    @classmethod
    def create(cls, spark: SparkSession, root: str, config: CrawlConfig) -> Project:
        """Settings, manifest and empty tables; tables that are there stay."""
        project = cls(spark, root)
        project._settings(config)
        if not _exists(spark, f"{project.meta}/manifest"):
            project._manifest(config.project_name, time.time(), None)
        for name, schema in TABLES.items():
            if not _exists(spark, f"{project.meta}/{name}"):
                spark.createDataFrame([], schema).write.parquet(f"{project.meta}/{name}")
        return project

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Project:
        project = cls(spark, root)
        if not _exists(spark, project.meta):
            raise FileNotFoundError(f"{root} is no project: it has no _meta")
        return project

    def _settings(self, config: CrawlConfig) -> None:
        write_json(self.spark.createDataFrame([config.to_dict()], schemas.SETTINGS), f"{self.meta}/settings")

    def _manifest(self, name: str, created: float, saved: float | None) -> None:
        write_json(self.spark.createDataFrame([(name, created, VERSION, saved)], schemas.MANIFEST), f"{self.meta}/manifest")

    def config(self) -> CrawlConfig:
        row = read_json(self.spark, f"{self.meta}/settings", schemas.SETTINGS).first()
        return CrawlConfig.from_dict({k: v for k, v in row.asDict().items() if v is not None}) if row else CrawlConfig()

    def table(self, name: str) -> DataFrame:
        path = f"{self.meta}/{name}"
        return self.spark.read.schema(TABLES[name]).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], TABLES[name])

    def save(self, summary: DataFrame | None = None, config: CrawlConfig | None = None, **tables: DataFrame) -> None:
        """Overwrites the named tables. The frontier is one of them, so a crawl that was stopped goes on where it was.

        A table must not be read from the place that it is written to; the crawl's tables lie in the shared folder.
        """
        for name, df in tables.items():
            df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("overwrite").parquet(f"{self.meta}/{name}")
        if summary is not None:
            write_json(summary, f"{self.meta}/summary")
        if config is not None:
            self._settings(config)
        row = read_json(self.spark, f"{self.meta}/manifest", schemas.MANIFEST).first()
        self._manifest(row.project_name if row else "", row.created_at if row else time.time(), time.time())

    def append_log(self, entries: DataFrame) -> None:
        write_json(entries, f"{self.meta}/crawl_log", "append")

    def log(self) -> DataFrame:
        return read_json(self.spark, f"{self.meta}/crawl_log", schemas.LOG)


def write_zones(files: DataFrame, path: str) -> None:
    """files (local_path, text) as Parquet, a folder for each zone."""
    files.withColumn("zone", zone(F.col("local_path"))).write.mode("overwrite").partitionBy("zone").parquet(path)


def export_files(files: DataFrame, root: str) -> DataFrame:
    """Writes files (local_path, body) as ordinary files under a folder that all machines share; local_path and bytes.

    Each is written under another name and moved, so a task that runs again does no harm.
    """
    rows = files.select("local_path", F.col("body").cast("binary").alias("body"))

    def run(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for name, body in zip(batch.column("local_path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} lies outside the project")
                place = f"{top}/{name}"
                system.create_dir(place.rpartition("/")[0])
                with system.open_output_stream(f"{place}.part") as out:
                    out.write(body or b"")
                system.move(f"{place}.part", place)
                sizes.append(len(body or b""))
            yield pa.RecordBatch.from_arrays([batch.column("local_path"), pa.array(sizes, pa.int64())], names=["local_path", "bytes"])

    return rows.mapInArrow(run, "local_path string, bytes long")


#: Bytes of bodies after which an archive is closed.
ARCHIVE_BYTES = 64 << 20


def archive(files: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """ZIP archives (deflate) of files (local_path, body): shard, archive and files (the number in it).

    Files are dealt out by their paths to as many tasks as their bytes ask for, in order of path. A task closes an
    archive once it holds `most` bytes, so its memory does not grow with the project; one file is the least archive.
    """
    rows = files.select("local_path", F.col("body").cast("binary").alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0

    def run(batches):
        task, k, size, names = TaskContext.get().partitionId(), 0, 0, 0
        out = held = None

        def closed():
            held.close()
            return pa.RecordBatch.from_pydict({"shard": [task << 32 | k], "archive": pa.array([out.getvalue()], pa.binary()), "files": [names]})

        for batch in batches:
            for name, body in zip(batch.column("local_path").to_pylist(), batch.column("body"), strict=True):
                if held is None:
                    out, size, names = io.BytesIO(), 0, 0
                    held = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                data = body.as_py() or b""
                held.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
                size, names = size + len(data), names + 1
                if size >= most:
                    yield closed()
                    held, k = None, k + 1
        if held is not None:
            yield closed()

    dealt = rows.repartition(total // most + 1, "local_path").sortWithinPartitions("local_path")
    return dealt.mapInArrow(run, "shard long, archive binary, files long")


def archived_files(archives: DataFrame) -> DataFrame:
    """local_path and body of every file of the archives."""
    def run(batches):
        for batch in batches:
            for held in batch.column("archive"):
                with zipfile.ZipFile(io.BytesIO(held.as_py())) as told:
                    for name in told.namelist():
                        yield pa.RecordBatch.from_pydict({"local_path": [name], "body": pa.array([told.read(name)], pa.binary())})

    return archives.select("archive").mapInArrow(run, "local_path string, body binary")
