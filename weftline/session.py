"""What every job needs of its Spark session: the package on the executors, and a folder that all machines share."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch; with texts of megabytes the default of ten thousand would not fit a worker.
ARROW_ROWS = 1_000


def prepare(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once, and bounds the Arrow batches that go to Python workers."""
    context = spark.sparkContext
    if not getattr(context, "_weftline_sent", False):
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, folder, True)
        archive = os.path.join(folder, "weftline_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for here, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(here, name)
                        out.write(path, os.path.join("weftline", os.path.relpath(path, root)))
        context.addPyFile(archive)
        context._weftline_sent = True
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none (as in tests), one that is made for it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-shared-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(f"file://{folder}")
    return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder; later steps read it and not what made it.

    Unlike checkpoint() it computes the rows once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = _located(spark, path)
    system.deleteOnExit(place)  # at the latest; discard() deletes it before
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def scratch_folder(spark: SparkSession) -> str:
    """A new folder among the shared ones, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/weftline-{uuid.uuid4().hex}"
    place, system = _located(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """A small file of JSON that is there whole or not at all."""
    place, system = _located(spark, path)
    part, _ = _located(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    out = system.create(part)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    system.delete(place, False)
    if not system.rename(part, place):
        raise OSError(f"{path} could not be written")


def read_records(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The records of a folder by file name; files that are no whole record do not count."""
    place, system = _located(spark, folder)
    if not system.exists(place):
        return {}
    found = {}
    for r in spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("_metadata.file_name", "value").collect():
        try:
            found[r.file_name] = json.loads(r.value)
        except ValueError:
            continue
    return found


def discard(df: DataFrame) -> None:
    """Deletes a table that materialise() made and that nothing reads any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch_folder() made and that nothing reads any more."""
    place, system = _located(spark, path)
    system.delete(place, True)


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
