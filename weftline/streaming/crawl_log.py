"""A crawl's log read as a stream: its state kept up to date, and counts over windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..session import read_records, write_record

#: Batches whose rows are kept apart before they are merged with all before them.
DELTAS = 10


def read_log(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The log's JSON lines as they are appended."""
    return spark.readStream.schema(schemas.LOG).option("maxFilesPerTrigger", files_at_once).json(path)


def windowed_counts(log: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """action and entries by window; a window is final when the watermark has passed it."""
    timed = log.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("window"), "action").agg(F.count("*").alias("entries")).select("window.start", "window.end", "action", "entries")


def latest_state(log: DataFrame) -> DataFrame:
    """The last action, path and error of each address, by seq; for output mode update or complete."""
    last = F.max_by(F.struct("action", "local_path", "error"), "seq").alias("last")
    return log.groupBy("url").agg(last).select("url", "last.*")


def follow(log: DataFrame, into, checkpoint: str) -> StreamingQuery:
    """Calls into(batch, number) for each batch of the log that has not been seen; seen batches are in the checkpoint."""
    return log.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class UpsertedState:
    """The last path of every visited and the last error of every failed address, kept up to date batch by batch.

    A batch writes one table under its own number: of each action and address the entry with the largest seq. So a batch
    that is run again, after a driver was lost between its rows and the stream's own record of it, writes the same rows to
    the same place, and what a batch writes follows the batch and not the state. Every DELTAS batches the tables are merged;
    the merged one counts once its record is written.
    """

    def __init__(self, spark: SparkSession, root: str, deltas: int = DELTAS):
        self.spark, self.root, self.deltas = spark, root.rstrip("/"), deltas

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: takes a batch of the log in."""
        _latest(batch).write.mode("overwrite").parquet(f"{self.root}/batches/{number:012d}")
        write_record(self.spark, f"{self.root}/taken/{number:012d}.json", {"number": number})
        merged, open_ = self._parts()
        if len(open_) >= self.deltas:
            _latest(self._read(merged, open_)).write.mode("overwrite").parquet(f"{self.root}/merged/{number:012d}")
            write_record(self.spark, f"{self.root}/merges/{number:012d}.json", {"number": number})

    def _parts(self) -> tuple[int, list[int]]:
        """The number of the last merge (-1 for none), and the batches after it."""
        merged = max((r["number"] for r in read_records(self.spark, f"{self.root}/merges").values()), default=-1)
        taken = sorted(r["number"] for r in read_records(self.spark, f"{self.root}/taken").values())
        return merged, [n for n in taken if n > merged]

    def _read(self, merged: int, open_: list[int]) -> DataFrame:
        paths = [f"{self.root}/merged/{merged:012d}"] * (merged >= 0) + [f"{self.root}/batches/{n:012d}" for n in open_]
        return self.spark.read.schema(schemas.LOG).parquet(*paths) if paths else self.spark.createDataFrame([], schemas.LOG)

    def entries(self) -> DataFrame:
        """The log's last entry for each action and address."""
        return _latest(self._read(*self._parts()))

    def url_map(self) -> DataFrame:
        return self.entries().where("action = 'visited' AND local_path IS NOT NULL").select("url", "local_path")

    def errors(self) -> DataFrame:
        return self.entries().where("action = 'failed'").select("url", "error")


def _latest(log: DataFrame) -> DataFrame:
    """Of each action and address the entry with the largest seq; of visits those with a path."""
    columns = log.columns
    rows = log.where("action <> 'visited' OR local_path IS NOT NULL")
    last = F.max(F.struct("seq", *(c for c in columns if c not in ("seq", "action", "url")))).alias("last")
    return rows.groupBy("action", "url").agg(last).select("action", "url", "last.*").select(*columns)
