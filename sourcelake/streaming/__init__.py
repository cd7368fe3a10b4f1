"""Applying delta events with Structured Streaming, and the pointer that makes a version the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT = "batch long, seq long, operation string, chunk_id string, relative_path string, content_hash string"
STATE = ["chunk_id", "relative_path", "content_hash"]


class Conflict(Exception):
    """The current version is not the one that a change was made for."""


class Pointer:
    """A small JSON file that names the current version, replaced by renaming; on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.jvm, self.path = jvm, jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> dict | None:
        if not self.fs.exists(self.path):
            return None
        stream = self.fs.open(self.path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def swap(self, expected: dict | None, new: dict) -> bool:
        """Makes ``new`` current if ``expected`` still is; False if ``new`` is current already, an identical retry."""
        now = self.read()
        if now == new:
            return False
        if now != expected:
            raise Conflict(f"the current version is {now}, not {expected}")
        temp = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}.{uuid.uuid4().hex}")
        stream = self.fs.create(temp, True)
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        if now is not None:
            self.fs.delete(self.path, False)
        if not self.fs.rename(temp, self.path):
            self.fs.delete(temp, False)
            raise Conflict("another version became current meanwhile")
        return True

    def remove(self, path: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)


def checked(batch: DataFrame) -> DataFrame:
    """The batch, if every event is one: known operations, ids, and for upserts a path and a hash. One bad event rejects it whole."""
    bad = ~F.coalesce(F.col("operation").isin("upsert", "delete"), F.lit(False)) | F.col("chunk_id").isNull() | ((F.col("operation") == "upsert") & (F.col("relative_path").isNull() | F.col("content_hash").isNull()))
    n = batch.where(bad).count()
    if n:
        raise ValueError(f"{n} events of the batch are invalid")
    return batch


def apply_stream(spark: SparkSession, events_dir: str, base: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Consumes JSON event files and keeps the state as Parquet versions under ``out``; gives the current one.

    The pointer ``out/current.json`` names the version and the last micro-batch in it, so a batch that runs again after
    a failure is left out if it took effect and else writes its version anew; further calls go on from there, and
    ``base`` counts in the first alone. Of several events of a chunk the last by batch and sequence holds. The version
    before the current one stays for its readers, older ones go.
    """
    pointer = Pointer(spark, f"{out}/current.json")
    if pointer.read() is None:
        base.select(*STATE).write.mode("overwrite").parquet(f"{out}/v=0")
        pointer.swap(None, {"version": 0, "batch": -1, "before": None})

    def step(batch: DataFrame, number: int) -> None:
        now = pointer.read()
        if now["batch"] >= number:
            return
        change = F.struct("operation", "relative_path", "content_hash")
        order = F.struct(F.coalesce("batch", F.lit(-1)).alias("batch"), F.coalesce("seq", F.lit(-1)).alias("seq"), change)
        last = checked(batch).groupBy("chunk_id").agg(F.max_by(change, order).alias("change")).select("chunk_id", "change.*")
        state = spark.read.parquet(f"{out}/v={now['version']}")
        new = last.where("operation = 'upsert'").select(*STATE)
        state.join(last.select("chunk_id"), "chunk_id", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{out}/v={number + 1}")
        pointer.swap(now, {"version": number + 1, "batch": number, "before": now["version"]})
        if now["before"] is not None:
            pointer.remove(f"{out}/v={now['before']}")

    stream = spark.readStream.schema(EVENT).json(events_dir).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/v={pointer.read()['version']}")
