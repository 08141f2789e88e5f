"""Changes: debounced rescans, coalesced updates, watched folders, an event bus."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EXTENSIONS = "*.{ts,tsx,js,jsx}"
SKIPPED = ("node_modules", "dist", "build", ".next", "coverage", ".git", "__pycache__", ".turbo", ".cache", ".output", "vendor")


def debounce(events: DataFrame, gap: str = "300 milliseconds", key: str | None = None, time: str = "ts") -> DataFrame:
    """(key, start, end, n): one row for each run of events with no gap as long as gap; of a batch or (with a watermark) a stream."""
    at = F.session_window(F.col(time), gap)
    keys = [F.col(key).alias("key")] if key else []
    return events.groupBy(*keys, at.alias("w")).agg(F.count("*").alias("n")).select(*(["key"] if key else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """The last change of each key of (seq, key, op, ...): a delete takes back an upsert before it, and the reverse."""
    rest = [c for c in changes.columns if c != "key"]
    return changes.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("key", "x.*")


def list_sources(spark: SparkSession, folder: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, content) of the source files under folder, but for those below skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", EXTENSIONS).load(folder)
    return kept_sources(files, ignore)


def kept_sources(files: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    names = F.split("path", "/")
    skipped = F.exists(names, lambda x: x.isin(*SKIPPED, *ignore))
    return files.where(~skipped).select("path", F.col("length").alias("size"), F.decode("content", "utf-8").alias("content"))


def watch(spark: SparkSession, folder: str, rescan: Callable[[DataFrame, int], None], checkpoint: str, ignore: tuple[str, ...] = (), once: bool = False) -> StreamingQuery:
    """Call rescan with the new files of each micro-batch.

    The file source sees new files; a rescan that lists the folder (list_sources) finds those
    changed in place or gone, which is what a batch is a signal for.  Stop it by stop().
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", EXTENSIONS).load(folder)
    writer = kept_sources(files, ignore).writeStream.foreachBatch(rescan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 milliseconds")).start()


class Watcher:
    """At most one watch at a time; another replaces it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.query = spark, None

    def start(self, folder: str, rescan: Callable[[DataFrame, int], None], checkpoint: str, **more: Any) -> None:
        self.stop()
        self.query = watch(self.spark, folder, rescan, checkpoint, **more)

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    @property
    def watching(self) -> bool:
        return self.query is not None and self.query.isActive


class Bus:
    """Handlers by event; one that fails doesn't keep the others from being called."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[Any], None]]] = {}
        self.errors: list[tuple[str, Exception]] = []

    def on(self, event: str, handler: Callable[[Any], None]) -> None:
        if handler not in self.handlers.setdefault(event, []):
            self.handlers[event].append(handler)

    def off(self, event: str, handler: Callable[[Any], None]) -> None:
        if handler in self.handlers.get(event, []):
            self.handlers[event].remove(handler)

    def emit(self, event: str, payload: Any = None) -> None:
        for handler in list(self.handlers.get(event, [])):
            try:
                handler(payload)
            except Exception as error:  # noqa: BLE001
                self.errors.append((event, error))
