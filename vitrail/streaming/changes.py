"""Change feeds: events gathered until a quiet gap, applied to the catalog batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import text
from vitrail.operators import catalog
from vitrail.sources.tables import cut

#: The quiet gap that ends a batch of changes.
QUIET_GAP = "420 milliseconds"


def relevant(events: DataFrame, index_folder: str | None = None) -> DataFrame:
    """Events (library_id, kind, path, ts) that change something: mere access doesn't, nor do paths of the index folder."""
    kept = events.where(~F.coalesce(text.nocase(F.col("kind")) == "access", F.lit(False)))
    if index_folder is None:
        return kept
    return kept.where(~F.coalesce(F.array_contains(F.split("path", r"[\\/]"), index_folder), F.lit(False)))


def batches(events: DataFrame, key: str = "library_id", gap: str = QUIET_GAP, delay: str = "10 minutes") -> DataFrame:
    """(key, started, ended, n_events, paths): distinct sorted paths of each burst of events.

    Works on streams, in append mode, and on tables. ``ts`` may be without zone; it is read as the session's zone.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", delay)
    grouped = timed.groupBy(key, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("path")).alias("paths")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "paths")


def latest(requests: DataFrame, key: str, generation: str, value: str) -> DataFrame:
    """(key, generation, value): of several requests the newest; older ones are dropped."""
    return requests.groupBy(key).agg(F.max(generation).alias(generation), F.max_by(value, generation).alias(value))


def apply_changes(images: DataFrame, changed: DataFrame, removed: DataFrame, inspected: DataFrame) -> DataFrame:
    """The catalog after a batch: subtrees of removed paths go, inspected files are merged.

    ``changed`` (path) are reported paths; only inspected rows among them are merged. ``removed`` (path) may be folders, matched through the folders of each catalog path without regard to case; the path itself exactly.
    """
    folded = removed.select(text.nocase(F.col("path")).alias("_k"), F.col("path").alias("_removed"))
    above = images.select("path").distinct().withColumn("_a", F.explode(text.folders_above(F.col("path")))).withColumn("_k", text.nocase(F.col("_a")))
    hit = above.join(folded, "_k").where((F.col("_a") != F.col("path")) | (F.col("path") == F.col("_removed"))).select("path").distinct()
    rest = images.join(hit, "path", "left_anti")
    return catalog.upsert(rest, inspected.join(changed.select("path").distinct(), "path", "left_semi"))


def stream_into(events: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], trigger_once: bool = True):
    """Starts a stream that hands each micro-batch to ``apply(batch, batch_id)``.

    ``apply`` must give the same state if a batch comes again after a crash: writing a snapshot named by the batch does. Pausing is stopping the query;
    starting it again on the same checkpoint goes on where it stopped.
    """
    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


class Reconciler:
    """Applies batches of changes, and falls back to a whole rescan where the feed can't be trusted.

    While ``busy()`` batches queue up, by their paths; the next batch or ``drain()`` applies what has queued when it is idle. A batch that reports a feed error (kind ``error``),
    or a feed that failed (``failed``), asks for a rescan: ``rescan`` is called once idle, and what had queued is dropped, as the rescan sees it.
    """

    def __init__(self, apply: Callable[[DataFrame, int], None], rescan: Callable[[], None], busy: Callable[[], bool] = lambda: False):
        self.apply, self.rescan, self.busy = apply, rescan, busy
        self.queued: list[tuple[DataFrame, int]] = []
        self.reasons: list[str] = []

    def failed(self, reason: str) -> None:
        self.reasons.append(reason)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch.where(text.nocase(F.col("kind")) == "error").limit(1).count():
            self.failed("the feed reported an error")
        # The batch outlives its micro-batch only as a written table.
        self.queued.append((cut(batch), batch_id) if self.busy() else (batch, batch_id))
        self.drain()

    def drain(self) -> str:
        """What was done: ``waiting``, ``rescanned`` or ``applied``."""
        if self.busy():
            return "waiting"
        if self.reasons:
            self.queued.clear()
            self.rescan()
            self.reasons.clear()
            return "rescanned"
        while self.queued:
            self.apply(*self.queued[0])
            self.queued.pop(0)
        return "applied"

    def watch(self, query) -> None:
        """Waits for a streaming query; one that ends by an error asks for a rescan."""
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001 - whatever ended the feed, changes may have been missed
            self.failed(f"the feed stopped: {type(e).__name__}")
            self.drain()


def once_per_batch(apply: Callable[[DataFrame, int], None], done: Callable[[], int], mark: Callable[[int], None]) -> Callable[[DataFrame, int], None]:
    """``apply`` that skips batches already done, as a restart may bring the last one again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id > done():
            apply(batch, batch_id)
            mark(batch_id)

    return run


def debounced_batch_table(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """(key, batch, n_events) of a table, by gaps between consecutive events of a key, numbered from 1."""
    t = F.col("ts").cast("timestamp").cast("double")
    w = Window.partitionBy(key).orderBy("ts", "path")
    begun = events.withColumn("_t", t).withColumn("_new", (F.coalesce(F.col("_t") - F.lag("_t").over(w) >= gap_seconds, F.lit(True))).cast("int"))
    return begun.withColumn("batch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n_events"))
