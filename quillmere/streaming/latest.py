"""The last event of each document, kept on a stream with an end to its state.

The state of a document is the order of its last event (time in microseconds, kind, offset),
not the event: a message that is delivered again, or comes late, changes
nothing and gives no row.  A document that nothing happens to for ``ttl`` loses
its state; a message of before that is delivered again after that gives its row
once more, which ``latest_of`` sets right, since it goes by the events' order.

The events of a document are dealt out by offset over ``SALTS`` keys, so a busy
document is no single task's work; its last event is the last of these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quillmere.streaming import metrics
from quillmere.streaming.handlers import event_rank

SALTS = 8
PARTS_PER_CORE = 2
TTL_SECONDS = 7 * 24 * 3600
ORDER = ("event_micros", "rank", "offset")
_STATE = "event_micros long, rank int, offset long"


class _Latest(StatefulProcessor):
    def __init__(self, columns: Sequence[str], ttl_seconds: int):
        self.columns, self.ttl = list(columns), ttl_seconds * 1000

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", _STATE, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: tuple(r[c] for c in ORDER))
        order = tuple(best[c] for c in ORDER)
        known = self.last.get()  # None if there is none
        if known is None or tuple(known) < order:
            self.last.update(order)
            yield Row(document_id=key[0], **{c: best[c] for c in (*ORDER, *self.columns)})

    def close(self) -> None:
        pass


def latest_events(parsed: DataFrame, columns: Sequence[str], ttl_seconds: int = TTL_SECONDS, salts: int = SALTS) -> DataFrame:
    """Rows of a stream of parsed messages that are the last of their document
    so far: document_id, the order, and ``columns``."""
    wanted = [c for c in columns if c not in ORDER]
    ordered = parsed.select(
        "document_id", F.unix_micros("event_time").alias("event_micros"), event_rank().cast("int").alias("rank"),
        F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"), *wanted,
    ).filter(F.col("document_id").isNotNull() & F.col("event_micros").isNotNull())
    out = T.StructType([ordered.schema[c] for c in ("document_id", *ORDER, *wanted)])
    keyed = ordered.withColumn("salt", F.pmod("offset", F.lit(salts)).cast("int"))
    return keyed.groupBy("document_id", "salt").transformWithState(
        _Latest(wanted, ttl_seconds), out, "Update", "ProcessingTime")


def run(latest: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of each micro-batch until the input ends.  The
    state lives in the store that can let it end; without new messages there
    is no batch, or the clock would make them for ever.  Each batch opens and
    commits every part of the state, whatever it brings: there are no more of
    them than ``PARTS_PER_CORE`` for each core."""
    spark = latest.sparkSession
    parts = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    wanted = {
        "spark.sql.shuffle.partitions": str(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return metrics.run_updates(latest, path, checkpoint)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def latest_of(updates: DataFrame) -> DataFrame:
    """Current rows of a table written by ``run``: the last by the events'
    order, whatever batch or part of a document brought it."""
    columns = [c for c in updates.columns if c not in ("document_id", "batch")]
    last = F.max_by(F.struct(*columns), F.struct(*ORDER))
    return updates.groupBy("document_id").agg(last.alias("_row")).select("document_id", "_row.*")
