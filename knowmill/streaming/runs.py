"""Benchmark runs as a keyed state machine over a stream of records.

A run is pending until a record gives it another status. A transient status reverts to pending if no record follows within
``patience`` (a run that was cut off is taken up again); a terminal one refuses all further records, until its state expires
``keep`` after it was set. Both are decided by the records' own times, so the outcome does not hang on how a stream is cut
into batches: records of a run that come together are taken in order of time and place, and an expiry that lies before a
record is applied first. Timers only tell the expiry of runs that no record follows; they fire when the watermark passes.

A record is late if the watermark has passed it, and is dropped by Spark as in any watermarked stream (whose first watermark is 1970); ``delay`` must cover
the disorder of the source. State holds four values for each run. Records without a run, a time or a status are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from knowmill.operators.projects import TERMINAL, TRANSIENT

OUT = "run string, pos bigint, at bigint, status string, outcome string"


class Runs(StatefulProcessor):
    """Rows (run, pos, at, status, outcome): a record was accepted or refused, or a status reverted or expired. Times are
    milliseconds."""

    def __init__(self, patience: int, keep: int):
        self.patience, self.keep = patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "status string, at bigint, due bigint, pos bigint")

    def due(self, status: str, at: int) -> int:
        return at + self.patience if status in TRANSIENT else at + self.keep if status in TERMINAL else -1

    def expired(self, run: str, now: int) -> list[tuple]:
        """What the run's status has become by ``now``."""
        held = self.state.get() if self.state.exists() else None
        if held is None or held[2] < 0 or held[2] >= now:
            return []
        status, _, due, pos = held
        self.state.clear()
        return [(run, pos, due, "pending" if status in TRANSIENT else None, "reverted" if status in TRANSIENT else "expired")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, out = key[0], []
        records = pd.concat(list(rows)).sort_values(["at", "pos"])
        before = self.state.get() if self.state.exists() else None
        for at, pos, status in zip(records["at"].tolist(), records["pos"].tolist(), records["status"].tolist(), strict=True):
            out += self.expired(run, at)
            held = self.state.get() if self.state.exists() else None
            if held is not None and held[0] in TERMINAL:
                out.append((run, pos, at, held[0], "refused"))
                continue
            self.state.update((status, at, self.due(status, at), pos))
            out.append((run, pos, at, status, "accepted"))
        if before is not None and before[2] >= 0:
            self.handle.deleteTimer(before[2] + 1)
        held = self.state.get() if self.state.exists() else None
        if held is not None and held[2] >= 0:
            self.handle.registerTimer(held[2] + 1)
        yield pd.DataFrame(out, columns=["run", "pos", "at", "status", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self.expired(key[0], expiredTimerInfo.getExpiryTimeInMs()), columns=["run", "pos", "at", "status", "outcome"])

    def close(self) -> None:
        pass


def run_states(records: DataFrame, patience: str, keep: str, delay: str = "0 seconds", time: str = "time") -> DataFrame:
    """The outcomes of a stream of records (run, pos, status, time). The session's state store must be RocksDB. Times are rounded
    to the nearest millisecond, halves away from zero; the watermark too, so that timers and records agree. Records that are left out
    for want of a run or a status still tell how far the time has come."""
    ms = lambda s: int(pd.Timedelta(s).total_seconds() * 1000)
    timed = records.withColumn(time, F.col(time).cast("timestamp")).select("run", "pos", "status", F.expr(f"round(unix_micros(`{time}`), -3) div 1000").alias("at"))
    marked = timed.withColumn(time, F.timestamp_millis("at")).withWatermark(time, delay)
    rows = marked.where(F.when(F.col("run").isNotNull() & F.col("status").isNotNull(), F.col(time)).isNotNull())  # names the time, so it is not moved before the watermark
    return rows.groupBy("run").transformWithStateInPandas(Runs(ms(patience), ms(keep)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def replay(spark, path: str, roles, patience: str, keep: str, folder: str) -> DataFrame:
    """The outcomes of a finished table, read as a stream to its end and written to ``folder``; roles turns its rows into
    records. A second call with the same folder goes on where the first one ended."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")  # times without a zone are not shifted by the caller's
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = own.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since a stream's path must be a folder
    out = run_states(roles(stream), patience, keep)
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/rows")
