"""Change logs that keep arriving: duplicate removal, open transactions, and the latest state of each record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StringType, StructField, StructType

#: Rows that end a transaction, and how; of both in one batch COMMIT holds.
TERMINATORS = {"COMMIT": "committed", "ROLLBACK": "rolled_back"}


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_repeats(events: DataFrame, ref: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each reference once within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(ref)


class _Open(StatefulProcessor):
    """Members of one transaction until its terminator or until its time is up."""

    def __init__(self, keys: list[str], members: StructType, open_for_ms: int):
        self.keys, self.members, self.open_for_ms = keys, members, open_for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.members)
        self.until = handle.getValueState("until", "ms long")
        self.row = Row(*self.keys, *self.members.names, "status")

    def _close(self, key: tuple, status: str) -> Iterator[Row]:
        if self.rows.exists():
            for member in self.rows.get():
                yield self.row(*key, *member, status)
        else:
            yield self.row(*key, *[None] * len(self.members), status)
        self.rows.clear()
        self._wake(None)

    def _wake(self, at: int | None) -> None:
        """Keep one timer, at a time or none."""
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
            self.until.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.until.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        ended, last, seen = None, 0, []
        for row in rows:
            last = max(last, row["at_ms_"])
            if row["event_type"] in TERMINATORS:
                ended = min(ended or row["event_type"], row["event_type"])
            else:
                seen.append(tuple(row[f.name] for f in self.members))
                if len(seen) == 10_000:
                    self.rows.appendList(seen)
                    seen = []
        if seen:
            self.rows.appendList(seen)
        if ended:
            yield from self._close(key, TERMINATORS[ended])
        else:
            before = self.until.get()[0] if self.until.exists() else 0
            self._wake(max(before, last + self.open_for_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        yield from self._close(key, "incomplete")


def open_transactions(events: DataFrame, keys: list[str], members: list[str], time: str = "ts", delay: str = "1 hour", open_for_ms: int = 3_600_000) -> DataFrame:
    """(keys, members, status): the rows of each transaction once it is known how it ended.

    Rows are held in a list in the state store until a row whose event_type is COMMIT or ROLLBACK; if none comes within
    open_for_ms of event time after the last row, a timer hands them out as incomplete. A terminator with no rows before it
    gives one row with null members. Rows of a batch belong together whatever their order in it; rows that come after the
    terminator's batch start anew. The state store must be RocksDB (use_state_store), which keeps a long transaction on
    disk; members leave it one at a time.
    """
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withColumn("at_ms_", F.unix_millis(time)).withWatermark(time, delay)
    held = StructType([marked.schema[m] for m in members])
    out = StructType([*[marked.schema[k] for k in keys], *held.fields, StructField("status", StringType())])
    return marked.groupBy(*keys).transformWithState(_Open(keys, held, open_for_ms), out, "Append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    """Set the session's state store to RocksDB, for queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transactions(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour", open_for_ms: int = 3_600_000) -> DataFrame:
    """(keys, n_events, status): open_transactions counted where only sizes are asked for; state is a count and a time.

    Rows are counted until a terminator; a transaction that stays open past open_for_ms of event time is incomplete.
    """
    names = ", ".join(f"{k} string" for k in keys)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*map(str, key), n, "incomplete")], columns=[*keys, "n_events", "status"])
            return
        done = None
        for batch in batches:
            ends = batch.event_type.isin(list(TERMINATORS))
            n += int((~ends).sum())
            last = max(last, int(batch[time].max().timestamp() * 1000))
            if ends.any():
                done = TERMINATORS[batch.event_type[ends].min()]
        if done:
            state.remove()
            yield pd.DataFrame([(*map(str, key), n, done)], columns=[*keys, "n_events", "status"])
            return
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + open_for_ms, state.getCurrentWatermarkMs() + 1))

    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return marked.groupBy(*keys).applyInPandasWithState(fold, f"{names}, n_events long, status string", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest(cells: DataFrame, keys: list[str], ord_col: str = "ord", value_col: str = "value") -> DataFrame:
    """The last VALUE of each key by order, for one batch or all of them."""
    return cells.groupBy(*keys).agg(F.max_by(F.col(value_col), F.col(ord_col)).alias(value_col), F.max(ord_col).alias(ord_col))


def keep_latest(cells: DataFrame, path: str, checkpoint: str, keys: list[str], parts: int = 64):
    """Start a query that keeps the latest value of each key under path, in hash parts. Returns the query.

    A batch rewrites only the parts it touches. Each part has two slots: a batch reads the one that holds the last version
    before its own and overwrites the other, so what is stored is at most twice the state, however many batches come,
    nothing has to be deleted, and a batch that is run again starts from what it started from the first time. Late rows lose by
    order.
    """
    spark = cells.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch, keys).withColumn("part", part)
        try:
            stored = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            whole = new.withColumn("slot", F.lit(0))
        else:
            touched = new.select("part").distinct()
            earlier = stored.filter(F.col("version") < number).join(touched, "part", "left_semi")
            old = current(earlier)
            slots = touched.join(_newest(earlier), "part", "left").select("part", F.when(F.col("slot") == 0, 1).otherwise(0).alias("slot"))
            whole = latest(old.select(*new.columns).unionByName(new), [*keys, "part"]).join(slots, "part")
        whole.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "part").parquet(path)

    return cells.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(stored: DataFrame) -> DataFrame:
    """(part, slot): where each part's last version is."""
    return stored.groupBy("part").agg(F.max_by("slot", "version").alias("slot"))


def current(stored: DataFrame) -> DataFrame:
    """Rows of each part's last version."""
    return stored.join(_newest(stored), ["part", "slot"], "left_semi")
