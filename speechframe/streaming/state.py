"""Streams that keep state by key: markers that are seen once, and the live state of jobs and recorders.

Each is a stateful processor over Spark's own state store, with a fixed-size value a key and timers that
drop it. The value of every key can be asked for through the state data source, while the stream runs or
after it: it equals the batch query over the events that the stream has taken in. The session needs the
RocksDB state store (use_state_store()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from speechframe import schema as S


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store; a store that the session names already stays if it is one."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(setting, ""):
        spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Once(StatefulProcessor):
    """The first marker of each key; a timer at its time and the delay forgets the key."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: r["__ms"], default=None)  # one pass; only the earliest row is held
        if first is not None and not self.first.exists():
            self.first.update((first["__ms"],))
            self.handle.registerTimer(first["__ms"] + self.delay_ms)
            yield Row(**{c: first[c] for c in first.__fields__ if c not in ("__key", "__ms")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def once_only(markers: DataFrame, key: str, delay_seconds: int = 3600, time: str = "ts") -> DataFrame:
    """Each key's first marker of a stream; later ones of the key are dropped until the watermark passes its time and the delay.

    Restarts don't repeat a marker: what was seen stands in the checkpoint. Markers later than the
    watermark, which trails the latest by the delay, are dropped. A key that was forgotten is seen again
    at its next marker. Null keys are one key; markers without a time are dropped.
    """
    use_state_store(markers.sparkSession)
    timed = markers.where(F.col(time).isNotNull()).withWatermark(time, f"{delay_seconds} seconds")
    keyed = timed.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))).withColumn("__ms", F.unix_millis(F.col(time).cast("timestamp")))
    return keyed.groupBy("__key").transformWithState(_Once(delay_seconds * 1000), markers.schema, "Append", "EventTime")


class _Fold(StatefulProcessor):
    """A value a key, which each row changes by a step that doesn't depend on the rows' order."""

    def __init__(self, key: str, schema: str, start: tuple, step: Callable[[tuple, Row], tuple], shown: Callable[[tuple], dict], keep_ms: int | None):
        self.key, self.schema, self.start, self.step, self.shown, self.keep_ms = key, schema, start, step, shown, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("live", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        value, latest = tuple(self.value.get()) if self.value.exists() else self.start, 0
        for row in rows:
            value, latest = self.step(value, row), max(latest, row["__ms"])
        if self.keep_ms is not None:
            timers = [t for t in self.handle.listTimers() if t < latest + self.keep_ms]
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.keep_ms)
        self.value.update(value)
        yield Row(**{self.key: key[0]}, **self.shown(value))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def _folded(events: DataFrame, time: str, out: str, processor: _Fold) -> DataFrame:
    use_state_store(events.sparkSession)
    kept = processor.keep_ms is not None
    timed = events.where(F.col(time).isNotNull()).withWatermark(time, f"{processor.keep_ms} milliseconds") if kept else events
    ms = F.unix_millis(F.col(time).cast("timestamp")) if kept else F.lit(0).cast("long")
    return timed.withColumn("__ms", ms).groupBy(processor.key).transformWithState(processor, out, "Update", "EventTime" if kept else "None")


def _job_step(value: tuple, row: Row) -> tuple:
    """(code, its ord, stage, its ord, failed): the last code that takes or releases the card, the last that has a stage."""
    code, code_ord, stage, stage_ord, failed = value
    if row["code"] in (*S.GPU_CODES, *S.RELEASE_CODES) and (code_ord is None or row["ord"] > code_ord):
        code, code_ord = row["code"], row["ord"]
    if row["code"] in S.STAGES and (stage_ord is None or row["ord"] > stage_ord):
        stage, stage_ord = S.STAGES[row["code"]], row["ord"]
    return code, code_ord, stage, stage_ord, failed or row["code"] == "job_failed"


def _job_shown(value: tuple) -> dict:
    return {"code": value[0], "busy": value[0] in S.GPU_CODES, "stage": value[2], "failed": value[4]}


def live_jobs(events: DataFrame, keep_seconds: int | None = None) -> DataFrame:
    """job, code, busy, stage, failed of each job of a stream of events (job, code, ord, ts) that a batch changes.

    With keep_seconds a job is forgotten once the watermark is so long past its last event, so the state
    holds live jobs only; events later than the watermark, and those without a time, are then dropped.
    """
    fold = _Fold("job", "code string, code_ord long, stage int, stage_ord long, failed boolean", (None, None, 0, None, False), _job_step, _job_shown, None if keep_seconds is None else keep_seconds * 1000)
    return _folded(events.where("job IS NOT NULL"), "ts", "job string, code string, busy boolean, stage int, failed boolean", fold)


def _recorder_step(value: tuple, row: Row) -> tuple:
    status, status_ord, since, now = value
    if status_ord is None or row["ord"] > status_ord:
        status, status_ord = row["status"], row["ord"]
    if row["status"] == "recording":
        since = row["us"] if since is None else min(since, row["us"])
    return status, status_ord, since, row["us"] if now is None else max(now, row["us"])


def _recorder_shown(value: tuple) -> dict:
    status, _, since, now = value
    return {"status": status, "since": since, "elapsed": None if status == "idle" or since is None else (now - since) // 1_000_000}


def live_recorders(events: DataFrame, keep_seconds: int | None = None) -> DataFrame:
    """session, status, since (microseconds), elapsed of each recorder of a stream of events (session, ts, status, ord) that a batch changes; keep_seconds as for live_jobs()."""
    fold = _Fold("session", "status string, status_ord long, since long, now long", (None, None, None, None), _recorder_step, _recorder_shown, None if keep_seconds is None else keep_seconds * 1000)
    timed = events.select("session", "status", "ord", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return _folded(timed, "ts", "session string, status string, since long, elapsed long", fold)


def _state(spark: SparkSession, checkpoint: str) -> DataFrame:
    use_state_store(spark)
    return spark.read.format("statestore").option("stateVarName", "live").load(checkpoint)


def jobs_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """job, code, busy, stage, failed of every job in the state of a live_jobs() stream after its last batch."""
    s = _state(spark, checkpoint).select(F.col("key.job").alias("job"), "value.*")
    return s.select("job", "code", F.coalesce(F.col("code").isin(*S.GPU_CODES), F.lit(False)).alias("busy"), "stage", "failed")


def recorders_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session, status, since, elapsed of every recorder in the state of a live_recorders() stream after its last batch."""
    s = _state(spark, checkpoint).select(F.col("key.session").alias("session"), "value.*")
    seconds: Column = F.expr("(now - since) div 1000000")
    return s.select("session", "status", F.timestamp_micros("since").alias("since"), F.when(F.col("status") != "idle", seconds).alias("elapsed"))
