"""Streams: files that arrive, the activity log, paired audio blocks, rotation and device changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from speechframe import schema as S
from speechframe.operators.models import retrying


def watch(stream: DataFrame, process: Callable[[DataFrame, int], None], dead: str, checkpoint: str, once: bool = False, interval: str = "5 seconds", tries: int = 1, delay: float = 1.0) -> StreamingQuery:
    """Runs process on each micro-batch of new rows; a batch that fails, after so many tries, goes to the table of dead letters and the stream goes on.

    Delivery is at least once: process is to be idempotent in the batch number, as Spark's own file sink is.
    So are the dead letters: a batch's stand under its number.
    """
    attempt = retrying(process, tries, delay)

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            attempt(batch, number)
        except Exception as error:  # the failure is the result: it is written with its rows
            failed = batch.select(F.to_json(F.struct("*")).alias("row"), F.lit(str(error)[:2000]).alias("error"))
            failed.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    writer = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def inbox(spark: SparkSession, directory: str) -> DataFrame:
    """path, length, modified of audio files as they arrive; writers publish by renaming into the folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.*").schema("path string, modificationTime timestamp, length bigint, content binary").load(directory)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*S.AUDIO_EXTENSIONS)).select("path", "length", F.col("modificationTime").alias("modified"))


def activity(spark: SparkSession, directory: str) -> DataFrame:
    """Events of a folder of JSON lines as they are appended."""
    return spark.readStream.schema("ts timestamp, job string, code string, level string, ord bigint").json(directory)


def live_gpu_jobs(events: DataFrame) -> DataFrame:
    """job, code, busy of a stream of events: the last code of each job that takes or releases the card, as a running aggregate."""
    held = events.where(F.col("code").isin(*S.GPU_CODES, *S.RELEASE_CODES))
    return held.groupBy("job").agg(F.max_by("code", "ord").alias("code")).withColumn("busy", F.col("code").isin(*S.GPU_CODES))


def to_mono(frames: Column) -> Column:
    """Mean of the channels of each frame."""
    return F.transform(frames, lambda f: F.aggregate(f, F.lit(0.0), lambda a, x: a + x) / F.size(f))


def mix(a: Column, b: Column) -> Column:
    """Half of each of two arrays of samples; the shorter is filled with zeros, a missing one counts as empty."""
    none = F.array().cast("array<double>")
    return F.zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda x, y: 0.5 * F.coalesce(x, F.lit(0.0)) + 0.5 * F.coalesce(y, F.lit(0.0)))


def muted(samples: Column, mute: Column) -> Column:
    return F.when(mute, F.transform(samples, lambda x: x * 0.0)).otherwise(samples)


def zip_blocks(mic: DataFrame, speaker: DataFrame, delay: str | None = None, grace: str = "1 second") -> DataFrame:
    """session, block_no, ts, samples: the blocks (session, block_no, ts, samples) of two sources mixed; a side that never comes counts as silence.

    With a delay the inputs are streams: the outer join waits for the other side until the watermark has passed.
    """
    a, b = mic, speaker
    if delay is not None:
        a, b = a.withWatermark("ts", delay), b.withWatermark("ts", delay)
    a = a.select(F.col("session").alias("s1"), F.col("block_no").alias("n1"), F.col("ts").alias("t1"), F.col("samples").alias("x1"))
    b = b.select(F.col("session").alias("s2"), F.col("block_no").alias("n2"), F.col("ts").alias("t2"), F.col("samples").alias("x2"))
    same = (F.col("s1") == F.col("s2")) & (F.col("n1") == F.col("n2"))
    if delay is not None:
        same = same & (F.col("t2") >= F.col("t1") - F.expr(f"INTERVAL {grace}")) & (F.col("t2") <= F.col("t1") + F.expr(f"INTERVAL {grace}"))
    j = a.join(b, same, "full_outer")
    return j.select(F.coalesce("s1", "s2").alias("session"), F.coalesce("n1", "n2").alias("block_no"), F.coalesce("t1", "t2").alias("ts"), mix(F.col("x1"), F.col("x2")).alias("samples"))


def rotate(blocks: DataFrame, rate: int, seconds: int = S.ROTATE_SECONDS) -> DataFrame:
    """part of each block (session, block_no, n): by the samples of the session before it, so many seconds at the rate to a part."""
    from pyspark.sql import Window as W

    before = F.sum("n").over(W.partitionBy("session").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("part", F.call_function("div", F.coalesce(before, F.lit(0)), F.lit(rate * seconds)) + 1)


def rotation_windows(events: DataFrame, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """key, part start, blocks and peak of events (key, ts, value) in windows of time, for streams with late data."""
    w = F.window("ts", f"{minutes} minutes")
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy("key", w.alias("w")).agg(F.count("*").alias("blocks"), F.max(F.abs("value")).alias("peak")).select("key", F.col("w.start").alias("part_start"), "blocks", "peak")


def measure_peaks(blocks: DataFrame) -> DataFrame:
    """stream, peak: the greatest absolute sample of each stream's blocks (stream, samples)."""
    return blocks.groupBy("stream").agg(F.max(F.aggregate("samples", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("peak"))


def _last_name(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Changes of one stream's name; the state is the last name alone."""
    rows = pd.concat(list(batches)).dropna(subset=["name"]).sort_values("ts")
    last, out = state.get[0] if state.exists else None, []
    for ts, name in zip(rows["ts"], rows["name"], strict=True):
        if last is not None and name != last:
            out.append((key[0], ts, last, name))
        last = name
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(out, columns=["stream", "ts", "old", "new"])


def live_device_changes(polls: DataFrame) -> DataFrame:
    """stream, ts, old, new of a stream of polls (stream, ts, name), with the last name of each stream as state."""
    return polls.groupBy("stream").applyInPandasWithState(_last_name, "stream string, ts timestamp, old string, new string", "name string", "append", "NoTimeout")
