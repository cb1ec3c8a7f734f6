"""The whole batch job for meetings: segments and turns in, transcripts, statistics, queue and summaries out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.operators import dictionary as D
from speechframe.operators import intervals, models, queues, sequences, stats, voices
from speechframe.sources import sinks


@dataclass
class Meetings:
    """Tables that the job leaves, each keyed by meeting_id."""

    merged: DataFrame
    labels: DataFrame
    transcripts: DataFrame
    participants: DataFrame
    counts: DataFrame
    chunks: DataFrame
    summaries: DataFrame
    pending: DataFrame | None
    failures: DataFrame


def process(segments: DataFrame, turns: DataFrame, glossary: DataFrame, factory: Callable, prints: DataFrame | None = None, registry: DataFrame | None = None, max_tokens: int = S.CHUNK_MAX_TOKENS, overlap_tokens: int = S.CHUNK_OVERLAP_TOKENS, threshold: int = S.SINGLE_CALL_THRESHOLD) -> Meetings:
    """Joins speakers to segments, names the known voices, renders, corrects terms, merges runs, and summarises through the
    text model's factory: a transcript within the threshold in one call, a longer one chunk by chunk and then as a whole.

    The segments with their speakers, the corrected and the merged transcripts and the model's answers are written to the
    shared folder before they are used twice, so each is made once and the model is asked once for each chunk. A meeting whose calls all fail is listed in failures (meeting_id, error), not lost.
    """
    merged = sinks.stored(intervals.merge_segments_turns(segments, turns), "merged")
    names = matches = None
    if prints is not None and registry is not None:
        probes = prints.withColumn("label", F.concat_ws("\x1f", F.col("meeting_id").cast("string"), "speaker"))
        parts = F.split("label", "\x1f")
        matches = voices.match_known(probes, registry.withColumnRenamed("id", "speaker_id")).withColumn("meeting_id", parts[0]).withColumn("speaker", parts[1])
        names = matches.where("confident").select("meeting_id", "speaker", "name")
    labels = stats.speaker_labels(merged, names)
    transcripts = stats.render_transcript(merged, labels)
    fixed, counts = D.apply_exact(transcripts, glossary, "meeting_id", "md")
    fixed = sinks.stored(fixed, "fixed")
    segs = sequences.parse_segments(fixed)
    participants = stats.participants_line(stats.speaker_stats(segs))
    runs = sinks.stored(sequences.merge_transcripts(fixed), "runs")
    plans = models.summary_plan(runs, threshold)
    long = runs.join(plans.where("plan = 'map_reduce'"), "meeting_id", "left_semi")
    chunks = sequences.split_into_chunks(sequences.parse_segments(long), max_tokens, overlap_tokens)
    parts = sinks.stored(models.complete(chunks.withColumn("prompt", F.col("text")), factory, max_tokens), "parts")
    reduced = models.reduce_input(parts)
    whole = runs.join(plans.where("plan = 'single'"), "meeting_id", "left_semi").select(F.col("meeting_id").cast("string").alias("meeting_id"), F.col("md").alias("text"))
    asked = reduced.where("error IS NULL").select(F.col("meeting_id").cast("string").alias("meeting_id"), "text").unionByName(whole)
    body = sinks.stored(models.complete(asked.withColumn("prompt", F.col("text")), factory, max_tokens), "bodies")
    line = participants.select(F.col("meeting_id").cast("string").alias("meeting_id"), "line")
    times = models.timeline(parts).select(F.col("meeting_id").cast("string").alias("meeting_id"), "md")
    summaries = body.where("error IS NULL").join(line, "meeting_id", "left").join(times, "meeting_id", "left").select("meeting_id", F.concat_ws("\n\n", "line", F.coalesce("value", F.lit("")), "md").alias("summary"))
    failures = body.where("error IS NOT NULL").select("meeting_id", "error").unionByName(reduced.where("error IS NOT NULL").select(F.col("meeting_id").cast("string").alias("meeting_id"), "error"))
    pending = queues.pending_speakers(merged, labels, prints, matches) if matches is not None else None
    return Meetings(merged, labels, transcripts, participants, counts, chunks, summaries, pending, failures)
