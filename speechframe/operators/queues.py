"""Naming and enrolment queues: who is to be asked, what is requested, done, stale or orphaned.

Files stand as rows of a listing; each queue is a join of listings, and its upkeep a new set of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions.text import is_safe_name
from speechframe.operators.intervals import clean_intervals, seconds_by_speaker, select_intervals


def longest_samples(merged: DataFrame, count: int = S.SAMPLE_LINES) -> DataFrame:
    """meeting_id, speaker, samples: the longest lines of each speaker, the earlier of equals, in order of time."""
    w = W.partitionBy("meeting_id", "speaker").orderBy(F.desc(F.char_length("text")), "seq")
    top = merged.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= count)
    return top.groupBy("meeting_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "end", "text"))).alias("__s")).select("meeting_id", "speaker", F.transform("__s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("samples"))


def pending_speakers(merged: DataFrame, labels: DataFrame, prints: DataFrame, matches: DataFrame, min_seconds: float = S.MIN_SPEAKING_SECONDS) -> DataFrame:
    """Speakers to ask about: those with a voice print and min_seconds of speech whom no match is confident of.

    merged: meeting_id, seq, start, end, speaker, text; labels: meeting_id, speaker, label; prints:
    meeting_id, speaker, embedding, seconds, segment_count, embedding_model; matches: meeting_id,
    speaker, speaker_id, name, score, confident.
    """
    keys = ["meeting_id", "speaker"]
    spoken = seconds_by_speaker(merged).where(F.col("seconds") >= min_seconds)
    asked = spoken.join(matches.where("confident"), keys, "left_anti").join(prints.withColumnRenamed("seconds", "embedding_seconds"), keys)
    guess = matches.select(*keys, F.struct("speaker_id", "name", F.round("score", 3).alias("score")).alias("suggested"))
    d = asked.join(labels.select(*keys, "label"), keys, "left").join(longest_samples(merged), keys).join(guess, keys, "left")
    return d.select(*keys, F.coalesce("label", "speaker").alias("label"), F.round("seconds", 1).alias("speaking_seconds"), "embedding", "embedding_seconds", "segment_count", "embedding_model", "samples", "suggested")


def find_pending(pending: DataFrame, meeting_dir: str, label: str) -> DataFrame:
    """The first entry of a meeting's queue with the label. pending: meeting_dir, speakers array<struct<label, ...>>."""
    rows = pending.where(F.col("meeting_dir") == meeting_dir).select("meeting_dir", F.posexplode("speakers").alias("pos", "entry"))
    return rows.where(F.col("entry.label") == label).orderBy("pos").limit(1)


def resolve_pending(pending: DataFrame, resolved: DataFrame) -> DataFrame:
    """The queues without the resolved (meeting_dir, label) entries; queues left empty drop out."""
    rows = pending.select("meeting_dir", F.posexplode("speakers").alias("pos", "entry")).withColumn("label", F.col("entry.label"))
    left = rows.join(resolved.select("meeting_dir", "label"), ["meeting_dir", "label"], "left_anti")
    return left.groupBy("meeting_dir").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("__s")).select("meeting_dir", F.transform("__s", lambda x: x["entry"]).alias("speakers"))


def write_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (audio_file) whose name is safe, whose kind is audio and whose file exists."""
    audio = F.lower(F.regexp_extract("audio_file", r"\.([^.]+)$", 1)).isin(*S.AUDIO_EXTENSIONS)
    return requests.where(is_safe_name(F.col("audio_file")) & audio).join(files.select("audio_file"), "audio_file", "left_semi")


def pending_requests(files: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """audio_file of files that are requested and have no result."""
    return files.select("audio_file").distinct().join(requests, "audio_file", "left_semi").join(results, "audio_file", "left_anti")


def valid_results(results: DataFrame, files: DataFrame, tolerance: float = S.MTIME_TOLERANCE_SECONDS) -> DataFrame:
    """Results (audio_file, audio_size, audio_mtime, ...) whose file is still of that size and, within the tolerance, that age."""
    f = files.select("audio_file", F.col("length").alias("__l"), F.col("mtime").alias("__m"))
    return results.join(f, "audio_file").where((F.col("audio_size") == F.col("__l")) & (F.abs(F.col("audio_mtime") - F.col("__m")) <= tolerance)).drop("__l", "__m")


def stale_results(results: DataFrame, files: DataFrame) -> DataFrame:
    """audio_file of results that no longer hold."""
    return results.select("audio_file").distinct().join(valid_results(results, files), "audio_file", "left_anti")


def accept_results(results: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results of files that are the same before and after the analysis, audio_file of those that changed meanwhile)."""
    same = before.select("audio_file", "length", "mtime").join(after.select("audio_file", "length", "mtime"), ["audio_file", "length", "mtime"])
    return results.join(same.select("audio_file"), "audio_file", "left_semi"), results.select("audio_file").join(same, "audio_file", "left_anti")


def enroll_state(files: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """audio_file, state, status, reason: done with a result, queued with a request, else idle."""
    q = requests.select("audio_file", F.lit(True).alias("__q")).distinct()
    r = results.select("audio_file", "status", "reason")
    state = F.when(F.col("status").isNotNull(), "done").when(F.col("__q"), "queued").otherwise("idle")
    return files.select("audio_file").distinct().join(q, "audio_file", "left").join(r, "audio_file", "left").select("audio_file", state.alias("state"), "status", "reason")


def orphan_sidecars(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """Sidecars (audio_file, ...) whose audio is gone."""
    return sidecars.join(files.select("audio_file"), "audio_file", "left_anti")


def session_parts(listing: DataFrame) -> DataFrame:
    """session, name, path of the parts of recordings that hold sound; listing: session, name, path, length."""
    return listing.where(F.col("name").rlike(r"^part.*\.wav$") & (F.col("length") > S.MIN_PART_BYTES)).select("session", "name", "path")


def orphan_sessions(sessions: DataFrame, manifests: DataFrame, parts: DataFrame) -> DataFrame:
    """Sessions that can be finished: with a manifest and at least one part."""
    return sessions.join(manifests, "session", "left_semi").join(parts, "session", "left_semi")


def unrecoverable_sessions(sessions: DataFrame, manifests: DataFrame) -> DataFrame:
    return sessions.join(manifests, "session", "left_anti")


def concat_lists(parts: DataFrame) -> DataFrame:
    """session, list: the lines that name a session's parts in order, for an encoder."""
    from speechframe.functions.text import concat_line

    g = parts.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("name", concat_line(F.col("path")).alias("l")))).alias("__s"))
    return g.select("session", F.concat(F.array_join(F.transform("__s", lambda x: x["l"]), "\n"), F.lit("\n")).alias("list"))


def classify_clips(turns: DataFrame, prints: DataFrame | None = None, min_seconds: float = S.MIN_SPEAKING_SECONDS) -> DataFrame:
    """meeting_id, speaker_count, speaking_seconds, ignored_short_labels, status, reason of single-speaker clips.

    Asked in this order: more than one speaker with clean stretches, too little speech, no clean stretch,
    no voice print (prints: meeting_id, speaker, seconds), too little clean speech. Without prints the
    clean stretches stand in for them.
    """
    raw = seconds_by_speaker(turns).groupBy("meeting_id").agg(F.count("*").alias("labels"), F.sum("seconds").alias("speaking_seconds"))
    chosen = select_intervals(clean_intervals(turns))
    usable = chosen.groupBy("meeting_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("clean_seconds"))
    if prints is not None:
        usable = usable.drop("clean_seconds").join(prints.select("meeting_id", "speaker", F.col("seconds").alias("clean_seconds")), ["meeting_id", "speaker"], "left")
    u = usable.groupBy("meeting_id").agg(F.count("*").alias("speaker_count"), F.max("clean_seconds").alias("clean_seconds"))
    d = raw.join(u, "meeting_id", "left").withColumn("speaker_count", F.coalesce("speaker_count", F.lit(0)).cast("bigint")).withColumn("speaking_seconds", F.round("speaking_seconds", 1))
    reason = (
        F.when(F.col("speaker_count") > 1, "multiple_speakers")
        .when(F.col("speaking_seconds") < min_seconds, "too_short")
        .when((F.col("speaker_count") == 0) | F.col("clean_seconds").isNull(), "unusable_embedding")
        .when(F.col("clean_seconds") < min_seconds, "too_short")
    )
    return d.select("meeting_id", "speaker_count", "speaking_seconds", (F.col("labels") - F.col("speaker_count")).alias("ignored_short_labels"), F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"), reason.alias("reason"))
