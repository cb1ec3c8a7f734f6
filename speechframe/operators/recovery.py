"""Recordings that were broken off, and inputs that failed: commands that can be run again after any step.

A session folder holds parts of a recording and a manifest. Finishing it encodes beside the target, leaves
the sidecar in the inbox, renames the recording there, drops the manifest, then the rest. Whatever step a
command dies after, running it again ends in the same files: a session without a manifest is debris, one
whose recording is already published only has to be cleared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.functions.text import basename
from speechframe.operators import queues
from speechframe.sources import files, sinks

Encode = Callable[[str, str], None]


class NoAudio(Exception):
    """A session whose parts hold no sound."""


def sessions(spark: SparkSession, inbox: str) -> DataFrame:
    """session (path), stem, has_manifest of an inbox's session folders."""
    fs, glob = sinks._fs(spark, f"{inbox}/.session-*")
    found = [s.getPath().toString() for s in (fs.globStatus(glob) or []) if s.isDirectory()]
    names = spark.createDataFrame([(p,) for p in found], "session string")
    manifests = files.read_manifests(spark, inbox).select(F.regexp_replace("path", r"/[^/]*$", "").alias("at"), "stem")
    held = manifests.select(basename(F.col("at")).alias("name"), "stem")
    return names.withColumn("name", basename(F.col("session"))).join(held, "name", "left").select("session", "stem", F.col("stem").isNotNull().alias("has_manifest"))


def finish(spark: SparkSession, session: str, inbox: str, encode: Encode) -> str:
    """Publishes a session's recording and returns its path; encode(list of parts, target) makes one sound file of the parts in the list.

    The manifest says the stem and what the user chose. A recording that is there already is not encoded again.
    """
    manifest = spark.read.text(f"{session}/session.json", wholetext=True).select(F.from_json("value", files.S.MANIFEST).alias("m")).select("m.*").first()
    target, beside = f"{inbox}/{manifest.stem}.ogg", f"{session}/{manifest.stem}.ogg"
    if not files.exists(spark, target):
        parts = files.audio_parts(spark, session).select(F.lit(session).alias("session"), "name", "path")
        lines = queues.concat_lists(parts).first()
        if lines is None:
            raise NoAudio(session)
        sinks.save_file(spark, f"{session}/concat.txt", lines["list"])
        encode(f"{session}/concat.txt", beside)
        if manifest.claude_model or manifest.profile or manifest.asr_engine:
            chosen = spark.createDataFrame([("", manifest.claude_model, manifest.profile, manifest.asr_engine, None)], "path string, claude_model string, profile string, asr_engine string, transcript_path string")
            sinks.save_file(spark, f"{inbox}/{manifest.stem}.job.json", sinks.job_json(chosen).first()["value"])
        if not sinks.move(spark, beside, target):
            raise OSError(f"{beside} couldn't be published")
    # the manifest goes first: what is left without it can't be finished a second time
    sinks.delete(spark, f"{session}/session.json")
    sinks.delete(spark, session)
    return target


def recover(spark: SparkSession, inbox: str, encode: Encode) -> DataFrame:
    """session, code, detail: what became of each session that an earlier run left behind.

    orphan_swept: debris without a manifest, deleted; orphan_recovered: published, detail is the path;
    orphan_silent: no sound to publish, left; orphan_failed: left for the next time, detail is the error.
    One session's failure doesn't keep the others. A driver's loop over the sessions of one inbox; the sound is encoded by the plug point.
    """
    out = []
    for row in sessions(spark, inbox).orderBy("session").toLocalIterator():
        if not row.has_manifest:
            out.append((row.session, "orphan_swept" if sinks.delete(spark, row.session) else "orphan_failed", None))
            continue
        try:
            out.append((row.session, "orphan_recovered", finish(spark, row.session, inbox, encode)))
        except NoAudio:
            out.append((row.session, "orphan_silent", None))
        except Exception as error:  # reported with its session
            out.append((row.session, "orphan_failed", str(error)[:2000]))
    return spark.createDataFrame(out, "session string, code string, detail string")


def fail(spark: SparkSession, path: str, failed: str, error: str) -> str:
    """Moves an input with its sidecar into the folder of failed ones, with the error in a log beside it; returns the new path.

    The log is written first and the sidecar goes last; each step is left out where it was done before.
    """
    name = path.rpartition("/")[2]
    stem = name.rpartition(".")[0] or name
    fs, folder = sinks._fs(spark, failed)
    fs.mkdirs(folder)
    sinks.save_file(spark, f"{failed}/{stem}.error.log", error)
    if not sinks.move(spark, path, f"{failed}/{name}") and not files.exists(spark, f"{failed}/{name}"):
        raise FileNotFoundError(path)
    sinks.move(spark, f"{path.rpartition('/')[0]}/{stem}.job.json", f"{failed}/{stem}.job.json")
    return f"{failed}/{name}"


def fail_all(failures: DataFrame, failed: str) -> int:
    """fail() for each row (path, error) of a batch's failures; returns how many. A driver's loop over the failed inputs of one command."""
    n = 0
    for row in failures.select("path", "error").toLocalIterator():
        fail(failures.sparkSession, row.path, failed, row.error)
        n += 1
    return n
