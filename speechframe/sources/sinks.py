"""Sinks: appends, overwrites by rename, dead letters and the texts that a meeting keeps.

A table is replaced by writing beside it and renaming, which readers see as one step where the store
renames atomically. Writers are Spark's; the driver only moves names.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions.text import fingerprint, safe_stem


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def append_events(events: DataFrame, path: str) -> None:
    """Adds events as JSON lines; null fields are left out."""
    events.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", tries: int = 3, delay: float = 0.5) -> None:
    """Writes df beside the target, then renames it there; df may read the target.

    A rename that fails is tried again, after twice the time each. A folder can't be renamed over another,
    so the old table stands aside for a moment: if the writer dies then, restore_table() brings it back.
    """
    spark = df.sparkSession
    beside, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    df.write.format(fmt).save(beside)
    fs, target = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(old)
    had = fs.exists(target)
    if had:
        fs.rename(target, aside)
    for n in range(tries):
        if fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), target):
            break
        time.sleep(delay * 2**n)
    else:
        if had:
            fs.rename(aside, target)
        raise OSError(f"{path} couldn't be replaced")
    if had:
        fs.delete(aside, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the folder that spark.checkpoint.dir names, or, in one process, in a temporary one: computed
    once however often it is read, and read again where an executor is lost."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='speechframe-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/speechframe-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def restore_table(spark: SparkSession, path: str) -> bool:
    """Puts the table that a broken-off replace_table() left aside back in its place; False where there is nothing to do."""
    fs, target = _fs(spark, path)
    aside = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}-old-*"))
    return bool(not fs.exists(target) and aside and fs.rename(aside[0].getPath(), target))


def save_file(spark: SparkSession, path: str, text: str) -> None:
    """One small text under exactly this name: written beside it, then renamed over it in one step where the store can."""
    fs, target = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-new-{uuid.uuid4().hex}")
    fs.setWriteChecksum(False)  # a local store would leave a second file beside this one
    try:
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
    finally:
        fs.setWriteChecksum(True)
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(target), how)


def save_files(files: DataFrame) -> int:
    """Each row's value (path, value) under its exact path, for sources that read a file a record. A driver's loop over
    small records of one command, such as sidecars; tables go to save_partitioned()."""
    n = 0
    for row in files.select("path", "value").toLocalIterator():
        save_file(files.sparkSession, row["path"], row["value"])
        n += 1
    return n


def trim_log(lines: DataFrame, path: str, keep: int = S.KEEP_LINES) -> None:
    """The log's last lines in place of the whole."""
    last = lines.orderBy(F.desc("ord")).limit(keep).orderBy("ord").select("value")
    replace_table(last, path, "text")


def registry_json(registry: DataFrame) -> DataFrame:
    """One JSON line for each speaker: id, name and the samples in order."""
    g = registry.groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "embedding", "embedding_model", "source", "added"))).alias("s"))
    samples = F.transform("s", lambda x: F.struct(x["embedding"].alias("embedding"), x["embedding_model"].alias("embedding_model"), x["source"].alias("source"), x["added"].alias("added")))
    return g.select(F.to_json(F.struct("id", "name", samples.alias("samples"))).alias("value"))


def registry_file(registry: DataFrame, path: str, version: int = 1) -> DataFrame:
    """path, value: the registry as one document {version, speakers} that load_registry() reads, speakers in order of their first samples."""
    lines = registry_json(registry).select("value", F.get_json_object("value", "$.id").alias("id"))
    first = registry.groupBy("id").agg(F.min("ord").alias("first"))
    ordered = lines.join(first, "id").agg(F.array_sort(F.collect_list(F.struct("first", "id", "value"))).alias("s"))
    speakers = F.array_join(F.transform("s", lambda x: x["value"]), ",")
    return ordered.select(F.lit(path).alias("path"), F.concat(F.lit(f'{{"version":{version},"speakers":['), F.coalesce(speakers, F.lit("")), F.lit("]}")).alias("value"))


def pending_files(pending: DataFrame, directory: str) -> DataFrame:
    """path, value: a document for each meeting's naming queue (meeting_id, meeting_dir, audio_file, and the columns of
    queues.pending_speakers) that load_pending() reads; the first label first."""
    entry = F.struct(*[c for c in pending.columns if c not in ("meeting_id", "meeting_dir", "audio_file")])
    g = pending.groupBy("meeting_dir", "audio_file").agg(F.array_sort(F.collect_list(F.struct("label", entry.alias("entry")))).alias("s"))
    doc = F.to_json(F.struct("meeting_dir", "audio_file", F.transform("s", lambda x: x["entry"]).alias("speakers")))
    return g.select(F.concat(F.lit(f"{directory}/"), safe_stem(F.col("meeting_dir")), F.lit(".json")).alias("path"), doc.alias("value"))


def save_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrites the partitions that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def save_texts(texts: DataFrame, path: str) -> None:
    """Texts (meeting_dir, kind, value) as text files under a folder for each meeting and kind."""
    texts.select("meeting_dir", "kind", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("meeting_dir", "kind").text(path)


def job_json(jobs: DataFrame) -> DataFrame:
    """path, value: sidecars with the model always, even null, and the other fields where they aren't empty."""
    rest = F.to_json(F.struct(*[F.nullif(c, F.lit("")).alias(c) for c in ("profile", "asr_engine", "transcript_path")]))
    model = F.concat(F.lit('{"claude_model":'), F.coalesce(F.to_json(F.array("claude_model")), F.lit("[null]")))
    head = F.regexp_replace(model, r":\[(.*)\]$", r":$1")
    return jobs.select("path", F.when(rest == "{}", F.concat(head, F.lit("}"))).otherwise(F.concat(head, F.lit(","), F.substr(rest, F.lit(2)))).alias("value"))


def record_transcripts(jobs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Jobs (path, ...) with the transcript path of transcripts (path, transcript_path) where there is one."""
    new = transcripts.select("path", F.col("transcript_path").alias("__t"))
    return jobs.join(new, "path", "left").withColumn("transcript_path", F.coalesce("__t", "transcript_path")).drop("__t")


def manifest_json(sessions: DataFrame) -> DataFrame:
    """path, value of session manifests."""
    return sessions.select("path", F.to_json(F.struct(*[c for c in sessions.columns if c != "path"])).alias("value"))


def dead_letters(failures: DataFrame, path: str) -> None:
    """Appends failed inputs (path, error) with the time."""
    failures.select("path", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def cache_turns(turns: DataFrame, recordings: DataFrame, model: str, path: str) -> None:
    """Turns (name, ...) into the cache under the fingerprint of their recording (name, length, modified)."""
    key = recordings.select("name", fingerprint(F.col("name"), F.col("length"), F.unix_timestamp("modified"), F.lit(model)).alias("fingerprint"))
    save_partitioned(turns.join(key, "name").withColumn("model", F.lit(model)), path, "model", "fingerprint")


def clip_plan(clips: DataFrame) -> DataFrame:
    """file, start, end of clips (audio, ord, speaker, start, end), under names that any store takes; the cutting is a plug point."""
    name = F.concat(F.format_string("%02d_", "ord"), safe_stem(F.col("audio")), F.lit("_"), safe_stem(F.col("speaker")), F.lit(".wav"))
    return clips.select(name.alias("file"), "start", "end")


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames one path; False where it isn't there."""
    fs, p = _fs(spark, source)
    return bool(fs.exists(p) and fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def clear_enrolment(spark: SparkSession, directory: str, audio_file: str) -> list[str]:
    """Deletes what stands beside a recording in the enrolment folder, and gives the names of what was there.

    The recording itself stays. A name that is no plain file name deletes nothing; a second run finds nothing and changes nothing.
    """
    if audio_file in ("", ".", "..") or set("/\\") & set(audio_file):
        return []
    names = [audio_file + end for end in S.ENROLL_SUFFIXES]
    return [name for name in names if delete(spark, f"{directory}/{name}")]
