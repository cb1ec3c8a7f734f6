"""File sources: listings, manifests, sidecars, logs, registries and dictionaries as DataFrames.

Paths go to Spark's readers alone, so that any store works. A missing path reads as an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions.text import basename, fingerprint, strip
from speechframe.functions.typed import as_str, leaf


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, name, length, modified of a folder's files. The listing is made by the reader; the contents aren't read."""
    if not exists(spark, directory):
        return spark.createDataFrame([], "path string, name string, length bigint, modified timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return files.select("path", basename(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"))


def scan_audio(spark: SparkSession, directory: str) -> DataFrame:
    """The audio files of a folder, by the case-blind ends of their names, in order of their paths."""
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return listing(spark, directory).where(kind.isin(*S.AUDIO_EXTENSIONS)).orderBy("path")


def stable_files(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """path of files whose size is positive and the same in two listings."""
    return earlier.select("path", "length").join(later.select("path", "length"), ["path", "length"]).where("length > 0").select("path")


def audio_parts(spark: SparkSession, session_dir: str) -> DataFrame:
    """The parts of a recording session that hold sound, in order; the listing decides, not the manifest."""
    return listing(spark, session_dir, "part*.wav").where(F.col("length") > S.MIN_PART_BYTES).orderBy("name")


def whole_texts(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, text of each file of a folder."""
    if not exists(spark, directory):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.text(directory, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_objects(spark: SparkSession, directory: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """path, doc (variant) of each JSON file of a folder; doc is an empty object where the file is broken or holds something else."""
    doc = F.try_parse_json("text")
    ok = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    return whole_texts(spark, directory, pattern, recursive).select("path", F.when(ok, doc).otherwise(F.parse_json(F.lit("{}"))).alias("doc"), ok.alias("valid"))


def read_jobs(spark: SparkSession, directory: str) -> DataFrame:
    """path and the string fields of job sidecars; a field of another type is null."""
    field = lambda n: as_str(leaf(F.col("doc"), "$." + n)).alias(n)
    return json_objects(spark, directory, "*.job.json").select("path", *[field(n) for n in ("claude_model", "profile", "asr_engine", "transcript_path")])


def read_transcripts(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs whose transcript still exists."""
    return jobs.join(files.select(F.col("path").alias("transcript_path")), "transcript_path", "left_semi")


def read_manifests(spark: SparkSession, inbox: str) -> DataFrame:
    """Manifests of an inbox's session folders in their schema; keys that older files lack are null. The folders' names start with a dot, which readers skip unless named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{inbox}/.session-*/session.json")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], f"path string, {S.MANIFEST}")
    texts = spark.read.text(f"{inbox}/.session-*/session.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return texts.select("path", F.from_json("text", S.MANIFEST).alias("m")).where("m.stem IS NOT NULL").select("path", "m.*")


def read_lines(spark: SparkSession, path: str, file: str = "") -> DataFrame:
    """file, line (from 1), value of a text file, numbered as they stand in it: a file read whole, then divided."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], "file string, line int, value string")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.lit(file).alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n", -1)).alias("pos", "value")).select("file", (F.col("pos") + 1).alias("line"), "value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """ord, value of the lines of a log that only grows; blank lines don't count.

    The order is that of the files' ages, of the blocks of a file and of the lines in a block, so ord is
    a struct of these, made without moving a row.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "ord struct<age:timestamp,path:string,block:bigint,line:bigint>, value string")
    at = F.struct(F.col("_metadata.file_modification_time").alias("age"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(at.alias("ord"), "value").where(strip(F.col("value")) != "")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """id, name, ord, embedding, embedding_model, source, added of a registry's samples; speakers and samples of the wrong shape drop out."""
    docs = json_objects(spark, path).where("valid")
    speakers = docs.select(F.posexplode(F.try_variant_get("doc", "$.speakers", "array<variant>")).alias("s", "v"))
    typed = speakers.select("s", as_str(leaf(F.col("v"), "$.id")).alias("id"), as_str(leaf(F.col("v"), "$.name")).alias("name"), F.try_variant_get("v", "$.samples", "array<variant>").alias("samples")).where("id IS NOT NULL AND name IS NOT NULL AND samples IS NOT NULL")
    each = typed.select("s", "id", "name", F.posexplode("samples").alias("o", "v"))
    text = lambda n: as_str(leaf(F.col("v"), "$." + n)).alias(n)
    return each.select("id", "name", (F.col("s") * 1_000_000 + F.col("o")).cast("bigint").alias("ord"), F.try_variant_get("v", "$.embedding", "array<double>").alias("embedding"), text("embedding_model"), text("source"), text("added"))


def load_pending(spark: SparkSession, directory: str, pattern: str = "*.json") -> DataFrame:
    """path, meeting_dir, audio_file, doc of the naming queues in order of their names; those without speakers or of the wrong shape drop out."""
    d = json_objects(spark, directory, pattern).where("valid").withColumn("speakers", F.try_variant_get("doc", "$.speakers", "array<variant>")).where("size(speakers) > 0")
    return d.select("path", as_str(leaf(F.col("doc"), "$.meeting_dir")).alias("meeting_dir"), as_str(leaf(F.col("doc"), "$.audio_file")).alias("audio_file"), "speakers", "doc").orderBy("path")


def load_pending_of(spark: SparkSession, directory: str, meeting: str) -> DataFrame:
    """The naming queue of one meeting, its file alone read; none for a name that is no plain file name."""
    if meeting in ("", ".", "..") or set("/\\") & set(meeting):
        return load_pending(spark, directory).limit(0)
    return load_pending(spark, directory, re.sub(r"([*?\[\]{}])", r"\\\1", meeting) + ".json")


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """audio, ord, label, person of a truth file; of a repeated audio the first entry counts, entries of the wrong shape drop out."""
    doc = F.try_parse_json("text")
    rows = whole_texts(spark, path).select(F.posexplode(F.try_variant_get(doc, "$", "array<variant>")).alias("ord", "v"))
    typed = rows.select("ord", as_str(leaf(F.col("v"), "$.audio")).alias("audio"), F.try_variant_get("v", "$.truth", "map<string,variant>").alias("truth")).where("audio IS NOT NULL AND truth IS NOT NULL")
    first = typed.withColumn("__r", F.row_number().over(W.partitionBy("audio").orderBy("ord"))).where("__r = 1")
    return first.select("audio", "ord", F.explode("truth").alias("label", "p")).select("audio", "ord", "label", as_str(F.col("p")).alias("person")).where("person IS NOT NULL")


def cached_turns(spark: SparkSession, cache: str, recordings: DataFrame, model: str) -> DataFrame:
    """Turns of a partitioned cache for the recordings (name, length, modified) whose fingerprint it holds for this model."""
    wanted = recordings.select("name", fingerprint(F.col("name"), F.col("length"), F.unix_timestamp("modified"), F.lit(model)).alias("fingerprint"))
    if not exists(spark, cache):
        return wanted.limit(0)
    return spark.read.parquet(cache).where(F.col("model") == model).join(wanted, "fingerprint")
