"""Naming speakers as one command: what a decision changes, and only that, in every table that depends on it.

From decisions on queue entries come the deltas: the rows of the registry for the people concerned, the
transcripts that get new labels, the statistics and participants lines of those meetings, and the queue
entries that are done. apply() puts them into tables kept by commits, the registry first and the queue
last, so whatever step it dies after, the decisions can be given again. (A name that is another label of
the same meeting is the exception: given again after its transcript was written, that label is taken anew.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.functions.text import rename_label
from speechframe.functions.typed import embedding_model, is_usable_embedding
from speechframe.operators import sequences, stats, voices
from speechframe.sources import commits
from speechframe.sources.sinks import stored

KEYS = ["meeting_dir", "label"]


def outcomes(registry: DataFrame, queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """meeting_dir, label, name, code of each decision, a repeated one once: ok, skipped, or why it is refused.

    decisions: meeting_dir, label, name, speaker_id, skip; queue: meeting_dir, label, ord, embedding,
    embedding_model, added. Of several decisions on one entry the one that sorts first counts.
    """
    first = decisions.groupBy(*KEYS).agg(F.min(F.struct(F.coalesce("skip", F.lit(False)).alias("skip"), "speaker_id", "name")).alias("d")).select(*KEYS, "d.*")
    entries = queue.groupBy(*KEYS).agg(F.min_by(F.struct("embedding", "embedding_model"), "ord").alias("entry"))
    d = voices._decided(registry, first).join(entries, KEYS, "left")
    code = (
        F.when(F.col("entry").isNull(), "not_found")
        .when(F.col("skip"), "skipped")
        .when(~F.coalesce(is_usable_embedding(F.col("entry.embedding")), F.lit(False)), "bad_embedding")
        .when(embedding_model(F.col("entry.embedding_model")).isNull(), "missing_embedding_model")
        .otherwise(F.coalesce("refused", F.lit("ok")))
    )
    return d.select(*KEYS, F.when(code == "ok", F.col("name")).alias("name"), code.alias("code"))


def relabelled(transcripts: DataFrame, named: DataFrame) -> DataFrame:
    """meeting_dir, md of the transcripts that names (meeting_dir, label, name) change: labels at the heads of blocks, all of a meeting's at once.

    A label that is another's new name isn't renamed again: labels go by placeholders that no text holds.
    """
    pairs = named.groupBy("meeting_dir").agg(F.array_sort(F.collect_list(F.struct("label", "name"))).alias("__n"))
    mark = lambda p: F.concat(F.lit("\x00"), F.md5(p["label"]), F.lit("\x00"))
    marked = F.aggregate("__n", F.col("md"), lambda md, p: rename_label(md, p["label"], mark(p)))
    new = F.aggregate("__n", marked, lambda md, p: F.replace(md, mark(p), p["name"]))
    return transcripts.join(pairs, "meeting_dir").select("meeting_dir", new.alias("new"), "md").where("new <> md").select("meeting_dir", F.col("new").alias("md"))


def roll_ups(transcripts: DataFrame) -> DataFrame:
    """meeting_dir, line (participants), speakers (array of the statistics by speaker) of transcripts (meeting_dir, md)."""
    s = stats.speaker_stats(sequences.parse_segments(transcripts.select(F.col("meeting_dir").alias("meeting_id"), "md")))
    each = s.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("speaker", "lines", "turns", "chars", "identified", F.round("share", 6).alias("share")))).alias("speakers"))
    return stats.participants_line(s).join(each, "meeting_id").withColumnRenamed("meeting_id", "meeting_dir")


def deltas(registry: DataFrame, queue: DataFrame, transcripts: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """outcomes, and what changes: registry (all rows of the names concerned, as they become), transcripts and roll_ups
    (of relabelled meetings), done (queue entries to drop). A decision given again adds no sample twice."""
    told = stored(outcomes(registry, queue, decisions), "outcomes")
    ok = told.where("code = 'ok'").select(*KEYS, "name")
    entries = queue.dropDuplicates(KEYS).join(ok, KEYS).select("name", "ord", "embedding", "embedding_model", F.col("meeting_dir").alias("source"), "added")
    held = registry.select("name", "source", "embedding").withColumn("__k", F.xxhash64("embedding"))
    fresh = entries.withColumn("__k", F.xxhash64("embedding")).join(held.select("name", "source", "__k"), ["name", "source", "__k"], "left_anti").select(*entries.columns)
    touched = ok.select("name").distinct()
    people = voices.add_samples(registry.join(touched, "name", "left_semi"), fresh)
    changed = stored(relabelled(transcripts, ok), "relabelled")
    return {"outcomes": told, "registry": people, "transcripts": changed, "roll_ups": roll_ups(changed), "done": told.where("code IN ('ok', 'skipped')").select(*KEYS)}


def _replaced(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Rows of the table with the same keys make way for the given ones; nothing is written where there are none."""
    if not rows.isEmpty():
        commits.update_table(spark, path, lambda table: table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*table.columns)))


def apply(spark: SparkSession, tables: dict[str, str], decisions: DataFrame) -> DataFrame:
    """Carries decisions out on the tables (registry, transcripts, roll_ups, queue: paths kept by commits) and returns outcomes.

    If another command changes the registry meanwhile, commits.Conflict is raised before anything is changed.
    """
    seen = commits.version_of(spark, tables["registry"])
    registry = commits.read_table(spark, tables["registry"], seen)
    d = deltas(registry, commits.read_table(spark, tables["queue"]), commits.read_table(spark, tables["transcripts"]), decisions)
    people = stored(d["registry"], "people")
    if not people.isEmpty():
        kept = registry.join(people.select("name").distinct(), "name", "left_anti")
        commits.write_table(kept.unionByName(people.select(*registry.columns)), tables["registry"], seen)
    _replaced(spark, tables["roll_ups"], stored(d["roll_ups"], "rollups"), ["meeting_dir"])
    _replaced(spark, tables["transcripts"], d["transcripts"], ["meeting_dir"])
    if not d["done"].isEmpty():
        commits.update_table(spark, tables["queue"], lambda queue: queue.join(d["done"], KEYS, "left_anti"))
    return d["outcomes"]
