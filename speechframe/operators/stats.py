"""Speaker statistics, labels and the Markdown made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions.text import format_timestamp, strip


def speaker_stats(blocks: DataFrame) -> DataFrame:
    """Per meeting and speaker: lines, turns (starts of runs), chars, first and last second, whether identified, share of the chars.

    blocks has meeting_id, seg, speaker, body, start_seconds. Speakers are told apart without white
    space around their labels; a speaker is identified unless the label is the numbered default.
    """
    b = blocks.select("meeting_id", "seg", strip(F.col("speaker")).alias("speaker"), "body", "start_seconds")
    w = W.partitionBy("meeting_id").orderBy("seg")
    run = b.withColumn("__new", (~F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))).cast("bigint"))
    stats = run.groupBy("meeting_id", "speaker").agg(
        F.count("*").alias("lines"),
        F.sum("__new").alias("turns"),
        F.coalesce(F.sum(F.char_length(strip(F.col("body")))), F.lit(0)).cast("bigint").alias("chars"),
        F.min("start_seconds").alias("first_seconds"),
        F.max("start_seconds").alias("last_seconds"),
    )
    total = F.sum("chars").over(W.partitionBy("meeting_id"))
    return stats.withColumn("identified", ~F.col("speaker").rlike(rf"(?U)^{S.SPEAKER_PREFIX} \d+$")).withColumn("share", F.when(total > 0, F.col("chars") / total).otherwise(F.lit(0.0)))


def _in_order(parts: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["part"])


def _percent(share: Column) -> Column:
    """A share (0 to 1) as a percentage of one digit, rounded as C and Python do: by the exact binary value, ties to even.

    Java's formats round the shortest decimal half up. 20 times the value against an odd whole number tells the side of a
    tie: 16 times and 4 times it are exact, and so is the difference near a tie, so the sign of their sum is.
    """
    x = share * 100
    tenths = F.floor(x * 10)
    odd = tenths * 2 + 1
    above = (x * 16 - odd) + x * 4
    n = tenths + F.when((above > 0) | ((above == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.format_string("%d.%d%%", F.call_function("div", n, F.lit(10)), n % 10)


def participants_line(stats: DataFrame) -> DataFrame:
    """meeting_id, line: voices, identified ones, and each one's share, with the first time of those who came late."""
    m = W.partitionBy("meeting_id")
    started, ended = F.min("first_seconds").over(m), F.max("last_seconds").over(m)
    late = (ended > started) & ((F.col("first_seconds") - started) / (ended - started) > S.LATE_ARRIVAL_SHARE)
    part = F.concat("speaker", F.lit(" "), _percent(F.col("share")), F.when(late, F.concat(F.lit(" (พูดครั้งแรก "), format_timestamp(F.col("first_seconds")), F.lit(")"))).otherwise(F.lit("")))
    g = stats.withColumn("part", part).groupBy("meeting_id").agg(F.count("*").alias("n"), F.count_if("identified").alias("known"), _in_order(F.struct((-F.col("chars")).alias("c"), "speaker", "part")).alias("parts"))
    return g.select("meeting_id", F.concat(F.lit(S.PARTICIPANTS_PREFIX + " "), F.col("n").cast("string"), F.lit(" เสียง (ระบุตัวได้จากลายเสียง "), F.col("known").cast("string"), F.lit(" คน) — "), F.array_join("parts", " · ")).alias("line"))


def speaker_table(stats: DataFrame) -> DataFrame:
    """meeting_id, table: the statistics as a Markdown table, most chars first."""
    cells = F.concat_ws(" | ", "speaker", F.format_number("lines", 0), F.format_number("turns", 0), F.format_number("chars", 0), _percent(F.col("share")), format_timestamp(F.col("first_seconds")), format_timestamp(F.col("last_seconds")))
    row = F.concat(F.lit("| "), cells, F.lit(" |"))
    g = stats.withColumn("part", row).groupBy("meeting_id").agg(_in_order(F.struct((-F.col("chars")).alias("c"), "speaker", "part")).alias("rows"))
    return g.select("meeting_id", F.array_join(F.concat(F.lit(list(S.SPEAKER_TABLE_HEAD)), "rows"), "\n").alias("table"))


def speaker_labels(merged: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """meeting_id, speaker, label, first_seq: the known name, or a number by first appearance among the unknown alone."""
    first = merged.groupBy("meeting_id", "speaker").agg(F.min("seq").alias("first_seq"))
    if names is None:
        first = first.withColumn("name", F.lit(None).cast("string"))
    else:
        first = first.join(names.groupBy("meeting_id", "speaker").agg(F.max("name").alias("name")), ["meeting_id", "speaker"], "left").withColumn("name", F.nullif("name", F.lit("")))
    n = F.row_number().over(W.partitionBy("meeting_id", F.col("name").isNull()).orderBy("first_seq", "speaker"))
    return first.withColumn("__n", n).select("meeting_id", "speaker", F.coalesce("name", F.concat(F.lit(S.SPEAKER_PREFIX + " "), F.col("__n").cast("string"))).alias("label"), "first_seq")


def render_transcript(merged: DataFrame, labels: DataFrame, diarization_failed: bool = False) -> DataFrame:
    """meeting_id, md: a title, a note where diarization failed, and a block for each segment. A document is one cell by its nature."""
    head = [S.TRANSCRIPT_TITLE, *([S.DIARIZATION_FAILED_NOTE] if diarization_failed else [])]
    block = F.concat(F.lit("**"), "label", F.lit("** ["), format_timestamp(F.col("start")), F.lit("]: "), "text")
    g = merged.join(labels.select("meeting_id", "speaker", "label"), ["meeting_id", "speaker"]).withColumn("part", block).groupBy("meeting_id").agg(_in_order(F.struct("seq", "part")).alias("blocks"))
    return g.select("meeting_id", F.array_join(F.concat(F.lit(head), "blocks"), "\n\n").alias("md"))
