"""Meeting documents: carry-over between meetings, quality sections, folder names and the summary's two files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions.text import folder_name, lines, profile_of_meeting, recording_day, section_body, stem, strip


def previous_open_items(meetings: DataFrame, heading: str, exclude: str | None = None) -> DataFrame:
    """profile, meeting_dir, items: of each profile's latest meeting by folder name, the open items; empty where it has none.

    meetings: meeting_dir, summary_md, meta_md. The latest meeting decides alone: there is no look further back.
    """
    m = meetings.where("summary_md IS NOT NULL")
    if exclude is not None:
        m = m.where(F.col("meeting_dir") != exclude)
    rows = m.select("meeting_dir", "summary_md", profile_of_meeting(F.col("meta_md"), F.col("summary_md")).alias("profile")).where("profile IS NOT NULL")
    # the latest first, whose summary alone is read line by line
    best = rows.groupBy("profile").agg(F.max_by(F.struct("meeting_dir", "summary_md"), "meeting_dir").alias("b"))
    return best.select("profile", "b.meeting_dir", section_body(F.col("b.summary_md"), heading).alias("items"))


def split_quality(summaries: DataFrame) -> DataFrame:
    """meeting_dir, body, quality: the summary without its quality sections and tagged lines, and those as an array of blocks.

    A section runs from a quality heading to the next '## '. Tagged lines elsewhere are gathered under
    the '### ' heading above them, named once for a run of lines. Lines of a summary meet in one group,
    which is one document.
    """
    w = W.partitionBy("meeting_dir").orderBy("pos")
    row = summaries.select("meeting_dir", F.posexplode(lines(F.col("summary_md"))).alias("pos", "line")).withColumn("s", strip(F.col("line")))
    starts = lambda prefixes: F.coalesce(*[F.when(F.startswith("s", F.lit(p)), True) for p in prefixes], F.lit(False))
    row = row.withColumn("h2", F.startswith("s", F.lit("## "))).withColumn("sec", F.sum(F.col("h2").cast("int")).over(w))
    row = row.withColumn("q", F.max(F.col("h2") & starts(S.QUALITY_HEADINGS)).over(W.partitionBy("meeting_dir", "sec")))
    h3 = F.last(F.when(F.startswith("s", F.lit("### ")), F.col("s")), ignorenulls=True)
    row = row.withColumn("h3", h3.over(W.partitionBy("meeting_dir", "sec").orderBy("pos"))).withColumn("tag", ~F.col("q") & starts(S.QUALITY_TAGS))
    tagged = row.where("tag").withColumn("before", F.last("h3", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("rn", F.row_number().over(w))
    named = F.when(F.col("h3").isNotNull() & ~F.col("h3").eqNullSafe(F.col("before")), F.concat(F.when(F.col("rn") > 1, "\n").otherwise(""), F.col("h3"), F.lit("\n"), F.col("s"))).otherwise(F.col("s"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "\n")
    timeline = tagged.withColumn("out", named).groupBy("meeting_dir").agg(text("out").alias("t")).select("meeting_dir", F.concat(F.lit(S.TIMELINE_QUALITY_HEADING + "\n\n"), "t").alias("timeline"))
    sections = row.where("q").groupBy("meeting_dir", "sec").agg(strip(text("line")).alias("block")).groupBy("meeting_dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("sec", "block"))), lambda x: x["block"]).alias("sections"))
    body = row.where("NOT q AND NOT tag").groupBy("meeting_dir").agg(strip(text("line")).alias("body"))
    out = summaries.select("meeting_dir").join(body, "meeting_dir", "left").join(sections, "meeting_dir", "left").join(timeline, "meeting_dir", "left")
    none = F.array().cast("array<string>")
    blocks = F.filter(F.concat(F.coalesce("sections", none), F.when(F.col("timeline").isNotNull(), F.array("timeline")).otherwise(none)), lambda b: b != "")
    return out.select("meeting_dir", F.coalesce("body", F.lit("")).alias("body"), blocks.alias("quality"))


def summary_files(split: DataFrame, facts: DataFrame, counts: DataFrame, seen: DataFrame) -> DataFrame:
    """meeting_dir, summary, meta: the two texts that a meeting keeps.

    split is split_quality's result; facts: meeting_dir, model, profile, speaker_table; counts and seen:
    meeting_dir, term, n, written busiest first.
    """

    def listed(df: DataFrame, head: str, unit: str, name: str) -> DataFrame:
        g = df.groupBy("meeting_dir").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "term", "n"))).alias("l"))
        return g.select("meeting_dir", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: F.concat(x["term"], F.lit(" "), x["n"].cast("string"), F.lit(" " + unit))), ", ")).alias(name))

    d = split.join(facts, "meeting_dir").join(listed(counts, "แก้คำตาม glossary: ", "จุด", "c"), "meeting_dir", "left").join(listed(seen, "คำ fuzzy ที่เจอในห้อง: ", "ครั้ง", "s"), "meeting_dir", "left")
    foot = F.concat_ws("\n", F.concat(F.lit("สรุปด้วย "), "model"), F.concat(F.lit(S.PROFILE_PREFIX + " "), F.nullif("profile", F.lit(""))), "c", "s")
    meta = F.concat(F.concat_ws("\n\n", foot, F.nullif("speaker_table", F.lit("")), "quality"), F.lit("\n"))
    return d.select("meeting_dir", F.concat("body", F.lit("\n")).alias("summary"), meta.alias("meta"))


def disambiguate(df: DataFrame, base: str, order: str, out: str) -> DataFrame:
    """Names without collision: the first row of a base name keeps it, later ones get -2, -3 and so on."""
    n = F.row_number().over(W.partitionBy(base).orderBy(order))
    return df.withColumn("__n", n).withColumn(out, F.when(F.col("__n") > 1, F.concat(base, F.lit("-"), F.col("__n").cast("string"))).otherwise(F.col(base))).drop("__n")


def meeting_folders(recordings: DataFrame) -> DataFrame:
    """path, day, folder of recordings (path, finished_at)."""
    r = recordings.withColumn("__stem", stem(F.col("path")))
    r = r.withColumn("day", recording_day(F.col("__stem"), F.col("finished_at"))).withColumn("__base", folder_name(F.col("__stem"), F.col("day")))
    return disambiguate(r, "__base", "path", "folder").select("path", "day", "folder")
