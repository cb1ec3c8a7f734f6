"""Views over the given tables that stand in for meetings, turns, logs and voices, in Spark and as DuckDB SQL.

Each view has a function of (spark, sf_dir) and a common table expression of the same rows, so that a
query and its SQL start from the same place. Times are whole seconds or milliseconds throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark, sf_dir) -> DataFrame:
    """meeting_id, seq, speaker, text, start, end: the lines of conversations, timed by their lengths."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).where("text <> ''")
    w = W.partitionBy("conv_id").orderBy("turn", "pos")
    d = c.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint")).withColumn("dur", (1 + F.call_function("div", F.char_length("text"), F.lit(15))).cast("bigint"))
    before = F.coalesce(F.sum("dur").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return d.withColumn("start", before).select(F.col("conv_id").alias("meeting_id"), "seq", F.col("role").alias("speaker"), "text", "start", (F.col("start") + F.col("dur")).alias("end"))


def turns(spark, sf_dir) -> DataFrame:
    """meeting_id, turn_idx, speaker, start, end (ms): events as turns of six speakers, a meeting each day."""
    e = table(spark, sf_dir, "events")
    ms = F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000))
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("meeting_id"), F.col("event_id").alias("turn_idx"), F.concat(F.lit("S"), (F.col("user_id") % 6).cast("string")).alias("speaker"), ms.alias("start"), (ms + F.round(F.col("value") * 1000).cast("bigint")).alias("end"))


def segments(spark, sf_dir) -> DataFrame:
    """meeting_id, seq, start, end (ms), text: views and clicks as segments of a minute."""
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    ms = F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000))
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("meeting_id"), F.col("event_id").alias("seq"), ms.alias("start"), (ms + 60000).alias("end"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("text"))


CODES = {"view": "queued", "click": "transcribe_started", "signup": "diarize_started", "purchase": "meeting_done", "error": "job_failed"}


def activity(spark, sf_dir) -> DataFrame:
    """ord, ts, job, code, level, value: events as log entries of fifty jobs."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for p in CODES.items() for x in p]), F.col("event_type"))
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.concat(F.lit("job"), (F.col("user_id") % 50).cast("string")).alias("job"), code.alias("code"), level.alias("level"), "value")


def prints(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("embedding_model"), F.col("vec_id").alias("ord"))


def samples(spark, sf_dir) -> DataFrame:
    """Registered samples: every vector under its person."""
    return prints(spark, sf_dir).withColumn("speaker_id", F.concat(F.lit("id-"), "name"))


def probes(spark, sf_dir) -> DataFrame:
    """Every vector backwards, so that none meets itself."""
    return prints(spark, sf_dir).select(F.col("vec_id").alias("label"), F.reverse("embedding").alias("embedding"), "embedding_model")


def voices(spark, sf_dir) -> DataFrame:
    """file, label, embedding: every vector as a print in one of seven files."""
    return prints(spark, sf_dir).select((F.col("vec_id") % 7).alias("file"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"), "embedding", "name")


def truth(spark, sf_dir) -> DataFrame:
    """file, label, person: everyone under the own name, but in file 6 one person whose labels aren't listed."""
    v = voices(spark, sf_dir)
    own = v.where("file <> 6").select("file", "label", F.col("name").alias("person"))
    return own.unionByName(v.where("file = 6").select("file", F.lit("*").alias("label"), F.lit("p0").alias("person")).distinct())


#: Wrong forms are frequent pieces of the given texts, one the start of another.
DICTIONARY = [
    ("exact", "THE-ONE", 1, "the", 1),
    ("exact", "THESE-ONES", 2, "these", 1),
    ("exact", "INGEST", 3, "ing ", 1),
    ("exact", "ANDROID", 4, " and ", 1),
    ("aliases", "ONE", 5, "THE-ONE", 1),
    ("aliases", "STATION", 6, "tion", 1),
    ("fuzzy", "entropy", 7, "ent", 1),
    ("fuzzy", "entropy", 7, "ant", 2),
    ("project-names", "Desmond", 8, "des", 1),
    ("project-names", "Entirely", 9, "entirely", 1),
]


#: Sections of a lexicon's words by their length modulo four.
SECTIONS = ("exact", "aliases", "fuzzy", "project-names")


def dictionary(spark, sf_dir=None) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "section string, correct string, correct_ord int, wrong string, wrong_ord int")


def lexicon(spark, sf_dir) -> DataFrame:
    """A dictionary of the words of benchmark texts: sections by their length, each word and, where it is long, its start as forms."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("pos", "word"))
    first = w.groupBy("word").agg(F.min(F.col("item_id") * 100_000 + F.col("pos")).alias("correct_ord"))
    section = F.try_element_at(F.array(*[F.lit(x) for x in SECTIONS]), F.char_length("word") % 4 + 1)
    forms = F.when(F.char_length("word") >= 6, F.array("word", F.substr("word", F.lit(1), F.char_length("word") - 1))).otherwise(F.array("word"))
    each = first.select(section.alias("section"), F.upper("word").alias("correct"), "correct_ord", F.posexplode(forms).alias("p", "wrong"))
    return each.select("section", "correct", "correct_ord", "wrong", (F.col("p") + 1).alias("wrong_ord"))


def summaries(spark, sf_dir) -> DataFrame:
    """meeting_dir, summary_md, meta_md: documents as summaries with open items, profiles and quality sections."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    flat = F.concat(F.regexp_replace("text", r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", " "), F.lit("."))
    profile = F.when(F.col("lang") == "en", "dev").otherwise("cross")
    line = F.concat(F.lit("ประเภทประชุม: "), profile)
    items = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("- "), flat, F.lit("\nnote\n- second "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(F.lit("nothing\n"))
    summary = F.concat(
        F.lit("ผู้เข้าร่วม: old\n## Topics\n- a\n[ไม่มั่นใจ] early\n### part 1\n[คำเพี้ยน?] x"), F.col("doc_id").cast("string"), F.lit("\n[ไม่มั่นใจ] y\n### part 2\n- kept\n[คำเพี้ยน?] z\n## จุดที่ควรตรวจเอง (2)\n- check\n[ไม่มั่นใจ] inside\n## Open\n"),
        items, F.lit("---\n- after\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(line, F.lit("\n"))).otherwise(F.lit("")),
    )
    meta = F.when(F.col("doc_id") % 2 == 1, F.when(F.col("doc_id") % 5 == 0, F.lit("no profile here")).otherwise(F.concat(F.lit("model m\n"), line)))
    return d.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("meeting_dir"), summary.alias("summary_md"), meta.alias("meta_md"))


def recordings(spark, sf_dir) -> DataFrame:
    """path, finished_at: orders as recordings under names of three kinds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    hh = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format("d", "yyyy-MM-dd_"), hh, F.lit("-30-00"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("topic-"), hh, F.lit("-30-00"))).otherwise(F.concat(F.lit("memo"), (F.col("o_orderkey") % 7).cast("string")))
    finish = F.timestamp_seconds(F.unix_timestamp("d") + (F.col("o_orderkey") % 86400))
    return o.select(F.concat(F.lit("inbox/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("/"), name, F.lit(".ogg")).alias("path"), finish.alias("finished_at"))


def files(spark, sf_dir) -> DataFrame:
    """audio_file, length, mtime: orders as a listing."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("clip"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("audio_file"), (F.col("o_custkey") * 10).alias("length"), (F.col("o_orderkey") % 1000).cast("double").alias("mtime"))


def requests(spark, sf_dir) -> DataFrame:
    """Requests for the clips of urgent orders."""
    return table(spark, sf_dir, "orders").where("o_orderpriority < '4'").select(F.concat(F.lit("clip"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("audio_file"))


def results(spark, sf_dir) -> DataFrame:
    """Results of settled orders' clips, some of them gone; of some the size has changed, the age is off by 0 to 3 seconds."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    key = F.when(F.col("o_orderkey") % 12 == 0, F.concat(F.lit("gone"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("clip"), F.col("o_orderkey").cast("string")))
    return o.select(F.concat(key, F.lit(".wav")).alias("audio_file"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("rejected").alias("status"), F.when(F.col("o_orderstatus") != "F", "too_short").alias("reason"), (F.col("o_custkey") * 10 + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("audio_size"), ((F.col("o_orderkey") % 1000) + (F.col("o_orderkey") % 4)).cast("double").alias("audio_mtime"))


def merged(spark, sf_dir) -> DataFrame:
    return utterances(spark, sf_dir)


_DAY = "strftime(ts, '%Y-%m-%d')"
_MS = "epoch_us(ts) // 1000"
_DICT_ROWS = ", ".join("('{}', '{}', {}, '{}', {})".format(*r) for r in DICTIONARY)

#: The same views for DuckDB, in an order in which each may use those before.
SQL = {
    "utterances": """utterances AS (
  SELECT *, start + dur AS "end" FROM (SELECT *, coalesce(sum(dur) OVER (PARTITION BY meeting_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT conv_id AS meeting_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS seq, role AS speaker, text, (1 + length(text) // 15)::BIGINT AS dur
    FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM conversations) WHERE text <> '')))""",
    "turns": f"""turns AS (SELECT {_DAY} AS meeting_id, event_id AS turn_idx, 'S' || (user_id % 6) AS speaker, {_MS} AS start, {_MS} + round(value * 1000)::BIGINT AS "end" FROM events)""",
    "segments": f"""segments AS (SELECT {_DAY} AS meeting_id, event_id AS seq, {_MS} AS start, {_MS} + 60000 AS "end", event_type AS text FROM events WHERE event_type IN ('view', 'click'))""",
    "activity": f"""activity AS (SELECT event_id AS ord, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, 'job' || (user_id % 50) AS job, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())} END AS code, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, value FROM events)""",
    "prints": "prints AS (SELECT vec_id, embedding::DOUBLE[] AS embedding, 'p' || label AS name, 'm' || (vec_id % 2) AS embedding_model, vec_id AS ord FROM embeddings)",
    "voices": "voices AS (SELECT vec_id % 7 AS file, 'v' || vec_id AS label, embedding, name FROM prints)",
    "truth": "truth AS (SELECT file, label, name AS person FROM voices WHERE file <> 6 UNION ALL SELECT DISTINCT file, '*', 'p0' FROM voices WHERE file = 6)",
    "dictionary": f"dictionary(section, correct, correct_ord, wrong, wrong_ord) AS (VALUES {_DICT_ROWS})",
    "lexicon": """lexicon AS (SELECT section, upper(word) AS correct, correct_ord, wrong, wrong_ord FROM (
  SELECT word, ['exact', 'aliases', 'fuzzy', 'project-names'][length(word) % 4 + 1] AS section, min(item_id * 100000 + pos) AS correct_ord
  FROM (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[a-z]{4,}') AS w FROM benchmark)) GROUP BY word) f,
  LATERAL (SELECT f.word AS wrong, 1 AS wrong_ord UNION ALL SELECT f.word[1:length(f.word) - 1], 2 WHERE length(f.word) >= 6))""",
    "summaries": r"""summaries AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS meeting_dir, doc_id,
  'ผู้เข้าร่วม: old' || chr(10) || '## Topics' || chr(10) || '- a' || chr(10) || '[ไม่มั่นใจ] early' || chr(10) || '### part 1' || chr(10) || '[คำเพี้ยน?] x' || doc_id || chr(10) || '[ไม่มั่นใจ] y' || chr(10) || '### part 2' || chr(10) || '- kept' || chr(10) || '[คำเพี้ยน?] z' || chr(10) || '## จุดที่ควรตรวจเอง (2)' || chr(10) || '- check' || chr(10) || '[ไม่มั่นใจ] inside' || chr(10) || '## Open' || chr(10)
  || CASE WHEN doc_id % 3 > 0 THEN '- ' || regexp_replace(text, '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', ' ', 'g') || '.' || chr(10) || 'note' || chr(10) || '- second ' || doc_id || chr(10) ELSE 'nothing' || chr(10) END
  || '---' || chr(10) || '- after' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'ประเภทประชุม: ' || CASE WHEN lang = 'en' THEN 'dev' ELSE 'cross' END || chr(10) ELSE '' END AS summary_md,
  CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'no profile here' ELSE 'model m' || chr(10) || 'ประเภทประชุม: ' || CASE WHEN lang = 'en' THEN 'dev' ELSE 'cross' END END END AS meta_md,
  CASE WHEN doc_id % 2 = 1 AND doc_id % 5 = 0 THEN NULL WHEN lang = 'en' THEN 'dev' ELSE 'cross' END AS profile,
  CASE WHEN doc_id % 3 > 0 THEN ('- ' || regexp_replace(text, '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', ' ', 'g') || '.') || chr(10) || '- second ' || doc_id ELSE '' END AS items
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)""",
    "recordings": """recordings AS (SELECT o_orderkey, 'inbox/' || lpad(o_orderkey::VARCHAR, 9, '0') || '/' || name || '.ogg' AS path, name, o_orderdate + to_seconds(o_orderkey % 86400) AS finished_at
  FROM (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d_') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || '-30-00' WHEN 1 THEN 'topic-' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || '-30-00' ELSE 'memo' || (o_orderkey % 7) END AS name FROM orders))""",
    "files": "files AS (SELECT 'clip' || o_orderkey || '.wav' AS audio_file, o_custkey * 10 AS length, (o_orderkey % 1000)::DOUBLE AS mtime FROM orders)",
    "requests": "requests AS (SELECT 'clip' || o_orderkey || '.wav' AS audio_file FROM orders WHERE o_orderpriority < '4')",
    "results": "results AS (SELECT CASE WHEN o_orderkey % 12 = 0 THEN 'gone' ELSE 'clip' END || o_orderkey || '.wav' AS audio_file, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'rejected' END AS status, CASE WHEN o_orderstatus <> 'F' THEN 'too_short' END AS reason, o_custkey * 10 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS audio_size, (o_orderkey % 1000 + o_orderkey % 4)::DOUBLE AS audio_mtime FROM orders WHERE o_orderstatus <> 'O')",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """body behind the common table expressions of the named views."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
