"""Queries over voice vectors, the activity log, queues and meeting documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions import text as X
from speechframe.functions import typed as Y
from speechframe.operators import calibration as C
from speechframe.operators import events as E
from speechframe.operators import intervals as I
from speechframe.operators import meetings as M
from speechframe.operators import queues as Q
from speechframe.operators import voices as O
from speechframe.plans import views as V
from speechframe.plans.conversation import _CHOSEN, _clean
from speechframe.plans.registry import register
from speechframe.streaming import streams as T

_COS = "list_cosine_similarity({0}, {1})"


@register(
    "j02_match_known",
    V.sql("prints", """SELECT label, 'id-' || name AS speaker_id, name, round(score, 6) AS score, score >= 0.06 AS confident FROM (
  SELECT p.vec_id AS label, s.name, list_cosine_similarity(list_reverse(p.embedding), s.embedding) AS score, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_cosine_similarity(list_reverse(p.embedding), s.embedding), 12) DESC, s.ord) AS n
  FROM prints p JOIN prints s USING (embedding_model)) WHERE n = 1 AND score >= 0.02"""),
)
def match_known(spark, sf_dir):
    return O.match_known(V.probes(spark, sf_dir), V.samples(spark, sf_dir), 0.06, 0.02).withColumn("score", F.round("score", 6))


@register("a09_average_unit_vectors", V.sql("prints", """, cell AS (SELECT name, unnest(range(len(embedding))) AS i, unnest(embedding) / sqrt(list_inner_product(embedding, embedding)) AS x FROM prints),
s AS (SELECT name, i, sum(x) AS x FROM cell GROUP BY ALL), n AS (SELECT name, sqrt(sum(x * x)) AS n FROM s GROUP BY name)
SELECT name, count(*)::INTEGER AS dims, round(sum(x / n * (i + 1)), 6) AS weighted, round(max(x / n), 6) AS greatest FROM s JOIN n USING (name) GROUP BY name""").replace("\n,", ",", 1))
def average_unit_vectors(spark, sf_dir):
    v = O.average_unit_vectors(V.prints(spark, sf_dir), ["name"])
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("name", F.size("embedding").alias("dims"), F.round(weighted, 6).alias("weighted"), F.round(F.array_max("embedding"), 6).alias("greatest"))


_PAIRS = """resolved AS (SELECT v.file, v.label, v.embedding, coalesce(a.person, b.person) AS person FROM voices v LEFT JOIN truth a ON a.file = v.file AND a.label = v.label LEFT JOIN truth b ON b.file = v.file AND b.label = '*' WHERE coalesce(a.person, b.person) IS NOT NULL),
pairs AS (SELECT x.file AS left_file, x.label AS left_label, y.file AS right_file, y.label AS right_label, x.person = y.person AS same, list_cosine_similarity(x.embedding, y.embedding) AS score FROM resolved x JOIN resolved y ON (x.file, x.label) < (y.file, y.label) AND NOT (x.person = y.person AND x.file = y.file))"""


def _resolved(spark, sf_dir):
    return O.resolve_truth(V.voices(spark, sf_dir), V.truth(spark, sf_dir))


@register("j05_score_pairs", V.sql("prints voices truth", "") + ", " + _PAIRS + " SELECT * EXCLUDE (score), round(score, 6) AS score FROM pairs")
def score_pairs(spark, sf_dir):
    return C.score_pairs(_resolved(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("a13_score_summary", V.sql("prints voices truth", "") + ", " + _PAIRS + " SELECT same, count(*) AS n, round(min(score), 6) AS min, round(median(score), 6) AS median, round(max(score), 6) AS max FROM pairs GROUP BY same")
def score_summary(spark, sf_dir):
    s = C.piles(_resolved(spark, sf_dir))
    return s.select("same", "n", *[F.round(c, 6).alias(c) for c in ("min", "median", "max")])


_BOUNDS = "(SELECT max(CASE WHEN NOT same THEN score END) AS c, min(CASE WHEN same THEN score END) AS f FROM pairs)"


@register("a12_suggest_thresholds", V.sql("prints voices truth", "") + ", " + _PAIRS + f" SELECT CASE WHEN f > c THEN round(c + (f - c) * 0.1, 2) END AS low, CASE WHEN f > c THEN round((c + f) / 2, 2) END AS high, NOT coalesce(f > c, FALSE) AS overlap FROM {_BOUNDS}")
def suggest_thresholds(spark, sf_dir):
    return C.thresholds(_resolved(spark, sf_dir))


def _registry(spark, sf_dir):
    return V.samples(spark, sf_dir).where("name < 'p5'").select(F.col("speaker_id").alias("id"), "name", "ord", "embedding", "embedding_model", F.lit("first").alias("source"), F.lit("2026-01-01").alias("added"))


@register(
    "a10_add_samples",
    V.sql("prints", """SELECT CASE WHEN name < 'p5' THEN 'id-' || name ELSE md5('speaker:' || name) END AS id, name, ord, embedding_model, source FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY source DESC, ord DESC) AS n FROM (SELECT name, ord, embedding_model, 'first' AS source FROM prints WHERE name < 'p5' UNION ALL SELECT name, ord, embedding_model, 'second' FROM prints WHERE embedding_model = 'm1' AND name <> 'p3')) WHERE n <= 10 OR name = 'p3'"""),
)
def add_samples(spark, sf_dir):
    new = V.prints(spark, sf_dir).where("embedding_model = 'm1' AND name <> 'p3'").select(F.concat(F.lit(" *"), "name", F.lit("` ")).alias("name"), "ord", "embedding", "embedding_model", F.lit("second").alias("source"), F.lit("2026-02-01").alias("added"))
    return O.add_samples(_registry(spark, sf_dir), new).select("id", "name", "ord", "embedding_model", "source")


@register("f15_registry_summary", V.sql("prints", "SELECT 'id-' || name AS id, CASE WHEN name = 'p1' THEN 'new one' ELSE name END AS name, count(*) AS sample_count FROM prints WHERE name < 'p5' AND name <> 'p2' GROUP BY ALL"))
def registry_summary(spark, sf_dir):
    return O.registry_summary(O.remove_speaker(O.rename_speaker(_registry(spark, sf_dir), "id-p1", " new  *one* "), "id-p2"))


@register("f06_usable_embeddings", """SELECT vec_id, coalesce(embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0, FALSE) AS usable FROM embeddings""")
def usable_embeddings(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select("vec_id", Y.is_usable_embedding(F.col("embedding")).alias("usable"))


# -- the activity log


@register("a11_gpu_jobs", V.sql("activity", "SELECT job, arg_max(code, ord) AS code, arg_max(code, ord) IN ('queued', 'transcribe_started', 'diarize_started') AS busy FROM activity WHERE code IN ('queued', 'transcribe_started', 'diarize_started', 'summarize_started', 'meeting_done', 'job_failed') GROUP BY job"))
def gpu_jobs(spark, sf_dir):
    return E.gpu_jobs(V.activity(spark, sf_dir))


@register("e14_companion_snapshot", V.sql("activity", "SELECT 'off' AS state, NOT bool_or(busy) AS can_start, CASE WHEN bool_or(busy) THEN 'gpu_busy' END AS blocked_by FROM (SELECT arg_max(code, ord) IN ('queued', 'transcribe_started', 'diarize_started') AS busy FROM activity WHERE code IS NOT NULL GROUP BY job)"))
def companion_snapshot(spark, sf_dir):
    return E.companion_snapshot(E.gpu_is_busy(V.activity(spark, sf_dir)), configured=True, running=False)


@register("a21_job_stages", V.sql("activity", "SELECT job, arg_max(CASE code WHEN 'queued' THEN 1 WHEN 'transcribe_started' THEN 1 WHEN 'diarize_started' THEN 2 WHEN 'meeting_done' THEN 4 END, CASE WHEN code <> 'job_failed' THEN ord END)::INTEGER AS stage, bool_or(code = 'job_failed') AS failed FROM activity GROUP BY job"))
def job_stages(spark, sf_dir):
    return E.job_stages(V.activity(spark, sf_dir))


def _lines(spark, sf_dir):
    return V.activity(spark, sf_dir).select("ord", F.to_json(F.struct("ts", "job", "code", "level", F.struct(F.col("value").cast("string").alias("path"), F.array("value").alias("vector")).alias("params"))).alias("value"))


@register("s11_tail", V.sql("activity", "SELECT ord, job, code FROM activity ORDER BY ord DESC LIMIT 200"))
def tail(spark, sf_dir):
    e = E.tail(_lines(spark, sf_dir))
    return e.select("ord", Y.as_str(Y.leaf(F.col("entry"), "$.job")).alias("job"), Y.as_str(Y.leaf(F.col("entry"), "$.code")).alias("code"))


MESSAGES = [("th", "queued", "เข้าคิว {path}"), ("en", "queued", "queued {path}"), ("th", "meeting_done", "เสร็จ"), ("en", "job_failed", "failed {missing}"), ("th", "transcribe_started", "กำลังถอดเสียง")]


@register(
    "f14_public_activity",
    V.sql("activity", """SELECT ord, ts, job, code, level, value::VARCHAR AS path, CASE code WHEN 'queued' THEN 'queued ' || value WHEN 'meeting_done' THEN 'เสร็จ' WHEN 'job_failed' THEN 'failed {missing}' WHEN 'transcribe_started' THEN 'กำลังถอดเสียง' ELSE code END AS text FROM activity"""),
)
def public_activity(spark, sf_dir):
    messages = spark.createDataFrame(MESSAGES, "lang string, code string, template string")
    return E.public_activity(_lines(spark, sf_dir).select("ord", F.parse_json("value").alias("entry")), messages, "en")


@register("f27_log_lines", V.sql("activity", "SELECT ord, ts[12:19] AS clock, code AS text FROM activity ORDER BY ord DESC LIMIT 60"))
def log_lines(spark, sf_dir):
    return E.log_lines(V.activity(spark, sf_dir).withColumn("text", F.col("code")))


@register("t09_device_changes", """SELECT stream, ts, old, new FROM (SELECT user_id AS stream, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events) WHERE old <> new""")
def device_changes(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("name"))
    return E.device_changes(e).withColumn("ts", F.col("ts.ts"))


@register("w17_redraws", V.sql("activity", "SELECT ord, job, code FROM (SELECT *, lag(code || '|' || level) OVER (PARTITION BY job ORDER BY ord) AS before FROM activity) WHERE before IS DISTINCT FROM code || '|' || level"))
def redraws(spark, sf_dir):
    return E.redraws(V.activity(spark, sf_dir), "job", "ord", ["code", "level"]).select("ord", "job", "code")


@register("t03_rotation_windows", """SELECT event_type AS key, time_bucket(INTERVAL 30 MINUTES, ts) AS part_start, count(*) AS blocks, max(abs(value)) AS peak FROM events GROUP BY ALL""")
def rotation_windows(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "ts", "value")
    return T.rotation_windows(e)


def _streams(spark, sf_dir):
    """The vectors of even and odd users' first block numbers as two sources of blocks."""
    e = V.prints(spark, sf_dir).select(F.col("name").alias("session"), F.call_function("div", "vec_id", F.lit(2)).alias("block_no"), F.timestamp_seconds("vec_id").alias("ts"), F.col("embedding").alias("samples"), "embedding_model")
    return e.where("embedding_model = 'm0'"), e.where("embedding_model = 'm1'")


@register("t04_zip_blocks", V.sql("prints", """SELECT coalesce(a.name, b.name) AS session, coalesce(a.vec_id // 2, b.vec_id // 2) AS block_no, round(0.5 * coalesce(list_sum(a.embedding), 0) + 0.5 * coalesce(list_sum(b.embedding), 0), 6) AS total
FROM (SELECT * FROM prints WHERE embedding_model = 'm0') a FULL JOIN (SELECT * FROM prints WHERE embedding_model = 'm1') b ON a.name = b.name AND a.vec_id // 2 = b.vec_id // 2"""))
def zip_blocks(spark, sf_dir):
    z = T.zip_blocks(*_streams(spark, sf_dir))
    return z.select("session", "block_no", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("t03_rotate", V.sql("utterances", "SELECT meeting_id, seq, coalesce(sum(length(text)) OVER (PARTITION BY meeting_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 200 + 1 AS part FROM utterances"))
def rotate(spark, sf_dir):
    b = V.utterances(spark, sf_dir).select(F.col("meeting_id").alias("session"), F.col("seq").alias("block_no"), F.char_length("text").alias("n"))
    return T.rotate(b, 10, 20).select(F.col("session").alias("meeting_id"), F.col("block_no").alias("seq"), "part")


@register("a16_measure_peaks", V.sql("prints", """SELECT name AS stream, round(max(greatest(list_max(embedding), -list_min(embedding))), 6) AS peak, CASE WHEN 20 * log10(max(greatest(list_max(embedding), -list_min(embedding)))) >= -30 THEN 'ok' WHEN 20 * log10(max(greatest(list_max(embedding), -list_min(embedding)))) >= -45 THEN 'warn' ELSE 'fail' END AS level FROM prints GROUP BY name"""))
def measure_peaks(spark, sf_dir):
    p = T.measure_peaks(V.prints(spark, sf_dir).select(F.col("name").alias("stream"), F.col("embedding").alias("samples")))
    return p.select("stream", F.round("peak", 6).alias("peak"), X.mic_level(X.peak_dbfs(F.col("peak"))).alias("level"))


# -- queues


_LONGEST = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY length(text) DESC, seq) AS r FROM utterances) WHERE r <= 3)"""


@register("w07_longest_samples", V.sql("utterances", "") + ", " + _LONGEST + " SELECT meeting_id, speaker, string_agg(start || ' ' || text, chr(10) ORDER BY start, seq) AS samples FROM top GROUP BY ALL")
def longest_samples(spark, sf_dir):
    s = Q.longest_samples(V.utterances(spark, sf_dir))
    return s.select("meeting_id", "speaker", F.array_join(F.transform("samples", lambda x: F.concat(x["start"].cast("string"), F.lit(" "), x["text"])), "\n").alias("samples"))


def _queue(spark, sf_dir):
    u = V.utterances(spark, sf_dir)
    who = u.select("meeting_id", "speaker").distinct()
    prints = who.where("speaker <> 'system'").select("*", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(12.0).alias("seconds"), F.lit(3).alias("segment_count"), F.lit("m").alias("embedding_model"))
    score = (F.col("meeting_id") % 10) / 10
    matches = who.where("speaker = 'user'").select("*", F.lit("id1").alias("speaker_id"), F.lit("Ann").alias("name"), score.alias("score"), (score >= 0.62).alias("confident"))
    labels = who.select("*", F.concat(F.lit("ผู้พูด "), "speaker").alias("label"))
    return Q.pending_speakers(u, labels, prints, matches)


@register(
    "j04_pending_speakers",
    V.sql("utterances", "") + ", " + _LONGEST
    + """, spoken AS (SELECT meeting_id, speaker, sum("end" - start)::BIGINT AS seconds FROM utterances GROUP BY ALL HAVING sum("end" - start) >= 10)
SELECT meeting_id, speaker, 'ผู้พูด ' || speaker AS label, seconds AS speaking_seconds, (SELECT count(*) FROM top t WHERE t.meeting_id = s.meeting_id AND t.speaker = s.speaker)::INTEGER AS n_samples, CASE WHEN speaker = 'user' THEN 'Ann ' || (meeting_id % 10) END AS suggested
FROM spoken s WHERE speaker <> 'system' AND NOT (speaker = 'user' AND (meeting_id % 10) / 10 >= 0.62)""",
)
def pending_speakers(spark, sf_dir):
    q = _queue(spark, sf_dir)
    return q.select("meeting_id", "speaker", "label", "speaking_seconds", F.size("samples").alias("n_samples"), F.concat(F.col("suggested.name"), F.lit(" "), F.round(F.col("suggested.score") * 10).cast("int").cast("string")).alias("suggested"))


@register("k11_resolve_pending", V.sql("utterances", "SELECT meeting_id::VARCHAR AS meeting_dir, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS labels FROM utterances WHERE speaker <> 'user' GROUP BY meeting_id"))
def resolve_pending(spark, sf_dir):
    u = V.utterances(spark, sf_dir).select(F.col("meeting_id").cast("string").alias("meeting_dir"), F.col("speaker").alias("label")).distinct()
    pending = u.groupBy("meeting_dir").agg(F.array_sort(F.collect_list(F.struct("label"))).alias("speakers"))
    left = Q.resolve_pending(pending, u.where("label = 'user'"))
    return left.select("meeting_dir", F.array_join(F.transform("speakers", lambda x: x["label"]), ",").alias("labels"))


@register("f23_pending_requests", V.sql("files requests results", "SELECT audio_file FROM files WHERE audio_file IN (SELECT audio_file FROM requests) AND audio_file NOT IN (SELECT audio_file FROM results)"))
def pending_requests(spark, sf_dir):
    return Q.pending_requests(V.files(spark, sf_dir), V.requests(spark, sf_dir), V.results(spark, sf_dir))


@register("k19_write_requests", V.sql("files requests", "SELECT audio_file FROM requests WHERE audio_file IN (SELECT audio_file FROM files)"))
def write_requests(spark, sf_dir):
    more = spark.createDataFrame([("../x.wav",), ("clip1.txt",), ("nowhere.wav",)], "audio_file string")
    return Q.write_requests(V.requests(spark, sf_dir).unionByName(more), V.files(spark, sf_dir))


@register("f26_enroll_state", V.sql("files requests results", "SELECT f.audio_file, CASE WHEN r.status IS NOT NULL THEN 'done' WHEN q.audio_file IS NOT NULL THEN 'queued' ELSE 'idle' END AS state, r.status, r.reason, CASE WHEN r.status = 'ok' THEN 'ok' WHEN r.status IS NOT NULL THEN 'bad' WHEN q.audio_file IS NOT NULL THEN 'queued' ELSE 'idle' END AS chip FROM files f LEFT JOIN requests q USING (audio_file) LEFT JOIN results r USING (audio_file)"))
def enroll_state(spark, sf_dir):
    s = Q.enroll_state(V.files(spark, sf_dir), V.requests(spark, sf_dir), V.results(spark, sf_dir))
    return s.withColumn("chip", X.enroll_chip(F.col("state"), F.col("status")))


@register("s28_valid_results", V.sql("files results", "SELECT r.audio_file, r.status, r.reason, r.audio_size, r.audio_mtime FROM results r JOIN files f USING (audio_file) WHERE r.audio_size = f.length AND abs(r.audio_mtime - f.mtime) <= 2"))
def valid_results(spark, sf_dir):
    return Q.valid_results(V.results(spark, sf_dir), V.files(spark, sf_dir))


@register("s28_stale_results", V.sql("files results", "SELECT r.audio_file FROM results r LEFT JOIN files f USING (audio_file) WHERE f.audio_file IS NULL OR r.audio_size <> f.length OR abs(r.audio_mtime - f.mtime) > 2"))
def stale_results(spark, sf_dir):
    return Q.stale_results(V.results(spark, sf_dir), V.files(spark, sf_dir))


@register("k23_orphan_sidecars", V.sql("files results", "SELECT audio_file, status FROM results WHERE audio_file NOT IN (SELECT audio_file FROM files)"))
def orphan_sidecars(spark, sf_dir):
    return Q.orphan_sidecars(V.results(spark, sf_dir), V.files(spark, sf_dir)).select("audio_file", "status")


def _sessions(spark, sf_dir):
    """Customers as recording sessions: manifests of some, parts of some from their orders."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), "c_mktsegment")
    o = V.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    listed = o.select(F.col("o_custkey").alias("session"), F.concat(F.lit("part"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.when(F.col("o_orderstatus") == "F", ".wav").otherwise(".tmp")).alias("name"), F.col("o_totalprice").alias("length"))
    return c.select("session"), c.where("c_mktsegment < 'H'").select("session"), Q.session_parts(listed.withColumn("path", F.concat(F.lit("it's/"), "name")))


@register("f22_orphan_sessions", "SELECT c_custkey AS session FROM customer WHERE c_mktsegment < 'H' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100)")
def orphan_sessions(spark, sf_dir):
    return Q.orphan_sessions(*_sessions(spark, sf_dir))


@register("k26_unrecoverable_sessions", "SELECT c_custkey AS session FROM customer WHERE NOT c_mktsegment < 'H'")
def unrecoverable_sessions(spark, sf_dir):
    sessions, manifests, _ = _sessions(spark, sf_dir)
    return Q.unrecoverable_sessions(sessions, manifests)


@register("k14_concat_lists", """SELECT o_custkey AS session, string_agg('file ''it''\\''''s/part' || lpad(o_orderkey::VARCHAR, 9, '0') || '.wav''', chr(10) ORDER BY o_orderkey) || chr(10) AS list FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100 GROUP BY o_custkey""")
def concat_lists(spark, sf_dir):
    return Q.concat_lists(_sessions(spark, sf_dir)[2])


def _clips(spark, sf_dir):
    t = V.turns(spark, sf_dir)
    e = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("turn_idx"), F.col("user_id"), "event_type")
    d = t.drop("speaker").join(e, "turn_idx")
    return d.select(F.concat_ws("/", "meeting_id", F.col("user_id").cast("string")).alias("meeting_id"), "turn_idx", F.col("event_type").alias("speaker"), (F.col("start").cast("decimal(18,3)") / 1000).cast("decimal(18,3)").alias("start"), (F.col("end").cast("decimal(18,3)") / 1000).cast("decimal(18,3)").alias("end"))


@register(
    "x06_classify_clips",
    V.sql("turns", "") + """, clips AS (SELECT t.meeting_id || '/' || e.user_id AS meeting_id, e.event_type AS speaker, t.start, t."end" FROM turns t JOIN events e ON e.event_id = t.turn_idx),
raw AS (SELECT meeting_id, count(DISTINCT speaker) AS labels, ((sum("end" - start) + 50) // 100)::BIGINT / 10 AS speaking_seconds FROM clips GROUP BY ALL),
""" + _clean("clips") + ",\n" + _CHOSEN.format(least=1500, target=20000) + """,
u AS (SELECT meeting_id, count(*) AS speaker_count, max(s) AS clean_seconds FROM (SELECT meeting_id, speaker, sum("end" - start) / 1000 AS s FROM chosen GROUP BY ALL) GROUP BY meeting_id),
d AS (SELECT r.*, coalesce(speaker_count, 0) AS speaker_count, clean_seconds FROM raw r LEFT JOIN u USING (meeting_id)),
k AS (SELECT *, CASE WHEN speaker_count > 1 THEN 'multiple_speakers' WHEN speaking_seconds < 10 THEN 'too_short' WHEN speaker_count = 0 THEN 'unusable_embedding' WHEN clean_seconds < 10 THEN 'too_short' END AS reason FROM d)
SELECT meeting_id, speaker_count, speaking_seconds, labels - speaker_count AS ignored_short_labels, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason FROM k""",
)
def classify_clips(spark, sf_dir):
    return Q.classify_clips(_clips(spark, sf_dir)).withColumn("speaking_seconds", F.col("speaking_seconds").cast("double"))


# -- documents of meetings


@register("w09_previous_open_items", V.sql("summaries", "SELECT profile, max(meeting_dir) AS meeting_dir, arg_max(items, meeting_dir) AS items FROM summaries WHERE profile IS NOT NULL GROUP BY profile"))
def previous_open_items(spark, sf_dir):
    return M.previous_open_items(V.summaries(spark, sf_dir), "## Open")


@register("d27_section_body", V.sql("summaries", "SELECT meeting_dir, items, profile FROM summaries"))
def section_body(spark, sf_dir):
    s = V.summaries(spark, sf_dir)
    return s.select("meeting_dir", X.section_body(F.col("summary_md"), "## Open").alias("items"), X.profile_of_meeting(F.col("meta_md"), F.col("summary_md")).alias("profile"))


_QUALITY = """'## จุดที่ควรตรวจเอง (2)' || chr(10) || '- check' || chr(10) || '[ไม่มั่นใจ] inside' || '---' || '## ป้ายคุณภาพที่ค้างอยู่ในไทม์ไลน์รายช่วง' || chr(10) || chr(10) || '[ไม่มั่นใจ] early' || chr(10) || chr(10) || '### part 1' || chr(10) || '[คำเพี้ยน?] x' || doc_id || chr(10) || '[ไม่มั่นใจ] y' || chr(10) || chr(10) || '### part 2' || chr(10) || '[คำเพี้ยน?] z'"""


@register("d29_split_quality", V.sql("summaries", f"""SELECT meeting_dir, {_QUALITY} AS quality,
'ผู้เข้าร่วม: old' || chr(10) || '## Topics' || chr(10) || '- a' || chr(10) || '### part 1' || chr(10) || '### part 2' || chr(10) || '- kept' || chr(10) || '## Open' || chr(10) || rtrim(substr(summary_md, instr(summary_md, chr(10) || '## Open' || chr(10)) + 9), chr(10)) AS body FROM summaries"""))
def split_quality(spark, sf_dir):
    s = M.split_quality(V.summaries(spark, sf_dir))
    return s.select("meeting_dir", F.array_join("quality", "---").alias("quality"), "body")


@register("k06_summary_files", V.sql("summaries", f"""SELECT meeting_dir, 'สรุปด้วย model-1' || chr(10) || 'ประเภทประชุม: dev' || chr(10) || 'แก้คำตาม glossary: b 2 จุด, a 1 จุด' || chr(10) || chr(10) || replace({_QUALITY}, '---', chr(10) || chr(10)) || chr(10) AS meta FROM summaries"""))
def summary_files(spark, sf_dir):
    s = V.summaries(spark, sf_dir)
    counts = s.select("meeting_dir", F.explode(F.array(F.struct(F.lit("a").alias("term"), F.lit(1).alias("n")), F.struct(F.lit("b").alias("term"), F.lit(2).alias("n")))).alias("c")).select("meeting_dir", "c.*")
    facts = s.select("meeting_dir", F.lit("model-1").alias("model"), F.lit("dev").alias("profile"), F.lit(None).cast("string").alias("speaker_table"))
    return M.summary_files(M.split_quality(s), facts, counts, counts.limit(0)).select("meeting_dir", "meta")


@register("d31_replace_participants", V.sql("summaries", "SELECT meeting_dir, 'ผู้เข้าร่วม: new' || chr(10) || chr(10) || rtrim(replace(summary_md, 'ผู้เข้าร่วม: old' || chr(10), ''), chr(10)) AS summary_md FROM summaries"))
def replace_participants(spark, sf_dir):
    return V.summaries(spark, sf_dir).select("meeting_dir", X.replace_participants(F.col("summary_md"), F.lit("ผู้เข้าร่วม: new")).alias("summary_md"))


@register("d30_rename_label", V.sql("utterances", """SELECT meeting_id, seq, replace('**' || speaker || '** [00:01]: **user** [x', '**user** [0', '**A$1\\B** [0') AS md FROM utterances"""))
def rename_label(spark, sf_dir):
    md = F.concat(F.lit("**"), "speaker", F.lit("** [00:01]: **user** [x"))
    return V.utterances(spark, sf_dir).select("meeting_id", "seq", X.rename_label(md, F.lit("user"), F.lit("A$1\\B")).alias("md"))


_FOLDERS = """r2 AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN strptime(name[1:10], '%Y-%m-%d')::DATE WHEN 1 THEN CASE WHEN hour(finished_at) * 60 + minute(finished_at) + (second(finished_at) > 0)::INT * 0 < (o_orderkey % 24) * 60 + 30 THEN finished_at::DATE - 1 ELSE finished_at::DATE END ELSE finished_at::DATE END AS day FROM recordings),
r3 AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN name[1:10] || '_' || name[12:16] WHEN 1 THEN strftime(day, '%Y-%m-%d') || '_' || name[7:11] || '-topic' ELSE strftime(day, '%Y-%m-%d') || '_' || name END AS base FROM r2)"""


@register("d12_meeting_folders", V.sql("recordings", "") + ", " + _FOLDERS + " SELECT path, day, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS folder FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS n FROM r3)")
def meeting_folders(spark, sf_dir):
    return M.meeting_folders(V.recordings(spark, sf_dir))


# -- scalars and typed leaves


@register("d06_clean_names", """SELECT c_custkey, left(trim(translate(regexp_replace(' *' || c_name || '  [x]' || chr(9) || repeat('`z', 50), '\\s+', ' ', 'g'), '*[]`', '')), 60) AS name, c_name || '.job.json' AS job_path FROM customer""")
def clean_names(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.clean_name(F.concat(F.lit(" *"), "c_name", F.lit("  [x]\t"), F.lit("`z" * 50))).alias("name"), X.job_path(F.concat("c_name", F.lit(".wav"))).alias("job_path"))


@register("d03_clocks", """SELECT event_id, printf('%02d:%02d', s // 60, s % 60) AS stamp, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS clock, CASE WHEN s >= 60 THEN printf('%d min %d sec', s // 60, s % 60) ELSE printf('%d sec', s) END AS spoken, ceil(length(event_type || s) / 1.1::DOUBLE)::BIGINT AS tokens, s::INTEGER AS parsed
FROM (SELECT event_id, event_type, user_id * 60 + event_id % 60 AS s FROM events)""")
def clocks(spark, sf_dir):
    s = (F.col("user_id") * 60 + F.col("event_id") % 60).cast("bigint")
    return V.table(spark, sf_dir, "events").select("event_id", X.format_timestamp(s).alias("stamp"), X.format_clock(s).alias("clock"), X.format_spoken(s).alias("spoken"), X.estimate_tokens(F.concat("event_type", s.cast("string"))).alias("tokens"), X.parse_timestamp(X.format_timestamp(s)).alias("parsed"))


@register("f01_typed_leaves", "SELECT event_id, NULL::VARCHAR AS as_str, (props::JSON->>'k')::DOUBLE AS as_number, NULL::BOOLEAN AS as_bool, props::JSON->>'k' AS param FROM events")
def typed_leaves(spark, sf_dir):
    v = Y.leaf(F.try_parse_json("props"), "$.k")
    return V.table(spark, sf_dir, "events").select("event_id", Y.as_str(v).alias("as_str"), Y.as_number(v).alias("as_number"), Y.as_bool(v).alias("as_bool"), Y.render_param(v).alias("param"))


@register("f03_leaves_of_each_type", """SELECT event_id, CASE event_type WHEN 'view' THEN 'true' WHEN 'click' THEN event_type END AS text, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN NULL WHEN 'signup' THEN user_id % 2 = 0 END AS flag,
  CASE event_type WHEN 'purchase' THEN user_id::DOUBLE END AS number FROM events""")
def leaves_of_each_type(spark, sf_dir):
    """One leaf that holds the text 'true', a text, a boolean, a number or, for errors, a list."""
    value = F.when(F.col("event_type") == "view", F.lit('"true"')).when(F.col("event_type") == "click", F.to_json(F.array("event_type")).substr(F.lit(2), F.length("event_type") + 2))
    value = value.when(F.col("event_type") == "signup", (F.col("user_id") % 2 == 0).cast("string")).when(F.col("event_type") == "purchase", F.col("user_id").cast("string")).otherwise(F.lit("[1]"))
    v = Y.leaf(F.try_parse_json(F.concat(F.lit('{"k":'), value, F.lit("}"))), "$.k")
    return V.table(spark, sf_dir, "events").select("event_id", Y.as_str(v).alias("text"), Y.as_bool(v).alias("flag"), Y.as_number(v).alias("number"))


@register("f05_drop_numeric_vectors", """SELECT vec_id, '{"k": {"note": "p' || label || '"}, "list": [1, "a"]}' AS doc FROM embeddings""")
def drop_numeric_vectors(spark, sf_dir):
    doc = F.to_json(F.struct(F.struct(F.col("embedding").alias("vector"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("note")).alias("k")))
    mixed = F.replace(doc, F.lit('{"k"'), F.lit('{"list":[1,"a",[2,3.5]],"k"'))
    return V.table(spark, sf_dir, "embeddings").select("vec_id", Y.drop_numeric_vectors(mixed).alias("doc"))


@register("d22_first_json_object", """SELECT event_id, '{"k": ' || (props::JSON->>'k') || '}' AS found FROM events""")
def first_json_object(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", Y.first_json_object(F.concat(F.lit("see {here} ```"), "props", F.lit("``` and {\"x\": 1} }"))).alias("found"))


@register("d20_fingerprint", "SELECT o_orderkey, left(sha256('clip' || o_orderkey || '|' || (o_custkey * 10) || '|' || (o_orderkey % 1000) || '|m1'), 16) AS fingerprint FROM orders")
def fingerprint(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.fingerprint(F.concat(F.lit("clip"), F.col("o_orderkey").cast("string")), F.col("o_custkey") * 10, (F.col("o_orderkey") % 1000).cast("double"), F.lit("m1")).alias("fingerprint"))


@register("d32_settings", """SELECT p_partkey, CASE WHEN p_size < 10 THEN TRUE WHEN p_size < 20 THEN FALSE ELSE TRUE END AS flag, CASE WHEN p_size < 25 THEN p_size * 1000 - 3000 ELSE NULL END AS raw, CASE WHEN p_size < 25 AND p_size * 1000 - 3000 BETWEEN 0 AND 14999 THEN p_size * 1000 - 3000 ELSE 1500 END::INTEGER AS overlap, CASE WHEN p_size < 25 THEN p_size / 2 ELSE 0.5 END::DOUBLE AS ratio, p_size < 25 AS again FROM part""")
def settings(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").withColumn("n", F.col("p_size").cast("bigint"))
    word = F.when(F.col("n") < 10, " Yes ").when(F.col("n") < 20, "off").otherwise("maybe")
    raw = F.when(F.col("n") < 25, F.col("n") * 1000 - 3000)
    status = F.when(F.col("n") < 25, 503).otherwise(404)
    return p.select("p_partkey", X.read_bool(word, True).alias("flag"), raw.cast("int").alias("raw"), X.read_overlap(F.coalesce(raw.cast("string"), F.lit("x"))).alias("overlap"), X.read_float(F.when(F.col("n") < 25, (F.col("n") / 2).cast("string")).otherwise("?"), 0.5).alias("ratio"), X.is_retryable(status, F.lit(None).cast("string")).alias("again"))


@register("a17_worst_status", "SELECT 'fail' AS status, count(*) AS n, string_agg('[' || CASE WHEN n_regionkey = 0 THEN 'fail' WHEN n_regionkey < 3 THEN 'warn' ELSE 'ok' END || '] ' || n_name, chr(10) ORDER BY n_nationkey) AS report FROM nation")
def worst_status(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    return E.worst_status(n.select(F.col("n_nationkey").alias("ord"), F.when(F.col("n_regionkey") == 0, "fail").when(F.col("n_regionkey") < 3, "warn").otherwise("ok").alias("status"), F.col("n_name").alias("text")))


@register("e13_providers_known", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ok' ELSE 'warn' END AS status, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'BUILDING, MACHINERY' END AS detail FROM customer")
def providers_known(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("model_id"))
    return E.providers_known(c, spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "model_id string")).select("c_custkey", "status", "detail")


@register("t12_recorder_state", """SELECT user_id AS session, arg_max(event_type, event_id) AS status, min(CASE WHEN event_type = 'view' THEN ts END) AS since FROM events GROUP BY user_id""")
def recorder_state(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", F.when(F.col("event_type") == "view", "recording").otherwise(F.col("event_type")).alias("status"), F.col("event_id").alias("ord"))
    return E.recorder_state(e).select("session", F.when(F.col("status") == "recording", "view").otherwise(F.col("status")).alias("status"), "since")


@register("s02_stable_files", "SELECT 'clip' || o_orderkey || '.wav' AS path FROM orders WHERE o_orderstatus <> 'P' AND o_custkey > 0")
def stable_files(spark, sf_dir):
    from speechframe.sources.files import stable_files as stable

    f = V.files(spark, sf_dir).select(F.col("audio_file").alias("path"), "length")
    grown = V.table(spark, sf_dir, "orders").select(F.concat(F.lit("clip"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("path"), (F.col("o_custkey") * 10 + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("length"))
    return stable(f, grown)


@register("e01_meeting_pipeline")
def meeting_pipeline(spark, sf_dir):
    """The whole job over segments and turns, with the stand-in for a text model; tests hold its parts against brute force."""
    from speechframe.operators.models import first_sentences
    from speechframe.operators.pipeline import process

    s = V.segments(spark, sf_dir).withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000)
    t = V.turns(spark, sf_dir).withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000)
    return process(s, t, V.dictionary(spark), lambda: first_sentences, max_tokens=2000, overlap_tokens=200, threshold=4000).summaries


def _confirmed(spark, sf_dir):
    """p0 and p1 stand in the registry; every person's first vector waits in the queue of a meeting."""
    registry = V.samples(spark, sf_dir).where("name < 'p2'").select(F.col("speaker_id").alias("id"), "name", "ord", "embedding", "embedding_model", F.lit("old").alias("source"), F.lit("d").alias("added"))
    first = V.prints(spark, sf_dir).groupBy("name").agg(F.min_by(F.struct("ord", "embedding", "embedding_model"), "ord").alias("f"))
    queue = first.select(F.lit("meeting").alias("meeting_dir"), F.col("name").alias("label"), (F.col("f.ord") + 1_000_000).alias("ord"), "f.embedding", "f.embedding_model", F.lit("2026-01-02").alias("added"))
    by_id = F.col("label") == "p0"
    decisions = queue.where("label < 'p4'").select("meeting_dir", "label", F.when(~by_id, F.concat(F.lit("name "), "label")).alias("name"), F.when(by_id, "id-p1").alias("speaker_id"))
    return O.confirm_speaker(registry, queue, decisions)


@register(
    "j08_confirm_speaker",
    V.sql("prints", """SELECT 'id-' || name AS id, name, CASE WHEN name = 'p1' THEN least(10, count(*) + 1) ELSE count(*) END AS sample_count FROM prints WHERE name < 'p2' GROUP BY name
UNION ALL SELECT DISTINCT md5('speaker:name ' || name), 'name ' || name, 1 FROM prints WHERE name > 'p0' AND name < 'p4'"""),
)
def confirm_speaker(spark, sf_dir):
    return O.registry_summary(_confirmed(spark, sf_dir))


@register("e05_preflight", """SELECT c_custkey AS device, ord, name, status FROM (SELECT c_custkey, abs(c_acctbal) / 100000 AS p, c_nationkey FROM customer) c, LATERAL (
  SELECT 1 AS ord, 'mic' AS name, CASE WHEN p > 0 AND 20 * log10(p) >= -30 THEN 'ok' WHEN p > 0 AND 20 * log10(p) >= -45 THEN 'warn' ELSE 'fail' END AS status
  UNION ALL SELECT 2, 'loopback', CASE WHEN p > 0 AND 20 * log10(p / 10) >= -50 THEN 'ok' ELSE 'warn' END UNION ALL SELECT 3, 'samplerate', CASE WHEN c_nationkey < 12 THEN 'ok' ELSE 'fail' END)""")
def preflight(spark, sf_dir):
    from speechframe.operators.services import preflight as checks

    c = V.table(spark, sf_dir, "customer")
    p = F.abs("c_acctbal").cast("double") / 100000
    return checks(c.select(F.col("c_custkey").alias("device"), p.alias("mic"), (p / 10).alias("loopback")), c.select(F.col("c_custkey").alias("device"), F.lit(48000).alias("mic_rate"), F.when(F.col("c_nationkey") < 12, 48000).otherwise(44100).alias("loopback_rate")))


@register("w16_pairs_by_score", V.sql("prints voices truth", "") + ", " + _PAIRS + " SELECT left_file, left_label, right_file, right_label, round(score, 6) AS score FROM pairs")
def pairs_by_score(spark, sf_dir):
    from speechframe.operators.services import calibration_pairs

    pairs = calibration_pairs(_resolved(spark, sf_dir))
    return pairs.select("left_file", "left_label", "right_file", "right_label", F.round("score", 6).alias("score"))


@register("a20_evidence", V.sql("prints voices truth", "SELECT v.file, v.label, coalesce(a.person, b.person) AS person FROM voices v LEFT JOIN truth a ON a.file = v.file AND a.label = v.label LEFT JOIN truth b ON b.file = v.file AND b.label = '*'"))
def evidence(spark, sf_dir):
    from speechframe.operators.services import calibration_evidence

    return calibration_evidence(V.voices(spark, sf_dir).drop("name"), V.truth(spark, sf_dir)).select("file", "label", "person")


@register("j11_reusable_transcripts", V.sql("recordings", "SELECT path, CASE WHEN o_totalprice > 100000 THEN 'text ' || r.o_orderkey END AS md FROM recordings r JOIN orders USING (o_orderkey)"))
def reusable_transcripts(spark, sf_dir):
    from speechframe.operators.services import reusable_transcripts as reusable

    r = V.recordings(spark, sf_dir).withColumn("key", F.split_part("path", F.lit("/"), F.lit(2)).cast("bigint"))
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("text "), F.col("o_orderkey").cast("string"))).otherwise(" \u00a0\n").alias("md"))
    return reusable(r, r.join(o, "key").select("path", "md")).select("path", "md")
