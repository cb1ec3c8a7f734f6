"""Queries over intervals, transcripts and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions import text as X
from speechframe.operators import dictionary as D
from speechframe.operators import intervals as I
from speechframe.operators import sequences as Q
from speechframe.operators import stats as A
from speechframe.plans import views as V
from speechframe.plans.registry import register

_MERGED = """best AS (SELECT s.meeting_id, s.seq, arg_max(t.speaker, (least(s."end", t."end") - greatest(s.start, t.start), -t.turn_idx)) AS speaker
  FROM segments s JOIN turns t ON s.meeting_id = t.meeting_id AND least(s."end", t."end") > greatest(s.start, t.start) GROUP BY ALL),
merged AS (SELECT s.meeting_id, s.seq, s.start, s."end", coalesce(nullif(b.speaker, ''), 'SPEAKER_UNKNOWN') AS speaker, s.text FROM segments s LEFT JOIN best b USING (meeting_id, seq))"""


@register("j01_merge_segments_turns", V.sql("turns segments", "") + ",\n" + _MERGED + ' SELECT meeting_id, seq, start, "end", speaker, text FROM merged')
def merge_segments_turns(spark, sf_dir):
    return I.merge_segments_turns(V.segments(spark, sf_dir), V.turns(spark, sf_dir), width=60_000)


@register("a02_seconds_by_speaker", V.sql("turns", 'SELECT meeting_id, speaker, sum(greatest(0, "end" - start))::BIGINT AS seconds FROM turns GROUP BY ALL'))
def seconds_by_speaker(spark, sf_dir):
    return I.seconds_by_speaker(V.turns(spark, sf_dir))


def _union(source: str, keys: str, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(CASE WHEN start <= m THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM (
    SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {source} WHERE "end" >= start)) GROUP BY {keys}, i)"""


def _clean(source: str) -> str:
    """Cells between neighbouring bounds that the turns of exactly one speaker cover, united."""
    return f"""p AS (SELECT DISTINCT meeting_id, start AS p FROM {source} WHERE "end" > start UNION SELECT DISTINCT meeting_id, "end" FROM {source} WHERE "end" > start),
cell AS (SELECT * FROM (SELECT meeting_id, p, lead(p) OVER (PARTITION BY meeting_id ORDER BY p) AS q FROM p) WHERE q IS NOT NULL),
one AS (SELECT c.meeting_id, min(t.speaker) AS speaker, p AS start, q AS "end" FROM cell c JOIN {source} t ON t.meeting_id = c.meeting_id AND t.start <= c.p AND t."end" >= c.q GROUP BY c.meeting_id, p, q HAVING count(DISTINCT t.speaker) = 1),
{_union("one", "meeting_id, speaker", "clean")}"""


_CHOSEN = """chosen AS (SELECT * FROM (SELECT *, row_number() OVER w AS rank, coalesce(sum("end" - start) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM clean WHERE "end" - start >= {least} WINDOW w AS (PARTITION BY meeting_id, speaker ORDER BY "end" - start DESC, start)) WHERE before < {target} AND rank <= 12)"""


@register("w12_union_intervals", V.sql("turns", "") + ",\n" + _union("turns", "meeting_id, speaker", "u") + ' SELECT meeting_id, speaker, start, "end" FROM u')
def union_intervals(spark, sf_dir):
    return I.union_intervals(V.turns(spark, sf_dir), ["meeting_id", "speaker"])


@register(
    "w13_subtract_intervals",
    V.sql("turns segments", "")
    + f""",
{_union("segments", "meeting_id", "k")},
{_union('(SELECT meeting_id, start, "end" FROM turns WHERE value_rank = 1)', "meeting_id", "r")},
pt AS (SELECT meeting_id, start AS p FROM k UNION SELECT meeting_id, "end" FROM k UNION SELECT meeting_id, start FROM r UNION SELECT meeting_id, "end" FROM r),
c AS (SELECT * FROM (SELECT meeting_id, p, lead(p) OVER (PARTITION BY meeting_id ORDER BY p) AS q FROM pt) WHERE q IS NOT NULL),
left_over AS (SELECT c.meeting_id, c.p AS start, c.q AS "end" FROM c WHERE EXISTS (SELECT 1 FROM k WHERE k.meeting_id = c.meeting_id AND k.start <= c.p AND k."end" >= c.q) AND NOT EXISTS (SELECT 1 FROM r WHERE r.meeting_id = c.meeting_id AND r.start <= c.p AND r."end" >= c.q)),
{_union("left_over", "meeting_id", "u")} SELECT meeting_id, start, "end" FROM u""".replace(" WHERE value_rank = 1", " WHERE speaker = 'S0'"),
)
def subtract_intervals(spark, sf_dir):
    return I.subtract_intervals(V.segments(spark, sf_dir), V.turns(spark, sf_dir).where("speaker = 'S0'"), ["meeting_id"])


@register("w14_clean_intervals", V.sql("turns", "") + ",\n" + _clean("turns") + ' SELECT meeting_id, speaker, start, "end" FROM clean')
def clean_intervals(spark, sf_dir):
    return I.clean_intervals(V.turns(spark, sf_dir))


@register("w06_select_intervals", V.sql("turns", "") + ",\n" + _clean("turns") + ",\n" + _CHOSEN.format(least=1500, target=20000) + ' SELECT meeting_id, speaker, start, "end", rank::INTEGER AS rank FROM chosen')
def select_intervals(spark, sf_dir):
    return I.select_intervals(I.clean_intervals(V.turns(spark, sf_dir)), 1500, 20_000)


@register("k25_longest_clips", V.sql("turns", "") + ",\n" + _clean("turns") + """ SELECT meeting_id, speaker, start, least("end", start + 12000) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY "end" - start DESC, start) AS n FROM clean) WHERE n = 1""")
def longest_clips(spark, sf_dir):
    return I.longest_clips(I.clean_intervals(V.turns(spark, sf_dir)), 12_000)


_STATS = """run AS (SELECT meeting_id, seq, trim(speaker) AS speaker, text, start, CASE WHEN lag(trim(speaker)) OVER (PARTITION BY meeting_id ORDER BY seq) IS NOT DISTINCT FROM trim(speaker) THEN 0 ELSE 1 END AS fresh FROM utterances),
grouped AS (SELECT meeting_id, speaker, count(*) AS lines, sum(fresh)::BIGINT AS turns, sum(length(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')))::BIGINT AS chars, min(start) AS first_seconds, max(start) AS last_seconds FROM run GROUP BY ALL),
stats AS (SELECT *, TRUE AS identified, CASE WHEN sum(chars) OVER (PARTITION BY meeting_id) > 0 THEN chars / sum(chars) OVER (PARTITION BY meeting_id) ELSE 0.0 END AS share FROM grouped)"""


def _blocks(spark, sf_dir):
    """Utterances in the shape of parsed blocks."""
    return V.utterances(spark, sf_dir).select("meeting_id", F.col("seq").alias("seg"), "speaker", F.col("text").alias("body"), F.col("start").alias("start_seconds"))


@register("a01_speaker_stats", V.sql("utterances", "") + ",\n" + _STATS + " SELECT * EXCLUDE (share), round(share, 6) AS share FROM stats")
def speaker_stats(spark, sf_dir):
    return A.speaker_stats(_blocks(spark, sf_dir)).withColumn("share", F.round("share", 6))


_CLOCK = "printf('%02d:%02d', {0}::BIGINT // 60, {0}::BIGINT % 60)"
_PCT = "printf('%.1f%%', share * 100)"


@register(
    "a14_participants_line",
    V.sql("utterances", "")
    + ",\n"
    + _STATS
    + f""", parted AS (SELECT *, speaker || ' ' || {_PCT} || CASE WHEN max(last_seconds) OVER m > min(first_seconds) OVER m AND (first_seconds - min(first_seconds) OVER m) / (max(last_seconds) OVER m - min(first_seconds) OVER m) > 0.25 THEN ' (พูดครั้งแรก ' || {_CLOCK.format("first_seconds")} || ')' ELSE '' END AS part FROM stats WINDOW m AS (PARTITION BY meeting_id))
SELECT meeting_id, 'ผู้เข้าร่วม: ' || count(*) || ' เสียง (ระบุตัวได้จากลายเสียง ' || count(*) || ' คน) — ' || string_agg(part, ' · ' ORDER BY chars DESC, speaker) AS line FROM parted GROUP BY meeting_id""",
)
def participants_line(spark, sf_dir):
    return A.participants_line(A.speaker_stats(_blocks(spark, sf_dir)))


@register(
    "a15_speaker_table",
    V.sql("utterances", "")
    + ",\n"
    + _STATS
    + f""" SELECT meeting_id, '{chr(10).join(S.SPEAKER_TABLE_HEAD)}' || chr(10) || string_agg('| ' || speaker || ' | ' || format('{{:,}}', lines) || ' | ' || format('{{:,}}', turns) || ' | ' || format('{{:,}}', chars) || ' | ' || {_PCT} || ' | ' || {_CLOCK.format("first_seconds")} || ' | ' || {_CLOCK.format("last_seconds")} || ' |', chr(10) ORDER BY chars DESC, speaker) AS "table" FROM stats GROUP BY meeting_id""",
)
def speaker_table(spark, sf_dir):
    return A.speaker_table(A.speaker_stats(_blocks(spark, sf_dir)))


_LABELS = """labels AS (SELECT meeting_id, speaker, first_seq, coalesce(name, 'ผู้พูด ' || row_number() OVER (PARTITION BY meeting_id, name IS NULL ORDER BY first_seq, speaker)) AS label
  FROM (SELECT meeting_id, speaker, min(seq) AS first_seq, CASE WHEN speaker = 'system' THEN 'สมศรี (ศรี)' END AS name FROM {0} GROUP BY ALL))"""


def _labels(spark, sf_dir):
    u = V.utterances(spark, sf_dir)
    return A.speaker_labels(u, u.where("speaker = 'system'").select("meeting_id", "speaker", F.lit("สมศรี (ศรี)").alias("name")))


@register("w01_speaker_labels", V.sql("utterances", "") + ",\n" + _LABELS.format("utterances") + " SELECT meeting_id, speaker, label, first_seq FROM labels")
def speaker_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


_RENDERED = (
    V.sql("utterances", "")
    + ",\n"
    + _LABELS.format("utterances")
    + f""", rendered AS (SELECT meeting_id, '# Transcript' || chr(10) || chr(10) || string_agg('**' || label || '** [' || {_CLOCK.format("start")} || ']: ' || text, chr(10) || chr(10) ORDER BY seq) AS md FROM utterances JOIN labels USING (meeting_id, speaker) GROUP BY meeting_id)"""
)


def _rendered(spark, sf_dir):
    return A.render_transcript(V.utterances(spark, sf_dir), _labels(spark, sf_dir))


@register("d41_render_transcript", _RENDERED + " SELECT meeting_id, md FROM rendered")
def render_transcript(spark, sf_dir):
    return _rendered(spark, sf_dir)


_HEAD = r"^\*\*([^*]+)\*\*\s*\[(\d+:\d{2})\]:"
_WS = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_PARSED = (
    _RENDERED
    + f""", blocks AS (SELECT meeting_id, pos, {_WS.format("block")} AS block FROM (SELECT meeting_id, unnest(string_split(md, chr(10) || chr(10))) AS block, unnest(range(len(string_split(md, chr(10) || chr(10))))) AS pos FROM rendered)),
numbered AS (SELECT *, sum(regexp_matches(block, '{_HEAD}')::INT) OVER (PARTITION BY meeting_id ORDER BY pos)::BIGINT AS seg FROM blocks WHERE block <> ''),
raws AS (SELECT meeting_id, seg, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS raw FROM numbered WHERE seg > 0 GROUP BY ALL),
parsed AS (SELECT meeting_id, seg, regexp_extract(raw, '{_HEAD}', 1) AS speaker, split_part(regexp_extract(raw, '{_HEAD}', 2), ':', 1)::INT * 60 + split_part(regexp_extract(raw, '{_HEAD}', 2), ':', 2)::INT AS start_seconds, {_WS.format("regexp_replace(raw, '" + _HEAD + "', '')")} AS body, raw FROM raws)"""
)


def _parsed(spark, sf_dir):
    return Q.parse_segments(_rendered(spark, sf_dir))


@register("s24_parse_segments", _PARSED + " SELECT meeting_id, seg, speaker, start_seconds, body, raw FROM parsed")
def parse_segments(spark, sf_dir):
    return _parsed(spark, sf_dir)


_TOKENS = "ceil({0} / 1.1::DOUBLE)::BIGINT"
_MERGE_CAP = S.MERGE_MAX_TOKENS


_MERGED_BLOCKS = (
    _PARSED.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", ordered AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg) AS n FROM parsed),
folded AS (SELECT meeting_id, n, 0 AS block, raw AS acc, CASE WHEN contains(body, chr(10) || chr(10)) THEN NULL ELSE speaker END AS open FROM ordered WHERE n = 1
  UNION ALL SELECT o.meeting_id, o.n, CASE WHEN f.open = o.speaker AND {_TOKENS.format("length(f.acc)")} + {_TOKENS.format("length(o.body)")} + 1 <= {_MERGE_CAP} THEN f.block ELSE f.block + 1 END,
    CASE WHEN f.open = o.speaker AND {_TOKENS.format("length(f.acc)")} + {_TOKENS.format("length(o.body)")} + 1 <= {_MERGE_CAP} THEN rtrim(f.acc || ' ' || o.body) ELSE o.raw END,
    CASE WHEN contains(o.body, chr(10) || chr(10)) THEN NULL ELSE o.speaker END
  FROM folded f JOIN ordered o ON o.meeting_id = f.meeting_id AND o.n = f.n + 1)
, merged_blocks AS (SELECT meeting_id::VARCHAR AS meeting_id, block::BIGINT AS block, arg_max(acc, n) AS raw FROM folded GROUP BY ALL)"""
)


@register("w02_merge_turns", _MERGED_BLOCKS + " SELECT meeting_id, block, raw FROM merged_blocks")
def merge_turns(spark, sf_dir):
    return Q.merge_turns(_parsed(spark, sf_dir), _MERGE_CAP).drop("n_segments")


@register("w02_merge_transcripts", _MERGED_BLOCKS + """, whole AS (SELECT meeting_id, '# Transcript' || chr(10) || chr(10) || string_agg(raw, chr(10) || chr(10) ORDER BY block) AS md FROM merged_blocks GROUP BY meeting_id) SELECT r.meeting_id, CASE WHEN (SELECT count(*) FROM parsed p WHERE p.meeting_id = r.meeting_id) = (SELECT count(*) FROM merged_blocks b WHERE b.meeting_id = r.meeting_id::VARCHAR) THEN r.md ELSE w.md END AS md FROM rendered r JOIN whole w ON w.meeting_id = r.meeting_id::VARCHAR""")
def merge_transcripts(spark, sf_dir):
    return Q.merge_transcripts(_rendered(spark, sf_dir))


@register(
    "w03_split_into_chunks",
    _PARSED.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", ordered AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg) AS n, {_TOKENS.format("length(raw)")} AS tok FROM parsed),
sums AS (SELECT *, sum(tok) OVER (PARTITION BY meeting_id ORDER BY n) AS upto FROM ordered),
folded AS (SELECT meeting_id, 0 AS chunk, 1::BIGINT AS a, (SELECT coalesce(min(x.n) - 1, (SELECT max(n) FROM sums z WHERE z.meeting_id = s.meeting_id)) FROM sums x WHERE x.meeting_id = s.meeting_id AND x.n > 1 AND x.upto > 400) AS b FROM sums s WHERE n = 1
  UNION ALL SELECT y.meeting_id, y.chunk + 1, y.a2, (SELECT coalesce(min(x.n) - 1, y.last) FROM sums x WHERE x.meeting_id = y.meeting_id AND x.n > y.b + 1 AND x.upto - y.base > 400)
  FROM (SELECT w.*, (SELECT max(upto) FROM sums x WHERE x.meeting_id = w.meeting_id AND x.n = w.a2) - (SELECT max(tok) FROM sums x WHERE x.meeting_id = w.meeting_id AND x.n = w.a2) AS base FROM (
    SELECT f.*, (SELECT max(n) FROM sums z WHERE z.meeting_id = f.meeting_id) AS last,
      (SELECT coalesce(min(x.n), f.b + 1) FROM sums x WHERE x.meeting_id = f.meeting_id AND x.n > f.a AND x.n <= f.b AND (SELECT max(upto) FROM sums e WHERE e.meeting_id = f.meeting_id AND e.n = f.b) - x.upto + x.tok <= 100) AS a2
    FROM folded f) w WHERE w.b < w.last) y)
SELECT f.meeting_id::VARCHAR AS meeting_id, chunk::BIGINT AS chunk, count(*)::INTEGER AS n_segments, string_agg(raw, chr(10) || chr(10) ORDER BY n) AS text, arg_min(start_seconds, n) AS start_seconds, arg_max(start_seconds, n) AS end_seconds
FROM folded f JOIN ordered o ON o.meeting_id = f.meeting_id AND o.n BETWEEN f.a AND f.b GROUP BY f.meeting_id, chunk""",
)
def split_into_chunks(spark, sf_dir):
    """Chunks of 400 tokens with 100 of overlap; a row that would overflow after a tail still joins it, as each chunk takes at least one new row."""
    return Q.split_into_chunks(_parsed(spark, sf_dir), 400, 100).withColumn("segs", F.size("segs")).withColumnRenamed("segs", "n_segments")


@register(
    "w15_group_by_span",
    V.sql("turns", "", recursive=True)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start, turn_idx) AS n FROM turns),
g AS (SELECT meeting_id, n, 0 AS grp, start AS first_start, "end" FROM o WHERE n = 1
  UNION ALL SELECT o.meeting_id, o.n, CASE WHEN o."end" - g.first_start > 280000 THEN g.grp + 1 ELSE g.grp END, CASE WHEN o."end" - g.first_start > 280000 THEN o.start ELSE g.first_start END, o."end" FROM g JOIN o ON o.meeting_id = g.meeting_id AND o.n = g.n + 1)
SELECT meeting_id, grp::BIGINT AS grp, count(*) AS n, min(first_start) AS start, arg_max("end", n) AS "end" FROM g GROUP BY meeting_id, grp""",
)
def group_by_span(spark, sf_dir):
    from pyspark.sql import Window as W

    t = V.turns(spark, sf_dir)
    return Q.group_by_span(t.withColumn("seq", F.row_number().over(W.partitionBy("meeting_id").orderBy("start", "turn_idx")).cast("bigint")), 280_000)


def _pattern(*sections: str) -> str:
    forms = sorted({w for s, _, _, w, _ in V.DICTIONARY if s in sections}, key=lambda w: (-len(w), w))
    return r"\*\*[^*]+\*\*\s*\[\d+:\d{2}\]:|" + "|".join(forms)


def _substituted(source: str, out: str, *sections: str) -> str:
    p = _pattern(*sections)
    lookup = "MAP {" + ", ".join(f"'{w}': '{c}'" for s, c, _, w, _ in V.DICTIONARY if s in sections) + "}"
    return f"""{out} AS (SELECT doc_id, list_aggregate(list_transform(list_zip(string_split_regex(text, '{p}'), list_append(list_transform(regexp_extract_all(text, '{p}'), lambda h: coalesce({lookup}[h], h)), '')), lambda z: z[1] || z[2]), 'string_agg', '') AS text FROM {source} WHERE text IS NOT NULL)"""


def _counted(source: str, *sections: str) -> str:
    lookup = "MAP {" + ", ".join(f"'{w}': '{c}'" for s, c, _, w, _ in V.DICTIONARY if s in sections) + "}"
    return f"SELECT doc_id, {lookup}[h] AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_pattern(*sections)}')) AS h FROM {source}) WHERE {lookup}[h] IS NOT NULL GROUP BY ALL"


@register("a07_apply_exact", "WITH " + _substituted("documents", "once", "exact") + ", " + _substituted("once", "twice", "aliases") + " SELECT doc_id, text FROM twice UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def apply_exact(spark, sf_dir):
    return D.apply_exact(V.table(spark, sf_dir, "documents").select("doc_id", "text"), V.dictionary(spark), "doc_id")[0]


@register("a03_substitution_counts", "WITH " + _substituted("documents", "once", "exact") + f", c AS ({_counted('documents', 'exact')} UNION ALL {_counted('once', 'aliases')}) SELECT doc_id, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL")
def substitution_counts(spark, sf_dir):
    return D.apply_exact(V.table(spark, sf_dir, "documents").select("doc_id", "text"), V.dictionary(spark), "doc_id")[1]


@register("a08_count_only", _counted("documents", "fuzzy", "project-names"))
def count_only(spark, sf_dir):
    return D.count_only(V.table(spark, sf_dir, "documents"), V.dictionary(spark), "doc_id")


@register("w11_busiest_first", f"SELECT term, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY sum(n) DESC, term)::INTEGER AS place FROM ({_counted('documents', 'fuzzy', 'project-names')}) GROUP BY term")
def busiest_first(spark, sf_dir):
    from pyspark.sql import Window as W

    counts = D.count_only(V.table(spark, sf_dir, "documents"), V.dictionary(spark), "doc_id").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "term")))


@register("w08_hotwords", "SELECT string_agg(term, ', ' ORDER BY s, o, term) AS hotwords FROM (SELECT *, sum(length(term) + 2) OVER (ORDER BY s, o, term) - 2 AS upto FROM (SELECT correct AS term, min((CASE section WHEN 'fuzzy' THEN 0 WHEN 'project-names' THEN 1 ELSE 2 END)) AS s, min(correct_ord) AS o FROM lexicon WHERE section IN ('fuzzy', 'project-names', 'exact') GROUP BY correct)) WHERE upto <= 600".join([V.sql("lexicon", ""), ""]))
def hotwords(spark, sf_dir):
    return D.hotwords_text(V.lexicon(spark, sf_dir))


@register("u03_prompt_blocks", V.sql("lexicon", """SELECT section, '### ' || section || chr(10) || string_agg('- ' || correct || ' ← ' || forms, chr(10) ORDER BY o, correct) AS block FROM (SELECT section, correct, min(correct_ord) AS o, string_agg(wrong, ', ' ORDER BY wrong_ord) AS forms FROM lexicon WHERE section IN ('fuzzy', 'project-names') GROUP BY ALL) GROUP BY section"""))
def prompt_blocks(spark, sf_dir):
    return D.prompt_blocks(V.lexicon(spark, sf_dir), {"fuzzy": "### fuzzy", "project-names": "### project-names"})


@register(
    "j06_find_collisions",
    V.sql("lexicon", """SELECT 'inside_correct' AS kind, 'heavy' AS severity, f.section, f.wrong, f.correct, t.correct AS other FROM (SELECT DISTINCT section, wrong, correct FROM lexicon WHERE section IN ('exact', 'aliases')) f JOIN (SELECT DISTINCT correct FROM lexicon) t ON contains(t.correct, f.wrong) AND f.wrong <> t.correct
UNION ALL SELECT DISTINCT 'inside_wrong', 'light', f.section, f.wrong, f.correct, g.wrong FROM lexicon f JOIN lexicon g ON f.section IN ('exact', 'aliases') AND g.section IN ('exact', 'aliases') AND contains(g.wrong, f.wrong) AND f.wrong <> g.wrong AND f.correct <> g.correct
UNION ALL SELECT DISTINCT 'short', 'light', section, wrong, correct, NULL FROM lexicon WHERE section IN ('exact', 'aliases') AND length(trim(wrong)) < 4
UNION ALL SELECT DISTINCT 'self', 'light', section, wrong, correct, NULL FROM lexicon WHERE section IN ('exact', 'aliases') AND wrong = correct"""),
)
def find_collisions(spark, sf_dir):
    return D.find_collisions(V.lexicon(spark, sf_dir))


_TALLY = "tally AS (SELECT wrong, sum((length(text) - length(replace(text, wrong, ''))) // length(wrong))::BIGINT AS hits, count_if(contains(text, wrong))::BIGINT AS meetings FROM documents, (SELECT DISTINCT wrong FROM dictionary) GROUP BY wrong)"


@register("j07_count_in_transcripts", V.sql("dictionary", "") + ", " + _TALLY + " SELECT wrong, coalesce(hits, 0) AS hits, meetings FROM tally")
def count_in_transcripts(spark, sf_dir):
    return D.count_in_transcripts(V.dictionary(spark), V.table(spark, sf_dir, "documents"))


@register("j07_lexicon_tally", V.sql("lexicon", "") + ", " + _TALLY.replace("FROM dictionary", "FROM lexicon") + " SELECT wrong, coalesce(hits, 0) AS hits, meetings FROM tally")
def lexicon_tally(spark, sf_dir):
    return D.count_in_transcripts(V.lexicon(spark, sf_dir), V.table(spark, sf_dir, "documents"))


@register("e10_audit_alive", V.sql("dictionary", "") + ", " + _TALLY + " SELECT wrong, hits, meetings FROM tally WHERE hits > 0 ORDER BY hits DESC, wrong LIMIT 15")
def audit_alive(spark, sf_dir):
    return D.audit(V.dictionary(spark), V.table(spark, sf_dir, "documents"))["alive"]


@register(
    "w10_sample_context",
    V.sql("dictionary", "", recursive=True)
    + """, terms AS (SELECT DISTINCT wrong FROM dictionary WHERE section IN ('exact', 'aliases')),
place AS (SELECT wrong, doc_id, text, instr(text, wrong) - 1 AS pos, 1 AS k FROM documents, terms WHERE contains(text, wrong)
  UNION ALL SELECT wrong, doc_id, text, pos + length(wrong) + instr(text[pos + length(wrong) + 1:], wrong) - 1, k + 1 FROM place WHERE k < 2 AND contains(text[pos + length(wrong) + 1:], wrong)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY doc_id, pos)::INTEGER AS example FROM place)
SELECT wrong, example, doc_id, pos::INTEGER AS pos, replace(text[greatest(0, pos - 25) + 1 : pos + length(wrong) + 25], chr(10), ' ') AS snippet FROM ranked WHERE example <= 2""",
)
def sample_context(spark, sf_dir):
    return D.sample_context(V.dictionary(spark), V.table(spark, sf_dir, "documents"), "doc_id")


@register("d05_demote_headings", """SELECT page_id, string_agg(CASE WHEN regexp_matches(l, '^#{1,6}[ \\t]+') THEN repeat('#', greatest(4, length(regexp_extract(l, '^(#{1,6})', 1)))) || ' ' || regexp_replace(l, '^#{1,6}[ \\t]+', '') ELSE l END, chr(10) ORDER BY i) AS md
FROM (SELECT page_id, unnest(string_split(h, chr(10))) AS l, unnest(range(len(string_split(h, chr(10))))) AS i FROM (SELECT page_id, '## ' || replace(html, '<', chr(10) || '# <') AS h FROM pages)) GROUP BY page_id""")
def demote_headings(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", X.demote_headings(F.concat(F.lit("## "), F.replace("html", F.lit("<"), F.lit("\n# <")))).alias("md"))
