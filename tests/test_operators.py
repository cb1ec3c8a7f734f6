"""Stated cases, ties, nulls and empty inputs of the conversation operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from speechframe.functions import text as X
from speechframe.functions import typed as Y
from speechframe.operators import dictionary as D
from speechframe.operators import events as E
from speechframe.operators import intervals as I
from speechframe.operators import meetings as M
from speechframe.operators import models, queues, sequences, stats, voices

SEG = "meeting_id string, seq int, start double, end double, text string"
TURN = "meeting_id string, turn_idx long, start double, end double, speaker string"


def turns(spark, rows):
    return spark.createDataFrame([("m", i, float(a), float(b), s) for i, (s, a, b) in enumerate(rows)], TURN)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_merge_takes_the_largest_overlap(spark):
    s = spark.createDataFrame([("m", 0, 0.0, 2.5, " สวัสดีครับ "), ("m", 1, 2.5, 5.0, "ผมมีประเด็นเสนอ"), ("m", 2, 10.0, 12.0, "x"), ("m", 3, 1.0, 1.0, None)], SEG)
    out = {r.seq: (r.speaker, r.text) for r in I.merge_segments_turns(s, turns(spark, [("S00", 0, 2.6), ("S01", 2.4, 5)])).collect()}
    assert out == {0: ("S00", "สวัสดีครับ"), 1: ("S01", "ผมมีประเด็นเสนอ"), 2: ("SPEAKER_UNKNOWN", "x"), 3: ("SPEAKER_UNKNOWN", None)}


def test_merge_first_turn_wins_ties_over_many_buckets(spark):
    s = spark.createDataFrame([("m", 0, 0.0, 400.0, "a"), ("m", 1, 500.0, 510.0, "b")], SEG)
    t = turns(spark, [("B", 0, 200), ("A", 200, 400), ("", 500, 510)])
    assert {r.seq: r.speaker for r in I.merge_segments_turns(s, t).collect()} == {0: "B", 1: "SPEAKER_UNKNOWN"}
    assert I.merge_segments_turns(s.limit(0), t).count() == 0 and I.merge_segments_turns(s, t.limit(0)).count() == 2


def brute_clean(rows):
    """By unit cells."""
    out = {}
    for x in range(0, 60):
        who = {s for s, a, b in rows if a <= x < b}
        if len(who) == 1:
            out.setdefault(who.pop(), []).append(x)
    return {s: cells for s, cells in out.items()}


@pytest.mark.parametrize("rows,expected", [([("A", 0, 10), ("B", 4, 6)], {"A": [(0, 4), (6, 10)]}), ([("A", 0, 10), ("B", 3, 7)], {"A": [(0, 3), (7, 10)]}), ([("A", 0, 12), ("B", 2, 5), ("C", 4, 9)], {"A": [(0, 2), (9, 12)]})])
def test_clean_intervals_cases(spark, rows, expected):
    got = {}
    for r in I.clean_intervals(turns(spark, rows)).orderBy("speaker", "start").collect():
        got.setdefault(r.speaker, []).append((r.start, r.end))
    assert got == expected


def test_clean_intervals_against_cells(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ABC"), a, a + rng.randrange(-1, 9)) for a in (rng.randrange(0, 50) for _ in range(40))]
    got = {}
    for r in I.clean_intervals(turns(spark, rows)).collect():
        got.setdefault(r.speaker, []).extend(range(int(r.start), int(r.end)))
    assert {k: sorted(v) for k, v in got.items()} == brute_clean(rows)


def test_select_intervals_stops_before_the_target(spark):
    c = spark.createDataFrame([("m", "A", 0.0, 15.0), ("m", "A", 20.0, 30.0), ("m", "A", 40.0, 49.0), ("m", "A", 50.0, 51.0)], "meeting_id string, speaker string, start double, end double")
    assert [(r.start, r["rank"]) for r in I.select_intervals(c).orderBy("rank").collect()] == [(0.0, 1), (20.0, 2)]


def transcript(spark, blocks):
    return spark.createDataFrame([("m", "\n\n".join(["# Transcript", *blocks]))], "meeting_id string, md string")


def test_parse_joins_continuations_and_skips_the_title(spark):
    rows = sequences.parse_segments(transcript(spark, ["note", "**A** [00:01]: one", "more", "**B** [75:02]: two"])).orderBy("seg").collect()
    assert [(r.speaker, r.start_seconds, r.body) for r in rows] == [("A", 1, "one\n\nmore"), ("B", 4502, "two")]


def test_merge_turns_of_neighbours_alone(spark):
    md = transcript(spark, [f"**{s}** [00:0{i}]: {t}" for i, (s, t) in enumerate([("A", "หนึ่ง"), ("A", "สอง"), ("B", "สาม"), ("A", "สี่")])])
    out = [r.raw for r in sequences.merge_turns(sequences.parse_segments(md)).orderBy("block").collect()]
    assert out == ["**A** [00:00]: หนึ่ง สอง", "**B** [00:02]: สาม", "**A** [00:03]: สี่"]


def test_merge_turns_keeps_its_cap_and_ends_at_continuations(spark):
    md = transcript(spark, [f"**A** [00:0{i}]: " + "ก" * 100 for i in range(10)])
    out = [r.raw for r in sequences.merge_turns(sequences.parse_segments(md), 200).collect()]
    assert len(out) > 1 and all(len(r) / 1.1 <= 200 and r.startswith("**A**") for r in out)
    md = transcript(spark, ["**A** [00:00]: a", "b", "**A** [00:01]: c", "**A** [00:02]: d"])
    assert [r.raw for r in sequences.merge_turns(sequences.parse_segments(md)).orderBy("block").collect()] == ["**A** [00:00]: a\n\nb", "**A** [00:01]: c d"]


def brute_chunks(sizes, most, overlap):
    out, cur = [], []
    for i, n in enumerate(sizes):
        if cur and sum(sizes[j] for j in cur) + n > most:
            out.append(cur)
            tail = []
            for j in reversed(cur[1:]):
                if sum(sizes[k] for k in tail) + sizes[j] > overlap:
                    break
                tail.insert(0, j)
            cur = tail
        cur = [*cur, i]
    return [*out, cur] if cur else out


@pytest.mark.parametrize("seed", range(4))
def test_chunks_against_a_list_version(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 20, 40, 130]) for _ in range(60)]
    segs = spark.createDataFrame([("m", i, "x" * int(n * 1.1), i) for i, n in enumerate(sizes)], "meeting_id string, seg int, raw string, start_seconds int")
    got = {r.chunk: r.segs for r in sequences.split_into_chunks(segs, 100, 30).collect()}
    tokens = [math.ceil(int(n * 1.1) / 1.1) for n in sizes]
    assert [got[k] for k in sorted(got)] == brute_chunks(tokens, 100, 30)
    with pytest.raises(ValueError):
        sequences.split_into_chunks(segs, 10, 10)


def test_labels_number_the_unknown_alone(spark):
    m = spark.createDataFrame([("m", i, s) for i, s in enumerate(["b", "a", "b", "c"])], "meeting_id string, seq int, speaker string")
    names = spark.createDataFrame([("m", "a", "Ann"), ("m", "c", "")], "meeting_id string, speaker string, name string")
    assert {r.speaker: r.label for r in stats.speaker_labels(m, names).collect()} == {"b": "ผู้พูด 1", "a": "Ann", "c": "ผู้พูด 2"}


def test_stats_and_participants(spark):
    rows = [("m", 0, "สมศรี (ศรี)", "aaaa", 0), ("m", 1, " สมศรี (ศรี)", "bb", 60), ("m", 2, "ผู้พูด 1", "c", 120), ("m", 3, "ผู้พูด 2", "ddd", 480)]
    b = spark.createDataFrame(rows, "meeting_id string, seg int, speaker string, body string, start_seconds int")
    s = {r.speaker: r for r in stats.speaker_stats(b).collect()}
    assert (s["สมศรี (ศรี)"].lines, s["สมศรี (ศรี)"].turns, s["สมศรี (ศรี)"].chars, s["สมศรี (ศรี)"].identified) == (2, 1, 6, True)
    assert not s["ผู้พูด 1"].identified and s["สมศรี (ศรี)"].share == 0.6
    line = stats.participants_line(stats.speaker_stats(b)).first().line
    assert line.startswith("ผู้เข้าร่วม: 3 เสียง (ระบุตัวได้จากลายเสียง 1 คน)") and "ผู้พูด 2 30.0% (พูดครั้งแรก 08:00)" in line


@pytest.mark.parametrize("kind", ["long", "double", "decimal(12,3)"])
def test_merge_equals_brute_force_and_takes_no_row_a_pair(spark, kind):
    rng = random.Random(4)
    a, b = ([(m, i, t := rng.randrange(200), t + rng.randrange(0, 60)) for m in "xy" for i in range(150)] for _ in range(2))
    times = [F.col(c).cast(kind).alias(c) for c in ("start", "end")]
    s = spark.createDataFrame(a, "meeting_id string, seq long, start long, end long").select("meeting_id", "seq", *times, F.lit(" t ").alias("text"))
    t = spark.createDataFrame(b, "meeting_id string, turn_idx long, start long, end long").select("meeting_id", "turn_idx", *times, F.col("turn_idx").cast("string").alias("speaker"))
    want = {}
    for m, i, x, y in a:
        best = max((min(y, q) - max(x, p), -n) for k, n, p, q in b if k == m and q > p)
        want[m, i] = str(-best[1]) if y > x and best[0] > 0 else "SPEAKER_UNKNOWN"
    for width in (1, 7, 60):  # groups of 16 widths
        assert {(r.meeting_id, r.seq): r.speaker for r in I.merge_segments_turns(s, t, width).collect()} == want
    # all pairs overlap: two hundred million of them
    s = spark.range(20_000).select(F.lit("m").alias("meeting_id"), F.col("id").alias("seq"), F.lit(0).alias("start"), (F.col("id") % 50 + 1).alias("end"), F.lit("").alias("text"))
    t = spark.range(10_000).select(F.lit("m").alias("meeting_id"), F.col("id").alias("turn_idx"), F.lit(0).alias("start"), (F.col("id") % 50 + 1).alias("end"), F.col("id").cast("string").alias("speaker"))
    merged = I.merge_segments_turns(s, t)
    assert {(r.end, r.speaker) for r in merged.collect()} == {(n + 1, str(n)) for n in range(50)}
    joined = str(merged._jdf.queryExecution().optimizedPlan())
    assert joined.count("Join ") == 1 and "Join LeftOuter" in joined  # segments meet turns in groups, not as rows


def test_a_large_registry_meets_probes_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(voices, "REGISTRY_BYTES", 0)
    v = spark.range(40).select(F.col("id").alias("label"), F.col("id").alias("ord"), F.lit("i").alias("speaker_id"), F.lit("n").alias("name"), F.lit("m").alias("embedding_model"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    found = voices.match_known(v.select("label", "embedding", "embedding_model"), v.drop("label"), 0.7, 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and found.where("score > 0.999999").count() == 40


def test_percentages_are_rounded_by_their_exact_value(spark):
    shares = sorted({a / b for b in (1, 3, 7, 16, 80, 160, 400, 1000, 1999, 2000) for a in range(b + 1)} | {1e-12, 0.8125, 0.0005, 1 - 1e-16})
    df = spark.createDataFrame([(s,) for s in shares], "share double")
    assert [r.p for r in df.select(stats._percent(F.col("share")).alias("p")).collect()] == [f"{s * 100:.1f}%" for s in shares]


@pytest.mark.parametrize("bytes_held", [voices.REGISTRY_BYTES, 0])
def test_match_known_ties_thresholds_and_stamps(spark, monkeypatch, bytes_held):
    monkeypatch.setattr(voices, "REGISTRY_BYTES", bytes_held)
    s = spark.createDataFrame([("i1", "one", 1, [1.0, 0.0], " m "), ("i2", "two", 2, [1.0, 0.0], "m"), ("i3", "three", 3, [0.0, 1.0], None), ("i4", "four", 4, [0.0, 0.0], "m")], "speaker_id string, name string, ord long, embedding array<double>, embedding_model string")
    p = spark.createDataFrame([("a", [2.0, 0.0], "m"), ("b", [0.6, 0.8], "m"), ("c", [0.0, 1.0], "m"), ("d", [1.0, 0.0], "other"), ("e", None, "m"), ("f", [float("nan"), 1.0], "m")], "label string, embedding array<double>, embedding_model string")
    got = {r.label: (r.name, round(r.score, 6), r.confident) for r in voices.match_known(p, s, 0.7, 0.5).collect()}
    assert got == {"a": ("one", 1.0, True), "b": ("one", 0.6, False)}
    assert voices.match_known(p, s.limit(0), 0.7, 0.5).count() == 0


def test_average_directions(spark):
    v = spark.createDataFrame([("a", 0, [3.0, 0.0]), ("a", 1, [0.0, 5.0]), ("a", 2, [1.0, 1.0, 1.0]), ("b", 0, [1.0, 0.0]), ("b", 1, [-2.0, 0.0]), ("c", 0, [1.0]), ("c", 1, [0.0, 1.0])], "name string, ord long, embedding array<double>")
    got = {r.name: [round(x, 6) for x in r.embedding] for r in voices.average_unit_vectors(v, ["name"]).collect()}
    assert got == {"a": [0.707107, 0.707107], "c": [1.0]}


def test_score_pairs_leave_out_one_person_in_one_file(spark):
    p = spark.createDataFrame([("f1", "A", [1.0, 0.0]), ("f2", "A", [1.0, 0.0]), ("f2", "B", [0.0, 1.0]), ("f3", "C", [1.0, 0.0])], "file string, label string, embedding array<double>")
    t = spark.createDataFrame([("f1", "A", "ann"), ("f2", "*", "ann"), ("f3", "D", "bob")], "file string, label string, person string")
    rows = voices.score_pairs(voices.resolve_truth(p, t)).collect()
    assert sorted((r.left_label, r.right_label, r.same, r.score) for r in rows) == [("A", "A", True, 1.0), ("A", "B", True, 0.0)]


def test_thresholds(spark):
    def of(same, different):
        rows = [(True, x) for x in same] + [(False, x) for x in different]
        return voices.suggest_thresholds(spark.createDataFrame(rows, "same boolean, score double")).first()

    r = of([0.75, 0.80], [0.43, 0.63])
    assert not r.overlap and 0.63 < r.high <= 0.75 and 0.43 < r.low <= r.high
    assert of([0.55, 0.80], [0.40, 0.62]).overlap and of([], []).overlap and of([0.5], [0.5]).high is None


def test_registry_changes(spark):
    cols = "id string, name string, ord long, embedding array<double>, embedding_model string, source string, added string"
    reg = spark.createDataFrame([("i1", "Ann", n, [1.0], "m", "s", "d") for n in range(10)] + [("i2", "Bob", 0, [1.0], "m", "s", "d")], cols)
    new = spark.createDataFrame([(" *Ann* ", 3, [2.0], " m ", "s", "d"), ("Cid", 0, [1.0], "m", "s", "d"), ("[]", 0, [1.0], "m", "s", "d"), ("Dan", 0, [1.0], " ", "s", "d"), ("Eve", 0, [0.0], "m", "s", "d")], cols.split(", ", 1)[1])
    got = {r.name: (r.id, r.sample_count) for r in voices.registry_summary(voices.add_samples(reg, new)).collect()}
    assert got["Ann"] == ("i1", 10) and got["Bob"] == ("i2", 1) and got["Cid"][1] == 1 and set(got) == {"Ann", "Bob", "Cid"}
    assert {r.name for r in voices.rename_speaker(reg, "i2", "Rob").collect()} == {"Ann", "Rob"}
    for name, message in (("Ann", "taken"), (" [] ", "empty")):
        with pytest.raises(ValueError, match=message):
            voices.rename_speaker(reg, "i2", name)
    assert voices.remove_speaker(reg, "i1").count() == 1


def lines(spark, text):
    return spark.createDataFrame([("g", i, v) for i, v in enumerate(text.split("\n"), 1)], "file string, line int, value string")


GLOSSARY = """# head
## exact
PostgreSQL: โพสเกรส, พอสเกรส  # db
C#: ซีชาร์ป
PostgreSQL: โพสเกรส, postgre
broken line
bad*: x
## fuzzy
entropy: ent
## aliases
DB: PostgreSQL
## ambiguous
close | dev = merge | ops = shut
bad | dev
"""


def test_glossary_parsing(spark):
    g = D.parse_glossary(lines(spark, GLOSSARY))
    rows = [(r.section, r.correct, r.wrong) for r in g.orderBy("section", "correct_ord", "wrong_ord").collect()]
    assert rows == [("aliases", "DB", "PostgreSQL"), ("exact", "PostgreSQL", "โพสเกรส"), ("exact", "PostgreSQL", "พอสเกรส"), ("exact", "PostgreSQL", "postgre"), ("exact", "C#", "ซีชาร์ป"), ("fuzzy", "entropy", "ent")]
    assert [(r.term, r.lines) for r in D.duplicate_keys(lines(spark, GLOSSARY)).collect()] == [("PostgreSQL", [3, 5])]
    assert [(r.term, r.meanings) for r in D.parse_ambiguous(lines(spark, GLOSSARY)).collect()] == [("close", {"dev": "merge", "ops": "shut"})]
    teams = D.parse_teams(lines(spark, "a: x, y\n# c\nb: z\na: w")).collect()
    assert {r.team: r.names for r in teams} == {"a": ["w"], "b": ["z"]}


def test_rewriting_counts_and_protects_headers(spark):
    g = D.parse_glossary(lines(spark, "## exact\nPostgreSQL: โพสเกรส, พอสเกรส\nLong: abc\nShort: ab\n$1\\: x+"))
    docs = spark.createDataFrame([(1, "ใช้ โพสเกรส และ พอสเกรส"), (2, "**ab** [00:01]: ab abc x+"), (3, None), (4, "")], "doc_id int, text string")
    fixed, counts = D.apply_exact(docs, g, "doc_id")
    assert {r.doc_id: r.text for r in fixed.collect()} == {1: "ใช้ PostgreSQL และ PostgreSQL", 2: "**ab** [00:01]: Short Long $1\\", 3: None, 4: ""}
    assert {(r.doc_id, r.term): r.n for r in counts.collect()} == {(1, "PostgreSQL"): 2, (2, "Short"): 1, (2, "Long"): 1, (2, "$1\\"): 1}
    empty = g.limit(0)
    assert D.apply_exact(docs, empty, "doc_id")[0].count() == 4 and D.count_only(docs, empty, "doc_id").count() == 0


def test_hotwords_stop_at_the_first_overflow(spark):
    d = spark.createDataFrame([("exact", "zz", 3, "a", 1), ("fuzzy", "abcd", 1, "b", 1), ("fuzzy", "efghijkl", 2, "c", 1)], "section string, correct string, correct_ord int, wrong string, wrong_ord int")
    assert D.hotwords_text(d, 8).first().hotwords == "abcd"


def test_collisions(spark):
    d = spark.createDataFrame([("exact", "Kubernetes", 1, "net", 1), ("exact", "Network", 2, "network", 1), ("aliases", "Same", 3, "Same", 1)], "section string, correct string, correct_ord int, wrong string, wrong_ord int")
    assert {(r.kind, r.wrong, r.other) for r in D.find_collisions(d).collect()} == {("inside_correct", "net", "Kubernetes"), ("inside_wrong", "net", "network"), ("short", "net", None), ("self", "Same", None)}


def test_log_tail_limits_before_it_drops_broken_lines(spark):
    rows = [(i, v) for i, v in enumerate(['{"job":"a"}', "broken", "[1]", '{"job":"b"}', ""])]
    got = E.tail(spark.createDataFrame(rows, "ord long, value string"), 4)
    assert [r.ord for r in got.collect()] == [3]


def test_last_code_decides(spark):
    ev = spark.createDataFrame([(1, "a", "queued"), (2, "a", "speakers_matched"), (3, "b", "queued"), (4, "b", "job_failed"), (5, "b", "diarize_failed"), (6, "c", "other")], "ord long, job string, code string")
    assert {r.job: r.busy for r in E.gpu_jobs(ev).collect()} == {"a": True, "b": False}
    assert not E.gpu_is_busy(ev, False).first().busy and not E.gpu_is_busy(ev.limit(0)).first().busy
    assert {r.job: (r.stage, r.failed) for r in E.job_stages(ev).collect()} == {"a": (1, False), "b": (1, True), "c": (0, False)}


def test_messages_fall_back(spark):
    m = spark.createDataFrame([("th", "a", "ก {x}"), ("en", "a", "A {x} {y}")], "lang string, code string, template string")
    ev = spark.createDataFrame([(1, "a", {"x": "1"}), (2, "b", None)], "ord int, code string, params map<string,string>")
    assert {r.ord: r.text for r in E.render_messages(ev, m, "en").collect()} == {1: "A {x} {y}", 2: "b"}
    assert {r.ord: r.text for r in E.render_messages(ev, m, "th").collect()} == {1: "ก 1", 2: "b"}


def test_carry_over_does_not_look_further_back(spark):
    def md(items, profile):
        return f"## Open\n{items}\n## Next\n- no\nประเภทประชุม: {profile}"

    rows = [("07-20", md("- old", "dev"), None), ("07-27", md("- new", "dev"), None), ("07-28", md("text", "cross"), None), ("07-26", md("- x", "cross"), None), ("07-29", md("- y", "dev"), "no profile")]
    m = spark.createDataFrame(rows, "meeting_dir string, summary_md string, meta_md string")
    assert {r.profile: (r.meeting_dir, r["items"]) for r in M.previous_open_items(m, "## Open").collect()} == {"dev": ("07-27", "- new"), "cross": ("07-28", "")}
    assert {r.profile: r["items"] for r in M.previous_open_items(m, "## Open", "07-27").collect()}["dev"] == "- old"


def test_recording_days(spark):
    d = F.to_timestamp(F.lit("2026-08-01 00:20:00"))
    assert str(one(spark, X.recording_day(F.lit("Meet-23-50-10"), d))) == "2026-07-31"
    assert str(one(spark, X.recording_day(F.lit("Meet-00-10-10"), d))) == "2026-08-01"
    assert one(spark, X.folder_name(F.lit("2026-07-31_09-05-00"), d.cast("date"))) == "2026-07-31_09-05"
    assert one(spark, X.folder_name(F.lit("a-b-09-05-00"), d.cast("date"))) == "2026-08-01_09-05-a-b"
    assert one(spark, X.folder_name(F.lit("memo"), d.cast("date"))) == "2026-08-01_memo"


def test_scalars(spark):
    assert one(spark, X.clean_name(F.lit("  a\n\t*b*[c]` "))) == "a bc"
    assert one(spark, X.strip_comment(F.lit("C# x # note"))) == "C# x"
    assert one(spark, X.rename_label(F.lit("**a.b** [0: **a.b** [\n**axb** ["), F.lit("a.b"), F.lit("$1"))) == "**$1** [0: **a.b** [\n**axb** ["
    assert one(spark, X.fill_template(F.lit("{a} {b}"), F.create_map(F.lit("a"), F.lit("1")))) == "{a} {b}"
    assert [one(spark, X.is_safe_name(F.lit(n))) for n in ("a.wav", "..", "", "a/b", "a\\b")] == [True, False, False, False, False]
    assert one(spark, X.read_command(F.lit('["a", 1]'))) == [] and one(spark, X.read_command(F.lit('["a"]'))) == ["a"]
    assert one(spark, X.demote_headings(F.lit("# a\n##### b\n#c"))) == "#### a\n##### b\n#c"
    assert one(spark, X.peak_dbfs(F.lit(0.0))) == float("-inf") and one(spark, X.format_db(X.peak_dbfs(F.lit(0.1)))) == "-20.0 dBFS"
    assert one(spark, X.stem(F.lit("a\\b/c.d.wav"))) == "c.d" and one(spark, X.job_path(F.lit("in/c.d.wav"))) == "in/c.d.job.json"


def test_typed_leaves(spark):
    v = lambda t: F.parse_json(F.lit(t))
    assert one(spark, Y.as_str(v("1"))) is None and one(spark, Y.as_str(v('"1"'))) == "1"
    assert one(spark, Y.as_number(v("true"))) is None and one(spark, Y.as_number(v("1.5"))) == 1.5
    assert one(spark, Y.as_bool(v("true"))) is True and one(spark, Y.render_param(v("[1]"))) is None
    assert one(spark, Y.is_numeric_vector(v("[1, 2.5]"))) and not one(spark, Y.is_numeric_vector(v("[1, true]"))) and not one(spark, Y.is_numeric_vector(v("[]")))
    assert one(spark, Y.drop_numeric_vectors(F.lit('{"a": [1, 2], "b": [{"c": [0.5]}, "x"]}'))) == '{"b": [{}, "x"]}'
    assert one(spark, Y.first_json_object(F.lit('x {y} {"a": {"b": 1}} {"c": 2}'))) == '{"a": {"b": 1}}'
    s = one(spark, Y.public_speaker(v('{"label": "L", "embedding": [1], "guess": {"name": 3}, "samples": [{"text": "t", "start": 1, "x": 2}, 5], "speaking_seconds": true}')))
    assert (s.label, s.guess.name, s.samples[0].text, len(s.samples), s.suggested, s.speaking_seconds) == ("L", None, "t", 1, None, None)


def test_pending_queue(spark):
    rows = [("m", 0, 0.0, 20.0, "S00", "long line of text"), ("m", 1, 20.0, 45.0, "S01", "b"), ("m", 2, 45.0, 47.0, "S01", "cc"), ("m", 3, 50.0, 55.0, "S02", "short")]
    merged = spark.createDataFrame(rows, "meeting_id string, seq int, start double, end double, speaker string, text string")
    prints = spark.createDataFrame([("m", s, [1.0], 5.0, 2, "e") for s in ("S00", "S01", "S02")], "meeting_id string, speaker string, embedding array<double>, seconds double, segment_count int, embedding_model string")
    none = spark.createDataFrame([], "meeting_id string, speaker string, speaker_id string, name string, score double, confident boolean")
    got = {r.label: r.speaking_seconds for r in queues.pending_speakers(merged, stats.speaker_labels(merged), prints, none).collect()}
    assert got == {"ผู้พูด 1": 20.0, "ผู้พูด 2": 27.0}


def test_clip_classes(spark):
    t = spark.createDataFrame([("ok", 0, 0.0, 12.0, "A"), ("two", 0, 0.0, 12.0, "A"), ("two", 1, 20.0, 32.0, "B"), ("short", 0, 0.0, 5.0, "A"), ("none", 0, 0.0, 12.0, "A"), ("none", 1, 0.0, 12.0, "B"), ("clean", 0, 0.0, 12.0, "A"), ("clean", 1, 0.0, 9.0, "B")], TURN)
    got = {r.meeting_id: (r.status, r.reason) for r in queues.classify_clips(t).collect()}
    assert got == {"ok": ("ok", None), "two": ("rejected", "multiple_speakers"), "short": ("rejected", "too_short"), "none": ("rejected", "unusable_embedding"), "clean": ("rejected", "too_short")}


def test_models_keep_errors_as_values(spark):
    def factory():
        def model(prompt, most):
            if prompt == "bad":
                raise RuntimeError("no")
            return ("cut" * most)[:most], most < 8

        return model

    p = spark.createDataFrame([(1, "bad"), (2, "x")], "chunk int, prompt string").withColumn("meeting_id", F.lit("m"))
    quick = lambda: models.retrying(factory(), 1)
    rows = {r.chunk: (r.value, r.error) for r in models.complete(p, quick, 2).collect()}
    assert rows[1] == (None, "no") and rows[2] == ("cutc\n\n[truncated]", None)
    assert models.reduce_input(models.complete(p, quick, 2)).first().text == "cutc"
    calls = []
    with pytest.raises(ValueError):
        models.retrying(lambda: calls.append(1) or (_ for _ in ()).throw(ValueError()), 3, 1.0, sleep=calls.append)()
    assert calls == [1, 1.0, 1, 2.0, 1]


def test_guesses(spark):
    a = spark.createDataFrame([("m", 'sure: {"L1": {"name": " Ann ", "evidence": 3}, "L2": {"name": ""}, "L9": {"name": "X"}}'), ("n", "none")], "meeting_id string, answer string")
    labels = spark.createDataFrame([("m", "L1"), ("m", "L2")], "meeting_id string, label string")
    assert [(r.label, r.name, r.evidence) for r in models.guess_names(a, labels).collect()] == [("L1", "Ann", "")]
