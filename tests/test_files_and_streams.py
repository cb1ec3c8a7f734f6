"""Sources, sinks and streams over temporary folders."""

import json
import os

from pyspark.sql import functions as F

from speechframe.operators import events, models
from speechframe.sources import files, sinks
from speechframe.streaming import streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_listings(spark, tmp_path):
    for name, text in (("a.WAV", "xx"), ("b.txt", "x"), ("c.ogg", "x")):
        put(tmp_path / "in" / name, text)
    assert [r.name for r in files.scan_audio(spark, str(tmp_path / "in")).collect()] == ["a.WAV", "c.ogg"]
    assert files.scan_audio(spark, str(tmp_path / "missing")).count() == 0
    put(tmp_path / "s" / "part0001.wav", "x" * 200)
    put(tmp_path / "s" / "part0002.wav", "x")
    assert [r.name for r in files.audio_parts(spark, str(tmp_path / "s")).collect()] == ["part0001.wav"]


def test_json_sources(spark, tmp_path):
    put(tmp_path / "j" / "a.job.json", '{"claude_model": "m", "profile": 3}')
    put(tmp_path / "j" / "b.job.json", "broken")
    got = {os.path.basename(r.path): (r.claude_model, r.profile) for r in files.read_jobs(spark, str(tmp_path / "j")).collect()}
    assert got == {"a.job.json": ("m", None), "b.job.json": (None, None)}
    put(tmp_path / "r.json", json.dumps({"speakers": [{"id": "i", "name": "n", "samples": [{"embedding": [1, 2.5], "embedding_model": "m"}]}, {"id": 3}]}))
    r = files.load_registry(spark, str(tmp_path / "r.json")).collect()
    assert [(x.id, x.embedding, x.source) for x in r] == [("i", [1.0, 2.5], None)]
    put(tmp_path / "q" / "m.json", json.dumps({"meeting_dir": "m", "speakers": [{"label": "a"}]}))
    put(tmp_path / "q" / "n.json", json.dumps({"meeting_dir": "n", "speakers": []}))
    assert [x.meeting_dir for x in files.load_pending(spark, str(tmp_path / "q")).collect()] == ["m"]
    put(tmp_path / "t.json", json.dumps([{"audio": "a", "truth": {"x": "p"}}, {"audio": "a", "truth": {"x": "q"}}, {"audio": 1}]))
    assert [(x.audio, x.label, x.person) for x in files.load_truth(spark, str(tmp_path / "t.json")).collect()] == [("a", "x", "p")]
    put(tmp_path / "ses" / ".session-a" / "session.json", '{"stem": "a", "samplerate": 48000, "parts": ["p"]}')
    assert [(x.stem, x.parts, x.profile) for x in files.read_manifests(spark, str(tmp_path / "ses")).collect()] == [("a", ["p"], None)]
    assert files.read_manifests(spark, str(tmp_path / "none")).count() == 0
    put(tmp_path / "g.md", "a\r\nb\n")
    assert [(x.line, x.value) for x in files.read_lines(spark, str(tmp_path / "g.md")).collect()] == [(1, "a"), (2, "b"), (3, "")]


def test_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.append_events(spark.createDataFrame([("a", None)], "job string, code string"), log)
    sinks.append_events(spark.createDataFrame([("b", "c")], "job string, code string"), log)
    assert sorted(r.value for r in files.read_log(spark, log).collect()) == ['{"job":"a"}', '{"job":"b","code":"c"}']
    put(tmp_path / "one.jsonl", "\n".join(f'{{"job":"{i}"}}' for i in range(50)) + "\n\n")
    last = events.tail(files.read_log(spark, str(tmp_path / "one.jsonl")), 2).orderBy("ord").select(F.to_json("entry")).collect()
    assert [r[0] for r in last] == ['{"job":"48"}', '{"job":"49"}']
    sinks.trim_log(files.read_log(spark, log), log, 1)
    assert [r.value for r in spark.read.text(log).collect()] == ['{"job":"b","code":"c"}']
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3).toDF("x"), path)
    sinks.replace_table(spark.read.parquet(path).where("x > 0"), path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2] and {"log", "t"} <= set(os.listdir(tmp_path)) and not [n for n in os.listdir(tmp_path) if "-old-" in n or "-new-" in n]
    jobs = spark.createDataFrame([("p", None, "", "x", None), ("q", 'a"b', None, None, None)], "path string, claude_model string, profile string, asr_engine string, transcript_path string")
    values = {r.path: json.loads(r.value) for r in sinks.job_json(jobs).collect()}
    assert values == {"p": {"claude_model": None, "asr_engine": "x"}, "q": {"claude_model": 'a"b'}}
    assert sinks.move(spark, path, path + "2") and not sinks.move(spark, path, path + "3") and sinks.delete(spark, path + "2")


def test_turn_cache(spark, tmp_path):
    rec = spark.createDataFrame([("a.wav", 5)], "name string, length long").withColumn("modified", F.lit("2026-01-01").cast("timestamp"))
    turns = spark.createDataFrame([("a.wav", 0.0, 1.0, "S")], "name string, start double, end double, speaker string")
    sinks.cache_turns(turns, rec, "m1", str(tmp_path / "c"))
    assert files.cached_turns(spark, str(tmp_path / "c"), rec, "m1").count() == 1
    assert files.cached_turns(spark, str(tmp_path / "c"), rec, "m2").count() == 0
    assert files.cached_turns(spark, str(tmp_path / "none"), rec, "m1").count() == 0


def test_watch_goes_on_after_a_failed_batch(spark, tmp_path):
    src = tmp_path / "src"
    put(src / "1.json", '{"ts":"2026-01-01T00:00:00","job":"a","code":"queued","level":"info","ord":1}')
    seen = []

    def process(batch, number):
        rows = batch.collect()
        seen.append(len(rows))
        if any(r.job == "bad" for r in rows):
            raise ValueError("poison")

    args = (process, str(tmp_path / "dead"), str(tmp_path / "cp"))
    streams.watch(streams.activity(spark, str(src)), *args, once=True).awaitTermination(120)
    put(src / "2.json", '{"ts":"2026-01-01T00:00:01","job":"bad","code":"queued","level":"info","ord":2}')
    streams.watch(streams.activity(spark, str(src)), *args, once=True).awaitTermination(120)
    assert seen == [1, 1] and spark.read.parquet(str(tmp_path / "dead")).first().error == "poison"


def test_live_queries(spark, tmp_path):
    src = tmp_path / "src"
    rows = [("a", "queued"), ("a", "meeting_done"), ("b", "queued")]
    put(src / "1.json", "\n".join(json.dumps({"ts": f"2026-01-01T00:00:0{i}", "job": j, "code": c, "level": "info", "ord": i}) for i, (j, c) in enumerate(rows)))
    live = streams.activity(spark, str(src))
    q = streams.live_gpu_jobs(live).writeStream.outputMode("complete").format("memory").queryName("jobs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.job: r.busy for r in spark.table("jobs").collect()} == {"a": False, "b": True}
    polls = live.select(F.lit("mic").alias("stream"), "ts", F.col("code").alias("name"))
    q = streams.live_device_changes(polls).writeStream.outputMode("append").format("memory").queryName("devices").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.old, r.new) for r in spark.table("devices").orderBy("ts").collect()] == [("queued", "meeting_done"), ("meeting_done", "queued")]


def test_blocks_are_mixed_with_silence(spark):
    b = "session string, block_no long, ts timestamp, samples array<double>"
    t = F.lit("2026-01-01").cast("timestamp")
    mic = spark.createDataFrame([("s", 0, None, [1.0, 1.0]), ("s", 1, None, [1.0])], b).withColumn("ts", t)
    spk = spark.createDataFrame([("s", 0, None, [0.0, 1.0, 1.0]), ("s", 2, None, [1.0])], b).withColumn("ts", t)
    assert {r.block_no: r.samples for r in streams.zip_blocks(mic, spk).collect()} == {0: [0.5, 1.0, 0.5], 1: [0.5], 2: [0.5]}


def test_transcription_plug_points(spark):
    audio = spark.createDataFrame([("m", "p", 30.0)], "meeting_id string, path string, duration double")
    assert models.transcribe(audio, lambda: lambda path: [(0.0, 1.0, path)]).first().text == "p"
    turns = models.diarize(audio, lambda: lambda path: [(0.0, 5.0, "A"), (6.0, 60.0, "B")])
    got = {r.speaker: (r.seconds, r.segment_count) for r in models.extract_voiceprints(turns, audio, lambda: lambda p, a, b: [b - a, 0.0]).collect()}
    assert got == {"A": (5.0, 1), "B": (24.0, 1)}


def test_services(spark, tmp_path):
    from speechframe.operators import services

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    put(tmp_path / "q" / "m.json", json.dumps({"meeting_dir": "m", "speakers": [{"label": "a", "embedding": [1, 2]}]}))
    row = services.pending_meetings(files.load_pending(spark, str(tmp_path / "q"))).first()
    assert row.meeting_dir == "m" and row.speakers[0].label == "a"
    listing = {"n": 5}

    def current():
        return spark.createDataFrame([("a.wav", listing["n"], 1.0), ("b.wav", 3, 1.0)], "audio_file string, length long, mtime double")

    def analyse(df):
        out = df.select("audio_file", F.lit("ok").alias("status"))
        listing["n"] = 6
        return out

    services.process_requests(analyse, current, str(tmp_path / "res"))(spark.createDataFrame([("a.wav",), ("b.wav",)], "audio_file string"), 0)
    assert [r.audio_file for r in spark.read.parquet(str(tmp_path / "res")).collect()] == ["b.wav"]
    assert [r.audio_file for r in spark.read.parquet(str(tmp_path / "res-changed")).collect()] == ["a.wav"]
    put(tmp_path / "inbox" / ".session-x" / "session.json", "{}")
    side = spark.createDataFrame([("x", "m", None, None, None)], "path string, claude_model string, profile string, asr_engine string, transcript_path string")
    ok = services.finish_session(spark, str(tmp_path / "inbox" / ".session-x"), str(tmp_path / "inbox"), "x", lambda a, b: put(tmp_path / "inbox" / ".session-x" / "x.ogg.part", "sound"), side)
    assert ok and sorted(os.listdir(tmp_path / "inbox")) == ["x.job.json", "x.ogg"]


def test_registry_is_read_back(spark, tmp_path):
    schema = "id string, name string, ord long, embedding array<double>, embedding_model string, source string, added string"
    rows = [("b", "ข\"x", 2, [1.0, 2.0], "m", "s", "2026"), ("b", "ข\"x", 1, [3.0], "m", None, None), ("a", "n", 5, [0.5], "k", "t", "2025")]
    path = str(tmp_path / "registry.json")
    for _ in range(2):  # a file that is there is replaced
        assert sinks.save_files(sinks.registry_file(spark.createDataFrame(rows, schema), path)) == 1
    got = [tuple(r)[:2] + tuple(r)[3:] for r in files.load_registry(spark, path).orderBy("ord").collect()]
    assert got == [tuple(r)[:2] + tuple(r)[3:] for r in sorted(rows, key=lambda r: r[2])]
    assert json.load(open(path, encoding="utf-8"))["version"] == 1 and os.path.isfile(path)
    sinks.save_files(sinks.registry_file(spark.createDataFrame([], schema), path))
    assert files.load_registry(spark, path).count() == 0
    assert [n for n in os.listdir(tmp_path) if "-new-" in n] == []


def test_sidecars_and_queues_are_read_back(spark, tmp_path):
    jobs = spark.createDataFrame([(str(tmp_path / "in" / "a.job.json"), None, "dev", "x", None), (str(tmp_path / "in" / "b.job.json"), 'q"', None, None, "t.md")], "path string, claude_model string, profile string, asr_engine string, transcript_path string")
    assert sinks.save_files(sinks.job_json(jobs)) == 2
    got = {os.path.basename(r.path): tuple(r)[1:] for r in files.read_jobs(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.job.json": (None, "dev", "x", None), "b.job.json": ('q"', None, None, "t.md")}
    pending = spark.createDataFrame([("m1", "dir1", "a.wav", "B", [1.0, 2.0]), ("m1", "dir1", "a.wav", "A", None), ("m2", "dir2", "b.wav", "C", [0.0])], "meeting_id string, meeting_dir string, audio_file string, label string, embedding array<double>")
    assert sinks.save_files(sinks.pending_files(pending, str(tmp_path / "q"))) == 2
    back = files.load_pending(spark, str(tmp_path / "q")).select("meeting_dir", "audio_file", F.transform("speakers", lambda v: F.try_variant_get(v, "$.label", "string")).alias("labels")).collect()
    assert [tuple(r) for r in back] == [("dir1", "a.wav", ["A", "B"]), ("dir2", "b.wav", ["C"])]


def test_a_table_that_was_left_aside_comes_back(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    os.rename(path, path + "-old-1")
    assert sinks.restore_table(spark, path) and spark.read.parquet(path).count() == 3 and not sinks.restore_table(spark, path)


def test_decisions_on_unknown_people_are_refused(spark):
    from speechframe.operators import voices

    registry = spark.createDataFrame([("i1", "Ann", 1, [1.0], "m", "s", "d")], "id string, name string, ord long, embedding array<double>, embedding_model string, source string, added string")
    queue = spark.createDataFrame([("x", label, 9, [2.0], "m", "d") for label in "abcd"], "meeting_dir string, label string, ord long, embedding array<double>, embedding_model string, added string")
    decisions = spark.createDataFrame([("x", "a", "Bob", "nobody"), ("x", "b", " ", None), ("x", "c", "Cid", None), ("x", "d", "other", "i1")], "meeting_dir string, label string, name string, speaker_id string")
    assert sorted((r.name, r.sample_count) for r in voices.registry_summary(voices.confirm_speaker(registry, queue, decisions)).collect()) == [("Ann", 2), ("Cid", 1)]
    assert sorted(tuple(r) for r in voices.refused_decisions(registry, decisions).collect()) == [("x", "a", "unknown_speaker"), ("x", "b", "no_name")]


def test_the_job_asks_once_for_each_chunk_and_keeps_failed_meetings(spark, tmp_path):
    from speechframe.operators.pipeline import process

    rows = [(m, i, 10.0 * i, 10.0 * i + 9, f"{m} says line {i} " * 8) for m, n in (("long", 60), ("short", 2), ("bad", 2)) for i in range(n)]
    segments = spark.createDataFrame(rows, "meeting_id string, seq long, start double, end double, text string")
    turns = spark.createDataFrame([(m, i, a, b, f"S{i % 3}") for m, i, a, b, _ in rows], "meeting_id string, turn_idx long, start double, end double, speaker string")
    glossary = spark.createDataFrame([], "section string, correct string, correct_ord int, wrong string, wrong_ord int")
    calls = str(tmp_path / "calls")
    os.makedirs(calls)

    def factory():
        def model(prompt, most):
            if "bad says" in prompt:
                raise ValueError("no answer")
            with open(f"{calls}/{os.getpid()}-{len(os.listdir(calls))}-{abs(hash(prompt))}", "x"):
                return prompt.split("\n")[0][:50], False

        return model

    out = process(segments, turns, glossary, factory, max_tokens=800, overlap_tokens=50, threshold=1500)
    got = {r.meeting_id: r.summary for r in out.summaries.collect()}
    assert set(got) == {"long", "short"} and [(r.meeting_id, r.error) for r in out.failures.collect()] == [("bad", "no answer")]
    chunks = out.chunks.count()
    assert chunks > 2 and out.chunks.where("meeting_id <> 'long'").count() == 0
    assert len(os.listdir(calls)) == chunks + 1 + 1  # the long one's parts and reduction, the short one's single call
    assert got["long"].count("### ") == chunks and "### " not in got["short"]
