"""Keyed streams across restarts, tables replaced in one step, stable files and waveforms."""

import json
import math
import os
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframe.operators import events
from speechframe.sources import commits, inbox, sinks, waveform
from speechframe.streaming import state, streams


def put(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{number}.json", "w", encoding="utf-8") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(f"{folder}/.{number}.json", f"{folder}/{number:03d}.json")


def drained(frame, out, checkpoint, mode="append"):
    query = frame.writeStream.format("parquet").option("path", out).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_a_marker_is_seen_once_across_a_restart_and_a_late_duplicate(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def go(number, rows):
        put(src, number, [{"id": i, "key": k, "ts": f"2026-01-01T{t}Z"} for i, k, t in rows])
        markers = spark.readStream.schema("id int, key string, ts timestamp").json(src)
        drained(state.once_only(markers, "key", 600), out, ck)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert go(1, [(2, "a", "00:00:10"), (1, "a", "00:00:00"), (3, None, "00:00:05")]) == [1, 3]
    assert go(2, [(4, "a", "00:09:00"), (5, "b", "00:01:00"), (6, None, "00:02:00")]) == [1, 3, 5]  # restarted from the checkpoint
    assert go(3, [(7, "c", "00:30:00")]) == [1, 3, 5, 7]  # the watermark passes 00:20: a and b are forgotten
    assert go(4, [(8, "a", "00:00:30"), (9, "a", "00:31:00")]) == [1, 3, 5, 7, 9]  # the late duplicate is dropped, a new marker is not
    assert go(5, [(10, "a", "00:31:30"), (11, "c", "00:32:00")]) == [1, 3, 5, 7, 9]


def test_live_state_equals_the_batch_query_at_every_step(spark, tmp_path):
    rng = random.Random(3)
    codes = ["queued", "transcribe_started", "diarize_started", "summarize_started", "meeting_done", "job_failed", "encode_started", "note"]
    rows = [{"job": None if i % 17 == 0 else f"j{rng.randint(0, 6)}", "code": rng.choice(codes), "ord": i, "ts": f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}", "session": f"s{rng.randint(0, 3)}", "status": rng.choice(["idle", "recording", "encoding"])} for i in range(120)]
    rng.shuffle(rows)
    src, schema = str(tmp_path / "in"), "job string, code string, ord long, ts timestamp, session string, status string"
    for step in range(3):
        put(src, step, rows[step * 40 : step * 40 + 40])
        stream, batch = spark.readStream.schema(schema).json(src), spark.read.schema(schema).json(src)
        for name, live in (("jobs", state.live_jobs(stream)), ("recorders", state.live_recorders(stream.select("session", "ts", "status", "ord")))):
            live.writeStream.foreachBatch(lambda batch, number, name=name: batch.write.mode("append").parquet(str(tmp_path / f"changed-{name}"))).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        now = {r.job: (r.code, r.busy, r.stage, r.failed) for r in state.jobs_now(spark, str(tmp_path / "jobs")).collect()}
        gpu = {r.job: (r.code, r.busy) for r in events.gpu_jobs(batch).collect()}
        want = {r.job: (*gpu.get(r.job, (None, False)), r.stage, r.failed) for r in events.job_stages(batch).collect()}
        assert now == want
        recorders = {tuple(r) for r in state.recorders_now(spark, str(tmp_path / "recorders")).collect()}
        assert recorders == {tuple(r) for r in events.recorder_state(batch).collect()}


def test_jobs_are_forgotten_after_their_last_event(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")

    def go(number, rows):
        put(src, number, [{"job": j, "code": "queued", "ord": number, "ts": f"2026-01-01T{t}"} for j, t in rows])
        live = state.live_jobs(spark.readStream.schema("job string, code string, ord long, ts timestamp").json(src), 600)
        live.writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(str(tmp_path / "changed"))).outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.job for r in state.jobs_now(spark, ck).collect())

    assert go(1, [("a", "00:00:00"), ("b", "00:00:00")]) == ["a", "b"]
    assert go(2, [("a", "00:15:00")]) == ["a", "b"]
    assert go(3, [("c", "00:21:00")]) == ["a", "c"]  # the watermark is at 00:11, past b's last event and ten minutes


def test_a_table_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        commits.read_table(spark, path)
    assert commits.write_table(spark.range(3).toDF("x"), path) == 1
    assert commits.write_table(commits.read_table(spark, path).where("x > 0"), path) == 2
    assert sorted(r.x for r in commits.read_table(spark, path).collect()) == [1, 2]
    assert commits.read_table(spark, path, 1).count() == 3


def test_two_writers_from_one_version_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.write_table(spark.range(1).toDF("x"), path)
    seen = commits.version_of(spark, path)
    assert commits.write_table(spark.range(2).toDF("x"), path, seen) == 2
    with pytest.raises(commits.Conflict):
        commits.write_table(spark.range(9).toDF("x"), path, seen)
    assert commits.read_table(spark, path).count() == 2
    asked = []

    def change(df):
        if not asked:  # another writer is faster the first time
            commits.write_table(spark.range(5).toDF("x"), path)
        asked.append(1)
        return df.unionByName(spark.range(100, 101).toDF("x"))

    assert commits.update_table(spark, path, change) == 4 and len(asked) == 2
    assert commits.read_table(spark, path).count() == 6


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.write_table(spark.range(3).toDF("x"), path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # after the data, before the commit
        m.setattr(commits, "version_of", killed)
        with pytest.raises(KeyboardInterrupt):
            commits.write_table(spark.range(9).toDF("x"), path)
    assert commits.read_table(spark, path).count() == 3 and commits.version_of(spark, path) == 1
    (tmp_path / "t" / "data-half").mkdir()  # killed while it wrote data
    assert commits.write_table(spark.range(4).toDF("x"), path) == 2
    assert commits.write_table(spark.range(5).toDF("x"), path) == 3
    assert len(commits.vacuum(spark, path, keep=2)) == 1  # version 1; what may still be written stays
    assert len(commits.vacuum(spark, path, keep=1, idle_seconds=0)) == 3
    assert commits.read_table(spark, path).count() == 5
    assert [n for n in os.listdir(path) if n.startswith("data-")] == [json.loads((tmp_path / "t" / "_commits" / "000000000003.json").read_text())["data"]]


def test_files_are_admitted_when_stable_and_once(spark, tmp_path):
    box, out, ck = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "ck")
    box.mkdir()

    def go(**how):
        drained(inbox.stable_files_stream(spark, str(box), str(tmp_path / "state"), settle=0.2, **how), out, ck)
        return sorted(r.name for r in spark.read.parquet(out).collect()) if os.path.exists(out) else []

    for name, text in (("a.WAV", "x"), ("b.ogg", "xy"), ("c.txt", "x"), ("empty.mp3", ""), (".hid.wav", "x")):
        (box / name).write_text(text)
    assert go() == ["a.WAV", "b.ogg"]
    assert go() == ["a.WAV", "b.ogg"]  # nothing new, after a restart
    for i in range(5):
        (box / f"n{i}.wav").write_text("x" * (i + 1))
    assert set(go(max_files=2)) >= {"a.WAV", "b.ogg"}
    while len(got := go(max_files=2)) < 7:
        pass
    assert got == ["a.WAV", "b.ogg", "n0.wav", "n1.wav", "n2.wav", "n3.wav", "n4.wav"]
    (box / "b.ogg").unlink()  # archived, then recorded again under its name
    (box / "m.wav").write_text("x")
    assert go().count("b.ogg") == 1
    (box / "b.ogg").write_text("new")
    assert go().count("b.ogg") == 2


def test_a_growing_file_waits(tmp_path, monkeypatch):
    (tmp_path / "g.wav").write_text("x")
    (tmp_path / "s.wav").write_text("x")
    reader = inbox.StableFilesReader({"path": str(tmp_path), "state": str(tmp_path / "state"), "settle": "0"})
    monkeypatch.setattr(inbox.time, "sleep", lambda _: (tmp_path / "g.wav").write_text("xx" + (tmp_path / "g.wav").read_text()))
    assert reader.latestOffset() == {"n": 1} and [f[0].rpartition("/")[2] for p in reader.partitions({"n": 0}, {"n": 1}) for f in p.files] == ["s.wav"]
    monkeypatch.setattr(inbox.time, "sleep", lambda _: None)
    again = inbox.StableFilesReader({"path": str(tmp_path), "state": str(tmp_path / "state"), "settle": "0"})  # a restart
    assert again.latestOffset() == {"n": 2} == again.latestOffset()
    again.commit({"n": 2})
    assert again._numbers() == [2]


def write_wav(path, rate=16000, channels=1, width=2, frames=8000):
    rng = np.random.default_rng(frames)
    data = rng.integers(0, 256, frames * channels * width, dtype=np.uint8).tobytes()
    with wave.open(str(path), "wb") as out:
        out.setparams((channels, width, rate, frames, "NONE", ""))
        out.writeframes(data)
    return data


def plain(data, channels, width):
    """Samples by the letter of the format, a list a channel."""
    full = 1 << (8 * width - 1)
    flat = [(b - 128) / 128 for b in data] if width == 1 else [int.from_bytes(data[i : i + width], "little", signed=True) / full for i in range(0, len(data), width)]
    return [flat[c::channels] for c in range(channels)]


def joined(rows):
    rows = sorted(rows, key=lambda r: r.frame)
    at = 0
    for r in rows:
        assert r.frame == at and all(len(c) == len(r.waveform[0]) for c in r.waveform)
        at += len(r.waveform[0])
    return [[x for r in rows for x in r.waveform[c]] for c in range(rows[0].channels)] if rows else []


@pytest.mark.parametrize(("rate", "channels", "width", "frames"), [(16000, 1, 2, 8000), (8000, 2, 2, 4001), (48000, 3, 3, 777), (44100, 1, 1, 500), (16000, 2, 4, 90), (16000, 1, 2, 0)])
def test_samples_equal_brute_force_in_one_and_in_many_ranges(spark, tmp_path, rate, channels, width, frames):
    data = write_wav(tmp_path / "a.wav", rate, channels, width, frames)
    want = plain(data, channels, width)
    for block, ranged in ((65536, 1 << 26), (100, 501), (7, 333)):
        rows = waveform.load_waveform(spark, str(tmp_path / "a.wav"), block, ranged).collect()
        got = joined(rows)
        assert {(r.sample_rate, r.channels) for r in rows} <= {(rate, channels)}
        assert len(got) == (channels if frames else 0) and all(np.allclose(g, w, atol=1e-7) for g, w in zip(got, want, strict=False))


def test_odd_wav_files(spark, tmp_path):
    (tmp_path / "not.wav").write_bytes(b"fake audio data")
    with pytest.raises(Exception, match="not a WAV"):
        waveform.load_waveform(spark, str(tmp_path / "not.wav")).collect()
    floats = np.linspace(-1, 1, 50, dtype="<f4").tobytes()
    form = struct.pack("<HHIIHHH", 0xFFFE, 1, 8000, 32000, 4, 32, 22) + struct.pack("<HIH", 32, 4, 3) + b"\0" * 14
    chunks = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", 0xFFFFFFFF) + floats + b"\1"
    (tmp_path / "open.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + chunks)  # its recorder died; a part of a frame is left
    assert np.allclose(joined(waveform.load_waveform(spark, str(tmp_path / "open.wav"), 20, 64).collect())[0], np.linspace(-1, 1, 50), atol=1e-6)
    with pytest.raises(Exception, match="none.wav"):
        waveform.load_waveform(spark, str(tmp_path / "none.wav")).count()


def test_peaks_and_rotation_of_a_recording(spark, tmp_path):
    for name, frames in (("a.wav", 5000), ("b.wav", 1200)):
        write_wav(tmp_path / name, 1000, 2, 2, frames)
    blocks = waveform.as_blocks(waveform.load_waveform(spark, str(tmp_path), 500, 1000))
    peaks = {os.path.basename(r.stream): r.peak for r in streams.measure_peaks(blocks.withColumnRenamed("session", "stream")).collect()}
    for name in ("a.wav", "b.wav"):
        with wave.open(str(tmp_path / name)) as f:
            left, right = plain(f.readframes(f.getnframes()), 2, 2)
        assert math.isclose(peaks[name], max(abs(a + b) / 2 for a, b in zip(left, right, strict=True)), abs_tol=1e-6)
    parts = streams.rotate(blocks, 1000, 2).groupBy("session", "part").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in parts) == 6200 and {r.part for r in parts if r.session.endswith("a.wav")} == {1, 2, 3}
