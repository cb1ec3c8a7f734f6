"""Sessions and failed inputs after a kill between any two steps."""

import json
import os

import pytest

from speechframe.operators import recovery as R
from speechframe.sources import files, sinks


def session(inbox, stem, parts=(300, 400), **manifest):
    folder = inbox / f".session-{stem}"
    folder.mkdir(parents=True)
    for i, n in enumerate(parts, 1):
        (folder / f"part{i:04d}.wav").write_bytes(b"x" * n)
    (folder / "session.json").write_text(json.dumps({"stem": stem, "started_at": "t", "samplerate": 16000, "parts": [], "status": "recording", **manifest}))
    return folder


def encode(parts, target):
    with open(target.removeprefix("file:"), "w") as out, open(parts.removeprefix("file:")) as lines:
        out.write(lines.read())


def told(spark, inbox, how=encode):
    return {os.path.basename(r.session): (r.code, r.detail) for r in R.recover(spark, str(inbox), how).collect()}


def test_each_leftover_session_is_finished_or_reported(spark, tmp_path):
    box = tmp_path / "in"
    session(box, "a", claude_model="m", profile="cross")
    session(box, "b")
    session(box, "quiet", parts=(10,))
    (box / ".session-debris").mkdir()
    (box / ".session-debris" / "part0001.wav").write_bytes(b"x" * 4096)

    def flaky(parts, target):
        if "/.session-b/" in parts:
            raise RuntimeError("boom")
        encode(parts, target)

    got = told(spark, box, flaky)
    assert {k: v[0] for k, v in got.items()} == {".session-a": "orphan_recovered", ".session-b": "orphan_failed", ".session-quiet": "orphan_silent", ".session-debris": "orphan_swept"}
    assert "boom" in got[".session-b"][1] and got[".session-a"][1].endswith("/a.ogg")
    assert sorted(os.listdir(box)) == [".session-b", ".session-quiet", "a.job.json", "a.ogg"]
    assert (box / "a.ogg").read_text().count("part000") == 2
    job = files.read_jobs(spark, str(box)).first()
    assert (job.claude_model, job.profile, job.asr_engine) == ("m", "cross", None)
    assert told(spark, box)[".session-b"][0] == "orphan_recovered" and sorted(os.listdir(box)) == [".session-quiet", "a.job.json", "a.ogg", "b.ogg"]
    assert told(spark, tmp_path / "none") == {}


@pytest.mark.parametrize("step", ["save_file 1", "save_file 2", "move 1", "delete 1", "delete 2"])
@pytest.mark.parametrize("after", [False, True])
def test_a_kill_at_any_step_of_finishing(spark, tmp_path, monkeypatch, step, after):
    box = tmp_path / "in"
    session(box, "s", claude_model="m")
    name, at = step.split()
    done, calls, encoded = getattr(sinks, name), [], []

    def killed(*args):
        calls.append(1)
        if len(calls) == int(at):
            if after:
                done(*args)
            raise KeyboardInterrupt
        return done(*args)

    with monkeypatch.context() as m:
        m.setattr(sinks, name, killed)
        with pytest.raises(KeyboardInterrupt):
            R.recover(spark, str(box), lambda a, b: (encoded.append(1), encode(a, b)))
    published = [f for f in os.listdir(box) if f.endswith(".ogg")]
    assert not published or "s.job.json" in os.listdir(box)  # never a recording without its sidecar
    told(spark, box, lambda a, b: (encoded.append(1), encode(a, b)))
    assert sorted(os.listdir(box)) == ["s.job.json", "s.ogg"] and (box / "s.ogg").read_text().count("part000") == 2
    assert len(encoded) == 1 or not published  # what was published is not encoded again


@pytest.mark.parametrize("sidecar", [False, True])
@pytest.mark.parametrize("step", [0, 1, 2, 3])
def test_failed_inputs_move_with_their_error_and_sidecar(spark, tmp_path, monkeypatch, sidecar, step):
    box, failed = tmp_path / "in", tmp_path / "failed"
    box.mkdir()
    (box / "x.mp3").write_text("sound")
    if sidecar:
        (box / "x.job.json").write_text('{"claude_model":"m"}')
    calls = []

    def broken(done):
        def run(*args):
            calls.append(1)
            if len(calls) == step:
                raise KeyboardInterrupt
            return done(*args)

        return run

    with monkeypatch.context() as m:
        m.setattr(sinks, "save_file", broken(sinks.save_file))
        m.setattr(sinks, "move", broken(sinks.move))
        if step:
            with pytest.raises(KeyboardInterrupt):
                R.fail(spark, str(box / "x.mp3"), str(failed), "boom")
    failures = spark.createDataFrame([(str(box / "x.mp3"), "boom")], "path string, error string")
    assert R.fail_all(failures, str(failed)) == 1
    assert sorted(os.listdir(failed)) == sorted(["x.error.log", "x.mp3", *(["x.job.json"] if sidecar else [])]) and os.listdir(box) == []
    assert (failed / "x.error.log").read_text() == "boom"


def test_a_missing_input_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.fail(spark, str(tmp_path / "no.mp3"), str(tmp_path / "failed"), "e")
