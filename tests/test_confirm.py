"""Naming speakers: deltas against a full recomputation, and a kill between any two tables."""

import pytest
from pyspark.sql import functions as F

from speechframe.operators import confirm as C
from speechframe.operators import voices
from speechframe.sources import commits

REGISTRY = "id string, name string, ord long, embedding array<double>, embedding_model string, source string, added string"
QUEUE = "meeting_dir string, label string, ord long, embedding array<double>, embedding_model string, added string"
DECISIONS = "meeting_dir string, label string, name string, speaker_id string, skip boolean"


def md(*blocks):
    return "# Transcript\n\n" + "\n\n".join(f"**{who}** [00:{i:02d}]: {text}" for i, (who, text) in enumerate(blocks))


@pytest.fixture
def tables(spark, tmp_path):
    rows = {
        "registry": spark.createDataFrame([("id-a", "Ann", 1, [1.0, 0.0], "m", "old", "t"), ("id-z", "Zoe", 2, [0.0, 1.0], "m", "old", "t")], REGISTRY),
        "queue": spark.createDataFrame([("x", "S 1", 3, [1.0, 1.0], "m", "t"), ("x", "S 2", 4, [2.0, 1.0], "m", "t"), ("x", "S 3", 5, [0.0, 0.0], "m", "t"), ("y", "S 1", 6, [3.0, 1.0], "m", "t"), ("y", "S 2", 7, [3.0, 2.0], None, "t"), ("y", "S 4", 8, [1.0, 3.0], "m", "t")], QUEUE),
        "transcripts": spark.createDataFrame([("x", md(("S 1", "hi **S 1** [x"), ("S 2", "S 1 said"), ("S 1", "bye"))), ("y", md(("S 1", "yo"), ("S 4", "no"))), ("z", md(("S 1", "alone")))], "meeting_dir string, md string"),
    }
    rows["roll_ups"] = C.roll_ups(rows["transcripts"])
    paths = {name: str(tmp_path / name) for name in rows}
    for name, df in rows.items():
        commits.write_table(df, paths[name])
    return paths


def decisions(spark, name="S 2"):
    rows = [("x", "S 1", f" *{name}* ", None, None), ("x", "S 2", None, "id-a", False), ("x", "S 3", "Bob", None, None), ("y", "S 1", "  ", None, None), ("y", "S 2", "Bob", None, None), ("y", "S 4", None, None, True), ("z", "S 1", "Zed", None, None), ("y", "S 9", None, "id-none", None), ("x", "S 1", f" *{name}* ", None, None)]
    return spark.createDataFrame(rows, DECISIONS)


def state(spark, tables):
    read = {n: commits.read_table(spark, p) for n, p in tables.items()}
    return {
        "registry": sorted((r.name, r.source, tuple(r.embedding)) for r in read["registry"].collect()),
        "queue": sorted((r.meeting_dir, r.label) for r in read["queue"].collect()),
        "transcripts": {r.meeting_dir: r.md for r in read["transcripts"].collect()},
        "roll_ups": {r.meeting_dir: (r.line, str(r.speakers)) for r in read["roll_ups"].collect()},
    }


def people(name):
    return sorted([("Ann", "old", (1.0, 0.0)), ("Ann", "x", (2.0, 1.0)), (name, "x", (1.0, 1.0)), ("Zoe", "old", (0.0, 1.0))])


def check(spark, tables, before, name="S 2"):
    now = state(spark, tables)
    assert now["registry"] == people(name) and now["queue"] == [("x", "S 3"), ("y", "S 1"), ("y", "S 2")]
    assert now["transcripts"] == {**before["transcripts"], "x": md((name, "hi **S 1** [x"), ("Ann", "S 1 said"), (name, "bye"))}
    every = {r.meeting_dir: (r.line, str(r.speakers)) for r in C.roll_ups(commits.read_table(spark, tables["transcripts"])).collect()}
    assert now["roll_ups"] == every  # the delta equals a full recomputation
    assert now["roll_ups"]["x"] != before["roll_ups"]["x"]


def test_one_command_changes_all_that_depends_on_it(spark, tables):
    before = state(spark, tables)
    told = {(r.meeting_dir, r.label): (r.code, r.name) for r in C.apply(spark, tables, decisions(spark)).collect()}
    assert told == {("x", "S 1"): ("ok", "S 2"), ("x", "S 2"): ("ok", "Ann"), ("x", "S 3"): ("bad_embedding", None), ("y", "S 1"): ("no_name", None), ("y", "S 2"): ("missing_embedding_model", None), ("y", "S 4"): ("skipped", None), ("z", "S 1"): ("not_found", None), ("y", "S 9"): ("not_found", None)}
    check(spark, tables, before)
    again = {r.code for r in C.apply(spark, tables, decisions(spark)).collect()}
    assert "ok" not in again and state(spark, tables)["registry"] == people("S 2")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_a_kill_between_tables_is_made_good_by_the_same_command(spark, tables, monkeypatch, step):
    before, calls, write = state(spark, tables), [], commits.write_table

    def killed(*args, **how):
        calls.append(1)
        if len(calls) == step:
            raise KeyboardInterrupt
        return write(*args, **how)

    with monkeypatch.context() as m:
        m.setattr(commits, "write_table", killed)
        with pytest.raises(KeyboardInterrupt):
            C.apply(spark, tables, decisions(spark, "Sue"))
    C.apply(spark, tables, decisions(spark, "Sue"))
    check(spark, tables, before, "Sue")


def test_deltas_touch_only_what_changes(spark, tables):
    d = C.deltas(*(commits.read_table(spark, tables[n]) for n in ("registry", "queue", "transcripts")), decisions(spark))
    assert {r.name for r in d["registry"].collect()} == {"Ann", "S 2"}
    assert [r.meeting_dir for r in d["transcripts"].collect()] == ["x"] == [r.meeting_dir for r in d["roll_ups"].collect()]
    none = C.deltas(*(commits.read_table(spark, tables[n]) for n in ("registry", "queue", "transcripts")), decisions(spark).limit(0))
    assert all(df.isEmpty() for df in none.values())
    assert voices.registry_summary(commits.read_table(spark, tables["registry"])).agg(F.sum("sample_count")).first()[0] == 2
