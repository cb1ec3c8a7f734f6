"""Loaders of one queue and of a glossary's layers."""

from speechframe.operators import services
from speechframe.sources import files, sinks


def test_queue_of_one_meeting(spark, tmp_path):
    for name in ("a", "b [1]"):
        (tmp_path / f"{name}.json").write_text('{"meeting_dir": "%s", "audio_file": "x.ogg", "speakers": [{"label": "S1"}]}' % name)
    (tmp_path / "broken.json").write_text("{")
    at = str(tmp_path)
    assert [r.meeting_dir for r in files.load_pending_of(spark, at, "b [1]").collect()] == ["b [1]"]
    assert [r.meeting_dir for r in files.load_pending_of(spark, at, "a").collect()] == ["a"]
    for name in ("broken", "none", "", "..", "../a", "x\\a", "*"):
        assert files.load_pending_of(spark, at, name).count() == 0
    assert files.load_pending_of(spark, f"{at}/none", "a").count() == 0


def test_glossary_of_all_layers(spark, tmp_path):
    (tmp_path / "g.md").write_text("# words\n## exact\nKafka: cafka, caf ka # heard\nKafka: kavka\n## ambiguous\nport | ops = socket | yard = harbour\nbad line\n")
    (tmp_path / "t.md").write_text("ops: Ann, Bob\n# note\nyard: Cid\n")
    g = services.load_glossary(spark, str(tmp_path / "g.md"), str(tmp_path / "t.md"))
    assert [(r.correct, r.wrong) for r in g.dictionary.orderBy("wrong_ord").collect()] == [("Kafka", "cafka"), ("Kafka", "caf ka"), ("Kafka", "kavka")]
    assert {(r.term, tuple(sorted(r.meanings.items()))) for r in g.ambiguous.collect()} == {("port", (("ops", "socket"), ("yard", "harbour")))}
    assert {r.team: r.names for r in g.teams.collect()} == {"ops": ["Ann", "Bob"], "yard": ["Cid"]}
    assert [(r.term, r.lines) for r in g.duplicates.collect()] == [("Kafka", [3, 4])]
    docs = spark.createDataFrame([(1, "cafka and kavka")], "id int, text string")
    assert g.rewrite(docs, "id")[0].first().text == "Kafka and Kafka"
    none = services.load_glossary(spark, None, str(tmp_path / "none"))
    assert [layer.count() for layer in none] == [0, 0, 0, 0]


def test_enrolment_is_cleared_beside_the_recording(spark, tmp_path):
    for name in ("call.wav", "call.wav.request.json", "call.wav.changed.json", "call.mp3.result.json"):
        (tmp_path / name).write_text("{}")
    assert sinks.clear_enrolment(spark, str(tmp_path), "call.wav") == ["call.wav.request.json", "call.wav.changed.json"]
    assert sinks.clear_enrolment(spark, str(tmp_path), "call.wav") == sinks.clear_enrolment(spark, str(tmp_path), "../call.mp3") == []
    assert sorted(p.name for p in tmp_path.glob("call*")) == ["call.mp3.result.json", "call.wav"]
