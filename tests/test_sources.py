import json

import pytest

from mnemolith.sources import files


def test_transcripts(spark, tmp_path):
    lines = [
        {"type": "user", "uuid": "u1", "parentUuid": "", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/home/x/Proj", "promptId": "p1", "message": {"role": "user", "content": "please look at the parser"}},
        {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "sessionId": "s", "isSidechain": True, "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "the parser is fine now"}, {"type": "thinking", "text": "no"}]}},
        {"type": "user", "uuid": "u3", "isMeta": True, "message": {"role": "user", "content": "meta meta meta meta"}},
        {"type": "user", "uuid": "u4", "message": {"role": "user", "content": "ok"}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    got = {r.message_uuid: r for r in files.transcripts(spark, str(tmp_path)).collect()}
    assert set(got) == {"u1", "u2"} and got["u2"].content == "the parser is fine now" and got["u2"].prompt_id == "p1" and got["u2"].tags == ["subagent"]
    assert got["u1"].project == "proj" and got["u2"].session_id == "s"


def test_rollouts(spark, tmp_path):
    line = lambda q, a: json.dumps({"type": "model_io", "sessionId": "s", "model": {"modelId": "m"}, "request": {"messages": [{"role": "user", "content": q}]}, "response": {"text": a}})
    (tmp_path / "r.jsonl").write_text("\n".join([line("first question", "a long enough answer 1"), line("first question", "a long enough answer 2"), line("second", "a long enough answer 3"), line("second", "short")]))
    got = sorted(r.content for r in files.rollouts(spark, str(tmp_path)).collect())
    assert got == ["Q: first question\nA: a long enough answer 1", "Q: second\nA: a long enough answer 3", "a long enough answer 2"]


def test_markdown_and_vaults(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / ".trash").mkdir()
    (tmp_path / "pages" / "Note.md").write_text("---\nname: My Note\ntags: [Go, \"ui\"]\naliases:\n  - other name\n---\nintro text that is long enough [[Link]]\n## One\nbody one is here\n## X\n")
    (tmp_path / ".trash" / "gone.md").write_text("gone")
    chunks = files.markdown_chunks(spark, str(tmp_path / "pages")).collect()
    assert sorted(r.content[:5] for r in chunks) == ["## On", "intro"] and chunks[0].tags == ["my note"]
    notes = files.vault_notes(spark, str(tmp_path)).collect()
    assert len(notes) == 1 and set(notes[0].tags) == {"go", "ui", "other name", "pages", "link"}
    assert files.journals(spark, str(tmp_path)).collect()[0].tags == ["note", "link"]
    assert files.chat_file(spark, str(tmp_path / "pages" / "Note.md"), 10).head().content == "---\nname: "


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\nb", "global", ["t"], "s", "organized", "knowledge"), ("2", "c", "x", None, "s", "inbox", "inbox")], "id string, content string, scope string, tags array<string>, source string, phase string, category string")
    files.export_jsonl(df, str(tmp_path / "out"), scope="global")
    back = files.import_jsonl(spark, str(tmp_path / "out"), preserve=True).collect()
    assert [(r.id, r.content, r.phase) for r in back] == [("1", "a\nb", "organized")]
    assert files.import_jsonl(spark, str(tmp_path / "out")).head().phase == "inbox"
    assert [r.content for r in files.new_records(df, df.where("id = '1'")).collect()] == ["c"]
    with pytest.raises(ValueError):
        files.read_all(spark, {"nothing": "x"})
