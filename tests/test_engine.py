"""Readers, writers, descriptors, the engine and streams."""

import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from parley.plans.descriptor import DescriptorError, Step, parse
from parley.plans.engine import Engine, HashMismatch
from parley.plans.registry import Context, Registry, read_stats
from parley.schema import CONVERSATION, flat
from parley.sources import readers, writers
from parley.streaming import micro_batch

CSV = 'n,conv,who,say\r\n0,007,u,"Hello, ""you"""\r\n1,007,g,"two\nlines"\r\n2,8,u,\r\n3,007,u,again\r\n'


@pytest.fixture
def csv_file(tmp_path):
    p = tmp_path / "in.csv"
    p.write_text(CSV, newline="")
    return p


def rows(df):
    return [(r.input_id, [tuple(m) for m in r.messages]) for r in df.orderBy("conversation_seq").collect()]


def test_csv_groups_by_adjacency(spark, csv_file):
    df = readers.read_csv(spark, f"file://{csv_file}", "conv", "who", "say")
    assert df.schema.simpleString() == spark.createDataFrame([], CONVERSATION).schema.simpleString()
    assert rows(df) == [("007", [(0, "u", 'Hello, "you"'), (1, "g", "two\nlines")]), ("8", [(2, "u", "")]), ("007", [(3, "u", "again")])]
    assert [r.conversation_seq for r in df.orderBy("conversation_seq").collect()] == [0, 1, 2]
    assert df.first().meta["inputId"] == df.first().input_id
    both = readers.read_csv(spark, f"file://{csv_file}", "conv", "who", "say", group="global")
    assert sorted(len(m) for _, m in rows(both)) == [1, 3]
    with pytest.raises(ValueError, match="nope"):
        readers.read_csv(spark, f"file://{csv_file}", "nope", "who", "say")


def test_chat_json(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"id": 4, "conversations": [{"id": 9, "from": "u", "value": "x"}, {"from": "g", "value": "y"}], "meta": {"k": "v"}}, {"id": 5}, {"id": 6, "conversations": [{"from": "u", "value": "z"}]}]))
    ids = lambda df: [[m.id for m in r.messages] for r in df.orderBy("conversation_seq").collect()]
    assert ids(readers.read_chat_json(spark, f"file://{p}")) == [[0, 1], [], [2]]
    kept = readers.read_chat_json(spark, f"file://{p}", preserve_ids=True)
    assert ids(kept) == [[9, 0], [], [1]]
    assert kept.orderBy("conversation_seq").first().meta == {"k": "v"}


def test_inputs_are_appended(spark, csv_file):
    one = readers.read_csv(spark, f"file://{csv_file}", "conv", "who", "say")
    both = readers.append(one, one)
    assert [r.conversation_seq for r in both.orderBy("conversation_seq").collect()] == list(range(6))
    assert readers.append(one, one, "replace").count() == 3


def test_written_files_read_the_same(spark, csv_file, tmp_path):
    df = readers.read_csv(spark, f"file://{csv_file}", "conv", "who", "say")
    out = tmp_path / "sub" / "out.csv"
    writers.write_csv(df, str(out), ["message", "conversation", "from", "value"], ["n", "conv", "who", "say"])
    assert out.read_bytes().count(b"\r\n") == 5
    back = readers.read_csv(spark, f"file://{out}", "conv", "who", "say")
    assert [m for _, m in rows(back)] == [m for _, m in rows(df)]
    writers.write_csv(df, str(out), ["from"], ["who"])
    assert out.read_text().count("who") == 1  # appended, without a second header
    writers.write_csv(df, str(tmp_path / "d.csv"), ["from"], ignore_duplicates=True)
    assert (tmp_path / "d.csv").read_bytes() == b"u\r\ng\r\n"
    j = tmp_path / "o.json"
    writers.write_json_array(writers.chat_lines(df, True), str(j), 2)
    back = readers.read_chat_json(spark, f"file://{j}", preserve_ids=True)
    assert [m for _, m in rows(back)] == [m for _, m in rows(df)]
    writers.write_json_array(writers.native_lines(df), str(j))
    assert [len(c["messages"]) for c in json.loads(j.read_text())] == [2, 1, 1]
    writers.write_json_array(writers.native_lines(df.limit(0)), str(j))
    assert json.loads(j.read_text()) == []


def test_text_sinks(spark, csv_file, tmp_path):
    df = readers.read_csv(spark, f"file://{csv_file}", "conv", "who", "say")
    raw, found = tmp_path / "raw.txt", tmp_path / "found.txt"
    writers.write_raw(df, str(raw), escape=True)
    assert raw.read_text() == 'Hello, "you"\ntwo\\nlines\n\nagain\n'
    writers.write_regex(df, str(found), ["[aeiou]g", "l+"], escape=False)
    ids = [r.id for r in df.orderBy("conversation_seq").collect()]
    assert found.read_text() == f"{ids[0]} / u:\nll\n\n{ids[0]} / g:\nl\n\n{ids[2]} / u:\nag\n\n"
    writers.concatenate(spark, [str(raw), str(raw)], str(tmp_path / "two.txt"))
    assert (tmp_path / "two.txt").read_bytes() == raw.read_bytes() * 2
    writers.concatenate(spark, [str(raw), str(tmp_path / "two.txt")], str(tmp_path / "lines.txt"), ignore_duplicate_lines=True, eol="\r\n", delete=True)
    assert (tmp_path / "lines.txt").read_bytes().decode() == 'Hello, "you"\r\ntwo\\nlines\r\n\r\nagain\r\n' and not raw.exists()


def test_descriptor_is_checked():
    with pytest.raises(DescriptorError, match="build"):
        parse({"passes": []})
    with pytest.raises(DescriptorError, match="type"):
        parse({"build": {}, "passes": [{"required": [], "steps": [{}]}]})
    with pytest.raises(DescriptorError, match="required"):
        parse({"build": {}, "passes": [{"steps": []}]})
    d = parse("name: x\nbuild: {verifyHashes: false, concurrency: {local: 3}}\npasses:\n- required: [{path: a}]\n  steps: [{type: Trim, sync: group7}]\n")
    assert not d.build.verify_artifacts and d.passes[0].steps[0].type == "Trim"


def test_all_step_types_are_there():
    assert len(Registry().names()) == 21 and Registry(with_defaults=False).names() == []


YAML = """
name: two passes
build: {generateHashes: true, cleanDirectory: ["out/*"]}
passes:
- required: [{path: in.csv, sha512: %s}]
  artifacts: [{file: out/stats.json}, {file: out/missing}]
  steps:
  - {type: CsvInput, sync: main, config: {path: in.csv, fields: {conversation: conv, from: who, message: say}}}
  - {type: Trim}
  - {type: StatsCountOccurrences, pack: [patterns.csv], config: {path: out/counts.csv, packedPatterns: [patterns.csv], countCol: 1, caseSensitive: "true"}}
  - {type: StatsOutput, config: {path: out/stats.json, conversationsPath: out/conversations.json.gz, vocabPath: out/vocab.json.gz}}
  - {type: StatsAddColMerge, config: {files: [out/counts.csv, out/counts.csv], path: out/merged.csv, cols: [1]}}
  - {type: FileConcatenate, config: {files: ["out/counts.csv", "out/counts.csv"], path: out/all.csv}}
- required: []
  artifacts: [{file: out/chat.json}]
  steps:
  - {type: CsvInput, config: {path: in.csv, fields: {conversation: conv, from: who, message: say}}}
  - {type: ExactReplace, config: {replacements: [["again", "more"]], packedReplacements: [replace.csv]}}
  - {type: RawOutput, config: {path: out/raw.txt}}
  - {type: StatsConversationPrune, config: {statsPath: out/stats.json, messagesCountMin: 1, wordsClampMin: 1, wordsClampMax: 2}}
  - {type: RenameParticipants, config: {names: [human]}}
  - {type: Upper}
  - {type: FastChatOutput, config: {path: out/chat.json}}
"""


def test_two_pass_build(spark, csv_file, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old").write_text("x")
    (tmp_path / "patterns.csv").write_text("l,letter\nqq,none\nl,again\n")
    (tmp_path / "replace.csv").write_text("two,2\\n\nHello\n")
    sha = hashlib.sha512(csv_file.read_bytes()).hexdigest()
    registry = Registry()
    assert "no step type 'Upper'" in Engine(spark, YAML % sha, str(tmp_path), registry).verify()[0]
    registry.register("Upper", lambda config, x: lambda df: df.withColumn("messages", F.transform("messages", lambda m: m.withField("value", F.upper(m["value"])))))
    engine = Engine(spark, YAML % sha, str(tmp_path), registry)
    assert engine.verify() == []
    r = engine.run()
    out = tmp_path / "out"
    assert not (out / "old").exists() and r.warnings == ["artifact out/missing isn't there"]
    assert (out / "counts.csv").read_bytes() == b"l,3,letter\r\nqq,0,none\r\n"  # the first row of a pattern
    assert (out / "merged.csv").read_bytes() == b"l,6,letter\r\nqq,0,none\r\n"
    assert (out / "all.csv").read_bytes() == (out / "counts.csv").read_bytes() * 2
    stats = json.loads((out / "stats.json").read_text())
    assert stats["messagesTotal"] == 2 and stats["conversationsTotal"] == 2  # ids 007 twice: the last counts
    with gzip.open(out / "vocab.json.gz") as f:
        assert json.load(f)["[UNK]"] == 0
    assert read_stats(spark, str(out / "stats.json")).count() == 2
    chat = json.loads((out / "chat.json").read_text())
    assert [m["value"] for c in chat for m in c["conversations"]] == [', "YOU"', "2\n\nLINES", "", "MORE"] and chat[0]["conversations"][0]["from"] == "human"
    assert r.hashes["in.csv"] == sha and len(r.hashes["out/chat.json"]) == 128
    p = r.progress
    assert (p.passes_complete, p.conversations_total, p.messages_total, p.conversations_processed) == (2, 6, 8, 6) and p.to_dict()["messages_dropped"] == 0


def test_requirements(spark, csv_file, tmp_path):
    make = lambda r: Engine(spark, {"build": {}, "passes": [{"required": [r], "steps": []}]}, str(tmp_path))
    with pytest.raises(HashMismatch):
        make({"path": "in.csv", "sha512": "00"}).run()
    with pytest.raises(FileNotFoundError):
        make({"path": "none.csv"}).run()
    assert make({"path": "none.csv", "optional": True}).run().progress.passes_complete == 1
    with pytest.raises(ValueError, match="http"):
        make({"path": "none.csv", "source": "ftp://x"}).run()
    with pytest.raises(ValueError, match="leave"):
        Engine(spark, {"build": {"cleanDirectory": ["../x"]}, "passes": []}, str(tmp_path)).clean()


def test_pipeline_returns_rows_and_honours_initial(spark, csv_file, tmp_path):
    df = readers.read_csv(spark, f"file://{csv_file}", "conv", "who", "say")
    e = Engine(spark, {"build": {}, "passes": []}, str(tmp_path))
    got = e.build_pipeline([Step("Participants", {"min": 2}), Step("RawSampleOutput", {"path": "s.txt", "ratio": 0.5, "batchSize": 1, "forwardFilter": True})], df)
    assert got.count() == 0 and (tmp_path / "s.txt").read_text() == ""
    assert e.build_pipeline([Step("FullMatch", {"patterns": ["again"], "action": "drop"})], df).count() == 3
    assert e.build_pipeline([Step("NativeOutput", {"path": "n.json", "terminal": True})], df).count() == 0 and os.path.exists(tmp_path / "n.json")
    assert e.build_pipeline([]).count() == 0


def test_stream_gives_the_rows_of_a_batch(spark, csv_file, tmp_path):
    df = readers.read_csv(spark, f"file://{csv_file}", "conv", "who", "say")
    for k in range(2):
        df.where(f"conversation_seq % 2 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
    steps = [Step("Trim"), Step("ExactReplace", {"replacements": [["l", "L"]], "recursive": True}), Step("HtmlStrip"), Step("Participants", {"min": 1, "alternating": True}), Step("RenameParticipants", {"names": ["h"]})]
    stream = micro_batch.apply(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), steps)
    q = micro_batch.write(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = Engine(spark, {"build": {}, "passes": []}).build_pipeline(steps, df)
    key = lambda d: sorted(map(str, flat(d).collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want)
    with pytest.raises(ValueError, match="across rows"):
        micro_batch.apply(stream, [Step("StatsOutput", {"path": "x"})], Context(spark))


def test_side_inputs(tmp_path):
    (tmp_path / "a.csv").write_text('é,"x,y"\n')
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("é,b\n")
    assert readers.read_cells(str(tmp_path / "a.csv")) == [["é", "x,y"]] and readers.read_cells(str(tmp_path / "a.gz")) == [["é", "b"]]


def _descriptor(steps, artifacts=()):
    return {"build": {}, "passes": [{"required": [], "steps": [{"type": "CsvInput", "config": {"path": "in.csv", "fields": {"conversation": "conv", "from": "who", "message": "say"}}}, *steps], "artifacts": [{"file": a} for a in artifacts]}]}


def test_parts_and_tables_are_written_by_executors(spark, csv_file, tmp_path):
    steps = [{"type": "CsvOutput", "config": {"path": "csv", "fields": ["from", "value"], "parts": True}}, {"type": "RawOutput", "config": {"path": "raw", "parts": True, "gZip": True}}]
    steps += [{"type": "FastChatOutput", "config": {"path": "chat", "parts": True}}, {"type": "StatsOutput", "config": {"path": "stats", "tables": True}}, {"type": "StatsConversationPrune", "config": {"statsPath": "stats", "messagesCountMin": 2}}]
    r = Engine(spark, _descriptor(steps), str(tmp_path)).run()
    read = lambda name, op: "".join(op(f, "rt", newline="").read() for f in sorted((tmp_path / name).glob("part-*")))
    assert read("csv", open) == 'u,"Hello, ""you"""\r\ng,"two\nlines"\r\nu,\r\nu,again\r\n'
    assert read("raw", gzip.open) == 'Hello, "you"\ntwo\nlines\n\nagain\n'
    assert [json.loads(x)["conversations"][0]["value"] for x in read("chat", open).splitlines()] == ['Hello, "you"', "", "again"]
    tables = {t: spark.read.parquet(f"file://{tmp_path}/stats/{t}") for t in ("conversations", "corpus", "vocabulary")}
    assert tables["corpus"].first().messages_total == 2 and tables["vocabulary"].where("token = 'again'").count() == 1  # the last conversation of an id counts
    assert r.progress.conversations_processed == 0


def test_listener_tasks_and_hashes(spark, csv_file, tmp_path):
    from parley.plans.descriptor import with_hashes

    said, registry = [], Registry()

    def shout(config, conversations):
        for c in conversations:
            for m in c["messages"]:
                m["value"] = m["value"].upper() + config["mark"]
        return [c for c in conversations if c["input_id"] != "8"]

    registry.register_task("Shout", shout)
    d = _descriptor([{"type": "Shout", "config": {"mark": "!"}}, {"type": "RawOutput", "config": {"path": "out.txt"}}], ["out.txt"])
    r = Engine(spark, d, str(tmp_path), registry, lambda event, p: said.append((event, p.messages_total))).run()
    assert (tmp_path / "out.txt").read_text() == 'HELLO, "YOU"!\nTWO\nLINES!\nAGAIN!\n'
    assert [e for e, _ in said] == ["build begins", "pass begins", "step CsvInput", "source read", "step Shout", "step RawOutput", "pass done", "build done"] and said[-1][1] == 4
    text = "# a build\nbuild: {}\npasses:\n- required: []\n  steps: []\n  artifacts:\n  - file: out.txt\n  - file: other.txt\n"
    back = parse(with_hashes(text, r.hashes)).passes[0].artifacts
    assert back[0].sha512 == hashlib.sha512((tmp_path / "out.txt").read_bytes()).hexdigest() and back[1].sha512 is None


def test_command_line(spark, csv_file, tmp_path, capsys):
    import yaml

    from parley.__main__ import main

    path = tmp_path / "build.yaml"
    path.write_text(yaml.safe_dump(_descriptor([{"type": "RawOutput", "config": {"path": "out.txt"}}], ["out.txt"])))
    assert main([str(path), "--verify"]) == 0 and not (tmp_path / "out.txt").exists()
    assert main([str(path), "--write-hashes"]) == 0 and json.loads(capsys.readouterr().out)["progress"]["messages_processed"] == 4
    assert parse(path.read_text()).passes[0].artifacts[0].sha512
    path.write_text(yaml.safe_dump(_descriptor([{"type": "NoSuchStep"}])))
    assert main([str(path)]) == 1
