"""Reading, writing, publishing and following logs, with faults."""

import json

import pytest

from ledgerloom.sources import publish, tables
from ledgerloom.sources.files import Files
from ledgerloom.streaming.checkpoint import LastWritten, follow_log, windowed_counts

LOG = "qa_id string, retriever string, no int, status string"


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "x"', "0012"), ("é", "p|q", None)], "t string, u string, cik string")
    tables.write_csv(df, str(tmp_path / "c"), ["t", "u", "cik"], ["t"])
    got = tables.read_csv(spark, str(tmp_path / "c"), "t string, u string, cik string")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(Exception, match="exists"):
        tables.write_csv(df, str(tmp_path / "c"), ["t"], ["t"])


def test_encodings_and_texts(spark, tmp_path):
    (tmp_path / "u").write_bytes("é".encode())
    (tmp_path / "l").write_bytes("é".encode("latin-1"))
    assert tables.csv_encoding(spark, str(tmp_path / "u")) == "utf-8" and tables.csv_encoding(spark, str(tmp_path / "l")) == "latin-1"
    got = {r.path.rsplit("/", 1)[1]: r.content for r in tables.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"u": "é", "l": "\ufffd"}
    (tmp_path / "q.csv").write_bytes(b'\xef\xbb\xbfqa_id,answer\n1,"a, ""b""\nc"\n')
    assert tables.read_csv(spark, str(tmp_path / "q.csv"), "qa_id string, answer string").collect() == [("1", 'a, "b"\nc')]


def test_records_have_defaults_and_lack_nothing(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": "1"},\n {"k": "2", "v": "x"}]')
    got = tables.read_records(spark, str(tmp_path / "a.json"), "k string, v string", ["k"], {"v": "none"})
    assert {tuple(r) for r in got.collect()} == {("1", "none"), ("2", "x")}
    (tmp_path / "b.jsonl").write_text('{"k": "1", "v": " "}\n')
    with pytest.raises(Exception, match="a record lacks v"):
        tables.read_records(spark, str(tmp_path / "b.jsonl"), "k string, v string", ["k", "v"]).collect()


def test_newest_run(spark, tmp_path):
    for name, at in (("a", 2_000_000_000), ("b", 1_000_000_000)):
        (tmp_path / name / "results").mkdir(parents=True)
        import os

        os.utime(tmp_path / name / "results", (at, at))
    (tmp_path / "c").mkdir()
    assert tables.newest_run(spark, str(tmp_path)).endswith("/a/results")
    with pytest.raises(FileNotFoundError):
        tables.newest_run(spark, str(tmp_path / "c"))


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    tables.write_jsonl(df, str(tmp_path / "j"), ["k", "v"], ["k"])
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "k string, v string").count() == 2
    with pytest.raises(FileNotFoundError, match="preceding"):
        tables.read_jsonl(spark, str(tmp_path / "none"), "k string")


def test_log_survives_an_interrupted_write(spark, tmp_path):
    good = [json.dumps({"qa_id": f"q{i}", "retriever": "b", "no": i, "status": "ok"}) for i in range(3)]
    p = tmp_path / "log.jsonl"
    p.write_text("\n".join(good) + '\n{"qa_id": "q9", "re')
    assert tables.read_checkpoint(spark, str(p), LOG).count() == 3
    assert [r.no for r in tables.repair_log(spark, str(p), LOG).orderBy("log_at", "log_no").collect()] == [0, 1, 2]
    assert spark.read.text(str(p)).count() == 3 and tables.read_checkpoint(spark, str(p), LOG).count() == 3
    whole = tmp_path / "whole.jsonl"
    whole.write_text("\n".join(good))
    assert tables.repair_log(spark, str(whole), LOG).count() == 3 and whole.is_file()
    whole.write_text(good[0] + "\nbroken\n" + good[1] + "\n")
    with pytest.raises(Exception, match="malformed"):
        tables.read_checkpoint(spark, str(whole), LOG).collect()


def test_publish_puts_everything_back_after_a_fault(spark, tmp_path):
    (tmp_path / "a").write_text("old a")
    (tmp_path / "new_a").write_text("new a")
    with pytest.raises(FileNotFoundError):
        publish.publish(spark, {str(tmp_path / "new_a"): str(tmp_path / "a"), str(tmp_path / "missing"): str(tmp_path / "b")})
    assert (tmp_path / "a").read_text() == "old a" and not (tmp_path / "b").exists()
    (tmp_path / "new_a").write_text("new a")
    publish.publish(spark, {str(tmp_path / "new_a"): str(tmp_path / "a")})
    assert (tmp_path / "a").read_text() == "new a" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a"]


def test_manifest_and_pruning(spark, tmp_path):
    path = str(tmp_path / "m.json")
    publish.write_manifest(spark, path, {"k": 5, "name": "é"})
    assert publish.check_manifest(spark, path, {"k": 5})["name"] == "é"
    with pytest.raises(ValueError, match="differs in: k"):
        publish.check_manifest(spark, path, {"k": 3})
    files = Files(spark)
    said = json.loads(files.read(path))
    files.write(path, json.dumps(said | {"k": 3}))
    with pytest.raises(ValueError, match="changed"):
        publish.check_manifest(spark, path, {"k": 3})
    files.write(str(tmp_path / "keep"), "x")
    files.write(str(tmp_path / "folder" / "part"), "x")
    files.write(str(tmp_path / "stale" / "part"), "")
    with pytest.raises(ValueError, match="outside"):
        publish.prune(spark, str(tmp_path), ["../x"])
    gone = [p for p in publish.prune(spark, str(tmp_path), ["keep", "m.json", "folder"]) if not p.endswith(".crc")]
    assert gone == ["stale/part"] and files.exists(str(tmp_path / "folder" / "part"))
    assert files.sha256(str(tmp_path / "keep")) == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    with pytest.raises(FileExistsError):
        publish.refuse_existing(spark, path)
    assert publish.markdown_table(["a"], []) == "_No rows._" and publish.markdown_table(["a"], [("x|y\nz",)]).endswith("| x\\|y z |")


def test_stream_of_the_log_keeps_last_rows(spark, tmp_path):
    log = tmp_path / "log"
    for i, rows in enumerate([[("q1", "b", 1, "generation_error"), ("q2", "b", 1, "ok")], [("q1", "b", 2, "ok")]]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(str(log))
        target = LastWritten(spark, str(tmp_path / "t"), ["qa_id", "retriever"], ["no"])
        follow_log(spark, str(log), LOG, target, str(tmp_path / "state")).awaitTermination(120)
        assert target.read().count() == 2, i
    assert {(r.qa_id, r.status) for r in target.read().collect()} == {("q1", "ok"), ("q2", "ok")}
    before = target.read().collect()
    target.merge(spark.createDataFrame([("q1", "b", 9, "x")], LOG), 0)  # a batch that ran before changes nothing
    assert target.read().collect() == before


def test_windows_of_events(spark):
    events = spark.createDataFrame([("2026-01-01 00:00:01", "a"), ("2026-01-01 00:04:59", "a"), ("2026-01-01 00:05:00", "b")], "ts string, kind string").selectExpr("timestamp(ts) AS ts", "kind")
    assert sorted(r.n for r in windowed_counts(events, "ts", ["kind"], "5 minutes", "10 minutes").collect()) == [1, 2]
