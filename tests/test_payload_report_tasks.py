import json

from pyspark.sql import functions as F

from confab.functions import payload as P
from confab.operators import report, tasks
from confab.sources import files, sinks


def parsed(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_decision_errors(spark):
    item = {"decision": "d", "owner": None, "timestamp": " ", "confidence": " HIGH "}
    ok = parsed(spark, json.dumps({"decisions": [item, {**item, "decision": None}]}), lambda c: P.parse_items(c, P.DECISIONS))
    assert ok["error"] is None and [tuple(x) for x in ok["items"]] == [("d", None, None, "high"), ("None", None, None, "high")]
    for value, words in (
        ("", "empty"), ("no", "not valid JSON"), ("[1]", "must be an object"), ("{}", "must include"), ('{"decisions": null}', "must include"), ('{"decisions": [7]}', "Decision 1 must be a JSON object"),
        (json.dumps({"decisions": [item, {**item, "confidence": "sure"}]}), "Decision 2 has invalid confidence 'sure'"), (json.dumps({"decisions": [{"decision": "x"}]}), "Decision 1 is missing confidence"),
    ):
        assert words in parsed(spark, value, lambda c: P.parse_items(c, P.DECISIONS))["error"]


def test_points_and_speech(spark):
    f = lambda c: P.parse_items(c, P.POINTS)
    assert "speakers must be a list" in parsed(spark, '{"key_discussion_points": [{"point": "p", "speakers": "x"}]}', f)["error"]
    assert "missing speakers" in parsed(spark, '{"key_discussion_points": [{"point": "p"}]}', f)["error"]
    s = parsed(spark, '{"transcript": " ", "diarized_transcript": {"entries": [7, {"transcript": " a "}, {"transcript": "b", "start_time_seconds": "x", "end_time_seconds": 2}]}}', P.parse_speech)
    assert s["transcript"] == "a b" and s["error"] is None and [tuple(x) for x in s["segments"]] == [("a", None, None, None), ("b", None, None, 2.0)]
    assert parsed(spark, '{"diarized_transcript": []}', P.parse_speech)["error"]


def test_steps_differ_by_flavour(spark):
    kinds = "a array<struct<task:string,owner:string,due_date:string,status:string>>, d array<struct<decision:string>>"
    df = spark.createDataFrame([([], [("go on",)]), ([("Do it...", None, "n/a", "open"), ("...", "A", "today", "x")], [("",), ("b",)])], kinds)
    docx, pdf = ([r["y"] for r in df.select(report.next_steps(F.col("a"), F.col("d"), x).alias("y")).collect()] for x in ("docx", "pdf"))
    assert docx[0] == ["Team will proceed in line with: Go on."] and pdf[0] == [report.NO_STEPS]
    assert docx[1] == ["Team will do it.", "A will complete the assigned task by today.", "Team will proceed in line with: B."]


def test_task_asks_each_key_once_and_uses_the_cache(spark, tmp_path):
    log = tmp_path / "calls"

    class Counting:
        def generate(self, prompt, *, system_prompt=None):
            with open(log, "a") as f:
                f.write("x")
            if "bad" in prompt:
                raise ValueError("no")
            return '{"decisions": []}'

    m = spark.createDataFrame([(1, "a"), (2, " a "), (3, ""), (4, None), (5, "bad")], "meeting_id int, transcript_text string")
    got, cache = tasks.run_task(m, "decisions", Counting)
    rows = {r["meeting_id"]: r for r in got.collect()}
    assert rows[1]["items"] == [] and rows[2]["error"] is None and rows[3]["error"] == tasks.EMPTY and rows[4]["error"] == tasks.EMPTY and "failed" in rows[5]["error"]
    assert len(log.read_text()) == 2
    again, _ = tasks.run_task(m.where("meeting_id < 3"), "decisions", Counting, cache=cache)
    assert again.where("error is null").count() == 2 and len(log.read_text()) == 2


def test_retries_wait_and_give_up():
    waits = []

    class Down:
        def generate(self, prompt, *, system_prompt=None):
            raise tasks.Unavailable("503")

    answer, error = tasks.with_retries(Down(), (2, 5, 10), waits.append)("p", None)
    assert answer is None and "unavailable" in error and waits == [2, 5, 10]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeffSpeaker 1: hé".encode())
    (tmp_path / "b.txt").write_bytes("Speaker 2: x".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"caf\xe9!")
    (tmp_path / "d.docx").write_bytes(sinks.docx_bytes([{"kind": "strong", "text": "Speaker 1:", "cells": None}, {"kind": "paragraph", "text": "a < b", "cells": None}]))
    (tmp_path / "f.rtf").write_bytes(b"x")
    empty = spark.createDataFrame([("/e.txt", bytearray())], "path string, content binary")  # the file source itself skips empty files
    rows = files.read_files(spark, str(tmp_path)).select("path", "content").unionByName(empty)
    got = {r["path"].rpartition("/")[2]: r for r in files.transcripts_of_files(rows).collect()}
    assert got["a.txt"]["segments"][0]["transcript"] == "hé" and got["b.txt"]["segments"][0]["speaker_id"] == "1" and got["c.txt"]["text"] == "café!"
    assert got["d.docx"]["segments"][0]["transcript"] == "a < b" and "empty" in got["e.txt"]["error"] and "Unsupported" in got["f.rtf"]["error"]
