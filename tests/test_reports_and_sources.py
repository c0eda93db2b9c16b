"""Documents, exports, audio, speech, settings, templates, verbs and streaming."""

import io
import re
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from confab.functions import text
from confab.operators import report, segments, tasks
from confab.sources import files, sinks
from confab.streaming import drop_folder

ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def test_all_line_ends(spark):
    rows = [(f"Speaker 1:{e}hello{e}there{e}Speaker 2 [0:01 - 0:02]{e}bye{e}",) for e in ENDS] + [("a\x1fb",), ("",), ("\n\n",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(text.lines_of(F.col("t")).alias("l"), segments.header_count(F.col("t")).alias("n"), segments.parse_segments(F.col("t")).alias("s"), text.blocks(F.col("t")).alias("b"), "t").collect()
    for r in got:
        assert r["l"] == r["t"].splitlines()
    for r in got[: len(ENDS)]:
        assert r["n"] == 2 and [x["transcript"] for x in r["s"]] == ["hello there", "bye"] and r["b"][0]["header"] == "Speaker 1:"
    blanks = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace())
    assert set(text.BLANKS) == set(blanks)
    assert spark.createDataFrame([(f"{blanks}a b{blanks}",)], "t string").select(text.strip(F.col("t")).alias("t")).first()["t"] == "a b"


ANALYSIS = "meeting_id int, cleaned_transcript string, summary struct<title:string,short_summary:string,detailed_summary:string,topics_discussed:array<string>>, key_discussion_points array<struct<point:string,speakers:array<string>,timestamp:string>>, decisions array<struct<decision:string,owner:string,timestamp:string,confidence:string>>, action_items array<struct<task:string,owner:string,due_date:string,timestamp:string,status:string>>"


@pytest.fixture(scope="module")
def analyses(spark):
    full = (1, "Speaker 1 [00:00 - 01:30]\nhello (all)\nthere\n\nSpeaker 2\n", ("Plan <A>", "s", "They talked about it", ["x", "y"]), [("go & see", ["Speaker 1"], None)], [("ship it", None, None, "high"), ("wait!", "B", "0:01", "low")], [("Write", "Ann", "today", None, "open"), ("Read \\ file", None, None, None, None)])
    none = (2, None, ("", "", "", []), [], [], [])
    return spark.createDataFrame([full, none], ANALYSIS).withColumn("info", F.create_map(F.lit("Source File"), F.when(F.col("meeting_id") == 1, "a.wav").otherwise("")))


def test_documents_have_sections_lists_and_tables(spark, analyses):
    model = report.report_model(analyses, today=F.lit("2024-01-01"))
    parts = {r["meeting_id"]: r["parts"] for r in report.minutes_document(model).collect()}
    kinds = [p["kind"] for p in parts[1]]
    assert kinds[0] == "title" and kinds.count("heading") == 7 and kinds.count("columns") == 1 and kinds.count("numbered") == 2 and kinds[-1] == "end"
    assert [p["text"] for p in parts[2] if p["kind"] == "paragraph"] == [report.STOCK, "No topics were extracted.", report.NO_POINTS, report.NO_DECISIONS, report.NO_ACTIONS, report.NO_STEPS]
    data = sinks.docx_bytes(parts[1])
    z = zipfile.ZipFile(io.BytesIO(data))
    xml = z.read("word/document.xml").decode()
    assert z.testzip() is None and xml.count("<w:tbl>") == 2 and xml.count("<w:tr>") == 4 + 3 and xml.count('<w:numId w:val="2"/>') == 2 and "Plan &lt;A&gt;" in xml
    read = files.docx_text(data)
    assert "ACTION ITEMS" in read and "Write | Ann | today | High | open" in read and "go & see" in read
    pdf = sinks.pdf_bytes(parts[1])
    shown = [m.decode("cp1252") for m in re.findall(rb"Tm \(((?:\\.|[^\\)])*)\) Tj", pdf)]
    assert pdf.startswith(b"%PDF") and pdf.rstrip().endswith(b"%%EOF") and "1. Ship it." in shown and "2. Wait!" in shown and "- go & see" in shown and "Page 1" in shown and "Task" in shown
    assert sinks.pdf_bytes([{"kind": "paragraph", "text": "w " * 9000, "cells": None}]).count(b"/Type /Page /") > 3
    # every object is where the table says
    at = int(re.search(rb"startxref\n(\d+)", pdf)[1])
    for k, place in enumerate(re.findall(rb"(\d{10}) 00000 n", pdf[at:]), 1):
        assert pdf[int(place) :].startswith(b"%d 0 obj" % k)


def test_transcript_documents(analyses):
    docx, pdf = ({r["meeting_id"]: [(p["kind"], p["text"]) for p in r["parts"]] for r in report.transcript_document(analyses, x, "info").collect()} for x in ("docx", "pdf"))
    assert docx[1] == [("title", "Plan <A>"), ("note", "Transcript Report"), ("paragraph", "Source Audio File: a.wav"), ("heading", "Cleaned Transcript"), ("strong", "Speaker 1 [00:00 - 01:30]"), ("paragraph", "hello (all)\nthere"), ("strong", "Speaker 2")]
    assert ("paragraph", "hello (all) there") in pdf[1]
    assert docx[2][0] == ("title", "Minutes of Meeting") and pdf[2][0] == ("title", "Transcript Report") and docx[2][-1] == ("paragraph", report.NO_TRANSCRIPT)


def test_exports_are_made_once(spark, analyses, tmp_path):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    for name in sinks.EXPORTS:
        first = sinks.export(analyses.where("meeting_id = 1"), name, f"file://{tmp_path}/{name}", info="info", at=at)
        both = {r["meeting_id"]: r["path"] for r in sinks.export(analyses, name, f"file://{tmp_path}/{name}", first, "info", at).collect()}
        assert sorted(both) == [1, 2] and all((tmp_path / name / p.rpartition("/")[2]).stat().st_size > 300 for p in both.values())
        assert "20240102_030405_1." in both[1]


def test_json_text_and_log_sinks(spark, analyses, tmp_path):
    sinks.write_json(analyses.select("meeting_id", "cleaned_transcript"), str(tmp_path / "j"))
    assert '"cleaned_transcript":null' in "".join(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect())
    sinks.write_text(report.report_model(analyses, today=F.lit("d")), str(tmp_path / "t"))
    assert "NEXT STEPS" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect())
    rows = spark.createDataFrame([("s", "m", {"a": "b"})], "stage string, message string, details map<string,string>").withColumn("ts", F.current_timestamp())
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "l"))
    log = spark.read.parquet(str(tmp_path / "l"))
    assert {r["x"] for r in log.select(text.log_line(F.col("stage"), F.col("message"), F.col("details")).alias("x")).collect()} == {"s: m (a='b')"} and log.count() == 2


def clip(seconds: float, chunk: bytes = b"") -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * int(8000 * seconds))
    data = out.getvalue()
    return data[:12] + chunk + data[12:]


def test_wav_durations(spark):
    odd = b"LIST" + (5).to_bytes(4, "little") + b"abcde\0"
    bad = bytearray(clip(1))
    bad[24:28] = b"\0\0\0\0"
    rows = [("a", bytearray(clip(0.5))), ("b", bytearray(clip(0.5, odd))), ("c", bytearray(b"x")), ("d", bad), ("e", None), ("f", bytearray(clip(1)[:40]))]
    got = {r["path"]: (r["seconds"], r["error"]) for r in files.wav_seconds(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a"] == got["b"] == (0.5, None) and "Not a WAV" in got["c"][1] and "sample rate" in got["d"][1] and got["e"][0] is None and "no audio data" in got["f"][1]


def test_audio_is_checked_converted_and_transcribed(spark):
    short, long = clip(2), clip(40)

    class Tool:
        def to_wav(self, data, kind):
            if data == b"bad":
                raise ValueError("no stream")
            return b"" if data == b"none" else short if kind == "mp3" else long

    class Service:
        def realtime(self, wav):
            return '{"transcript": "short"}'

        def batch(self, wav, diarize, speakers):
            return '{"transcript": "long"}' if not diarize else '{"job_state": "failed", "failed": [{"error_message": "quota"}]}'

    rows = [("/a.mp3", b"x"), ("/b.MP4", b"x"), ("/c.ogg", b"x"), ("/d.wav", b""), ("/e.mp3", b"bad"), ("/f.mp3", b"none"), ("/g", b"x")]
    src = spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in rows], "path string, content binary, length long")
    wav = files.converted(src, Tool)
    got = {r["path"]: r["error"] for r in wav.collect()}
    assert got["/a.mp3"] is None and got["/b.MP4"] is None and "'.ogg'" in got["/c.ogg"] and got["/d.wav"] == "The audio file is empty." and "no stream" in got["/e.mp3"] and "converted audio file is empty" in got["/f.mp3"] and "'unknown'" in got["/g"]
    good = wav.where("error is null")
    assert {r["path"]: r["transcript"] for r in files.transcribed(good, Service).collect()} == {"/a.mp3": "short", "/b.MP4": "long"}
    assert {r["error"] for r in files.transcribed(good, Service, diarize=True).collect()} == {"quota"}


def test_retries_read_codes_and_texts():
    class Coded(Exception):
        def __init__(self, words="", **more):
            super().__init__(words)
            self.__dict__.update(more)

    class Answer:
        status_code = "503"

    for error, again in ((Coded(code=503), True), (Coded(status_code="503"), True), (Coded(response=Answer()), True), (Coded("model is unavailable"), True), (Coded("HTTP 503"), True), (Coded("no", code=400), False), (Coded("bad key"), False), (tasks.Unavailable("x"), True)):
        waits = []

        def fail(*_, error=error):
            raise error

        answer, said = tasks.with_retries(tasks.ModelBackend(fail, "m"), (2, 5, 10), waits.append)("p", None)
        assert answer is None and waits == ([2, 5, 10] if again else []) and ("unavailable" in said) == again
    seen = []
    ok = tasks.ModelBackend(lambda *a: seen.append(a) or " yes ", "m")
    assert tasks.with_retries(ok, ())("p", "s") == ("yes", None) and seen == [("m", "p", "s", 0.2)]
    assert tasks.with_retries(tasks.Constant(" "), ())("p", None)[1] == "The backend gave an empty answer."


def test_verbs_templates_and_typed_input(spark, tmp_path):
    (tmp_path / "summary.md").write_text("Häppy {transcript}", encoding="utf-8")
    (tmp_path / "other.md").write_text("x")
    options = tasks.Options.from_folder(spark, str(tmp_path), system_prompt="s")
    assert options.templates["summary"] == "Häppy {transcript}" and options.templates["cleanup"] == tasks.TEMPLATES["cleanup"] and set(options.templates) == set(tasks.TEMPLATES)

    class Backend:
        def generate(self, prompt, *, system_prompt=None):
            if prompt.startswith("Häppy"):
                return '{"title": "%s", "short_summary": "s", "detailed_summary": "d", "topics_discussed": ["t"]}' % system_prompt
            for key in ("action_items", "decisions", "key_discussion_points"):
                if f"the list {key} of" in prompt:
                    return '{"%s": []}' % key
            if "cleaned_transcript" in prompt:
                return '{"cleaned_transcript": "a", "summary": {"title": "t", "short_summary": "s", "detailed_summary": "d"}, "topics_discussed": ["x"]}'
            return "a."

    s = tasks.Summarizer(Backend, options)
    assert s.generate_meeting_summary("a").first()["summary"]["title"] == "s"
    assert [r["cleaned_transcript"] for r in s.cleanup_transcript(["a", " a "]).collect()] == ["a.", "a."]
    frame = spark.createDataFrame([(7, "a")], "meeting_id int, transcript_text string")
    for verb in (s.extract_action_items, s.extract_decisions, s.extract_key_discussion_points):
        r = verb(frame).first()
        assert r["items"] == [] and r["error"] is None and r["meeting_id"] == 7
    assert s.analyze_meeting(frame).first()["summary"]["topics_discussed"] == ["x"] and s.cache.count() == 1
    assert s.analyze_meeting("a").count() == 1 and s.cache.count() == 1
    assert s.cleanup_transcript("").first()["error"] == tasks.EMPTY


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("CONFAB_KEY", " v ")
    assert files.setting(spark, "CONFAB_KEY", {"CONFAB_KEY": "file"}) == "v" and files.setting(spark, "NOPE", {"NOPE": " "}) is None
    spark.conf.set("spark.confab.CONFAB_KEY", "session")
    try:
        assert files.required_settings(spark, ["CONFAB_KEY"]) == {"CONFAB_KEY": "session"}
        with pytest.raises(ValueError, match="A_KEY, B_KEY"):
            files.required_settings(spark, ["A_KEY", "CONFAB_KEY", "B_KEY"], {"A_KEY": ""})
    finally:
        spark.conf.unset("spark.confab.CONFAB_KEY")


def test_env_files(spark, tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# head\nKEY_A = plain # note\nexport KEY_B='single # kept'\nKEY_C=\"a\\nb \\\"q\\\"\"\r\nKEY_D=\n KEY_A=last\nnot a line\nKEY_E=x#y\nKEY_F=#none\n")
    got = files.env_file(spark, f"file://{tmp_path}/.env")
    assert got == {"KEY_A": "last", "KEY_B": "single # kept", "KEY_C": 'a\nb "q"', "KEY_D": "", "KEY_E": "x#y", "KEY_F": ""}
    monkeypatch.setenv("KEY_B", "from the environment")
    assert files.setting(spark, "KEY_A", got) == "last" and files.setting(spark, "KEY_B", got) == "from the environment" and files.setting(spark, "KEY_D", got) is None
    assert files.env_file(spark, f"file://{tmp_path}/none") == {}


def test_stock_sentences_of_a_meeting_stay_its_own(spark):
    row = (1, "x", ("t", "s", "d", [report.NO_TOPICS["docx"]]), [], [], [("No next steps were identified", None, None, None, "open")])
    model = report.report_model(spark.createDataFrame([row], ANALYSIS), today=F.lit("d"))
    pieces = report.minutes_document(model).first()["parts"]
    assert ("bullet", report.NO_TOPICS["docx"]) in [(p["kind"], p["text"]) for p in pieces] and [p["kind"] for p in pieces if "next steps" in (p["text"] or "")] == ["bullet"]


def test_letters_that_a_pdf_loses_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Żółw é €", ("Ж中", "s", "d", ["x"]), [], [], []), (2, "é € “x”", ("t", "s", "d", ["x"]), [], [], [])], ANALYSIS)
    lost = {r["meeting_id"]: r["lost"] for r in sinks.export(rows, "transcript_pdf", f"file://{tmp_path}/p").collect()}
    assert lost == {1: 4, 2: 0} and {r["lost"] for r in sinks.export(rows, "transcript_docx", f"file://{tmp_path}/d").collect()} == {0}
    text = "Żółw é €Ж中\x85"
    assert spark.range(1).select(report.lost_characters(F.array(F.struct(F.lit("k").alias("kind"), F.lit(text).alias("text"), F.lit(None).cast("array<string>").alias("cells")))).alias("n")).first()["n"] == sum("?" == c.encode("cp1252", "replace").decode("cp1252") for c in text)


def test_display_gate_and_nested_text(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, " ", 1), (3, "b", None)], "id int, transcript string, summary int")
    assert [r["id"] for r in report.shown(df).collect()] == [1]
    row = spark.createDataFrame([([("hi", "0", 1.0, 2.0), ("yo", None, None, None)], "x"), ([], " y ")], f"s array<{segments.SEGMENT}>, t string")
    assert [r["t"] for r in row.select(segments.transcript_of(F.col("s"), F.col("t")).alias("t")).collect()] == ["Speaker 1 [00:01 - 00:02]\nhi\n\nSpeaker [--:-- - --:--]\nyo", "y"]
    a = spark.createDataFrame([(("t", None, None, None),)], "a struct<task:string,owner:string,due_date:string,timestamp:string>").select(report.card_action(F.col("a")).alias("x"))
    assert a.first()["x"] == "t | Unassigned | No due date | --:--"


def test_drop_folder_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("Speaker 1: hello")
    (inbox / "b.txt").write_text("Speaker 1: hello")
    for _ in range(2):
        drop_folder.ingest(drop_folder.read_drop_folder(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    rows = spark.createDataFrame([("2024-01-01 00:00:01", 1, "a"), ("2024-01-01 00:04:59", 1, "a"), ("2024-01-01 00:05:00", 1, "a")], "t string, meeting_id int, speaker_id string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r["turns"] for r in drop_folder.active_speakers(rows).collect()) == [1, 2]


def test_pdf_text_by_the_optional_library(spark, monkeypatch):
    import sys
    import types

    class Reader:
        def __init__(self, source):
            self.pages = [types.SimpleNamespace(extract_text=lambda t=t: t) for t in (" one ", None, "  ", "two")]

    assert files.extract("pdf", b"%PDF") in ((None, "PDF support is not installed."),) or "pypdf" in sys.modules
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    assert files.extract("pdf", b"%PDF") == ("one\n\ntwo", None) and files.extract("pdf", b"")[1] == "The uploaded transcript file is empty."
