"""Long texts by splits, keyed streams, the transcript format and committed documents."""

import os
import random
import subprocess
import sys
import textwrap
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from confab.functions.text import normalise
from confab.operators import metrics, segments
from confab.sources import documents, files, folder, sinks
from confab.streaming import drop_folder, keyed


def fold(text):
    """Segments by a plain loop over the lines of a normalised text."""
    import re

    header = re.compile(r"^((?:speaker|spk)\s*[\w.-]*)(?:\s*\[([^\]-]+)\s*-\s*([^\]]+)\])?\s*:?\s*(.*)$", re.I)
    out, head, body = [], None, []
    for line in [x.strip() for x in text.split("\n")] + ["speaker end"]:
        if not line:
            continue
        if m := header.match(line):
            if head is not None and body:
                out.append((head, " ".join(body)))
            head, body = line, [m[4].strip()] if m[4].strip() else []
        elif head is not None:
            body.append(line)
    return out


def random_text(r, lines):
    kinds = ["Speaker 1 [00:01 - 00:05]", "Speaker 2:", "spk 3: with words", "speaker x [1:02:03 - 9] and more", "plain words", "more words here", "", "  ", "x"]
    return "\n".join(r.choice(kinds) for _ in range(lines))


def test_slices_equal_the_fold(spark):
    r = random.Random(1)
    rows = [(k, random_text(r, r.randint(0, 40))) for k in range(300)]
    got = spark.createDataFrame(rows, "id int, t string").select("id", segments.parse_segments(normalise(F.col("t"))).alias("s")).collect()
    for row in got:
        assert [x["transcript"] for x in row["s"]] == [b for _, b in fold(rows[row["id"]][1])]


def as_rows(df):
    return sorted(tuple(r) for r in df.select("meeting_id", "seg_no", "speaker_id", "start_s", "end_s", "transcript").collect())


def test_splits_equal_the_fold(spark, monkeypatch):
    monkeypatch.setattr(segments, "SPLIT_LINES", 7)
    r = random.Random(2)
    rows = [(k, random_text(r, r.choice((0, 3, 30, 300)))) for k in range(60)] + [(99, "no header\nat all"), (98, "Speaker 1:\n" + "word\n" * 100)]
    df = spark.createDataFrame(rows, "meeting_id int, t string").select("meeting_id", normalise(F.col("t")).alias("t"))
    assert as_rows(segments.segments_of_lines(segments.lines_of_texts(df, "t"))) == as_rows(segments.explode_segments(df, "t"))


def test_a_file_of_a_million_lines(spark, tmp_path):
    lines = [f"Speaker {k % 5} [0:{k % 60:02d} - 1:00]" if k % 9 == 0 else f"line {k}" for k in range(1_000_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = segments.lines_of_files(spark, f"file://{tmp_path}/a.txt")
        assert rows.rdd.getNumPartitions() > 10
        got = segments.segments_of_lines(rows, "path").orderBy("seg_no").select("speaker_id", "transcript").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(str(max(0, k % 5 - 1)), " ".join(lines[k + 1 : k + 9])) for k in range(0, 1_000_000, 9) if k + 1 < 1_000_000]
    assert [tuple(x) for x in got] == want


def test_changed_rows_over_micro_batches_equal_the_batch_query(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKS)
    r = random.Random(3)
    schema = "user_id int, event_id int, ts timestamp, signature string"
    rows = [(r.randrange(4), k, 60 * k + r.randrange(60), r.choice("ab")) for k in range(90)]
    rows[10] = (None, *rows[10][1:])
    late = [(abs(k - 45) % 7 == 0, x) for k, x in enumerate(rows)]
    parts = [[x for slow, x in late[:30] if not slow], [x for slow, x in late[:30] if slow] + [x for slow, x in late[30:60] if not slow], [x for slow, x in late[30:60] if slow] + [x for _, x in late[60:]], [(77, 1000, 10**6, "end")]]
    source = tmp_path / "in"
    for k, part in enumerate(parts):
        d = spark.createDataFrame(part, "user_id int, event_id int, s long, signature string")
        d.select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "signature").coalesce(1).write.mode("append").parquet(str(source))
        q = keyed.changed_rows_stream(spark.readStream.schema(schema).parquet(str(source)), "signature", "user_id", "ts", ["event_id"], "40 minutes")
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    table = spark.read.parquet(str(source)).where("user_id is null or user_id <> 77")
    want = metrics.changed_rows(table, "signature", ["user_id"], ["ts", "event_id"]).select("event_id").collect()
    got = spark.read.parquet(str(tmp_path / "out")).where("user_id is null or user_id <> 77").select("event_id").collect()
    assert sorted(x[0] for x in got) == sorted(x[0] for x in want) and 20 < len(want) < 90


def test_keys_are_seen_once_over_micro_batches_and_failed_files_stay(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run():
        drop_folder.ingest(drop_folder.read_drop_folder(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted((r["path"].rpartition("/")[2], r["error"] is None) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for name, data in (("a", b"Speaker 1: hello"), ("b", b"Speaker 1: hello"), ("c", b"  "), ("d", b"\n"), ("e", b" \t"), ("f", b"\x81\x8d\x8f"), ("g", b"\x8d\x81\x90")):
        (inbox / f"{name}.txt").write_bytes(data)
    first = run()
    assert [n for n, _ in first][-5:] == ["c.txt", "d.txt", "e.txt", "f.txt", "g.txt"] and len(first) == 6 and sum(ok for _, ok in first) == 1
    (inbox / "h.txt").write_bytes(b"Speaker 1: hello\n")
    (inbox / "i.txt").write_bytes(b"Speaker 1: bye")
    (inbox / "j.txt").write_bytes(b" ")
    assert [n for n, _ in run()][-2:] == ["i.txt", "j.txt"] and len(run()) == 8


@pytest.fixture()
def inbox(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("﻿Speaker 1: hé")
    (tmp_path / "in" / "b.TXT").write_bytes("Speaker 2: x".encode("utf-16"))
    (tmp_path / "in" / "sub" / "c.docx").write_bytes(sinks.docx_bytes([{"kind": "paragraph", "text": "Speaker 1: a < b", "cells": None}]))
    (tmp_path / "in" / "d.rtf").write_text("x")
    (tmp_path / "in" / "e.txt").write_text("")
    (tmp_path / "in" / "_hidden.txt").write_text("x")
    return f"file://{tmp_path}/in"


def test_rejected_files_are_never_opened(spark, inbox, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not, StringEndsWith, StringStartsWith

    opened = []
    plain = folder.read_bytes
    monkeypatch.setattr(folder, "read_bytes", lambda path, system: opened.append(path.rpartition("/")[2]) or plain(path, system))

    def run(*filters):
        opened.clear()
        reader = folder.TranscriptFolder({"path": inbox}).reader(None)
        left = list(reader.pushFilters(list(filters)))
        return [r for p in reader.partitions() for r in reader.read(p)], left

    rows, _ = run()
    assert len(rows) == 5 and sorted(opened) == ["a.txt", "b.TXT", "c.docx"] and {r[5] for r in rows if r[1] == "rtf"} == {"Unsupported transcript file type."}
    other = GreaterThan(("modificationTime",), None)
    rows, left = run(EqualTo(("kind",), "txt"), GreaterThan(("length",), 0), other)
    assert sorted(opened) == ["a.txt", "b.TXT"] and left == [other] and len(rows) == 2
    run(In(("kind",), ("docx", "pdf")))
    assert opened == ["c.docx"]
    run(Not(StringEndsWith(("path",), "docx")), StringStartsWith(("path",), inbox.removeprefix("file://") + "/b"))
    assert opened == ["b.TXT"]


def test_partitions_have_about_equal_bytes():
    some = [folder.File(f"f{k}", "txt", (k % 7) * 3_000_000, 0) for k in range(200)]
    parts = folder.dealt(some, 32 << 20)
    sizes = [sum(f.length + folder.OPEN_COST for f in p.files) for p in parts]
    assert sorted(f.path for p in parts for f in p.files) == sorted(f.path for f in some) and max(sizes) < 1.2 * min(sizes) and max(sizes) < 48 << 20
    assert folder.dealt([], 10) == [folder.Files([])]


def test_format_in_batch_and_stream(spark, inbox, tmp_path):
    folder.register(spark)
    rows = spark.read.format("transcripts").option("path", inbox).option("partitionBytes", "1000000").load()
    got = {r["path"].rpartition("/")[2]: r for r in folder.transcripts(rows.where("kind <> 'rtf'")).collect()}
    assert set(got) == {"a.txt", "b.TXT", "c.docx", "e.txt"} and got["a.txt"]["segments"][0]["transcript"] == "hé" and got["c.docx"]["segments"][0]["transcript"] == "a < b" and "empty" in got["e.txt"]["error"]
    old = 1_600_000_000
    stream = lambda: spark.readStream.format("transcripts").option("path", inbox).option("settleSeconds", "0").load()

    def run():
        stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["path"].rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for k, (_, _, names) in enumerate(os.walk(inbox.removeprefix("file://"))):
        assert k < 3
    assert run() == ["a.txt", "b.TXT", "c.docx", "d.rtf", "e.txt"]
    (tmp_path / "in" / "new.txt").write_text("Speaker 1: new")
    (tmp_path / "in" / "before.txt").write_text("x")
    os.utime(tmp_path / "in" / "before.txt", (old, old))
    assert run() == ["a.txt", "b.TXT", "c.docx", "d.rtf", "e.txt", "new.txt"]


PIECES = "array<struct<kind:string,text:string,cells:array<string>>>"


def test_documents_are_listed_by_their_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{k}.docx", [("paragraph", f"text {k}\x0b\x00￾", None)]) for k in range(7)], f"name string, parts {PIECES}").repartition(3)
    uri = f"file://{tmp_path}/out"
    documents.write_documents(rows, "docx", uri)
    listed = documents.exported(spark, uri).collect()
    assert sorted(r["name"] for r in listed) == [f"m{k}.docx" for k in range(7)] and sorted(p.name for p in (tmp_path / "out").glob("*.docx")) == [f"m{k}.docx" for k in range(7)]
    assert all((tmp_path / "out" / r["name"]).stat().st_size == r["bytes"] for r in listed) and len({r["job"] for r in listed}) == 1
    from xml.etree import ElementTree

    assert ElementTree.fromstring(zipfile.ZipFile(tmp_path / "out" / "m1.docx").read("word/document.xml")) is not None
    assert files.docx_text((tmp_path / "out" / "m1.docx").read_bytes()) == "text 1"
    documents.write_documents(rows.where("false"), "docx", uri)
    assert documents.exported(spark, uri).count() == 7


JOB = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from confab.sources import documents
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
@F.udf("string")
def once(k):
    if k == 7 and (not os.path.exists({flag!r}) or {always}):
        open({flag!r}, "w").close()
        raise RuntimeError("lost")
    return f"text {{k}}"
rows = spark.range(0, 12, 1, 3).select(F.format_string("m%02d.pdf", "id").alias("name"), F.array(F.struct(F.lit("paragraph").alias("kind"), once(F.col("id")).alias("text"), F.lit(None).cast("array<string>").alias("cells"))).alias("parts"))
try:
    documents.write_documents(rows, "pdf", {uri!r})
    print("WRITTEN", documents.exported(spark, {uri!r}).count())
except Exception as e:
    print("FAILED", documents.exported(spark, {uri!r}).count())
"""


@pytest.mark.parametrize("always", [False, True])
def test_a_failed_task_leaves_one_file_and_a_failed_job_none(tmp_path, always):
    code = textwrap.dedent(JOB).format(repo=str(Path(__file__).resolve().parents[1]), flag=str(tmp_path / "died"), uri=f"file://{tmp_path}/out", always=always)
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    left = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and "_manifests" not in str(p)) if (tmp_path / "out").exists() else []
    if always:
        assert "FAILED 0" in got.stdout and left == [], got.stdout + got.stderr[-2000:]
    else:
        assert "WRITTEN 12" in got.stdout and left == [f"m{k:02d}.pdf" for k in range(12)] and (tmp_path / "died").exists(), got.stdout + got.stderr[-2000:]
