"""Batch jobs with a ledger, functions of SQL, metrics by increments."""

import json
import random

import pytest
from pyspark.sql import functions as F

from confab.functions import sql
from confab.functions.text import normalise
from confab.operators import increments, metrics, segments
from confab.sources import jobs


@pytest.fixture()
def service(tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    class Service:
        """Keeps its jobs in files; a job is done at the third poll, jobs with a clip ``bad`` fail."""

        def submit(self, reference, clips, diarize, speakers):
            path = log / reference
            with open(log / "submitted", "a") as f:
                f.write(f"{reference}\n")
            path.write_text(json.dumps({n: len(b) for n, b in clips.items()}))
            return f"id-{reference}"

        def state(self, job_id):
            polls = log / f"{job_id}.polls"
            with open(polls, "a") as f:
                f.write("x")
            n, clips = len(polls.read_text()), json.loads((log / job_id[3:]).read_text())
            if (log / "never").exists() or n < 3:
                return json.dumps({"job_state": "Running"})
            failed = [{"error_message": f"{name} is broken"} for name in sorted(clips) if "bad" in name]
            return json.dumps({"job_state": "Failed" if failed else "Completed", "failed": failed})

        def results(self, job_id):
            clips = json.loads((log / job_id[3:]).read_text())
            return {n: json.dumps({"transcript": f"{k} bytes", "language_code": "en"}) for n, k in clips.items() if "lost" not in n}

    return Service, log


def test_jobs_are_sent_once_and_collected_after_a_restart(spark, tmp_path, service):
    make, log = service
    clips = spark.createDataFrame([(f"c{k:02d}.wav", bytearray(b"x" * k)) for k in range(23)] + [("lost.wav", bytearray(b"y"))], "path string, wav binary")
    options = jobs.JobOptions(clips=6, poll=0.05, deadline=20)
    ledger = lambda: jobs.Ledger(spark, f"file://{tmp_path}/ledger")  # noqa: E731  a new one each time, as after a restart
    jobs.submit(jobs.dealt_jobs(clips, options), ledger(), make, options)  # and then the driver was lost
    sent = (log / "submitted").read_text().split()
    assert len(sent) == len(set(sent)) > 2
    got = {r["path"]: r for r in jobs.transcribed_in_jobs(clips, make, ledger(), options).collect()}
    assert (log / "submitted").read_text().split() == sent
    assert all(got[f"c{k:02d}.wav"]["transcript"] == f"{k} bytes" and got[f"c{k:02d}.wav"]["error"] is None for k in range(23)) and "No transcript" in got["lost.wav"]["error"]
    polls = sum(len(p.read_text()) for p in log.glob("*.polls"))
    assert jobs.transcribed_in_jobs(clips, make, ledger(), options).count() == 24 and polls == sum(len(p.read_text()) for p in log.glob("*.polls")) == 3 * len(sent)


def test_failed_and_endless_jobs(spark, tmp_path, service):
    make, log = service
    options = jobs.JobOptions(clips=10, poll=0.02, deadline=0.2)
    clips = spark.createDataFrame([("a.wav", bytearray(b"x")), ("bad1.wav", bytearray(b"x")), ("bad0.wav", bytearray(b"x"))], "path string, wav binary")
    rows = jobs.transcribed_in_jobs(clips, make, jobs.Ledger(spark, f"file://{tmp_path}/a"), options).collect()
    assert {r["error"] for r in rows} == {"bad0.wav is broken"} and {r["transcript"] for r in rows} == {None}
    (log / "never").write_text("")
    rows = jobs.transcribed_in_jobs(clips.where("path = 'a.wav'"), make, jobs.Ledger(spark, f"file://{tmp_path}/b"), options).collect()
    assert [r["error"] for r in rows] == ["The job did not end within 0.2 seconds."]


TEXTS = ["Speaker 1: hello\nyou\nSpeaker 2 [0:01 - 0:02]\nbye", "", "no header", None, "speaker 7 [1:02:03 - 9.5] x\n\n\nspk b:\ny", "it's 'quoted' \\ and\r\nSpeaker 1 [00:00 - 10:00]\n- (a) = b"]


def test_functions_of_sql_equal_the_columns(spark):
    names = sql.register(spark)
    answer = json.dumps({"decisions": [{"decision": "d", "confidence": "HIGH"}], "action_items": [{"task": "t", "status": "open"}], "key_discussion_points": [{"point": "p", "speakers": ["a"]}], "title": "t", "short_summary": "s", "detailed_summary": "d", "topics_discussed": ["x"]})
    rows = [(k, t) for k, t in enumerate([*TEXTS, answer, "```json\n" + answer + "\n```", "12:30", "75.4", "not json", json.dumps({"decisions": [7]}), json.dumps({"transcript": "x", "diarized_transcript": {"entries": [{"transcript": "a", "speaker_id": "0"}]}})])]
    df = spark.createDataFrame(rows, "id int, t string")
    df.createOrReplaceTempView("sql_texts")
    for name, (arguments, make) in sql.SCALARS.items():
        kinds = [a.split()[1] for a in arguments.split(", ")]
        own = [F.col("t").try_cast(kind.lower()) for kind in kinds]
        called = ", ".join("try_cast(t AS DOUBLE)" if kind == "DOUBLE" else "t" for kind in kinds)
        want = df.select("id", make(*own).alias("x")).collect()
        assert spark.sql(f"SELECT id, confab_{name}({called}) AS x FROM sql_texts").collect() == want, name
    assert len(names) == len(sql.SCALARS) + len(sql.TABLES)
    got = spark.sql("SELECT id, s.* FROM sql_texts, LATERAL confab_segments(sql_texts.t) AS s")
    want = segments.explode_segments(df, "t", "id")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect())) and got.count() > 4
    assert spark.sql("SELECT d.decision, d.confidence FROM sql_texts, LATERAL confab_decisions(t) AS d").collect() == [("d", "high"), ("d", "high")]
    assert spark.sql("SELECT a.task, p.point, s.transcript FROM sql_texts, LATERAL confab_action_items(t) a, LATERAL confab_discussion_points(t) p LEFT JOIN LATERAL confab_speech_segments(t) s").count() == 0
    assert "PythonUDF" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_increments_in_any_order_equal_the_whole(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(12), k, r.choice([None, "0", "1", "Host"]), r.choice([None, float(k)]), r.choice([None, float(k) + 0.5])) for k in range(400)] + [(50, 0, None, None, None)]
    whole = spark.createDataFrame(rows, "meeting_id long, seg_no int, speaker_id string, start_s double, end_s double")
    want = sorted(tuple(x) for x in metrics.meeting_metrics(whole).select("meeting_id", "duration_s", "speakers", "turns", "timed_turns", "duration").collect())
    for order in ([0, 1, 2, 3, 4], [3, 0, 4, 2, 1]):
        store = increments.MetricStore(spark, f"file://{tmp_path}/{order[0]}", most_live=3)
        for k in order:
            assert store.add(whole.where(F.col("seg_no") % 5 == k), f"increment {k}")
        assert not store.add(whole.where("seg_no % 5 = 0"), "increment 0")
        got = increments.MetricStore(spark, f"file://{tmp_path}/{order[0]}").metrics()
        assert sorted(tuple(x) for x in got.select("meeting_id", "duration_s", "speakers", "turns", "timed_turns", "duration").collect()) == want
    some = store.metrics(spark.createDataFrame([(3,)], "meeting_id long")).where("meeting_id = 3")
    assert [tuple(x)[0] for x in some.select("meeting_id").collect()] == [3]


def test_normalised_texts_are_parsed_alike(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [len(r["s"] or []) for r in df.select(segments.parse_segments(normalise(F.col("t"))).alias("s")).collect()] == [2, 0, 0, 0, 2, 1]
