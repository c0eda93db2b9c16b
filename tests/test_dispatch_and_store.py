"""Dispatch of requests, the durable answer store, call counts and strict mode."""

import subprocess
import sys
import textwrap
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from confab.functions.checks import strict
from confab.operators import tasks
from confab.operators.dispatch import Answer, Limits, Schedule, Unavailable, dispatch
from confab.sources.answers import AnswerStore


class FakeClock:
    """Time that passes only while nothing runs."""

    def __init__(self):
        self.t, self.waits = 0.0, []

    def now(self):
        return self.t

    def wait(self, running, seconds):
        if running:
            from concurrent.futures import FIRST_COMPLETED, wait

            wait(running, 10, FIRST_COMPLETED)
        else:
            self.waits.append(seconds)
            self.t += seconds


def failing(times: dict):
    """A backend whose answers to a prompt come after so many failures."""
    left, calls = dict(times), []

    def ask(prompt):
        calls.append(prompt)
        if left.get(prompt, 0) > 0:
            left[prompt] -= 1
            raise Unavailable("503")
        return f"<{prompt}>"

    return ask, calls


def test_a_waiting_request_does_not_block_the_others():
    ask, calls = failing({"a": 2})
    clock = FakeClock()
    got = list(dispatch([("a", "a"), ("b", "b"), ("c", "c")], ask, Limits(in_flight=1), clock))
    assert calls == ["a", "b", "c", "a", "a"] and clock.waits == [2.0, 5.0]
    assert got == [Answer("b", "<b>", None, 1), Answer("c", "<c>", None, 1), Answer("a", "<a>", None, 3)]


def test_retries_come_in_order_of_their_due_time_and_end():
    ask, calls = failing({"a": 9, "b": 1})
    clock = FakeClock()
    got = {a.key: a for a in dispatch([("a", "a"), ("b", "b")], ask, Limits(in_flight=1), clock)}
    assert got["b"] == Answer("b", "<b>", None, 2) and got["a"].attempts == 4 and got["a"].response is None and "unavailable" in got["a"].error
    assert calls == ["a", "b", "a", "b", "a", "a"] and clock.t == 17.0
    assert [a.error for a in dispatch([("x", "x"), ("y", "y")], lambda p: "" if p == "x" else 1 / 0, Limits(), FakeClock())][0] in ("The backend gave an empty answer.", "The backend failed: division by zero")


def test_no_more_requests_run_or_wait_than_allowed():
    lock, gate, running, most = threading.Lock(), threading.Barrier(3, timeout=10), 0, 0

    def ask(prompt):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        gate.wait()
        with lock:
            running -= 1
        return prompt

    assert len(list(dispatch(((str(k), "x") for k in range(30)), ask, Limits(in_flight=3)))) == 30 and most == 3
    taken = []

    def requests():
        for k in range(50):
            taken.append(k)
            yield str(k), f"p{k}"

    schedule = Schedule(requests(), Limits(waiting=5, delays=(10.0,)))
    while job := schedule.take(0.0):
        schedule.again(job, 0.0)
    assert len(taken) == 5 and schedule.pause(0.0) == 10.0 and schedule.take(10.0).key == "0"


def test_first_calls_and_retries_share_the_rate():
    ask, _ = failing({"p3": 1})
    clock = FakeClock()
    assert len(list(dispatch([(str(k), f"p{k}") for k in range(10)], ask, Limits(in_flight=1, per_second=4.0, delays=(0.1,)), clock))) == 10
    assert clock.t == pytest.approx(11 / 4)  # a quarter of a second after each of eleven calls, the last one too


def test_store_keeps_the_latest_entry_and_reads_only_what_is_asked_for(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "cache_key string, response string")
    store = AnswerStore(spark, f"file://{tmp_path}/s", most_live=3)
    assert store.answers().count() == 0
    store.append(rows(("00a", "1"), ("01b", "1"), ("ffc", "1")))
    store.append(rows(("00a", "2"), ("07d", "2")))
    again = AnswerStore(spark, f"file://{tmp_path}/s", most_live=3)
    assert {tuple(r) for r in again.answers().collect()} == {("00a", "2"), ("01b", "1"), ("ffc", "1"), ("07d", "2")}
    some = again.answers(rows(("00z", None), ("07d", None)))
    assert {tuple(r) for r in some.collect()} == {("00a", "2"), ("07d", "2")} and len(some.inputFiles()) >= 1
    assert "PartitionFilters: [prefix" in some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for k in range(5):
        again.append(rows(("ffc", f"n{k}")))
    assert len(store.live()[1]) <= 3 and {r["cache_key"]: r["response"] for r in store.answers().collect()} == {"00a": "2", "01b": "1", "ffc": "n4", "07d": "2"}
    store.vacuum()
    assert len(list((tmp_path / "s" / "data").iterdir())) == len(store.live()[1]) and store.answers().count() == 4


def test_of_two_writers_none_is_lost(spark, tmp_path):
    rows = lambda k: spark.createDataFrame([(k, k)], "cache_key string, response string")
    stores = [AnswerStore(spark, f"file://{tmp_path}/s") for _ in range(4)]
    threads = [threading.Thread(target=s.append, args=(rows(f"k{k}"),)) for k, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["cache_key"] for r in stores[0].answers().collect()) == ["k0", "k1", "k2", "k3"] and stores[0].live()[0] == 4
    # a compaction that began before another append keeps what was appended
    first, second = stores[:2]
    _, old = first.live()
    name = first._write(first._read(old))
    second.append(rows("k9"))
    first._replace(old, name)
    assert len(first.live()[1]) == 2 and first.answers().count() == 5
    assert first.append(rows("k5"), "day 5") and not second.append(rows("k6"), "day 5") and first.answers().count() == 6
    first.compact()
    assert not first.append(rows("k6"), "day 5") and len(first.live()[1]) == 1


def test_runs_and_a_restart_ask_each_key_once(spark, tmp_path):
    log = tmp_path / "calls"

    class Counting:
        def generate(self, prompt, *, system_prompt=None):
            with open(log, "a") as f:
                f.write("x")
            return '{"decisions": []}'

    meetings = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "meeting_id int, transcript_text string")
    plans, counts = [], []
    for texts in (("a", "b", "a "), ("b", "c"), ("a", "c", "d"), ("d", "a")):
        store, calls = AnswerStore(spark, f"file://{tmp_path}/s"), tasks.Calls()  # a new one each time, as after a restart
        out, kept = tasks.run_task(meetings(*texts), "decisions", Counting, cache=store, calls=calls)
        assert out.where("error is null").count() == len(texts) and kept is store
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        counts.append((calls.keys, calls.hits, calls.asked, calls.calls, calls.retries, calls.failed))
    assert len(log.read_text()) == 4 and len(set(plans)) == 1
    assert counts == [(2, 0, 2, 2, 0, 0), (2, 1, 1, 1, 0, 0), (3, 2, 1, 1, 0, 0), (2, 2, 0, 0, 0, 0)]


COUNTS = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from confab.operators import tasks
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
class Flaky:
    def __init__(self):
        self.seen = {{}}
    def generate(self, prompt, *, system_prompt=None):
        if "m7" in prompt and not os.path.exists({flag!r}):
            open({flag!r}, "w").close()
            os._exit(1)
        self.seen[prompt] = self.seen.get(prompt, 0) + 1
        if "m3" in prompt and self.seen[prompt] == 1:
            raise tasks.Unavailable("503")
        if "m5" in prompt:
            raise ValueError("no")
        return '{{"decisions": []}}'
m = spark.createDataFrame([(k, f"m{{k}}") for k in range(10)], "meeting_id int, transcript_text string").repartition(4)
calls = tasks.Calls()
out, kept = tasks.run_task(m, "decisions", Flaky, tasks.Options(limits=tasks.Limits(delays=(0.01,))), calls=calls)
print("COUNTS", calls.keys, calls.hits, calls.asked, calls.calls, calls.retries, calls.failed, kept.count(), os.path.exists({flag!r}))
"""


def test_counts_are_right_when_a_task_dies_once(tmp_path):
    code = textwrap.dedent(COUNTS).format(repo=str(Path(__file__).resolve().parents[1]), flag=str(tmp_path / "died"))
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert "COUNTS 10 0 10 11 1 1 9 True" in got.stdout, got.stdout + got.stderr[-2000:]


def test_strict_mode_cannot_be_optimised_away(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], "meeting_id int, transcript_text string")
    answer = '{"decisions": [{"decision": "x", "confidence": "sure"}]}'
    lenient, _ = tasks.run_task(m, "decisions", lambda: tasks.Constant(answer))
    words = lenient.first()["error"]
    rows, _ = tasks.run_task(m, "decisions", lambda: tasks.Constant(answer), tasks.Options(strict=True))
    for ask in (lambda d: d.count(), lambda d: d.where("meeting_id = 7").count(), lambda d: d.select(F.lit(1)).agg(F.sum("1")).collect(), lambda d: d.join(m.where("meeting_id = 1"), "meeting_id").count(), lambda d: d.limit(1).collect()):
        with pytest.raises(Exception) as e:
            ask(rows)
        assert "invalid confidence 'sure'" in words and words in str(e.value)
    good = strict(spark.createDataFrame([(1, None)], "meeting_id int, error string"))
    assert good.count() == 1
