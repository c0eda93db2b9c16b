"""Speech-to-text batch jobs with a ledger: many files a job, polled until a deadline, restartable.

The ledger is a durable keyed table of what is known of each job.  Clips are dealt into jobs by
their content, so that a run after a restart makes the same jobs; jobs that the ledger holds are
not sent again, and finished ones are not asked again.  A job's key goes to the service with it,
so a service that knows it can refuse a repetition if the driver is lost between sending and
noting.  Calls and polls are several at once a partition, by :mod:`confab.operators.dispatch`: a
job that still runs waits in the heap and blocks no other.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.payload import batch_failure, parse_speech
from confab.operators.dispatch import Limits, Unavailable, dispatch
from confab.sources.answers import KeyedLog
from confab.sources.tables import written


class JobService(Protocol):
    """A service's batch interface; called from several threads."""

    def submit(self, reference: str, clips: dict[str, bytes], diarize: bool, speakers: int | None) -> str:
        """Sends a job's files by name; its id.  ``reference`` is the same whenever the same job is sent."""

    def state(self, job_id: str) -> str:
        """JSON of the job's state, with ``job_state`` (``Failed`` and ``Completed`` are final) and ``failed`` files."""

    def results(self, job_id: str) -> dict[str, str]:
        """JSON payloads of a completed job by file name."""


@dataclass(frozen=True)
class JobOptions:
    """Clips of a job, seconds between polls, seconds until a job is given up (long with diarization), calls at once."""

    clips: int = 20
    poll: float = 5.0
    deadline: float = 300.0
    deadline_diarized: float = 3600.0
    in_flight: int = 8
    diarize: bool = False
    speakers: int | None = None


class Ledger(KeyedLog):
    """By job key: ``stage`` (submitted, done, failed), the service's id, the state or the results, and why it failed."""

    columns, key = "job_key string, stage string, job_id string, results map<string,string>, error string", "job_key"

    def merged(self, rows: DataFrame, age: Column) -> DataFrame:
        """Of a job's entries the newest; a final one is never replaced by an earlier stage."""
        newest = F.struct((F.col("stage") != "submitted").alias("final"), age.alias("age"))
        names = ("stage", "job_id", "results", "error")
        last = rows.groupBy("job_key").agg(F.max_by(F.struct(*names), newest).alias("r"))
        return last.select("job_key", *[f"r.{n}" for n in names])


def dealt_jobs(clips: DataFrame, options: JobOptions) -> DataFrame:
    """(``path``, ``wav``, ``job_key``): equal paths and contents always meet in the same jobs; about ``options.clips`` in each."""
    n = max(1, -(-clips.count() // options.clips))
    part = F.pmod(F.xxhash64("path"), F.lit(n))
    own = clips.select("path", "wav", part.alias("part"), F.sha2("wav", 256).alias("digest"))
    names = own.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit("\0"), "digest"))), "\n"), 256).alias("job_key"))
    return own.join(names, "part").select("path", "wav", "job_key")


def submit(jobs: DataFrame, ledger: Ledger, factory: Callable[[], JobService], options: JobOptions) -> None:
    """Sends the jobs that the ledger doesn't hold, and notes them."""
    keys = jobs.select("job_key").distinct()
    unsent = jobs.join(ledger.rows(keys).select("job_key"), "job_key", "left_anti")
    grouped = unsent.groupBy("job_key").agg(F.collect_list(F.struct("path", "wav")).alias("clips"))  # options.clips about, as a job's request holds them

    def run(batches):
        import pandas as pd

        service, clips = None, {}

        def ask(key: str) -> str:
            files = {c["path"]: bytes(c["wav"]) for c in clips[key]}
            return service.submit(key, files, options.diarize, options.speakers)

        def requests():
            nonlocal service
            for b in batches:
                service = service or factory()
                for key, own in zip(b["job_key"], b["clips"]):
                    clips[key] = own
                    yield key, key

        for a in dispatch(requests(), ask, Limits(in_flight=options.in_flight)):
            clips.pop(a.key)
            yield pd.DataFrame([(a.key, "submitted" if a.error is None else "failed", a.response, None, a.error)], columns=names)

    names = ["job_key", "stage", "job_id", "results", "error"]
    sent = written(grouped.mapInPandas(run, Ledger.columns), "jobs-sent")
    # a job that could not be sent is not noted, so the next run sends it
    ledger.append(sent.where("stage = 'submitted'"))
    refused = sent.where("stage = 'failed'")
    if not refused.isEmpty():
        raise RuntimeError(refused.orderBy("job_key").first()["error"])


def collect(jobs: DataFrame, ledger: Ledger, factory: Callable[[], JobService], options: JobOptions) -> None:
    """Polls the jobs that are not final until they are or their deadline has passed, and notes what came of them."""
    keys = jobs.select("job_key").distinct()
    open_ = ledger.rows(keys).join(keys, "job_key", "left_semi").where("stage = 'submitted'").select("job_key", "job_id")
    deadline = options.deadline_diarized if options.diarize else options.deadline
    polls = int(deadline // options.poll)

    def run(batches):
        import pandas as pd

        service = None

        def ask(job_id: str) -> str:
            state = service.state(job_id)
            kind = str(json.loads(state).get("job_state", "")).lower()
            if kind == "completed":
                return json.dumps({"results": service.results(job_id)})
            if kind == "failed":
                return json.dumps({"state": state})
            raise Unavailable(f"503 {kind}")

        def requests():
            nonlocal service
            for b in batches:
                service = service or factory()
                yield from zip(b["job_key"], b["job_id"])

        for a in dispatch(requests(), ask, Limits(in_flight=options.in_flight, waiting=100_000, delays=(options.poll,) * polls)):
            got = json.loads(a.response) if a.response else {}
            late = a.error is not None and a.attempts > polls
            error = f"The job did not end within {deadline:g} seconds." if late else a.error
            yield pd.DataFrame([(a.key, got.get("state"), got.get("results"), error)], columns=["job_key", "state", "results", "error"])

    ended = written(open_.mapInPandas(run, "job_key string, state string, results map<string,string>, error string"), "jobs-ended")
    failed = F.coalesce("error", F.when(F.col("state").isNotNull(), batch_failure(F.col("state"))))
    noted = ended.join(open_, "job_key").select("job_key", F.when(failed.isNull(), F.lit("done")).otherwise(F.lit("failed")).alias("stage"), "job_id", "results", failed.alias("error"))
    ledger.append(noted)


def transcribed_in_jobs(clips: DataFrame, factory: Callable[[], JobService], ledger: Ledger, options: JobOptions = JobOptions()) -> DataFrame:
    """(``path``, ``transcript``, ``language_code``, ``segments``, ``error``) of (``path``, ``wav``) rows, as batch jobs.

    All files of a failed job have its first failed file's message; a file without a result says so.
    """
    jobs = written(dealt_jobs(clips, options), "clips")
    submit(jobs, ledger, factory, options)
    collect(jobs, ledger, factory, options)
    rows = jobs.select("path", "job_key").join(ledger.rows(jobs.select("job_key").distinct()), "job_key", "left")
    payload = rows.select("path", "error", F.try_element_at("results", F.col("path")).alias("payload"))
    got = payload.select("path", F.coalesce("error", F.when(F.col("payload").isNull(), F.lit("No transcript was found in the results."))).alias("failed"), parse_speech(F.col("payload")).alias("r"))
    field = lambda name: F.when(F.col("failed").isNull(), F.col(f"r.{name}")).alias(name)
    return got.select("path", *map(field, ("transcript", "language_code", "segments")), F.coalesce("failed", "r.error").alias("error"))
