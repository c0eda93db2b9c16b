"""Text-generation tasks over many meetings: prompts, pluggable backends, cache, typed results.

Each distinct cache key is generated once: requests are written with their keys, keys that the
cache holds are left out, the rest goes through the backend in one pass per partition (several
requests in flight, see :mod:`.dispatch`) and is written before anything reads it, so plan
rewrites never call the backend twice.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from confab.functions import payload as P
from confab.functions.checks import strict
from confab.functions.text import content_key, fill, strip, versioned_key
from confab.operators.dispatch import Limits, Unavailable, attempt, dispatch, is_unavailable, status_of
from confab.sources.answers import AnswerStore
from confab.sources.tables import work_path, written

__all__ = ["Backend", "BaseSummarizer", "Calls", "Constant", "Limits", "ModelBackend", "Options", "Summarizer", "Unavailable", "is_unavailable", "status_of", "with_retries"]


class Backend(Protocol):
    """``generate`` answers one prompt; built once per partition by the factory that tasks take, asked from several threads."""

    def generate(self, prompt: str, *, system_prompt: str | None = None) -> str: ...


class ModelBackend:
    """A backend around any client: ``call(model, prompt, system_prompt, temperature)`` returns the text."""

    def __init__(self, call: Callable[[str, str, str | None, float], str], model: str, temperature: float = 0.2):
        self.call, self.model, self.temperature = call, model, temperature

    def generate(self, prompt: str, *, system_prompt: str | None = None) -> str:
        return self.call(self.model, prompt, system_prompt, self.temperature)


# Templates in our own words; `{transcript}` is where the text goes.
_HEAD = "You prepare minutes of a meeting. Use only what the transcript says.\n<transcript>\n{transcript}\n</transcript>\n"
TEMPLATES = {
    "cleanup": _HEAD + "Return the transcript with spelling and punctuation repaired, all speaker headers kept as they are.",
    "summary": _HEAD + "Return a JSON object with title, short_summary, detailed_summary and the list topics_discussed.",
    "action_items": _HEAD + "Return a JSON object with the list action_items of {task, owner, due_date, timestamp, status}.",
    "decisions": _HEAD + "Return a JSON object with the list decisions of {decision, owner, timestamp, confidence}; confidence is high, medium or low.",
    "key_discussion_points": _HEAD + "Return a JSON object with the list key_discussion_points of {point, speakers, timestamp}.",
    "analysis": _HEAD + "Return one JSON object with cleaned_transcript, summary {title, short_summary, detailed_summary}, topics_discussed, key_discussion_points, decisions and action_items.",
}
PARSERS: dict[str, Callable[[Column, Column], Column]] = {
    "cleanup": P.parse_cleanup,
    "summary": lambda r, t: P.parse_summary(r),
    "action_items": lambda r, t: P.parse_items(r, P.ACTIONS),
    "decisions": lambda r, t: P.parse_items(r, P.DECISIONS),
    "key_discussion_points": lambda r, t: P.parse_items(r, P.POINTS),
    "analysis": P.parse_analysis,
}
EMPTY = "Transcript is empty."


@dataclass(frozen=True)
class Options:
    """Templates by task, the system prompt, and how a backend is asked.

    ``limits`` hold for each partition, ``limits.per_second`` for all together: with a budget the requests go
    through ``lanes`` partitions, and each has its share of it.  ``strict``: a failed check is an exception.
    """

    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    system_prompt: str | None = None
    limits: Limits = Limits()
    lanes: int = 32
    strict: bool = False

    @classmethod
    def from_folder(cls, spark: SparkSession, path: str, **more) -> Options:
        """Templates from the UTF-8 files ``<task>.md`` of a folder; tasks without a file keep their own."""
        files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("task"))
        found = {r["task"]: r["value"] for r in files.where(F.col("task").isin(list(TEMPLATES))).collect()}  # one row a task
        return cls(templates=TEMPLATES | found, **more)


class Constant:
    """Backend that always gives one answer."""

    def __init__(self, answer: str):
        self.answer = answer

    def generate(self, prompt: str, *, system_prompt: str | None = None) -> str:
        return self.answer


def with_retries(backend: Backend, delays: tuple[float, ...], sleep=time.sleep) -> Callable[[str, str | None], tuple[str | None, str | None]]:
    """(answer, error) of a prompt by itself; only errors that say so are tried again, after the ``delays``."""

    def ask(prompt: str, system_prompt: str | None):
        for wait in (*delays, None):
            answer, error, again = attempt(lambda p: backend.generate(p, system_prompt=system_prompt), prompt)
            if wait is None or not again:
                return answer, error
            sleep(wait)

    return ask


@dataclass
class Calls:
    """What one run asked for, filled when its answers are written: observed on the rows as they are written,
    so that a task which is run again counts once."""

    keys: int = 0
    hits: int = 0
    asked: int = 0
    calls: int = 0
    retries: int = 0
    failed: int = 0


def generate(prompts: DataFrame, factory: Callable[[], Backend], options: Options = Options(), calls: Calls | None = None) -> DataFrame:
    """(``cache_key``, ``response``, ``backend_error``, ``attempts``) of (``cache_key``, ``prompt``); written once."""
    system_prompt, limits, src = options.system_prompt, options.limits, prompts.select("cache_key", "prompt")
    if limits.per_second:
        src, limits = src.repartition(options.lanes, "cache_key"), replace(limits, per_second=limits.per_second / options.lanes)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        backend = None

        def ask(prompt: str) -> str:
            return backend.generate(prompt, system_prompt=system_prompt)

        def requests():
            nonlocal backend
            for b in batches:
                backend = backend or factory()
                yield from zip(b["cache_key"], b["prompt"])

        done = []
        for answer in dispatch(requests(), ask, limits):
            done.append(answer)
            if len(done) == 256:
                yield pd.DataFrame(done, columns=names)
                done = []
        yield pd.DataFrame(done, columns=names)

    names = ["cache_key", "response", "backend_error", "attempts"]
    made = src.mapInPandas(run, "cache_key string, response string, backend_error string, attempts int")
    seen = Observation()
    out = written(made.observe(seen, F.count("*").alias("asked"), F.sum("attempts").alias("calls"), F.sum(F.col("attempts") - 1).alias("retries"), F.count("backend_error").alias("failed")), "responses")
    if calls is not None:
        for name, n in seen.get.items():
            setattr(calls, name, n or 0)
    return out


def request_keys(meetings: DataFrame, task: str, options: Options = Options(), text_col: str = "transcript_text") -> DataFrame:
    """``meetings`` with ``cache_key``: a hash of template, system prompt and trimmed text."""
    return meetings.withColumn("cache_key", versioned_key(options.templates[task], options.system_prompt, strip(F.col(text_col))))


def misses(requests: DataFrame, cache: DataFrame | None) -> DataFrame:
    """One row per key that the cache doesn't hold."""
    distinct = requests.dropDuplicates(["cache_key"])
    return distinct if cache is None else distinct.join(cache.select("cache_key"), "cache_key", "left_anti")


def _unknown(requests: DataFrame, known: DataFrame | None, seen: Observation) -> DataFrame:
    """One row per key that ``known`` (distinct keys) doesn't hold; how many keys there are, and how many it holds, is observed."""
    distinct = requests.dropDuplicates(["cache_key"])
    found = distinct.withColumn("_hit", F.lit(False)) if known is None else distinct.join(known.select("cache_key", F.lit(True).alias("_hit")), "cache_key", "left")
    return found.observe(seen, F.count("*").alias("keys"), F.count_if("_hit").alias("hits")).where("not coalesce(_hit, false)").drop("_hit")


def run_task(
    meetings: DataFrame, task: str, factory: Callable[[], Backend], options: Options = Options(), cache: DataFrame | AnswerStore | None = None, by: str = "meeting_id", text_col: str = "transcript_text",
    calls: Calls | None = None,
) -> tuple[DataFrame, DataFrame | AnswerStore]:
    """(results, cache with what is new): per meeting the parsed fields of the task and ``error``.

    A store is appended to, and plans do not grow with its age; a DataFrame comes back as a larger one.
    """
    keyed = written(request_keys(meetings.select(by, F.coalesce(F.col(text_col), F.lit("")).alias("text")), task, options, "text"), "requests")
    text, store = strip(F.col("text")), isinstance(cache, AnswerStore)
    wanted = keyed.where(text != "")
    known = cache.answers(wanted) if store else cache.dropDuplicates(["cache_key"]) if cache is not None else None
    seen = Observation()
    asked = _unknown(wanted, known, seen).select("cache_key", fill(options.templates[task], text).alias("prompt"))
    new = generate(asked, factory, options, calls)
    if calls is not None:
        calls.keys, calls.hits = seen.get["keys"], seen.get["hits"]
    good = new.where("response is not null").select("cache_key", "response")
    if store:
        cache.append(good)
        kept, answers = cache, cache.answers(wanted)
    else:
        kept = answers = good if cache is None else cache.select("cache_key", "response").unionByName(good)
    failures = new.select("cache_key", "backend_error").where("backend_error is not null")
    joined = keyed.join(answers, "cache_key", "left").join(failures, "cache_key", "left")
    got = joined.select(by, "cache_key", F.when(text == "", F.lit(EMPTY)).otherwise(F.col("backend_error")).alias("_before"), PARSERS[task](F.col("response"), text).alias("_r"))
    names = [f.name for f in got.schema["_r"].dataType.fields if f.name != "error"]
    out = got.select(by, "cache_key", *[F.when(F.col("_before").isNull(), F.col(f"_r.{n}")).alias(n) for n in names], F.coalesce("_before", "_r.error").alias("error"))
    return strict(out) if options.strict else out, kept


class BaseSummarizer(ABC):
    """The six verbs that anything which summarises meetings has; each takes meetings and returns a row for each."""

    @abstractmethod
    def cleanup_transcript(self, meetings: DataFrame | str | list[str]) -> DataFrame: ...

    @abstractmethod
    def generate_meeting_summary(self, meetings: DataFrame | str | list[str]) -> DataFrame: ...

    @abstractmethod
    def extract_action_items(self, meetings: DataFrame | str | list[str]) -> DataFrame: ...

    @abstractmethod
    def extract_decisions(self, meetings: DataFrame | str | list[str]) -> DataFrame: ...

    @abstractmethod
    def extract_key_discussion_points(self, meetings: DataFrame | str | list[str]) -> DataFrame: ...

    @abstractmethod
    def analyze_meeting(self, meetings: DataFrame | str | list[str]) -> DataFrame: ...


class Summarizer(BaseSummarizer):
    """The six verbs over meetings, with a durable cache for full analyses.

    Meetings are a DataFrame with ``meeting_id`` and ``transcript_text``, or texts (numbered from 0).
    Without a ``store`` the cache lives in the shared work folder.
    """

    def __init__(self, factory: Callable[[], Backend], options: Options = Options(), store: AnswerStore | None = None):
        self.factory, self.options, self.store, self.calls = factory, options, store, Calls()

    @property
    def cache(self) -> DataFrame:
        """(``cache_key``, ``response``) of what has been answered."""
        return self.store.answers()

    @staticmethod
    def meetings(given: DataFrame | str | list[str]) -> DataFrame:
        if isinstance(given, DataFrame):
            return given
        texts = [given] if isinstance(given, str) else list(given)
        return SparkSession.active().createDataFrame(list(enumerate(texts)), "meeting_id long, transcript_text string")

    def _one(self, meetings: DataFrame | str | list[str], task: str) -> DataFrame:
        self.calls = Calls()
        return run_task(self.meetings(meetings), task, self.factory, self.options, calls=self.calls)[0]

    def cleanup_transcript(self, meetings: DataFrame) -> DataFrame:
        return self._one(meetings, "cleanup")

    def generate_meeting_summary(self, meetings: DataFrame) -> DataFrame:
        return self._one(meetings, "summary")

    def extract_action_items(self, meetings: DataFrame) -> DataFrame:
        return self._one(meetings, "action_items")

    def extract_decisions(self, meetings: DataFrame) -> DataFrame:
        return self._one(meetings, "decisions")

    def extract_key_discussion_points(self, meetings: DataFrame) -> DataFrame:
        return self._one(meetings, "key_discussion_points")

    def analyze_meeting(self, meetings: DataFrame) -> DataFrame:
        rows = self.meetings(meetings)
        self.store = self.store or AnswerStore(rows.sparkSession, work_path(rows.sparkSession, "answers"))
        self.calls = Calls()
        return run_task(rows, "analysis", self.factory, self.options, self.store, calls=self.calls)[0]


def analysis_key(text: Column) -> Column:
    """The cache key of a session: a hash of the trimmed text alone."""
    return content_key(text)
