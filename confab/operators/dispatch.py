"""Requests to a backend from one partition: several in flight, retries by due time, one rate budget.

A request that must wait goes into a heap ordered by when it is due; meanwhile others are sent.
What is in flight and what waits is bounded, so a partition of any length streams through.  The
budget of calls a second is shared by first calls and retries.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import NamedTuple, Protocol


class Unavailable(Exception):
    """Raised by a backend that should be asked again later."""


def status_of(error: Exception) -> int | None:
    """The status code that a backend's error carries in one way or another, read from its text at last."""
    for holder, name in ((error, "code"), (error, "status_code"), (getattr(error, "response", None), "status_code")):
        try:
            return int(getattr(holder, name, None))
        except (TypeError, ValueError):
            continue
    return 503 if "503" in str(error) else None


def is_unavailable(error: Exception) -> bool:
    """Whether asking again later can help."""
    return isinstance(error, Unavailable) or status_of(error) == 503 or "UNAVAILABLE" in str(error).upper()


@dataclass(frozen=True)
class Limits:
    """``in_flight`` calls at once, ``waiting`` requests that are to be asked again, the ``delays`` before
    each further call (their number bounds the calls), and calls ``per_second`` (None: no budget)."""

    in_flight: int = 4
    waiting: int = 1000
    delays: tuple[float, ...] = (2.0, 5.0, 10.0)
    per_second: float | None = None


class Answer(NamedTuple):
    key: str
    response: str | None
    error: str | None
    attempts: int


class Clock(Protocol):
    """Time as the dispatcher sees it; tests bring their own."""

    def now(self) -> float: ...

    def wait(self, running: set[Future], seconds: float | None) -> None:
        """Until one of ``running`` is done, or ``seconds`` (None: however long) have passed."""


class SystemClock:
    def now(self) -> float:
        return time.monotonic()

    def wait(self, running: set[Future], seconds: float | None) -> None:
        if running:
            wait(running, seconds, FIRST_COMPLETED)
        elif seconds:
            time.sleep(seconds)


class Job(NamedTuple):
    """Ordered by when it is due; jobs of one time keep their order."""

    due: float
    number: int
    key: str
    prompt: str
    attempt: int


class Schedule:
    """What to send next."""

    def __init__(self, requests: Iterable[tuple[str, str]], limits: Limits):
        self.fresh, self.limits = iter(requests), limits
        self.heap: list[Job] = []
        self.number, self.slot, self.more = 0, float("-inf"), True

    def _fresh(self, now: float) -> Job | None:
        if not self.more or len(self.heap) >= self.limits.waiting:
            return None
        got = next(self.fresh, None)
        if got is None:
            self.more = False
            return None
        self.number += 1
        return Job(now, self.number, *got, 1)

    def take(self, now: float) -> Job | None:
        """A retry that is due, else a fresh request; None if there is none or the budget has to recover."""
        if now < self.slot:
            return None
        job = heapq.heappop(self.heap) if self.heap and self.heap[0].due <= now else self._fresh(now)
        if job and self.limits.per_second:
            self.slot = max(self.slot, now) + 1 / self.limits.per_second
        return job

    def again(self, job: Job, now: float) -> bool:
        """Puts a failed job back; False if it has been asked often enough."""
        if job.attempt > len(self.limits.delays):
            return False
        heapq.heappush(self.heap, job._replace(due=now + self.limits.delays[job.attempt - 1], attempt=job.attempt + 1))
        return True

    def idle(self) -> bool:
        return not self.more and not self.heap

    def pause(self, now: float) -> float | None:
        """Seconds until :meth:`take` may give something; None if nothing is left to give."""
        open_ = self.more and len(self.heap) < self.limits.waiting
        due = now if open_ else self.heap[0].due if self.heap else None
        return None if due is None else max(0.0, due - now, self.slot - now)


def attempt(ask: Callable[[str], str | None], prompt: str) -> tuple[str | None, str | None, bool]:
    """(answer, error, whether to ask again) of one call."""
    try:
        answer = (ask(prompt) or "").strip()
    except Exception as e:  # noqa: BLE001  one row's failure is that row's error
        again = is_unavailable(e)
        return None, f"The backend is unavailable: {e}" if again else f"The backend failed: {e}", again
    return (answer, None, False) if answer else (None, "The backend gave an empty answer.", False)


def dispatch(requests: Iterable[tuple[str, str]], ask: Callable[[str], str | None], limits: Limits = Limits(), clock: Clock | None = None) -> Iterator[Answer]:
    """An answer for each (key, prompt), in the order in which they are final.

    ``ask`` is called from up to ``limits.in_flight`` threads.
    """
    clock = clock or SystemClock()
    schedule, running = Schedule(requests, limits), {}
    with ThreadPoolExecutor(limits.in_flight) as pool:
        while True:
            while len(running) < limits.in_flight and (job := schedule.take(clock.now())):
                running[pool.submit(attempt, ask, job.prompt)] = job
            if not running and schedule.idle():
                return
            clock.wait(set(running), schedule.pause(clock.now()) if len(running) < limits.in_flight else None)
            for f in [f for f in running if f.done()]:
                job, (answer, error, again) = running.pop(f), f.result()
                if not (again and schedule.again(job, clock.now())):
                    yield Answer(job.key, answer, error, job.attempt)
