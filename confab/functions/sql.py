"""The parsers and validators as functions of SQL.

The functions are SQL-defined: their bodies are the library's own column expressions, rendered as
SQL text, so a query written in SQL alone gets the same plan as one of the DataFrame API.  Table
functions give rows, for ``LATERAL`` joins.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from confab.functions import clock, payload, text
from confab.operators import metrics, segments

#: A text or quoted name, or an operator that is written as a function.
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|(?<=[\s(,])(<=>|<=|>=|==|!=|=|<|>|\+|-|\*|/|%|!|and|or|not|in)\(", re.S)


def rendered(c: Column) -> str:
    """SQL text of a column expression over named columns."""
    return _TOKEN.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], " " + c._jc.node().sql()).strip()


#: Scalar functions: arguments (DDL), and the column of them.
SCALARS: dict[str, tuple[str, Callable[..., Column]]] = {
    "normalise": ("t STRING", text.normalise),
    "rule_cleanup": ("t STRING", text.rule_cleanup),
    "content_key": ("t STRING", text.content_key),
    "speaker_label": ("speaker_id STRING", segments.speaker_label),
    "parse_clock": ("t STRING", clock.parse_clock),
    "format_clock": ("seconds DOUBLE", clock.format_clock),
    "format_elapsed": ("seconds DOUBLE", clock.format_elapsed),
    "header_count": ("t STRING", segments.header_count),
    "text_duration": ("t STRING", metrics.duration_of_text),
    "text_speakers": ("t STRING", metrics.speakers_of_text),
    "parse_summary": ("response STRING", payload.parse_summary),
    "parse_decisions": ("response STRING", lambda r: payload.parse_items(r, payload.DECISIONS)),
    "parse_actions": ("response STRING", lambda r: payload.parse_items(r, payload.ACTIONS)),
    "parse_points": ("response STRING", lambda r: payload.parse_items(r, payload.POINTS)),
    "parse_cleanup": ("response STRING, original STRING", payload.parse_cleanup),
    "parse_analysis": ("response STRING, original STRING", payload.parse_analysis),
    "parse_speech": ("payload STRING", payload.parse_speech),
}
_SEGMENT = "s.speaker_id, s.start_time_seconds, s.end_time_seconds, s.transcript"
#: Table functions: arguments, what they return, the array whose elements are rows, and the columns of an element ``s``.
TABLES: dict[str, tuple[str, str, Callable[..., Column], str]] = {
    "segments": ("t STRING", "seg_no INT, speaker_id STRING, start_s DOUBLE, end_s DOUBLE, transcript STRING", lambda t: segments.parse_segments(text.normalise(t)), _SEGMENT),
    "speech_segments": ("payload STRING", "seg_no INT, speaker_id STRING, start_s DOUBLE, end_s DOUBLE, transcript STRING", lambda p: payload.parse_speech(p)["segments"], _SEGMENT),
    "decisions": ("response STRING", "ord INT, decision STRING, owner STRING, timestamp STRING, confidence STRING", lambda r: payload.parse_items(r, payload.DECISIONS)["items"], "s.decision, s.owner, s.timestamp, s.confidence"),
    "action_items": ("response STRING", "ord INT, task STRING, owner STRING, due_date STRING, timestamp STRING, status STRING", lambda r: payload.parse_items(r, payload.ACTIONS)["items"], "s.task, s.owner, s.due_date, s.timestamp, s.status"),
    "discussion_points": ("response STRING", "ord INT, point STRING, speakers ARRAY<STRING>, timestamp STRING", lambda r: payload.parse_items(r, payload.POINTS)["items"], "s.point, s.speakers, s.timestamp"),
}


def _body(arguments: str, make: Callable[..., Column], of: str | None = None) -> str:
    names = [a.split()[0] for a in arguments.split(", ")]
    return rendered(make(*[F.col(n if of is None else f"{of}.{n}") for n in names]))


def register(spark: SparkSession, prefix: str = "confab_") -> list[str]:
    """Defines all functions for this session; their names."""
    for name, (arguments, make) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURN {_body(arguments, make)}")
    for name, (arguments, returns, make, columns) in TABLES.items():
        rows = f"SELECT pos, {columns} FROM posexplode({_body(arguments, make, prefix + name)}) AS e(pos, s)"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE({returns}) RETURN {rows}")
    return [prefix + n for n in (*SCALARS, *TABLES)]
