"""Meeting metrics: grouped aggregates, and their forms over transcript text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.clock import format_elapsed, parse_strict_clock
from confab.functions.text import strip

from .segments import speaker_label

#: Fixed value: a clock range in brackets.
RANGE = r"\[([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\s*-\s*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\]"
#: Fixed value: a speaker's name at the start of a line.
SPEAKER = r"(?mUd)^(Speaker\s+\S+)"


def span_seconds() -> Column:
    """Aggregate: last end less first start, 0 at least; null if no start or no end is known."""
    return F.greatest(F.lit(0.0), F.max("end_s") - F.min("start_s"))


def span_label(seconds: Column) -> Column:
    return F.when(seconds.isNull(), F.lit("N/A")).otherwise(format_elapsed(seconds))


def meeting_metrics(segments: DataFrame, by: str = "meeting_id", *more: Column) -> DataFrame:
    """Per meeting: duration, distinct speaker labels, turns, and ``more`` aggregates.  One shuffle."""
    known = F.when(F.col("end_s").isNotNull() & F.col("start_s").isNotNull(), F.lit(1))
    has = (F.count("start_s") > 0) & (F.count("end_s") > 0)
    out = segments.groupBy(by).agg(F.when(has, span_seconds()).alias("duration_s"), F.size(F.collect_set(speaker_label(F.col("speaker_id")))).cast("long").alias("speakers"), F.count("*").alias("turns"), F.count(known).alias("timed_turns"), *more)
    return out.withColumn("duration", span_label(F.col("duration_s")))


def speakers_of(segments: Column, transcript: Column) -> Column:
    """Distinct labels of nested segments; without any, 1 if there is a transcript, else 0."""
    labels = F.array_distinct(F.transform(segments, lambda s: speaker_label(s["speaker_id"])))
    return F.when(F.size(segments) > 0, F.size(labels)).otherwise(F.when(strip(F.coalesce(transcript, F.lit(""))) != "", 1).otherwise(0))


def duration_of_text(text: Column) -> Column:
    """Minutes from the first range's start to the last range's end; ``N/A`` if there is none or no time passes."""
    first = parse_strict_clock(F.try_element_at(F.regexp_extract_all(text, F.lit(RANGE), F.lit(1)), F.lit(1)))
    last = parse_strict_clock(F.try_element_at(F.regexp_extract_all(text, F.lit(RANGE), F.lit(2)), F.lit(-1)))
    minutes = F.greatest(F.lit(1), F.bround((last - first) / 60).cast("long"))
    return F.when(last > first, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.lit("N/A"))


def speakers_of_text(text: Column) -> Column:
    """Number of distinct speaker names at line starts."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(SPEAKER), F.lit(1))))


def list_counts(points: Column, decisions: Column, actions: Column) -> list[Column]:
    """Sizes of the three result lists, 0 where there is no analysis."""
    n = lambda c, name: F.when(c.isNull(), 0).otherwise(F.size(c)).alias(name)
    return [n(points, "discussion_points"), n(decisions, "decisions"), n(actions, "action_items")]


def colour_slots(segments: DataFrame, slots: int = 4, by: str = "meeting_id", order: str = "seg_no") -> DataFrame:
    """Each label's slot ``s1``, ``s2``, ... by first appearance, round robin."""
    labelled = segments.select(by, F.col(order).alias("o"), speaker_label(F.col("speaker_id")).alias("label"))
    first = labelled.groupBy(by, "label").agg(F.min("o").alias("first_seg"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("first_seg", "label"))
    return first.select(by, "label", "first_seg", F.concat(F.lit("s"), ((rank - 1) % slots + 1).cast("string")).alias("slot"))


def colour_of_label(label: Column) -> Column:
    """The earlier rule: by the label's last digit."""
    return F.when(F.endswith(label, F.lit("2")), 2).when(F.endswith(label, F.lit("3")), 3).otherwise(1)


def stage_status(stages: list[str], active: Column) -> Column:
    """Per stage: done, active or waiting."""
    state = lambda i: F.when(active > i, F.lit("done")).when(active == i, F.lit("active")).otherwise(F.lit("waiting"))
    return F.array(*[F.struct(F.lit(s).alias("stage"), state(i).alias("status")) for i, s in enumerate(stages)])


def stage_percent(active: Column, stages: int = 5) -> Column:
    return (active / stages * 100).cast("int")


def changed_rows(rows: DataFrame, signature: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose signature differs from the one before."""
    before = F.lag(signature).over(Window.partitionBy(*by).orderBy(*order))
    return rows.select("*", (~F.col(signature).eqNullSafe(before)).alias("_changed")).where("_changed").drop("_changed")
