"""Meeting metrics kept up to date: partial states that are stored, and merged as segments arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.operators.metrics import span_label
from confab.operators.segments import speaker_label
from confab.sources.answers import KeyedLog


def states(segments: DataFrame, by: str = "meeting_id") -> DataFrame:
    """What a set of segments says about its meetings: (``by``, ``first_s``, ``last_s``, ``labels``, ``turns``, ``timed_turns``)."""
    timed = F.col("end_s").isNotNull() & F.col("start_s").isNotNull()
    return segments.groupBy(by).agg(
        F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"), F.collect_set(speaker_label(F.col("speaker_id"))).alias("labels"), F.count("*").alias("turns"), F.count_if(timed).alias("timed_turns")
    )


def merged_states(rows: DataFrame, by: str = "meeting_id") -> DataFrame:
    """States of the same meeting as one, in whatever order: minimum, maximum, union and sums."""
    return rows.groupBy(by).agg(
        F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"), F.sum("turns").alias("turns"), F.sum("timed_turns").alias("timed_turns")
    )


def metrics_of(rows: DataFrame, by: str = "meeting_id") -> DataFrame:
    """The columns of :func:`confab.operators.metrics.meeting_metrics`, from a state a meeting."""
    span = F.when(F.col("first_s").isNotNull() & F.col("last_s").isNotNull(), F.greatest(F.lit(0.0), F.col("last_s") - F.col("first_s")))
    out = rows.select(by, span.alias("duration_s"), F.size("labels").cast("long").alias("speakers"), "turns", "timed_turns")
    return out.withColumn("duration", span_label(F.col("duration_s")))


class MetricStore(KeyedLog):
    """Stored states by meeting.  ``add`` merges the segments of an increment into them, once for each tag;
    only the increment is counted, and readers of some meetings open their prefixes alone."""

    columns, key = "meeting_id long, first_s double, last_s double, labels array<string>, turns long, timed_turns long", "meeting_id"

    def merged(self, rows: DataFrame, age: Column) -> DataFrame:
        return merged_states(rows)

    def add(self, segments: DataFrame, tag: str | None = None) -> bool:
        return self.append(states(segments), tag)

    def metrics(self, meetings: DataFrame | None = None) -> DataFrame:
        return metrics_of(self.rows(meetings))
