"""Speaker segments: labels, text form, and the parser from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.functions.clock import format_clock, parse_clock
from confab.functions.text import BLANK, let, lines_of, normalise, strip

SEGMENT = "struct<transcript:string,speaker_id:string,start_time_seconds:double,end_time_seconds:double>"
#: Fixed value: a line that is nothing but a speaker header.
STRICT_HEADER = rf"(?iUd)^{BLANK}*Speaker{BLANK}+[^\s\x1c-\x1f]+(?:{BLANK}+\[[^\]]+\])?{BLANK}*:?{BLANK}*$"
#: Fixed value: a line that starts a segment; label, start, end and the rest of the line.
LOOSE_HEADER = r"(?iUd)^((?:speaker|spk)\s*[\w.-]*)(?:\s*\[([^\]-]+)\s*-\s*([^\]]+)\])?\s*:?\s*(.*)$"


def speaker_label(speaker_id: Column) -> Column:
    """``Speaker n+1`` of a number, a text that says so itself as it is, else ``Speaker text``; null: ``Speaker``."""
    number = F.when(speaker_id.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(speaker_id).try_cast("long"))
    own = F.startswith(F.lower(speaker_id), F.lit("speaker"))
    return (
        F.when(speaker_id.isNull(), F.lit("Speaker"))
        .when(number.isNotNull(), F.concat(F.lit("Speaker "), (number + 1).cast("string")))
        .when(own, speaker_id)
        .otherwise(F.concat(F.lit("Speaker "), speaker_id))
    )


def speaker_label_plain(speaker_id: Column) -> Column:
    """The earlier rule: texts always get the word in front."""
    return F.when(F.startswith(F.lower(speaker_id), F.lit("speaker")), F.concat(F.lit("Speaker "), speaker_id)).otherwise(speaker_label(speaker_id))


def speaker_id_of(label: Column) -> Column:
    """The first number of a label less one (0 at least), else the label with single blanks."""
    digits = F.regexp_extract(label, r"(\d+)", 1)
    return F.when(digits != "", F.greatest(F.lit(0).cast("decimal(38,0)"), digits.try_cast("decimal(38,0)") - 1).cast("decimal(38,0)").cast("string")).otherwise(strip(F.regexp_replace(label, rf"(?U){BLANK}+", " ")))


def segment_text(speaker_id: Column, start: Column, end: Column, transcript: Column) -> Column:
    """Header line with clocks, then the transcript."""
    return F.concat(speaker_label(speaker_id), F.lit(" ["), format_clock(start), F.lit(" - "), format_clock(end), F.lit("]\n"), transcript)


def transcript_of_group(order: str = "seg_no") -> Column:
    """Aggregate: the text form of a meeting's segments in order, a blank line between them."""
    text = segment_text(F.col("speaker_id"), F.col("start_s"), F.col("end_s"), F.col("transcript"))
    each = F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))
    return F.array_join(F.transform(F.array_sort(each), lambda x: x["t"]), "\n\n")


def transcripts(segments: DataFrame, by: str = "meeting_id", order: str = "seg_no") -> DataFrame:
    """One text per meeting."""
    return segments.groupBy(by).agg(transcript_of_group(order).alias("transcript_text"))


def transcript_of(segments: Column, transcript: Column) -> Column:
    """The text form of one nested meeting; the plain transcript if it has no segments."""
    each = F.transform(segments, lambda s: segment_text(s["speaker_id"], s["start_time_seconds"], s["end_time_seconds"], s["transcript"]))
    return F.when(F.size(segments) > 0, F.array_join(each, "\n\n")).otherwise(strip(transcript))


def plain_transcript(transcript: Column, segments: Column) -> Column:
    """The given transcript, or the segments' joined by blanks where it is blank."""
    own = strip(F.coalesce(transcript, F.lit("")))
    return F.when(own != "", own).otherwise(strip(F.array_join(F.transform(segments, lambda s: s["transcript"]), " ")))


def _segment(head: Column, body: Column) -> Column:
    """A parsed segment from its header line and its text."""
    part = lambda k: F.regexp_extract(head, LOOSE_HEADER, k)
    clock = lambda c: F.when(c != "", parse_clock(c))
    parts = F.struct(strip(part(1)).alias("label"), part(2).alias("start"), part(3).alias("end"))
    return let(parts, lambda p: F.struct(strip(body).alias("transcript"), speaker_id_of(p["label"]).alias("speaker_id"), clock(p["start"]).alias("start_time_seconds"), clock(p["end"]).alias("end_time_seconds")))


def parse_segments(text: Column) -> Column:
    """The speaker segments of a normalised text, as an array: no shuffle, no Python, linear in the text.

    A header line starts a segment, the lines up to the next one are its body, joined by
    blanks; segments without a body and lines before the first header are left out.
    """

    def cut(lines: Column) -> Column:
        size = F.size(lines)
        heads = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(LOOSE_HEADER), i + 1)), lambda i: i.isNotNull())
        return let(heads, lambda at: F.transform(at, lambda i, k: one(lines, i, F.coalesce(F.get(at, k + 1), size + 1))))

    def one(lines: Column, at: Column, end: Column) -> Column:
        head = F.element_at(lines, at)
        rest = F.array(strip(F.regexp_extract(head, LOOSE_HEADER, 4)))
        return F.struct(head.alias("head"), F.array_remove(F.concat(rest, F.slice(lines, at + 1, end - at - 1)), "").alias("body"))

    lines = F.array_remove(F.transform(lines_of(text), strip), "")
    return F.transform(F.filter(let(lines, cut), lambda x: F.size(x["body"]) > 0), lambda x: _segment(x["head"], F.array_join(x["body"], " ")))


#: Lines of a split: what one task counts and joins at once.
SPLIT_LINES = 4096


def lines_of_texts(texts: DataFrame, text_col: str, by: str = "meeting_id") -> DataFrame:
    """(``by``, ``split``, ``line_no``, ``line``) of the lines of each text."""
    rows = texts.select(by, F.posexplode(lines_of(F.col(text_col))).alias("line_no", "line"))
    return rows.select(by, F.floor(F.col("line_no") / SPLIT_LINES).cast("long").alias("split"), F.col("line_no").cast("long").alias("line_no"), "line")


def lines_of_files(spark: SparkSession, path: str, by: str = "path") -> DataFrame:
    """The same of UTF-8 files of any length, which Spark reads in blocks; a split is a part of a block.

    Rows of a block come in order, so the running number of its rows gives their order; it is not a line's
    number in the file.  Line ends are those of Spark's text source.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.text(path).select(at.alias("at"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return rows.select(F.col("at.path").alias(by), F.struct(F.col("at.start"), F.floor(F.col("line_no") / SPLIT_LINES).alias("part")).alias("split"), "line_no", "line")


def segments_of_lines(lines: DataFrame, by: str = "meeting_id") -> DataFrame:
    """(``by``, ``seg_no``, ``speaker_id``, ``start_s``, ``end_s``, ``transcript``): what :func:`parse_segments`
    finds, for texts too long for one row.

    A running group id by splits: headers are counted in each split, a prefix sum over a text's splits (a row
    each) gives every split its first group, and lines are numbered inside their split.  The lines of a group
    are joined in each split first; a segment that crosses splits is put together from these pieces.  Time is
    linear, and no task holds more than a split or a segment.
    """
    line = strip(F.col("line"))
    rows = lines.select(by, "split", "line_no", line.alias("line")).where("line <> ''").withColumn("head", F.col("line").rlike(LOOSE_HEADER))
    counts = rows.groupBy(by, "split").agg(F.count_if("head").alias("heads"))
    before = F.sum("heads").over(Window.partitionBy(by).orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(by, "split", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.sum(F.col("head").cast("long")).over(Window.partitionBy(by, "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("within", within).join(first, [by, "split"]).withColumn("group", F.col("first") + F.col("within")).where("group > 0")
    rest = strip(F.regexp_extract("line", LOOSE_HEADER, 4))
    words = F.when(F.col("head"), F.when(rest != "", rest)).otherwise(F.col("line"))
    joined = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(key.alias("o"), value.alias("t"))))), lambda x: x["t"]), " ")
    pieces = numbered.groupBy(by, "group", "split").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("head"), joined(F.col("line_no"), words).alias("piece"))
    whole = pieces.groupBy(by, "group").agg(F.max("head").alias("head"), joined(F.col("split"), F.when(F.col("piece") != "", F.col("piece"))).alias("body")).where("body <> ''")
    found = whole.select(by, "group", _segment(F.col("head"), F.col("body")).alias("s"))
    number = numbered_rows(found, by, "group")
    return number.select(by, "seg_no", "s.speaker_id", F.col("s.start_time_seconds").alias("start_s"), F.col("s.end_time_seconds").alias("end_s"), "s.transcript")


def numbered_rows(rows: DataFrame, by: str, order: str, name: str = "seg_no", block: int = 4096) -> DataFrame:
    """``rows`` numbered from 0 in each ``by``: counted by blocks of the (distinct) ``order``, so that a text of very many segments is no single window."""
    part = rows.withColumn("_block", F.floor(F.col(order) / block))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = part.groupBy(by, "_block").agg(F.count("*").alias("n")).select(by, "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(by, "_block").orderBy(order)) - 1
    return part.withColumn("_within", within).join(starts, [by, "_block"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_block", "_start", "_within")


def explode_segments(meetings: DataFrame, text_col: str, by: str = "meeting_id") -> DataFrame:
    """A row per parsed segment, with ``seg_no`` from 0."""
    parsed = meetings.select(by, F.posexplode(parse_segments(normalise(F.col(text_col)))).alias("seg_no", "s"))
    return parsed.select(by, "seg_no", "s.speaker_id", F.col("s.start_time_seconds").alias("start_s"), F.col("s.end_time_seconds").alias("end_s"), "s.transcript")


def header_count(text: Column) -> Column:
    """Lines that are a speaker header and nothing else."""
    return F.size(F.filter(lines_of(text), lambda x: x.rlike(STRICT_HEADER)))


def headers_kept(original: Column, cleaned: Column) -> Column:
    """Whether a cleaned transcript has as many headers as the original at least."""
    return header_count(cleaned) >= header_count(original)
