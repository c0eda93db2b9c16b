"""Model answers and speech-to-text payloads: parsed, coerced and validated as columns.

Nothing throws: each parser returns a struct with the parsed value and ``error``, the first
failure in the order in which a strict reader meets it (null if there is none).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from confab.functions.clock import to_float
from confab.functions.text import let, optional, strip, strip_fence
from confab.operators.segments import header_count

_V = "array<variant>"


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(v), F.lit("OBJECT")), F.lit(False))


def field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def text_field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def required(v: Column, key: str) -> Column:
    """Trimmed text; missing is empty, an explicit null is the word None."""
    f = field(v, key)
    return F.when(f.isNull(), F.lit("")).when(kind_of(f) == "VOID", F.lit("None")).otherwise(strip(F.coalesce(text_field(v, key), F.to_json(f))))


def optional_field(v: Column, key: str) -> Column:
    return optional(text_field(v, key))


def texts(v: Column) -> Column:
    """The non-blank texts of an array of variants."""
    word = lambda x: F.when(kind_of(x) == "VOID", F.lit("None")).otherwise(strip(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))))
    return F.filter(F.transform(v, word), lambda x: x != "")


def first(errors: Column) -> Column:
    """The first error of an array, null if it has none."""
    return F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))


@dataclass(frozen=True)
class Items:
    """A list task: the list's key, what messages call an element, its fields and checks.

    ``fields``: (name, kind) with kind text, optional, lower or texts; ``checks``: (name, what is
    missing); ``one_of``: (name, allowed values).
    """

    key: str
    one: str
    response: str
    fields: tuple[tuple[str, str], ...]
    checks: tuple[tuple[str, str], ...]
    one_of: tuple[str, tuple[str, ...]] | None = None


# Keys, fields and what a response without its list is told.
ACTIONS = Items(
    "action_items", "Action item", "Action item response must include an action_items list.",
    (("task", "text"), ("owner", "optional"), ("due_date", "optional"), ("timestamp", "optional"), ("status", "text")), (("task", "task"), ("status", "status")),
)
DECISIONS = Items(
    "decisions", "Decision", "Decision response must include a decisions list.",
    (("decision", "text"), ("owner", "optional"), ("timestamp", "optional"), ("confidence", "lower")), (("decision", "decision text"), ("confidence", "confidence")), ("confidence", ("high", "medium", "low")),
)
POINTS = Items(
    "key_discussion_points", "Key discussion point", "Key discussion point response must include a key_discussion_points list.",
    (("point", "text"), ("speakers", "texts"), ("timestamp", "optional")), (("point", "point text"), ("speakers", "speakers")),
)


def parse_object(response: Column, what: str) -> Column:
    """struct(value variant, error) of a response that should be one JSON object, fenced or not."""
    inner = strip_fence(strip(F.coalesce(response, F.lit(""))))
    v = F.try_parse_json(inner)
    error = (
        F.when(inner == "", F.lit(f"{what} response is empty."))
        .when(v.isNull(), F.lit(f"{what} response is not valid JSON."))
        .when(~is_object(v), F.lit(f"{what} response must be an object."))
    )
    return F.struct(v.alias("value"), error.alias("error"))


def items_of(raw: Column, spec: Items) -> Column:
    """struct(items, error) of a variant that should be the task's list."""
    arr = F.try_variant_get(raw, "$", _V)

    def value(x: Column, name: str, kind: str) -> Column:
        if kind == "texts":
            return texts(F.coalesce(F.try_variant_get(x, f"$.{name}", _V), F.array().cast(_V)))
        c = optional_field(x, name) if kind == "optional" else required(x, name)
        return F.lower(c) if kind == "lower" else c

    def shape(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        out = F.when(~is_object(x), F.concat(F.lit(f"{spec.one} "), n, F.lit(" must be a JSON object.")))
        for name, kind in spec.fields:
            if kind == "texts":
                f = field(x, name)
                out = F.coalesce(out, F.when(f.isNotNull() & ~F.startswith(kind_of(f), F.lit("ARRAY")), F.concat(F.lit(f"{spec.one} "), n, F.lit(f" {name} must be a list."))))
        return out

    def check(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        kinds, out = dict(spec.fields), F.lit(None).cast("string")
        for name, missing in spec.checks:
            empty = F.size(x[name]) == 0 if kinds[name] == "texts" else x[name] == ""
            out = F.coalesce(out, F.when(empty, F.concat(F.lit(f"{spec.one} "), n, F.lit(f" is missing {missing}."))))
        if spec.one_of:
            name, allowed = spec.one_of
            words = ", ".join(allowed[:-1]) + f", or {allowed[-1]}"
            out = F.coalesce(out, F.when(~x[name].isin(*allowed), F.concat(F.lit(f"{spec.one} "), n, F.lit(f" has invalid {name} '"), x[name], F.lit(f"'; expected {words}."))))
        return out

    parsed = F.transform(arr, lambda x: F.struct(*[value(x, n, k).alias(n) for n, k in spec.fields]))
    error = F.coalesce(F.when(arr.isNull(), F.lit(spec.response)), first(F.transform(arr, shape)), first(F.transform(parsed, check)))
    return F.struct(F.when(error.isNull(), parsed).alias("items"), error.alias("error"))


def parse_items(response: Column, spec: Items) -> Column:
    """struct(items, error) of a response of one list task."""
    both = let(parse_object(response, spec.one), lambda obj: F.struct(obj["error"].alias("error"), items_of(field(obj["value"], spec.key), spec).alias("got")))
    return let(both, lambda x: F.struct(F.when(x["error"].isNull(), x["got"]["items"]).alias("items"), F.coalesce(x["error"], x["got"]["error"]).alias("error")))


def cleaned_error(original: Column, cleaned: Column) -> Column:
    """Why a cleaned transcript is rejected: empty, or fewer speaker headers than the original."""
    fewer = header_count(cleaned) < header_count(original)
    return F.when(strip(cleaned) == "", F.lit("Cleaned transcript is empty.")).when(fewer, F.lit("Cleaned transcript appears to be missing speaker labels or timestamp headers."))


def parse_cleanup(response: Column, original: Column) -> Column:
    """struct(cleaned_transcript, error): plain text as it is, or the field of a JSON object."""
    inner = strip_fence(strip(F.coalesce(response, F.lit(""))))
    v = F.try_parse_json(inner)
    text = F.when(v.isNull(), inner).when(is_object(v), required(v, "cleaned_transcript")).otherwise(F.lit(""))
    error = F.coalesce(F.when(inner == "", F.lit("Cleanup response is empty.")), F.when(v.isNotNull() & ~is_object(v), F.lit("Cleanup response must be an object.")), cleaned_error(original, text))
    return F.struct(F.when(error.isNull(), text).alias("cleaned_transcript"), error.alias("error"))


def summary_of(v: Column, topics: Column) -> Column:
    return F.struct(*[required(v, k).alias(k) for k in ("title", "short_summary", "detailed_summary")], texts(F.try_variant_get(topics, "$", _V)).alias("topics_discussed"))


def summary_error(s: Column) -> Column:
    missing = lambda c, what: F.when(c, F.lit(f"Meeting summary is missing {what}."))
    return F.coalesce(
        missing(s["title"] == "", "a title"), missing(s["short_summary"] == "", "a short summary"), missing(s["detailed_summary"] == "", "a detailed summary"),
        missing(F.coalesce(F.size(s["topics_discussed"]), F.lit(0)) < 1, "topics discussed"),
    )


def _not_list(topics: Column) -> Column:
    return F.when(topics.isNotNull() & ~F.startswith(kind_of(topics), F.lit("ARRAY")), F.lit("topics_discussed must be a list."))


def parse_summary(response: Column) -> Column:
    """struct(summary, error)."""

    def parts(obj: Column) -> Column:
        topics = field(obj["value"], "topics_discussed")
        return F.struct(summary_of(obj["value"], topics).alias("s"), F.coalesce(obj["error"], _not_list(topics)).alias("before"))

    def result(p: Column) -> Column:
        return let(F.coalesce(p["before"], summary_error(p["s"])), lambda e: F.struct(F.when(e.isNull(), p["s"]).alias("summary"), e.alias("error")))

    return let(let(parse_object(response, "Meeting summary"), parts), result)


def parse_analysis(response: Column, original: Column) -> Column:
    """struct(cleaned_transcript, summary, key_discussion_points, decisions, action_items, error) of a full analysis."""
    lists = (POINTS, DECISIONS, ACTIONS)

    def parts(obj: Column) -> Column:
        v = obj["value"]
        raw, own = field(v, "summary"), field(v, "topics_discussed")
        topics = F.when(own.isNull() | (kind_of(own) == "VOID"), field(raw, "topics_discussed")).otherwise(own)
        cleaned = required(v, "cleaned_transcript")
        before = F.coalesce(obj["error"], cleaned_error(original, cleaned), F.when(~is_object(raw), F.lit("Full analysis response must include a summary object.")), _not_list(topics))
        each = [items_of(F.coalesce(field(v, x.key), F.parse_json(F.lit("[]"))), x).alias(x.key) for x in lists]
        return F.struct(cleaned.alias("cleaned"), summary_of(raw, topics).alias("s"), before.alias("before"), *each)

    def result(p: Column) -> Column:
        error = F.coalesce(p["before"], summary_error(p["s"]), *[p[x.key]["error"] for x in lists])
        ok = lambda c, name: F.when(error.isNull(), c).alias(name)
        return F.struct(ok(p["cleaned"], "cleaned_transcript"), ok(p["s"], "summary"), *[ok(p[x.key]["items"], x.key) for x in lists], error.alias("error"))

    return let(let(parse_object(response, "Meeting summary"), parts), result)


def batch_failure(job: Column) -> Column:
    """Why a batch job failed, from its JSON state: the first failed file's message; null if it did not."""
    v = F.try_parse_json(job)
    failed = F.coalesce(F.try_variant_get(v, "$.failed", _V), F.array().cast(_V))
    message = F.when(F.size(failed) > 0, text_field(F.try_element_at(failed, F.lit(1)), "error_message")).otherwise(F.lit("Unknown batch job failure."))
    return F.when(F.lower(text_field(v, "job_state")) == "failed", F.coalesce(message, F.lit("Unknown batch job failure.")))


def speech_result_error(result: Column) -> Column:
    """Why a transcription result (JSON with ``transcript`` and ``segments``) is not one; null if it is."""
    v = F.try_parse_json(result)
    text, segments = field(v, "transcript"), field(v, "segments")
    each = F.coalesce(F.try_variant_get(segments, "$", _V), F.array().cast(_V))
    odd = first(F.transform(each, lambda x, i: F.when(~is_object(x), F.concat(F.lit("Segment "), (i + 1).cast("string"), F.lit(" must be an object.")))))
    return F.coalesce(
        F.when(~is_object(v), F.lit("Transcription result must be an object.")),
        F.when(F.coalesce(kind_of(text) != "STRING", F.lit(True)), F.lit("Transcript must be a string.")),
        F.when(~F.coalesce(F.startswith(kind_of(segments), F.lit("ARRAY")), F.lit(False)), F.lit("Segments must be a list.")),
        odd,
        F.when((strip(text_field(v, "transcript")) == "") & (F.size(each) == 0), F.lit("Transcription result contains no transcript text or segments.")),
    )


def parse_speech(payload: Column) -> Column:
    """struct(transcript, language_code, segments, error) of a speech-to-text payload; wrong shapes count as absent."""
    v = F.try_parse_json(payload)
    entries = F.coalesce(F.try_variant_get(v, "$.diarized_transcript.entries", _V), F.array().cast(_V))
    number = lambda x, k: to_float(text_field(x, k))
    one = lambda x: F.struct(
        required(x, "transcript").alias("transcript"), text_field(x, "speaker_id").alias("speaker_id"),
        number(x, "start_time_seconds").alias("start_time_seconds"), number(x, "end_time_seconds").alias("end_time_seconds"),
    )
    segments = F.filter(F.transform(F.filter(entries, is_object), one), lambda s: s["transcript"] != "")
    own = required(v, "transcript")
    text = F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(strip(F.array_join(F.transform(segments, lambda s: s["transcript"]), " ")))
    error = F.when(v.isNull(), F.lit("Payload is not valid JSON.")).when(text == "", F.lit("Speech to text returned an empty transcript."))
    code = F.when(text_field(v, "language_code") != "", text_field(v, "language_code"))
    return F.struct(text.alias("transcript"), code.alias("language_code"), segments.alias("segments"), error.alias("error"))
