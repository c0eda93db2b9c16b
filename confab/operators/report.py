"""The report model: ordered sections of a meeting as columns, in two flavours (``docx`` and ``pdf``).

An analysis is a struct or row with ``summary``, ``key_discussion_points``, ``decisions``,
``action_items`` and ``cleaned_transcript``; missing lists count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.clock import MINUTE, written_time
from confab.functions.text import blank_to_null, blocks, let, lower_first, or_else, professional, sanitise, strip, strip_dots

from .metrics import duration_of_text, speakers_of_text

# Titles, section names, and what a report says where there is nothing.
STOCK = "The meeting covered the listed agenda items and produced the outcomes captured in this report."
NO_STEPS = "No next steps were identified."
TITLES = {"docx": "Meeting", "pdf": "Minutes of Meeting"}
TRANSCRIPT_TITLES = {"docx": "Minutes of Meeting", "pdf": "Transcript Report"}
NO_TOPICS = {"docx": "No topics were extracted.", "pdf": "No items were extracted."}
NO_POINTS = "No key discussion points were extracted."
NO_DECISIONS = "No decisions were extracted."
NO_ACTIONS = "No action items were extracted."
NO_TRANSCRIPT = "No cleaned transcript was available."
COLUMNS = ("Task", "Owner", "Due Date", "Priority", "Status")
# Words that make an action urgent or at least due soon.
HIGH = ("urgent", "today", "tomorrow", "blocked", "critical")
MEDIUM = ("this week", "friday", "next demo", "review", "validate")


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def priority(item: Column) -> Column:
    """High, Medium or Low by words anywhere in task, due date and status."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(item[k], F.lit("")) for k in ("task", "due_date", "status")]))
    return F.when(text.rlike("|".join(HIGH)), F.lit("High")).when(text.rlike("|".join(MEDIUM)), F.lit("Medium")).otherwise(F.lit("Low"))


def next_step(item: Column) -> Column:
    """Who will do what by when, as a sentence."""
    task = strip_dots(or_else(item["task"], "complete the assigned task"))
    act = F.when(task != "", lower_first(task)).otherwise(F.lit("complete the assigned task"))
    due = F.when((F.coalesce(item["due_date"], F.lit("")) != "") & (F.upper(item["due_date"]) != "N/A"), F.concat(F.lit(" by "), item["due_date"])).otherwise(F.lit(""))
    return F.concat(or_else(item["owner"], "Team"), F.lit(" will "), act, due, F.lit("."))


def decision_lines(decisions: Column, most: int = 3) -> Column:
    """The first decisions as phrases without full stop; blank ones are dropped after the cut."""
    return F.filter(F.transform(F.slice(decisions, 1, most), lambda d: strip_dots(professional(d["decision"]))), lambda x: x != "")


def next_steps(actions: Column, decisions: Column, flavor: str = "docx") -> Column:
    """All action sentences, then up to three decisions.  ``pdf`` says there are none whenever there is no action."""
    lines = F.concat(F.transform(actions, next_step), F.transform(decision_lines(decisions), lambda d: F.concat(F.lit("Team will proceed in line with: "), d, F.lit("."))))
    return F.when(has_steps(actions, decisions, flavor), lines).otherwise(F.array(F.lit(NO_STEPS)))


def has_steps(actions: Column, decisions: Column, flavor: str) -> Column:
    """False where the report says that there are no next steps."""
    none = F.size(actions) == 0 if flavor == "pdf" else (F.size(actions) == 0) & (F.size(decisions) == 0)
    return ~F.coalesce(none, F.lit(False))


def owners_text(actions: Column) -> Column:
    """Up to four owners, sorted, or a stock phrase."""
    owners = F.array_sort(F.array_distinct(F.filter(F.transform(actions, lambda a: a["owner"]), lambda o: o.isNotNull() & (o != ""))))
    return F.when(F.size(owners) > 0, F.array_join(F.slice(owners, 1, 4), ", ")).otherwise(F.lit("the assigned owners"))


def executive_summary(detailed: Column, short: Column, decisions: Column, actions: Column) -> Column:
    """Up to three paragraphs."""
    text = sanitise(strip(or_else(detailed, F.coalesce(short, F.lit("")))))
    brief = sanitise(strip(F.coalesce(short, F.lit(""))))
    first = F.when(text != "", text).when(brief != "", brief).otherwise(F.lit(STOCK))
    said = F.array_join(F.transform(F.filter(F.slice(decisions, 1, 3), lambda d: F.coalesce(d["decision"], F.lit("")) != ""), lambda d: strip_dots(professional(d["decision"]))), "; ")
    second = F.when(said != "", F.concat(F.lit("Key decisions included "), said, F.lit(".")))
    third = F.when(F.size(actions) > 0, F.concat(F.lit("Follow-up activities were assigned to "), owners_text(actions), F.lit(", with progress to be tracked through the action items below.")))
    return F.filter(F.array(first, second, third), lambda p: p.isNotNull())


def topics(values: Column, flavor: str = "docx", most: int = 8) -> Column:
    return F.when(F.size(values) > 0, F.slice(values, 1, most)).otherwise(F.array(F.lit(NO_TOPICS[flavor])))


def key_points(points: Column, most: int = 6) -> Column:
    """Text and source line of the first points."""
    line = lambda p: F.concat(F.lit("Timestamp: "), or_else(p["timestamp"], "N/A"), F.lit(" | Speaker(s): "), or_else(F.array_join(p["speakers"], ", "), "N/A"))
    return F.transform(F.slice(points, 1, most), lambda p: F.struct(strip(F.coalesce(p["point"], F.lit(""))).alias("point"), line(p).alias("source")))


def decision_sentences(decisions: Column) -> Column:
    """Every decision as a sentence; their numbers come from the list's style or are written out."""
    return F.transform(decisions, lambda d: professional(d["decision"]))


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def action_table(actions: Column) -> Column:
    """Task, owner, due date, priority and status with defaults."""
    return F.transform(
        actions,
        lambda a: F.struct(
            F.coalesce(a["task"], F.lit("")).alias("task"), or_else(a["owner"], "Unassigned").alias("owner"), or_else(a["due_date"], "N/A").alias("due_date"), priority(a).alias("priority"), or_else(a["status"], "N/A").alias("status")
        ),
    )


def verbose_lines(points: Column, decisions: Column) -> tuple[Column, Column]:
    """All points and decisions with their details, a line each."""
    p = F.transform(points, lambda x: F.concat(F.lit("["), or_else(x["timestamp"], "N/A"), F.lit("] "), x["point"], F.lit(" ("), or_else(F.array_join(x["speakers"], ", "), "N/A"), F.lit(")")))
    d = F.transform(decisions, lambda x: F.concat(F.lit("["), or_else(x["timestamp"], "N/A"), F.lit("] "), x["decision"], F.lit(" Owner: "), or_else(x["owner"], "Unassigned"), F.lit("; confidence: "), x["confidence"], F.lit(".")))
    return p, d


def metadata(info: Column, transcript: Column, today: Column, generated_by: str = "confab") -> Column:
    """Date, duration, speakers and generator; given values come before those read from the transcript."""
    given = lambda k: F.when(F.coalesce(F.try_element_at(info, F.lit(k)), F.lit("")) != "", F.try_element_at(info, F.lit(k)))
    n = speakers_of_text(transcript)
    return F.struct(
        F.coalesce(given("Date"), given("Generated Date"), today).alias("date"),
        F.coalesce(given("Duration"), duration_of_text(transcript)).alias("duration"),
        F.coalesce(given("Speakers Detected"), F.when(n > 0, n.cast("string")).otherwise(F.lit("N/A"))).alias("speakers_detected"),
        F.lit(generated_by).alias("generated_by"),
    )


def information(info: Column, at: Column | None = None, generated_by: str = "confab") -> Column:
    """The long form of the meeting information, a map: when and by whom it was made, then what is given and not empty."""
    made = F.create_map(F.lit("Generated On"), written_time(at, MINUTE), F.lit("Prepared By"), F.lit(generated_by))
    given = F.map_filter(info, lambda k, v: F.coalesce(v, F.lit("")) != "")
    own = F.map_filter(made, lambda k, v: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(own, given)


def report_model(analyses: DataFrame, flavor: str = "docx", info: str | None = None, today: Column | None = None, by: str = "meeting_id") -> DataFrame:
    """One row per meeting with all sections of its minutes, ready for a sink."""
    none = F.create_map().cast("map<string,string>")
    points, decisions, actions = (F.col(c) for c in ("key_discussion_points", "decisions", "action_items"))
    infos = F.coalesce(F.col(info), none) if info else none
    text = F.coalesce("cleaned_transcript", F.lit(""))
    return analyses.select(
        by,
        F.coalesce(blank_to_null(F.col("summary.title")), F.lit(TITLES[flavor])).alias("title"),
        metadata(infos, text, today if today is not None else written_time(None)).alias("metadata"),
        F.when(F.coalesce(F.try_element_at(infos, F.lit("Source File")), F.lit("")) != "", F.try_element_at(infos, F.lit("Source File"))).alias("source_file"),
        executive_summary(F.col("summary.detailed_summary"), F.col("summary.short_summary"), decisions, actions).alias("executive_summary"),
        topics(F.col("summary.topics_discussed"), flavor).alias("topics"),
        F.coalesce(F.size("summary.topics_discussed") > 0, F.lit(False)).alias("has_topics"),
        key_points(points).alias("key_points"),
        decision_sentences(decisions).alias("decisions"),
        action_table(actions).alias("action_items"),
        next_steps(actions, decisions, flavor).alias("next_steps"),
        has_steps(actions, decisions, flavor).alias("has_steps"),
        blocks(text, flavor == "pdf").alias("transcript"),
    )


def minutes_text(model: DataFrame, by: str = "meeting_id") -> DataFrame:
    """Plain-text minutes of a report model."""
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    part = lambda name, lines: F.concat(F.array(F.lit(""), F.lit(name)), lines)
    table = F.transform("action_items", lambda a: F.concat_ws(" | ", a["task"], a["owner"], a["due_date"], a["priority"], a["status"]))
    lines = F.concat(
        F.array(F.col("title"), F.concat(F.lit("Date: "), F.col("metadata.date")), F.concat(F.lit("Duration: "), F.col("metadata.duration")), F.concat(F.lit("Speakers: "), F.col("metadata.speakers_detected"))),
        part("EXECUTIVE SUMMARY", F.col("executive_summary")), part("TOPICS", bullets(F.col("topics"))),
        part("KEY POINTS", F.transform("key_points", lambda p: F.concat(F.lit("- "), p["point"], F.lit(" ("), p["source"], F.lit(")")))),
        part("DECISIONS", numbered(F.col("decisions"))), part("ACTION ITEMS", table), part("NEXT STEPS", bullets(F.col("next_steps"))),
    )
    return model.select(by, F.array_join(lines, "\n").alias("minutes"))


PART = "struct<kind:string,text:string,cells:array<string>>"


def part(kind: str, text: str | Column | None = None, cells: list[Column] | None = None) -> Column:
    """One piece of a document: what it is, its text, its table cells."""
    words = text if isinstance(text, Column) else F.lit(text)
    return F.struct(F.lit(kind).alias("kind"), words.cast("string").alias("text"), (F.array(*cells) if cells else F.lit(None)).cast("array<string>").alias("cells"))


def parts(kind: str, lines: Column, none: str | None = None) -> Column:
    """A piece per line; a paragraph ``none`` where there is no line."""
    each = F.transform(lines, lambda x: part(kind, x))
    return each if none is None else F.when(F.size(lines) > 0, each).otherwise(F.array(part("paragraph", none)))


def minutes_document(model: DataFrame, flavor: str = "docx", by: str = "meeting_id", generated_by: str = "confab") -> DataFrame:
    """(``by``, ``parts``): a report model as an ordered array of document pieces, for the DOCX and PDF sinks."""
    head = lambda name: F.array(part("heading", name))
    rule = [part("rule")] if flavor == "docx" else []

    def pieces(m: Column) -> Column:
        info = [part("row", None, [F.lit(k), m["metadata"][f]]) for k, f in (("Date", "date"), ("Duration", "duration"), ("Speakers Detected", "speakers_detected"), ("Generated By", "generated_by"))]
        points = F.flatten(F.transform(m["key_points"], lambda p: F.array(part("bullet", p["point"]), part("note", p["source"]))))
        rows = F.transform(m["action_items"], lambda a: part("row", None, [a[k] for k in ("task", "owner", "due_date", "priority", "status")]))
        table = F.concat(F.array(part("columns", None, [F.lit(c) for c in COLUMNS])), rows)
        return F.concat(
            F.array(part("title", "MINUTES OF MEETING"), *rule, part("strong", m["title"])),
            head("Meeting Information"), F.array(*info),
            head("EXECUTIVE SUMMARY"), parts("paragraph", m["executive_summary"]),
            head("TOPICS DISCUSSED"), F.when(m["has_topics"], parts("bullet", m["topics"])).otherwise(parts("paragraph", m["topics"])),
            head("KEY DISCUSSION POINTS"), F.when(F.size(m["key_points"]) > 0, points).otherwise(F.array(part("paragraph", NO_POINTS))),
            head("DECISIONS TAKEN"), parts("numbered", m["decisions"], NO_DECISIONS),
            head("ACTION ITEMS"), F.when(F.size(m["action_items"]) > 0, table).otherwise(F.array(part("paragraph", NO_ACTIONS))),
            head("NEXT STEPS"), F.when(m["has_steps"], parts("bullet", m["next_steps"])).otherwise(parts("paragraph", m["next_steps"])),
            F.array(*rule, part("end", f"Generated by {generated_by}")),
        )

    # the model's columns are bound once, so that none is computed for every use
    whole = F.struct("title", "metadata", "executive_summary", "topics", "has_topics", "key_points", "decisions", "action_items", "next_steps", "has_steps")
    return model.select(by, let(whole, pieces).alias("parts"))


#: What the PDF sink's two standard fonts have no letter for.
_NO_LETTER = r"[^\x00-\x7f\xa0-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"


def lost_characters(pieces: Column) -> Column:
    """How many characters of a document the PDF sink shows as question marks."""
    lost = lambda c: F.coalesce(F.regexp_count(c, F.lit(_NO_LETTER)), F.lit(0))
    return F.aggregate(pieces, F.lit(0), lambda n, p: n + lost(p["text"]) + lost(F.array_join(F.coalesce(p["cells"], F.array().cast("array<string>")), "")))


def transcript_document(analyses: DataFrame, flavor: str = "docx", info: str | None = None, by: str = "meeting_id") -> DataFrame:
    """(``by``, ``parts``): the transcript report, blocks of a speaker header and a body."""
    given = F.try_element_at(F.col(info), F.lit("Source File")) if info else F.lit(None).cast("string")
    text = strip(F.coalesce("cleaned_transcript", F.lit("")))
    source = F.when(F.coalesce(given, F.lit("")) != "", F.array(part("paragraph", F.concat(F.lit("Source Audio File: "), given)))).otherwise(F.array().cast(f"array<{PART}>"))
    speech = lambda b: F.when(b["body"] != "", F.array(part("strong", b["header"]), part("paragraph", b["body"]))).otherwise(F.array(part("strong", b["header"])))
    body = F.when(text != "", F.flatten(F.transform(blocks(text, flavor == "pdf"), speech))).otherwise(F.array(part("paragraph", NO_TRANSCRIPT)))
    title = F.coalesce(blank_to_null(F.col("summary.title")), F.lit(TRANSCRIPT_TITLES[flavor]))
    return analyses.select(by, F.concat(F.array(part("title", title), part("note", "Transcript Report")), source, F.array(part("heading", "Cleaned Transcript")), body).alias("parts"))


def shown(results: DataFrame, transcript: str = "transcript", result: str = "summary") -> DataFrame:
    """What a page displays: rows with a transcript and a result."""
    return results.where((strip(F.coalesce(F.col(transcript), F.lit(""))) != "") & F.col(result).isNotNull())


def card_point(p: Column) -> Column:
    """A discussion point as a page shows it: defaults differ from those of the documents."""
    return F.concat_ws(" | ", or_else(p["timestamp"], "--:--"), p["point"], or_else(F.array_join(p["speakers"], ", "), "N/A"))


def card_action(a: Column) -> Column:
    """An action item as a page shows it."""
    return F.concat_ws(" | ", a["task"], or_else(a["owner"], "Unassigned"), or_else(a["due_date"], "No due date"), or_else(a["timestamp"], "--:--"))
