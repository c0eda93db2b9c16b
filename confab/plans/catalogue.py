"""The registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.functions import clock, payload, sql, text
from confab.operators import increments, metrics, report, segments, tasks
from confab.sources.answers import AnswerStore
from confab.sources.files import audio_error, first_results, route
from confab.sources.sinks import analysis_json, output_path
from confab.sources.tables import work_path, written
from confab.streaming import keyed

from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class E:
    """What the SQL expects, written out once more: nothing here is read from the code under test."""

    RANGE = r"\[([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\s*-\s*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\]"
    CLEANUP = {"lets": "let's", "teh": "the", "api": "API", "rahul": "Rahul", "okay": "Okay"}
    DECISIONS_RESPONSE = "Decision response must include a decisions list."
    ACTIONS_RESPONSE = "Action item response must include an action_items list."
    COLUMNS = ("Task", "Owner", "Due Date", "Priority", "Status")
    HIGH = ("urgent", "today", "tomorrow", "blocked", "critical")
    MEDIUM = ("this week", "friday", "next demo", "review", "validate")
    NO_ACTIONS = "No action items were extracted."
    NO_DECISIONS = "No decisions were extracted."
    NO_STEPS = "No next steps were identified."
    STOCK = "The meeting covered the listed agenda items and produced the outcomes captured in this report."
    TRANSCRIPT_TITLES = {"docx": "Minutes of Meeting", "pdf": "Transcript Report"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {X.TEXTS},
m AS (SELECT meeting_id, count(DISTINCT label) AS speakers, count(*) AS turns, greatest(0.0, max(end_s) - min(start_s)) AS d, count(start_s) AS n FROM labelled GROUP BY meeting_id)
SELECT m.meeting_id, CASE WHEN n = 0 THEN 'N/A' WHEN d < 60 THEN concat(printf('%.1f', d), 's') ELSE concat(CAST(round_even(d, 0) AS BIGINT) // 60, 'm ', CAST(round_even(d, 0) AS BIGINT) % 60, 's') END AS duration,
       speakers, turns, sha256(trim(transcript_text, ' ' || chr(10))) AS cache_key
FROM m JOIN texts ON m.meeting_id = texts.meeting_id""")
def meeting_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: duration, speakers, turns and transcript key of every meeting."""
    m = metrics.meeting_metrics(X.segments(spark, sf_dir), "meeting_id", segments.transcript_of_group().alias("transcript_text"))
    return m.select("meeting_id", "duration", "speakers", "turns", text.content_key(F.col("transcript_text")).alias("cache_key"))


@query(f"WITH {X.LABELLED} SELECT meeting_id, seg_no, label, start_clock, end_clock, concat(label, ' [', start_clock, ' - ', end_clock, ']', chr(10), transcript) AS segment FROM labelled")
def segments_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir)
    whole = segments.segment_text(F.col("speaker_id"), F.col("start_s"), F.col("end_s"), F.col("transcript"))
    return s.select("meeting_id", "seg_no", segments.speaker_label(F.col("speaker_id")).alias("label"), clock.format_clock(F.col("start_s")).alias("start_clock"), clock.format_clock(F.col("end_s")).alias("end_clock"), whole.alias("segment"))


@query(f"WITH {X.TEXTS} SELECT meeting_id, transcript_text FROM texts")
def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.meeting_texts(spark, sf_dir)


@query(f"""
WITH {X.LABELLED}
SELECT meeting_id, CASE WHEN count(start_s) = 0 THEN 'N/A' WHEN greatest(0.0, max(end_s) - min(start_s)) < 60 THEN concat(printf('%.1f', greatest(0.0, max(end_s) - min(start_s))), 's')
  ELSE concat(CAST(round_even(max(end_s) - min(start_s), 0) AS BIGINT) // 60, 'm ', CAST(round_even(max(end_s) - min(start_s), 0) AS BIGINT) % 60, 's') END AS duration,
  count(DISTINCT label) AS speakers, count(*) AS turns, count(start_s) AS timed_turns FROM labelled GROUP BY meeting_id""")
def metrics_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all meetings from stored states, to which five increments were added, one of them twice."""
    s, store = X.segments(spark, sf_dir), increments.MetricStore(spark, work_path(spark, "metric-states"))
    for k in (3, 0, 4, 0, 1, 2):
        store.add(s.where(F.col("seg_no") % 5 == k), f"part {k}")
    return store.metrics().select("meeting_id", "duration", "speakers", "turns", "timed_turns")


_LOOSE = r"(?i)^((?:speaker|spk)\s*[\w.-]*)(?:\s*\[([^\]-]+)\s*-\s*([^\]]+)\])?\s*:?\s*(.*)$"


def _clock_value(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^\\s*[0-9]+:[0-9]+\\s*$') THEN TRY_CAST(split_part(trim({c}), ':', 1) AS DOUBLE) * 60 + TRY_CAST(split_part(trim({c}), ':', 2) AS DOUBLE) END"


_PARSED = rf"""
WITH {X.TEXTS},
l AS (SELECT meeting_id, unnest(list_filter(list_transform(string_split(transcript_text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line, generate_subscripts(list_filter(list_transform(string_split(transcript_text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) AS p FROM texts),
h AS (SELECT *, regexp_matches(line, '{_LOOSE}') AS head FROM l),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY meeting_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS grp FROM h),
b AS (SELECT meeting_id, grp, min(line) FILTER (head) AS hl, string_agg(CASE WHEN head THEN nullif(trim(regexp_extract(line, '{_LOOSE}', 4)), '') ELSE line END, ' ' ORDER BY p) AS transcript FROM g WHERE grp > 0 GROUP BY meeting_id, grp),
f AS (SELECT *, regexp_extract(hl, '{_LOOSE}', 1) AS lab, regexp_extract(hl, '{_LOOSE}', 2) AS st, regexp_extract(hl, '{_LOOSE}', 3) AS en FROM b WHERE transcript <> '')
SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY grp) - 1 AS seg_no,
       CASE WHEN regexp_extract(lab, '(\d+)', 1) <> '' THEN CAST(greatest(0, CAST(regexp_extract(lab, '(\d+)', 1) AS BIGINT) - 1) AS VARCHAR) ELSE trim(lab) END AS speaker_id,
       {_clock_value("st")} AS start_s, {_clock_value("en")} AS end_s, transcript FROM f"""


@query(_PARSED)
def parse_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text form read back into segments."""
    return segments.explode_segments(X.meeting_texts(spark, sf_dir), "transcript_text").withColumn("seg_no", F.col("seg_no").cast("long"))


@query(_PARSED)
def segments_by_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for texts that are too long for one row: by lines and splits of them."""
    lines = segments.lines_of_texts(X.meeting_texts(spark, sf_dir).withColumn("transcript_text", text.normalise(F.col("transcript_text"))), "transcript_text")
    return segments.segments_of_lines(lines).withColumn("seg_no", F.col("seg_no").cast("long"))


@query(_PARSED)
def segments_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written in SQL alone."""
    sql.register(spark)
    X.meeting_texts(spark, sf_dir).createOrReplaceTempView("confab_meeting_texts")
    return spark.sql("SELECT m.meeting_id, CAST(s.seg_no AS BIGINT) AS seg_no, s.speaker_id, s.start_s, s.end_s, s.transcript FROM confab_meeting_texts m, LATERAL confab_segments(m.transcript_text) s")


_STRICT = r"(?i)^\s*Speaker\s+\S+(?:\s+\[[^\]]+\])?\s*:?\s*$"


def _damaged(meeting: str, t: str) -> str:
    return f"CASE WHEN {meeting} % 2 = 0 THEN replace({t}, 'Speaker 2 [', 'Talker 2 [') ELSE {t} END"


@query(rf"""
WITH {X.TEXTS}, d AS (SELECT meeting_id, transcript_text AS o, {_damaged("meeting_id", "transcript_text")} AS c FROM texts),
n AS (SELECT meeting_id, len(list_filter(string_split(o, chr(10)), lambda x: regexp_matches(x, '{_STRICT}'))) AS headers, len(list_filter(string_split(c, chr(10)), lambda x: regexp_matches(x, '{_STRICT}'))) AS kept FROM d)
SELECT meeting_id, headers, kept, CASE WHEN kept < headers THEN 'Cleaned transcript appears to be missing speaker labels or timestamp headers.' END AS error FROM n""")
def header_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.meeting_texts(spark, sf_dir).select("meeting_id", F.col("transcript_text").alias("o"), F.expr(_damaged("meeting_id", "transcript_text")).alias("c"))
    return t.select("meeting_id", segments.header_count(F.col("o")).cast("long").alias("headers"), segments.header_count(F.col("c")).cast("long").alias("kept"), payload.cleaned_error(F.col("o"), F.col("c")).alias("error"))


_SECONDS = "list_reduce(list_transform(string_split({x}, ':'), lambda v: CAST(v AS BIGINT)), lambda a, b: a * 60 + b)"


@query(rf"""
WITH {X.TEXTS}, r AS (SELECT meeting_id, regexp_extract_all(transcript_text, '{E.RANGE}', 1) AS a, regexp_extract_all(transcript_text, '{E.RANGE}', 2) AS b FROM texts),
s AS (SELECT meeting_id, CASE WHEN len(a) > 0 THEN {_SECONDS.format(x="a[1]")} END AS f, CASE WHEN len(b) > 0 THEN {_SECONDS.format(x="b[-1]")} END AS l FROM r)
SELECT meeting_id, CASE WHEN l > f THEN concat(greatest(1, CAST(round_even((l - f) / 60, 0) AS BIGINT)), ' min') ELSE 'N/A' END AS duration FROM s""")
def transcript_duration_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.meeting_texts(spark, sf_dir).select("meeting_id", metrics.duration_of_text(F.col("transcript_text")).alias("duration"))


@query(rf"WITH {X.TEXTS} SELECT meeting_id, CAST(len(list_distinct(regexp_extract_all(transcript_text, '(?m)^(Speaker\s+\S+)', 1))) AS BIGINT) AS speakers FROM texts")
def transcript_speakers_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.meeting_texts(spark, sf_dir).select("meeting_id", metrics.speakers_of_text(F.col("transcript_text")).cast("long").alias("speakers"))


@query(f"""
WITH {X.LABELLED}, f AS (SELECT meeting_id, label, min(seg_no) AS first_seg FROM labelled GROUP BY ALL)
SELECT meeting_id, label, first_seg, concat('s', (row_number() OVER (PARTITION BY meeting_id ORDER BY first_seg, label) - 1) % 4 + 1) AS slot FROM f""")
def speaker_color_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.colour_slots(X.segments(spark, sf_dir))


_MESSY = "concat('  ', replace(text, '. ', ' \r\n\r\n\r\n '), '\t')"


@query(r"""
WITH a AS (SELECT doc_id, concat('  ', replace(text, '. ', concat(' ', chr(13), chr(10), chr(13), chr(10), chr(13), chr(10), ' ')), chr(9)) AS t FROM documents),
b AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, concat(' ', chr(9)))), chr(10)) AS t FROM a)
SELECT doc_id, trim(regexp_replace(t, '\n{3,}', concat(chr(10), chr(10)), 'g'), concat(' ', chr(10))) AS normalised FROM b""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.expr(_MESSY)).alias("normalised"))


@query(rf"""
WITH {X.TEXTS}, b AS (SELECT meeting_id, list_filter(string_split_regex(trim(transcript_text, concat(' ', chr(10))), '\n\s*\n'), lambda x: trim(x, concat(' ', chr(10))) <> '') AS b FROM texts),
u AS (SELECT meeting_id, unnest(b) AS x, generate_subscripts(b, 1) - 1 AS block FROM b)
SELECT meeting_id, CAST(block AS BIGINT) AS block, trim(string_split(trim(x, concat(' ', chr(10))), chr(10))[1]) AS header, trim(array_to_string(list_transform(string_split(trim(x, concat(' ', chr(10))), chr(10))[2:], lambda l: trim(l)), chr(10)), concat(' ', chr(10))) AS body FROM u""")
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.meeting_texts(spark, sf_dir).select("meeting_id", F.posexplode(text.blocks(F.col("transcript_text"))).alias("block", "b"))
    return t.select("meeting_id", F.col("block").cast("long").alias("block"), "b.header", "b.body")


_CLEAN = "x"
for _k, _v in E.CLEANUP.items():
    _CLEAN = f"regexp_replace({_CLEAN}, '(?i)\\b{_k}\\b', '{_v.replace(chr(39), chr(39) * 2)}', 'g')"


@query(rf"""
WITH a AS (SELECT conv_id, turn, list_transform(string_split(replace(replace(text, ' the ', ' teh '), ' of ', ' api '), chr(10)), lambda x: trim(x)) AS l FROM conversations),
b AS (SELECT conv_id, turn, list_transform(l, lambda x: {_CLEAN}) AS w, l FROM a)
SELECT conv_id, turn, array_to_string(list_transform(list_zip(l, w), lambda z: CASE WHEN z[1] = '' OR starts_with(lower(z[1]), 'speaker ') THEN z[1]
  ELSE concat(upper(z[2][1]), z[2][2:], CASE WHEN right(z[2], 1) IN ('.', '?', '!') THEN '' ELSE '.' END) END), chr(10)) AS cleaned FROM b""")
def rule_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(F.replace("text", F.lit(" the "), F.lit(" teh ")), F.lit(" of "), F.lit(" api "))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.rule_cleanup(raw).alias("cleaned"))


def _answers(name: str, rows: str, item: str, key: str) -> str:
    """SQL of the six shapes of an answer, and of the error of each."""
    return f"""
{name} AS (SELECT meeting_id, abs(meeting_id) % 6 AS k, list(x ORDER BY ord) AS items FROM (SELECT *, {item} AS x FROM {rows}) GROUP BY meeting_id)"""


def _shape_errors(one: str, response: str, checks: str) -> str:
    return f"""CASE k WHEN 2 THEN '{one} response must be an object.' WHEN 3 THEN '{one} response is not valid JSON.' WHEN 4 THEN '{response}'
  WHEN 5 THEN concat('{one} ', len(items) + 1, ' must be a JSON object.') ELSE {checks} END"""


_BAD_DECISION = "list_filter(list_transform(range(1, len(items) + 1), lambda i: CASE WHEN items[i].decision = '' THEN concat('Decision ', i, ' is missing decision text.') END), lambda e: e IS NOT NULL)[1]"
_DECISION_ROWS = f"""
WITH {X.DECISIONS}, {_answers("a", "decided", "{'decision': decision, 'confidence': lower(trim(confidence))}", "decisions")},
e AS (SELECT *, {_shape_errors("Decision", E.DECISIONS_RESPONSE, _BAD_DECISION)} AS error FROM a)"""


@query(f"""{_DECISION_ROWS}
SELECT meeting_id, CAST(i - 1 AS BIGINT) AS ord, items[i].decision AS decision, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS timestamp, items[i].confidence AS confidence
FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM e WHERE error IS NULL)""")
def decisions_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.decision_responses(spark, sf_dir).select("meeting_id", payload.parse_items(F.col("response"), payload.DECISIONS).alias("r"))
    return r.select("meeting_id", F.posexplode("r.items").alias("ord", "x")).select("meeting_id", F.col("ord").cast("long").alias("ord"), "x.*")


@query(f"{_DECISION_ROWS} SELECT meeting_id, error FROM e")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.decision_responses(spark, sf_dir).select("meeting_id", payload.parse_items(F.col("response"), payload.DECISIONS)["error"].alias("error"))


_ACTION_ROWS = f"""
WITH {X.ACTIONS}, {_answers("a", "actions", "{'task': task, 'owner': owner, 'due_date': due_date, 'status': status}", "action_items")},
e AS (SELECT *, {_shape_errors("Action item", E.ACTIONS_RESPONSE, "NULL")} AS error FROM a)"""


@query(f"""{_ACTION_ROWS}
SELECT meeting_id, CAST(i - 1 AS BIGINT) AS ord, items[i].task AS task, items[i].owner AS owner, items[i].due_date AS due_date, CAST(NULL AS VARCHAR) AS timestamp, items[i].status AS status
FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM e WHERE error IS NULL)""")
def action_items_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.action_responses(spark, sf_dir).select("meeting_id", payload.parse_items(F.col("response"), payload.ACTIONS).alias("r"))
    return r.select("meeting_id", F.posexplode("r.items").alias("ord", "x")).select("meeting_id", F.col("ord").cast("long").alias("ord"), "x.*")


def _point_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir)
    body = F.struct(F.concat(F.lit("Point "), F.col("seg_no").cast("string")).alias("point"), F.array(segments.speaker_label(F.col("speaker_id")), F.lit(" ")).alias("speakers"), clock.format_clock(F.col("start_s")).alias("timestamp"))
    return X.responses(s.select("meeting_id", F.col("seg_no").alias("ord"), F.to_json(body).alias("item")), "key_discussion_points")


@query(f"""WITH {X.LABELLED}, n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no) - 1 AS ord FROM labelled WHERE meeting_id % 6 < 2)
SELECT meeting_id, ord, concat('Point ', seg_no) AS point, label AS speakers, start_clock AS timestamp FROM n""")
def key_points_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _point_answers(spark, sf_dir).select("meeting_id", F.posexplode(payload.parse_items(F.col("response"), payload.POINTS)["items"]).alias("ord", "x"))
    return r.select("meeting_id", F.col("ord").cast("long").alias("ord"), "x.point", F.array_join("x.speakers", ", ").alias("speakers"), "x.timestamp")


def _json_text(c: Column) -> Column:
    whole = F.to_json(F.array(c))
    return whole.substr(F.lit(2), F.length(whole) - 2)


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def _analysis_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-analysis answers over the meetings' own texts; half of them break one rule each."""
    m = F.col("meeting_id")
    k = m % 16
    open_ = F.when((F.col("decision") == "") & (k != 8), F.concat(F.lit("left item "), F.col("ord").cast("string"), F.lit(" open"))).otherwise(F.col("decision"))
    d = X.listed(X.decisions(spark, sf_dir).withColumn("decision", open_), "decisions")
    a = X.listed(X.action_items(spark, sf_dir), "action_items")
    rows = X.meeting_texts(spark, sf_dir).join(d, "meeting_id", "left").join(a, "meeting_id", "left")
    changed = lambda name, field, value: F.transform(name, lambda x, i: x.withField(field, F.when((k == {"decisions": 6, "action_items": 7}[name]) & (i == 0), F.lit(value)).otherwise(x[field])))
    lists = F.struct(changed("decisions", "confidence", "maybe").alias("decisions"), changed("action_items", "status", " ").alias("action_items"))
    points = F.transform(_numbers(m % 9 + 1), lambda i: F.struct(F.when((k == 5) & (i == 1), F.lit(" ")).otherwise(F.concat(F.lit("Point "), i.cast("string"))).alias("point"), F.array(F.lit("Speaker 1"), F.lit(" ")).alias("speakers"), F.when(i % 2 == 0, F.concat(F.lit("00:0"), i.cast("string"))).alias("timestamp")))
    topics = F.transform(_numbers(m % 11), lambda i: F.concat(F.lit("topic "), i.cast("string")))
    title = F.when(k == 4, F.lit(" ")).otherwise(F.concat(F.lit("Meeting "), m.cast("string")))
    summary = F.when(k == 2, F.lit('"oops"')).otherwise(F.to_json(F.struct(title.alias("title"), F.lit("Short.").alias("short_summary"), F.lit("The discussion focused on orders.").alias("detailed_summary"), topics.alias("topics_discussed"))))
    cleaned = F.when(k == 1, F.replace("transcript_text", F.lit("Speaker 2 ["), F.lit("Talker 2 ["))).otherwise(F.col("transcript_text"))
    inner = F.regexp_replace(F.to_json(lists), r"^\{|\}$", "")
    body = F.concat(
        F.lit('{"cleaned_transcript": '), _json_text(cleaned), F.lit(', "summary": '), summary, F.when(k == 3, F.lit(', "topics_discussed": "oops"')).otherwise(F.lit("")),
        F.lit(', "key_discussion_points": '), F.to_json(points), F.when(inner != "", F.concat(F.lit(", "), inner)).otherwise(F.lit("")), F.lit("}"),
    )
    return rows.select("meeting_id", "transcript_text", F.when(k == 0, F.lit("not json")).otherwise(body).alias("response"))


_ANALYSIS = rf"""
{X.TEXTS}, {X.DECISIONS}, {X.ACTIONS},
h AS (SELECT meeting_id, transcript_text, meeting_id % 16 AS k, len(list_filter(string_split(transcript_text, chr(10)), lambda x: regexp_matches(x, '{_STRICT}'))) AS a,
        len(list_filter(string_split(CASE WHEN meeting_id % 16 = 1 THEN replace(transcript_text, 'Speaker 2 [', 'Talker 2 [') ELSE transcript_text END, chr(10)), lambda x: regexp_matches(x, '{_STRICT}'))) AS b FROM texts),
said AS (SELECT meeting_id, ord, CASE WHEN decision = '' AND meeting_id % 16 <> 8 THEN concat('left item ', ord, ' open') ELSE decision END AS decision FROM decided),
ds AS (SELECT meeting_id, list(decision ORDER BY ord) AS ds, list({X.PHRASE} ORDER BY ord) AS phrases FROM said GROUP BY meeting_id),
ac AS (SELECT meeting_id, list({X.STEP} ORDER BY ord) AS steps, list_sort(list_distinct(list(owner) FILTER (owner IS NOT NULL))) AS owners,
         list(concat(task, ' | ', coalesce(owner, 'Unassigned'), ' | ', coalesce(due_date, 'N/A'), ' | ', {{priority}}, ' | ', status) ORDER BY ord) AS rows FROM (SELECT *, lower(concat_ws(' ', task, coalesce(due_date, ''), status)) AS x FROM actions) GROUP BY meeting_id),
j AS (SELECT *, CASE WHEN k = 0 THEN 'Meeting summary response is not valid JSON.' WHEN b < a THEN 'Cleaned transcript appears to be missing speaker labels or timestamp headers.'
  WHEN k = 2 THEN 'Full analysis response must include a summary object.' WHEN k = 3 THEN 'topics_discussed must be a list.' WHEN k = 4 THEN 'Meeting summary is missing a title.'
  WHEN meeting_id % 11 = 0 THEN 'Meeting summary is missing topics discussed.' WHEN k = 5 THEN 'Key discussion point 1 is missing point text.'
  WHEN k = 6 AND ds IS NOT NULL THEN 'Decision 1 has invalid confidence ''maybe''; expected high, medium, or low.'
  WHEN k = 8 AND list_contains(ds, '') THEN concat('Decision ', list_position(ds, ''), ' is missing decision text.')
  WHEN k = 7 AND steps IS NOT NULL THEN 'Action item 1 is missing status.' END AS error
  FROM h LEFT JOIN ds USING (meeting_id) LEFT JOIN ac USING (meeting_id))""".replace(
    "{priority}", f"CASE WHEN regexp_matches(x, '{'|'.join(E.HIGH)}') THEN 'High' WHEN regexp_matches(x, '{'|'.join(E.MEDIUM)}') THEN 'Medium' ELSE 'Low' END"
)


@query(f"""WITH {_ANALYSIS}
SELECT meeting_id, error, CASE WHEN error IS NULL THEN concat('Meeting ', meeting_id) END AS title, CASE WHEN error IS NULL THEN CAST(meeting_id % 9 + 1 AS INTEGER) ELSE 0 END AS points,
       CASE WHEN error IS NULL THEN CAST(len(coalesce(ds, [])) AS INTEGER) ELSE 0 END AS decisions, CASE WHEN error IS NULL THEN CAST(len(coalesce(steps, [])) AS INTEGER) ELSE 0 END AS action_items FROM j""")
def full_analysis_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _analysis_answers(spark, sf_dir).select("meeting_id", payload.parse_analysis(F.col("response"), F.col("transcript_text")).alias("r"))
    counts = metrics.list_counts(F.col("r.key_discussion_points"), F.col("r.decisions"), F.col("r.action_items"))
    return r.select("meeting_id", "r.error", F.col("r.summary.title").alias("title"), *counts).withColumnRenamed("discussion_points", "points")


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyses that parse, written: reports use each field many times, and parse no answer twice."""
    r = _analysis_answers(spark, sf_dir).select("meeting_id", payload.parse_analysis(F.col("response"), F.col("transcript_text")).alias("r")).where("r.error is null")
    return written(r.select("meeting_id", "r.cleaned_transcript", "r.summary", "r.key_discussion_points", "r.decisions", "r.action_items"), "analyses")


_SENTENCE = "concat(upper(x[1]), x[2:], CASE WHEN right(x, 1) IN ('.', '?', '!') THEN '' ELSE '.' END)"
_MODEL = rf"""{_ANALYSIS},
t AS (SELECT *, regexp_extract_all(transcript_text, '{E.RANGE}', 1) AS f, regexp_extract_all(transcript_text, '{E.RANGE}', 2) AS l, len(list_distinct(regexp_extract_all(transcript_text, '(?m)^(Speaker\s+\S+)', 1))) AS n FROM j WHERE error IS NULL),
t2 AS (SELECT *, CASE WHEN len(f) > 0 THEN {_SECONDS.format(x="f[1]")} END AS began, CASE WHEN len(l) > 0 THEN {_SECONDS.format(x="l[-1]")} END AS ended FROM t),
model AS (SELECT meeting_id, transcript_text, concat('Meeting ', meeting_id) AS title, '2024-01-01' AS date, CASE WHEN ended > began THEN concat(greatest(1, CAST(round_even((ended - began) / 60, 0) AS BIGINT)), ' min') ELSE 'N/A' END AS duration,
  CASE WHEN n > 0 THEN CAST(n AS VARCHAR) ELSE 'N/A' END AS speakers,
  list_filter(['The meeting focused on orders.', CASE WHEN ds IS NOT NULL THEN concat('Key decisions included ', array_to_string(phrases[1:3], '; '), '.') END,
    CASE WHEN steps IS NOT NULL THEN concat('Follow-up activities were assigned to ', CASE WHEN len(coalesce(owners, [])) > 0 THEN array_to_string(owners[1:4], ', ') ELSE 'the assigned owners' END, ', with progress to be tracked through the action items below.') END], lambda x: x IS NOT NULL) AS paras,
  list_transform(range(1, least(meeting_id % 11, 8) + 1), lambda i: concat('topic ', i)) AS topics,
  list_transform(range(1, least(meeting_id % 9 + 1, 6) + 1), lambda i: {{{{'point': concat('Point ', i), 'source': concat('Timestamp: ', CASE WHEN i % 2 = 0 THEN concat('00:0', i) ELSE 'N/A' END, ' | Speaker(s): Speaker 1')}}}}) AS points,
  list_transform(coalesce(ds, []), lambda x: {_SENTENCE}) AS sentences, coalesce(rows, []) AS rows,
  CASE WHEN steps IS NULL AND ds IS NULL THEN ['{E.NO_STEPS}'] ELSE list_concat(coalesce(steps, []), list_transform(coalesce(phrases, [])[1:3], lambda x: concat('Team will proceed in line with: ', x, '.'))) END AS next
  FROM t2)""".replace("{{", "{").replace("}}", "}")


@query(rf"""WITH {_MODEL}
SELECT meeting_id, array_to_string(list_concat([title, concat('Date: ', date), concat('Duration: ', duration), concat('Speakers: ', speakers), '', 'EXECUTIVE SUMMARY'], paras, ['', 'TOPICS'], list_transform(topics, lambda x: concat('- ', x)),
  ['', 'KEY POINTS'], list_transform(points, lambda x: concat('- ', x.point, ' (', x.source, ')')), ['', 'DECISIONS'], list_transform(sentences, lambda x, i: concat(i, '. ', x)), ['', 'ACTION ITEMS'], rows, ['', 'NEXT STEPS'], list_transform(next, lambda x: concat('- ', x))), chr(10)) AS minutes FROM model""")
def minutes_of_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-text minutes of every meeting that parses."""
    return report.minutes_text(report.report_model(_analyses(spark, sf_dir), today=F.lit("2024-01-01")))


def _pieces(documents: DataFrame) -> DataFrame:
    """A row per document piece, table cells joined."""
    rows = documents.select("meeting_id", F.posexplode("parts").alias("ord", "p"))
    return rows.select("meeting_id", F.col("ord").cast("long").alias("ord"), F.col("p.kind").alias("kind"), F.coalesce("p.text", F.array_join("p.cells", " | ")).alias("text"))


_EACH = "list_transform({1}, lambda x: {{'kind': '{0}', 'text': x}})"
_ONE = "[{{'kind': '{0}', 'text': {1}}}]"


def _document_sql(flavor: str) -> str:
    each, one = (lambda k, x: _EACH.format(k, x)), (lambda k, x: _ONE.format(k, x))
    rule = [one("rule", "NULL")] if flavor == "docx" else []
    head = lambda t: one("heading", f"'{t}'")
    none = f"len(rows) = 0 AND len(sentences) = 0" if flavor == "docx" else "len(rows) = 0"
    steps = f"CASE WHEN {none} THEN {one('paragraph', chr(39) + E.NO_STEPS + chr(39))} ELSE {each('bullet', 'next')} END"
    parts = [
        one("title", "'MINUTES OF MEETING'"), *rule, one("strong", "title"), head("Meeting Information"), each("row", "[concat('Date | ', date), concat('Duration | ', duration), concat('Speakers Detected | ', speakers), 'Generated By | confab']"),
        head("EXECUTIVE SUMMARY"), each("paragraph", "paras"), head("TOPICS DISCUSSED"), each("bullet", "topics"), head("KEY DISCUSSION POINTS"),
        "flatten(list_transform(points, lambda x: [{'kind': 'bullet', 'text': x.point}, {'kind': 'note', 'text': x.source}]))",
        head("DECISIONS TAKEN"), f"CASE WHEN len(sentences) > 0 THEN {each('numbered', 'sentences')} ELSE {one('paragraph', chr(39) + E.NO_DECISIONS + chr(39))} END",
        head("ACTION ITEMS"), f"CASE WHEN len(rows) > 0 THEN list_concat({one('columns', chr(39) + ' | '.join(E.COLUMNS) + chr(39))}, {each('row', 'rows')}) ELSE {one('paragraph', chr(39) + E.NO_ACTIONS + chr(39))} END",
        head("NEXT STEPS"), steps, *rule, one("end", "'Generated by confab'"),
    ]
    return f"""WITH {_MODEL}, d AS (SELECT meeting_id, list_concat({', '.join(parts)}) AS parts FROM model)
SELECT meeting_id, CAST(i - 1 AS BIGINT) AS ord, parts[i].kind AS kind, CASE WHEN parts[i].kind = 'rule' THEN NULL ELSE parts[i].text END AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM d)"""


@query(_document_sql("docx"))
def minutes_document_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the minutes, as the DOCX sink writes them."""
    return _pieces(report.minutes_document(report.report_model(_analyses(spark, sf_dir), today=F.lit("2024-01-01"))))


@query(_document_sql("pdf"))
def minutes_document_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the minutes, as the PDF sink writes them."""
    return _pieces(report.minutes_document(report.report_model(_analyses(spark, sf_dir), "pdf", today=F.lit("2024-01-01")), "pdf"))


def _transcript_sql(flavor: str) -> str:
    strong, body = _ONE.format("strong", "y.header"), _ONE.format("paragraph", "y.body")
    lines = "list_transform(string_split(trim(x, concat(' ', chr(10))), chr(10)), lambda l: trim(l))"
    text = f"trim(array_to_string({lines}[2:], chr(10)), concat(' ', chr(10)))" if flavor == "docx" else f"array_to_string(list_filter({lines}[2:], lambda l: l <> ''), ' ')"
    return rf"""
WITH {X.TEXTS}, b AS (SELECT meeting_id, list_transform(list_filter(string_split_regex(trim(transcript_text, concat(' ', chr(10))), '\n\s*\n'), lambda x: trim(x, concat(' ', chr(10))) <> ''), lambda x: {{'header': {lines}[1], 'body': {text}}}) AS b FROM texts),
d AS (SELECT meeting_id, list_concat([{{'kind': 'title', 'text': CASE WHEN meeting_id % 4 = 0 THEN '{E.TRANSCRIPT_TITLES[flavor]}' ELSE concat('Meeting ', meeting_id) END}}, {{'kind': 'note', 'text': 'Transcript Report'}}],
  CASE WHEN meeting_id % 3 = 0 THEN [{{'kind': 'paragraph', 'text': concat('Source Audio File: ', meeting_id, '.wav')}}] ELSE [] END, [{{'kind': 'heading', 'text': 'Cleaned Transcript'}}],
  flatten(list_transform(b, lambda y: CASE WHEN y.body <> '' THEN list_concat({strong}, {body}) ELSE {strong} END))) AS parts FROM b)
SELECT meeting_id, CAST(i - 1 AS BIGINT) AS ord, parts[i].kind AS kind, parts[i].text AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM d)"""


def _transcript_reports(spark: SparkSession, sf_dir: str, flavor: str) -> DataFrame:
    m = F.col("meeting_id")
    title = F.when(m % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Meeting "), m.cast("string")))
    info = F.create_map(F.lit("Source File"), F.when(m % 3 == 0, F.concat(m.cast("string"), F.lit(".wav"))).otherwise(F.lit("")))
    rows = X.meeting_texts(spark, sf_dir).select("meeting_id", F.col("transcript_text").alias("cleaned_transcript"), F.struct(title.alias("title")).alias("summary"), info.alias("info"))
    return _pieces(report.transcript_document(rows, flavor, "info"))


@query(_transcript_sql("docx"))
def transcript_report_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcript_reports(spark, sf_dir, "docx")


@query(_transcript_sql("pdf"))
def transcript_report_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcript_reports(spark, sf_dir, "pdf")


@query("""SELECT conv_id, turn, CASE conv_id % 9 WHEN 0 THEN 'Meeting summary response is empty.' WHEN 1 THEN 'Meeting summary response is not valid JSON.' WHEN 2 THEN 'Meeting summary response must be an object.' WHEN 3 THEN 'topics_discussed must be a list.'
  WHEN 4 THEN 'Meeting summary is missing a title.' WHEN 5 THEN 'Meeting summary is missing a short summary.' WHEN 6 THEN 'Meeting summary is missing a detailed summary.' WHEN 7 THEN 'Meeting summary is missing topics discussed.' END AS error,
  CASE WHEN conv_id % 9 = 8 THEN concat('T', turn) END AS title, CASE WHEN conv_id % 9 = 8 THEN trim(text, concat(' ', chr(10))) END AS detailed, CASE WHEN conv_id % 9 = 8 THEN 'None, 7, a' END AS topics FROM conversations""")
def summary_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary answers, one in nine whole, the others with one fault each."""
    k = F.col("conv_id") % 9
    some = lambda n, c: F.when(k == n, F.lit('" "')).otherwise(c)
    topics = F.when(k == 3, F.lit('"a"')).when(k == 7, F.lit('[" "]')).otherwise(F.lit('[null, " ", 7, " a "]'))
    whole = F.concat(F.lit('{"title": '), some(4, _json_text(F.concat(F.lit("T"), F.col("turn").cast("string")))), F.lit(', "short_summary": '), some(5, F.lit('"s"')), F.lit(', "detailed_summary": '), some(6, _json_text(F.col("text"))), F.lit(', "topics_discussed": '), topics, F.lit("}"))
    answer = F.when(k == 0, F.lit(" ")).when(k == 1, F.lit("{oops")).when(k == 2, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    r = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.parse_summary(answer).alias("r"))
    return r.select("conv_id", "turn", "r.error", F.col("r.summary.title").alias("title"), F.col("r.summary.detailed_summary").alias("detailed"), F.array_join("r.summary.topics_discussed", ", ").alias("topics"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Action item 1 is missing task.' WHEN 1 THEN 'Action item 2 is missing status.' WHEN 2 THEN 'Action item 2 must be a JSON object.' END AS action_error,
  CASE doc_id % 6 WHEN 0 THEN 'Key discussion point 1 speakers must be a list.' WHEN 1 THEN 'Key discussion point 1 is missing speakers.' WHEN 2 THEN 'Key discussion point 2 is missing point text.' WHEN 3 THEN 'Key discussion point response must include a key_discussion_points list.' END AS point_error,
  CASE doc_id % 6 WHEN 0 THEN 'Decision 1 is missing decision text.' WHEN 1 THEN 'Decision 1 is missing confidence.' WHEN 2 THEN concat('Decision 2 has invalid confidence ''', 'sure', '''; expected high, medium, or low.') END AS decision_error,
  CASE doc_id % 6 WHEN 0 THEN 'Cleanup response is empty.' WHEN 1 THEN 'Cleanup response must be an object.' WHEN 2 THEN 'Cleaned transcript is empty.' WHEN 3 THEN 'Cleaned transcript appears to be missing speaker labels or timestamp headers.' END AS cleanup_error FROM labels""")
def answer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of list items and of the cleanup answer, in the order of the checks."""
    k = F.col("doc_id") % 6
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (k + 1).cast("int"))
    good = '{"task": "t", "status": "open"}'
    actions = pick(f'[{{"task": " ", "status": ""}}, {good}]', f'[{good}, {{"task": "t"}}]', f"[{good}, 7]", f"[{good}]", "[]", f"[{good}, {good}]")
    point = '{"point": "p", "speakers": ["a"]}'
    points = pick('[{"point": "p", "speakers": "a"}]', '[{"point": "p"}]', f'[{point}, {{"speakers": ["a"]}}]', '"x"', "[]", f"[{point}]")
    said = '{"decision": "d", "confidence": " HIGH "}'
    decided = pick('[{"decision": "", "confidence": "odd"}]', '[{"decision": "d"}]', f'[{said}, {{"decision": "d", "confidence": "Sure"}}]', "[]", f"[{said}]", f"[{said}, {said}]")
    cleanup = pick("``` ", "[1]", '{"cleaned_transcript": " "}', "no header", '{"cleaned_transcript": "Speaker 1:\\nhello"}', "Speaker 2 [00:01 - 00:02]\nhello")
    of = lambda key, items: F.concat(F.lit(f'{{"{key}": '), items, F.lit("}"))
    empty = F.when(k == 0, F.lit("")).otherwise(cleanup)
    return X.table(spark, sf_dir, "labels").select(
        "doc_id", payload.parse_items(of("action_items", actions), payload.ACTIONS)["error"].alias("action_error"), payload.parse_items(of("key_discussion_points", points), payload.POINTS)["error"].alias("point_error"),
        payload.parse_items(of("decisions", decided), payload.DECISIONS)["error"].alias("decision_error"), payload.parse_cleanup(empty, F.lit("Speaker 1:\nhi"))["error"].alias("cleanup_error"),
    )


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('file ', conv_id, ' is damaged') WHEN 1 THEN 'Unknown batch job failure.' END AS batch_error,
  CASE turn % 7 WHEN 0 THEN 'Transcription result must be an object.' WHEN 1 THEN 'Transcript must be a string.' WHEN 2 THEN 'Segments must be a list.' WHEN 3 THEN 'Segment 2 must be an object.' WHEN 4 THEN 'Transcription result contains no transcript text or segments.' END AS result_error,
  CASE turn % 3 WHEN 0 THEN 'Payload is not valid JSON.' WHEN 1 THEN 'Speech to text returned an empty transcript.' END AS payload_error,
  CASE WHEN turn % 3 = 2 THEN concat(trim(text, concat(' ', chr(10))), ' again') ELSE '' END AS plain FROM conversations""")
def speech_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed batch jobs, results of a wrong shape, payloads without text, and texts made of segments."""
    t, body = F.col("turn"), _json_text(F.col("text"))
    job = F.when(t % 4 == 0, F.concat(F.lit('{"job_state": "Failed", "failed": [{"error_message": "file '), F.col("conv_id").cast("string"), F.lit(' is damaged"}, {"error_message": "other"}]}'))).when(t % 4 == 1, F.lit('{"job_state": "FAILED", "failed": []}')).otherwise(F.lit('{"job_state": "Completed"}'))
    r = t % 7
    result = (
        F.when(r == 0, F.lit("[]")).when(r == 1, F.lit('{"transcript": 7, "segments": []}')).when(r == 2, F.concat(F.lit('{"transcript": '), body, F.lit("}"))).when(r == 3, F.lit('{"transcript": "", "segments": [{}, 7]}'))
        .when(r == 4, F.lit('{"transcript": " ", "segments": []}')).when(r == 5, F.lit('{"transcript": "", "segments": [{}]}')).otherwise(F.concat(F.lit('{"transcript": '), body, F.lit(', "segments": []}')))
    )
    speech = F.when(t % 3 == 0, F.lit("oops")).when(t % 3 == 1, F.lit('{"transcript": " "}')).otherwise(F.concat(F.lit('{"diarized_transcript": {"entries": [{"transcript": '), body, F.lit('}, 7, {"transcript": "again"}]}}')))
    p = payload.parse_speech(speech)
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.batch_failure(job).alias("batch_error"), payload.speech_result_error(result).alias("result_error"), p["error"].alias("payload_error"), p["transcript"].alias("plain"))


@query("""SELECT event_id, printf('%02d:%02d.%03d', CAST(round_even(value * 1000, 0) AS BIGINT) // 60000, CAST(round_even(value * 1000, 0) AS BIGINT) // 1000 % 60, CAST(round_even(value * 1000, 0) AS BIGINT) % 1000) AS clock_ms,
  CAST(CASE WHEN event_id % 10 > 2 THEN 0 WHEN event_id % 10 = 0 THEN 2 WHEN event_id % 10 = 1 THEN 5 ELSE 10 END AS DOUBLE) AS delay, printf('%.2f MB', round_even(event_id * 1000 / 1048576, 2)) AS size,
  CASE event_id % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'wav' WHEN 2 THEN 'ogg' ELSE '' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 'The audio file is empty.' WHEN event_id % 4 = 2 THEN 'Unsupported audio format ''.ogg''. Supported formats: .aac, .m4a, .mp3, .mp4, .wav.' WHEN event_id % 4 = 3 THEN 'Unsupported audio format ''unknown''. Supported formats: .aac, .m4a, .mp3, .mp4, .wav.' END AS audio_error,
  CASE WHEN event_id % 2 = 0 THEN concat('/given/', event_id) ELSE concat('/out/minutes_of_meeting_20240102_030405_', event_id, '.docx') END AS path,
  concat('Upload: ', event_type, CASE WHEN event_id % 2 = 0 THEN concat(' (user=''', user_id, ''')') ELSE '' END) AS log FROM events""")
def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks with milliseconds, waits, sizes, kinds, audio checks, output paths and log lines."""
    e = F.col("event_id")
    name = F.concat(F.lit("/a.b/file"), e.cast("string"), F.element_at(F.array(*map(F.lit, (".MP3", ".wav", ".tar.ogg", ""))), (e % 4 + 1).cast("int")))
    size = F.when(e % 5 == 0, 0).otherwise(e)
    path = output_path(F.lit("/out"), "minutes_of_meeting", F.lit("2024-01-02 03:04:05").cast("timestamp"), e, "docx", F.when(e % 2 == 0, F.concat(F.lit("/given/"), e.cast("string"))).otherwise(F.lit("")))
    details = F.when(e % 2 == 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return X.table(spark, sf_dir, "events").select(
        "event_id", clock.format_clock_ms(F.col("value")).alias("clock_ms"), F.coalesce(clock.retry_delay((e % 10 + 1).cast("int")).cast("double"), F.lit(0.0)).alias("delay"), text.size_label(e * 1000).alias("size"),
        text.suffix(name).alias("kind"), audio_error(name, size).alias("audio_error"), path.alias("path"), text.log_line(F.lit("Upload"), F.col("event_type"), details).alias("log"),
    )


@query(f"""WITH {X.LABELLED}, n AS (SELECT meeting_id, CAST(count(DISTINCT label) AS INTEGER) AS speakers FROM labelled GROUP BY meeting_id)
SELECT l.meeting_id, seg_no, CASE WHEN seg_no % 2 = 0 THEN speakers WHEN seg_no % 4 = 1 THEN 1 ELSE 0 END AS speakers, CASE WHEN label LIKE '%2' THEN 2 WHEN label LIKE '%3' THEN 3 ELSE 1 END AS colour,
  CASE WHEN speaker_id = '0' THEN 'Speaker 1' WHEN speaker_id = '1' THEN 'Speaker 2' WHEN speaker_id IS NULL THEN 'Speaker Speaker 9' ELSE concat('Speaker ', speaker_id) END AS old_label,
  concat_ws(' | ', coalesce(nullif(start_clock, '--:--'), '--:--'), transcript, CASE WHEN seg_no % 3 = 0 THEN 'N/A' ELSE label END) AS card,
  concat('[', CASE WHEN start_s IS NULL THEN 'N/A' ELSE start_clock END, '] ', transcript, ' (', CASE WHEN seg_no % 3 = 0 THEN 'N/A' ELSE label END, ')') AS verbose FROM labelled l JOIN n USING (meeting_id)""")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages and the long report show of each segment, and the speakers of nested meetings."""
    s = X.segments(spark, sf_dir)
    nested = s.groupBy("meeting_id").agg(F.collect_list(F.struct("speaker_id", "seg_no")).alias("all"))  # a meeting's segments
    n, label = F.col("seg_no"), segments.speaker_label(F.col("speaker_id"))
    one = F.struct(F.when(F.col("start_s").isNotNull(), clock.format_clock(F.col("start_s"))).alias("timestamp"), F.col("transcript").alias("point"), F.when(n % 3 != 0, F.array(label)).otherwise(F.array().cast("array<string>")).alias("speakers"))
    rows = s.join(nested, "meeting_id").select("*", one.alias("p"))
    none = F.array().cast(rows.schema["all"].dataType)
    speakers = metrics.speakers_of(F.when(n % 2 == 0, F.col("all")).otherwise(none), F.when(n % 4 == 1, F.col("transcript")).otherwise(F.lit(" ")))
    verbose = F.element_at(report.verbose_lines(F.array("p"), F.array().cast("array<struct<timestamp:string,decision:string,owner:string,confidence:string>>"))[0], 1)
    old = segments.speaker_label_plain(F.coalesce("speaker_id", F.lit("Speaker 9")))
    return rows.select("meeting_id", "seg_no", speakers.cast("int").alias("speakers"), metrics.colour_of_label(label).alias("colour"), old.alias("old_label"), report.card_point(F.col("p")).alias("card"), verbose.alias("verbose"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'None of it.' ELSE concat(['The meeting addressed', 'The meeting addressed', 'The meeting focused on', 'The meeting focused on', 'Participants reviewed'][doc_id % 6 + 1], ' ', text) END AS clean,
  to_json({'doc_id': doc_id, 'none': NULL::VARCHAR}) AS json FROM documents""")
def phrases_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock phrases before every text, and rows serialised with their nulls."""
    raw = F.when(F.col("doc_id") % 6 == 5, F.lit("None of it.")).otherwise(F.concat(F.try_element_at(F.array(*map(F.lit, text.PHRASES)), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" "), F.col("text")))
    return X.table(spark, sf_dir, "documents").select("doc_id", text.sanitise(raw).alias("clean"), analysis_json(F.struct("doc_id", F.lit(None).cast("string").alias("none"))).alias("json"))


@query(f"""WITH {X.ACTIONS}, t AS (SELECT *, lower(concat_ws(' ', task, coalesce(due_date, ''), status)) AS x FROM actions)
SELECT meeting_id, ord, coalesce(owner, 'Unassigned') AS owner, coalesce(due_date, 'N/A') AS due_date, CASE WHEN regexp_matches(x, '{"|".join(E.HIGH)}') THEN 'High' WHEN regexp_matches(x, '{"|".join(E.MEDIUM)}') THEN 'Medium' ELSE 'Low' END AS priority FROM t""")
def action_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.action_items(spark, sf_dir).select("meeting_id", "ord", "owner", "due_date", F.struct("task", "owner", "due_date", "status").alias("a"))
    return a.select("meeting_id", "ord", text.or_else(F.col("owner"), "Unassigned").alias("owner"), text.or_else(F.col("due_date"), "N/A").alias("due_date"), report.priority(F.col("a")).alias("priority"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d = X.listed(X.action_items(spark, sf_dir), "actions"), X.listed(X.decisions(spark, sf_dir), "decided")
    j = a.join(d, "meeting_id", "full")
    empty = lambda c: F.coalesce(c, F.array().cast(j.schema[c].dataType)).alias(c)
    return j.select("meeting_id", empty("actions"), empty("decided"))


_LISTS = f"""{X.ACTIONS}, {X.DECISIONS},
la AS (SELECT meeting_id, list({X.STEP} ORDER BY ord) AS steps, list_sort(list_distinct(list(owner) FILTER (owner IS NOT NULL))) AS owners FROM actions GROUP BY meeting_id),
ld AS (SELECT meeting_id, list_filter(list({X.PHRASE} ORDER BY ord)[1:3], lambda x: x <> '') AS phrases FROM decided GROUP BY meeting_id),
j AS (SELECT meeting_id, steps, owners, phrases FROM la FULL JOIN ld USING (meeting_id))"""
_STEPS = "array_to_string(list_concat(coalesce(steps, []), list_transform(coalesce(phrases, []), lambda x: concat('Team will proceed in line with: ', x, '.'))), chr(10))"


@query(f"WITH {_LISTS} SELECT meeting_id, {_STEPS} AS next_steps FROM j")
def next_steps_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("meeting_id", F.array_join(report.next_steps(F.col("actions"), F.col("decided"), "docx"), "\n").alias("next_steps"))


@query(f"WITH {_LISTS} SELECT meeting_id, CASE WHEN steps IS NULL THEN '{E.NO_STEPS}' ELSE {_STEPS} END AS next_steps FROM j")
def next_steps_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("meeting_id", F.array_join(report.next_steps(F.col("actions"), F.col("decided"), "pdf"), "\n").alias("next_steps"))


@query(f"""WITH {_LISTS}
SELECT meeting_id, array_to_string(list_filter([CASE WHEN meeting_id % 3 = 0 THEN '{E.STOCK}' ELSE 'The meeting focused on orders.' END,
  CASE WHEN len(coalesce(phrases, [])) > 0 THEN concat('Key decisions included ', array_to_string(phrases, '; '), '.') END,
  CASE WHEN steps IS NOT NULL THEN concat('Follow-up activities were assigned to ', CASE WHEN len(coalesce(owners, [])) > 0 THEN array_to_string(owners[1:4], ', ') ELSE 'the assigned owners' END, ', with progress to be tracked through the action items below.') END],
  lambda x: x IS NOT NULL), chr(10)) AS summary FROM j""")
def exec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    detailed = F.when(F.col("meeting_id") % 3 == 0, F.lit("")).otherwise(F.lit("The discussion focused on orders. "))
    s = report.executive_summary(detailed, F.lit(None).cast("string"), F.col("decided"), F.col("actions"))
    return _lists(spark, sf_dir).select("meeting_id", F.array_join(s, "\n").alias("summary"))


@query(f"WITH {X.DECISIONS} SELECT meeting_id, ord, decision FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS n FROM decided) WHERE n <= 3")
def topk_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("ord"))
    return X.decisions(spark, sf_dir).withColumn("n", n).where("n <= 3").select("meeting_id", "ord", "decision")


@query(rf"""
WITH {X.TEXTS}, r AS (SELECT meeting_id, transcript_text, regexp_extract_all(transcript_text, '{E.RANGE}', 1) AS a, regexp_extract_all(transcript_text, '{E.RANGE}', 2) AS b FROM texts),
s AS (SELECT *, CASE WHEN len(a) > 0 THEN {_SECONDS.format(x="a[1]")} END AS f, CASE WHEN len(b) > 0 THEN {_SECONDS.format(x="b[-1]")} END AS l, len(list_distinct(regexp_extract_all(transcript_text, '(?m)^(Speaker\s+\S+)', 1))) AS n FROM r)
SELECT meeting_id, CASE meeting_id % 3 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2024-06-01' ELSE '2024-01-01' END AS date,
  CASE WHEN meeting_id % 2 = 0 THEN '1 hour' WHEN l > f THEN concat(greatest(1, CAST(round_even((l - f) / 60, 0) AS BIGINT)), ' min') ELSE 'N/A' END AS duration, CASE WHEN n > 0 THEN CAST(n AS VARCHAR) ELSE 'N/A' END AS speakers_detected FROM s""")
def report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("meeting_id")
    info = F.create_map(F.lit("Date"), F.when(k % 3 == 0, "2024-05-01").otherwise(""), F.lit("Generated Date"), F.when(k % 3 == 1, "2024-06-01").otherwise(""), F.lit("Duration"), F.when(k % 2 == 0, "1 hour").otherwise(""))
    m = X.meeting_texts(spark, sf_dir).select("meeting_id", report.metadata(info, F.col("transcript_text"), F.lit("2024-01-01")).alias("m"))
    return m.select("meeting_id", "m.date", "m.duration", "m.speakers_detected")


@query("""SELECT * FROM (SELECT event_id, unnest(['Generated On', 'Prepared By', 'Place']) AS field, unnest([strftime(ts, '%Y-%m-%d %H:%M'), CASE WHEN event_id % 2 = 0 THEN 'confab' ELSE event_type END, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END]) AS value,
  strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events) WHERE value IS NOT NULL""")
def information_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form of the information of a meeting: empty values are left out, given ones come before our own."""
    e = F.col("event_id")
    info = F.create_map(F.lit("Prepared By"), F.when(e % 2 == 0, F.lit("")).otherwise(F.col("event_type")), F.lit("Place"), F.when(e % 3 != 0, F.col("user_id").cast("string")), F.lit("Other"), F.lit(""))
    rows = X.table(spark, sf_dir, "events").select("event_id", "ts", F.explode(report.information(info, F.col("ts"))).alias("field", "value"))
    return rows.select("event_id", "field", "value", clock.written_time(F.col("ts")).alias("day"), clock.written_time(F.col("ts"), clock.SECOND).alias("stamp"))


@query("SELECT doc_id, sha256(text) AS cache_key, sha256(concat('T', chr(10), chr(10), 'S', chr(10), chr(10), text)) AS versioned_key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", text.content_key(F.col("text")).alias("cache_key"), text.versioned_key("T", "S", F.col("text")).alias("versioned_key"))


@query("SELECT sha256(text) AS cache_key, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a cache of every third document's key doesn't hold, each key once."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", text.content_key(F.col("text")).alias("cache_key"))
    return d.groupBy("cache_key").agg(F.min("doc_id").alias("doc_id")).join(d.where("doc_id % 3 = 0").select("cache_key"), "cache_key", "left_anti")


@query("""
WITH k AS (SELECT doc_id, sha256(text) AS cache_key FROM documents),
f AS (SELECT cache_key, min(doc_id) AS d FROM k WHERE doc_id % 3 = 0 GROUP BY 1), g AS (SELECT cache_key, min(doc_id) AS d FROM k WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, CASE WHEN g.d IS NOT NULL THEN concat('second ', g.d) WHEN f.d IS NOT NULL THEN concat('first ', f.d) END AS response FROM k LEFT JOIN f USING (cache_key) LEFT JOIN g USING (cache_key)""")
def cache_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups in a durable cache of two generations: the later answer counts."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", text.content_key(F.col("text")).alias("cache_key"))
    store = AnswerStore(spark, work_path(spark, "answers"))
    for name, n in (("first ", 3), ("second ", 2)):
        store.append(d.where(F.col("doc_id") % n == 0).groupBy("cache_key").agg(F.concat(F.lit(name), F.min("doc_id").cast("string")).alias("response")))
    return d.join(store.answers(), "cache_key", "left").select("doc_id", "response")


@query(f"""
WITH {X.TEXTS}, k AS (SELECT meeting_id, trim(transcript_text, concat(' ', chr(10))) AS t FROM texts), n AS (SELECT count(DISTINCT t) AS keys, count(DISTINCT t) FILTER (meeting_id % 2 = 0) AS half FROM k)
SELECT 1 AS run, half AS keys, 0 AS hits, half AS asked, half AS calls, 0 AS retries, 0 AS failed FROM n UNION ALL SELECT 2, keys, half, keys - half, keys - half, 0, 0 FROM n""")
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs asked a backend for: half of the meetings, then all, with one cache."""
    t, store, rows = X.meeting_texts(spark, sf_dir), AnswerStore(spark, work_path(spark, "answers")), []
    for run, meetings in ((1, t.where("meeting_id % 2 = 0")), (2, t)):
        calls = tasks.Calls()
        tasks.run_task(meetings, "decisions", lambda: tasks.Constant('{"decisions": []}'), cache=store, calls=calls)
        rows.append((run, calls.keys, calls.hits, calls.asked, calls.calls, calls.retries, calls.failed))
    return spark.createDataFrame(rows, "run int, keys long, hits long, asked long, calls long, retries int, failed int")


@query("SELECT conv_id, turn, concat('Read <transcript>', chr(10), text, chr(10), '</transcript> and ', text) AS prompt FROM conversations")
def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fill("Read <transcript>\n{transcript}\n</transcript> and {transcript}", F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, text AS payload FROM conversations")
def prompt_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompt_fill(spark, sf_dir)
    return p.select("conv_id", "turn", text.prompt_payload(F.col("prompt")).alias("payload"))


@query("""
SELECT event_id, unnest(range(0, 5)) AS i, CASE WHEN event_id % 6 > unnest(range(0, 5)) THEN 'done' WHEN event_id % 6 = unnest(range(0, 5)) THEN 'active' ELSE 'waiting' END AS status, CAST(event_id % 6 * 20 AS INTEGER) AS percent FROM events""")
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = (F.col("event_id") % 6).cast("int")
    e = X.table(spark, sf_dir, "events").select("event_id", metrics.stage_percent(active).alias("percent"), F.posexplode(metrics.stage_status(["a", "b", "c", "d", "e"], active)).alias("i", "s"))
    return e.select("event_id", F.col("i").cast("long").alias("i"), "s.status", "percent")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def upload_log_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.changed_rows(X.table(spark, sf_dir, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def upload_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with keyed state, run until the table has been read."""
    out, check = work_path(spark, "upload-log"), work_path(spark, "upload-log-state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKS)
    events = X.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    changes = keyed.changed_rows_stream(rows, "event_type", "user_id", "ts", ["event_id"], "0 seconds")
    changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


@query("SELECT doc_id, concat('doc:', n_chars) AS signature, CASE WHEN n_chars * 5000 / 1048576 <= 10 THEN 'about 1-3 minutes' WHEN n_chars * 5000 / 1048576 <= 50 THEN 'about 3-7 minutes' ELSE '7+ minutes' END AS estimate FROM documents")
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", text.upload_signature(F.lit("doc"), F.col("n_chars")).alias("signature"), text.duration_estimate(F.col("n_chars") * 5000).alias("estimate"))


def speech_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech-to-text answers of every meeting, with blank, odd and bad entries."""
    s = X.segments(spark, sf_dir)
    k = F.col("seg_no") + F.col("meeting_id")
    number = F.when(k % 11 == 0, F.lit('"bad"')).otherwise(F.coalesce(F.col("start_s").cast("string"), F.lit("null")))
    entry = F.concat(F.lit('{"transcript": '), F.when(k % 5 == 0, F.lit('" "')).otherwise(F.to_json(F.array("transcript")).substr(F.lit(2), F.length(F.to_json(F.array("transcript"))) - 2)), F.lit(', "speaker_id": '), F.coalesce(F.concat(F.lit('"'), F.col("speaker_id"), F.lit('"')), F.lit("null")), F.lit(', "start_time_seconds": '), number, F.lit(', "end_time_seconds": '), F.col("end_s").cast("string"), F.lit("}"))
    item = F.when(k % 7 == 0, F.lit('"loose"')).otherwise(entry)
    rows = s.select("meeting_id", F.struct("seg_no", item.alias("e")).alias("x")).groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), ", ").alias("e"))
    return rows.select("meeting_id", F.concat(F.lit('{"transcript": "  ", "language_code": "en", "diarized_transcript": {"entries": ['), F.col("e"), F.lit("]}}")).alias("value"))


@query(f"""WITH {X.SEGMENTS}, k AS (SELECT *, seg_no + meeting_id AS k FROM segments)
SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no) - 1 AS seg_no, trim(transcript, concat(' ', chr(10))) AS transcript, speaker_id, CASE WHEN k % 11 <> 0 THEN start_s END AS start_s, end_s FROM k WHERE k % 5 <> 0 AND k % 7 <> 0""")
def stt_payload_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = speech_payloads(spark, sf_dir).select("meeting_id", F.posexplode(payload.parse_speech(F.col("value"))["segments"]).alias("seg_no", "s"))
    return p.select("meeting_id", F.col("seg_no").cast("long").alias("seg_no"), "s.transcript", "s.speaker_id", F.col("s.start_time_seconds").alias("start_s"), F.col("s.end_time_seconds").alias("end_s"))


@query("""SELECT job, min(CASE WHEN f % 3 = 2 THEN f END) AS file FROM (SELECT conv_id // 10 AS job, conv_id AS f FROM conversations) GROUP BY job""")
def speech_first_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten files a job the first, by name, with a transcript (a third of them has one)."""
    c = X.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    body = F.when(F.col("conv_id") % 3 == 2, F.col("conv_id").cast("string")).otherwise(F.lit(" "))
    files = c.select((F.col("conv_id") / 10).cast("long").alias("j"), F.format_string("%012d.json", "conv_id").alias("path"), F.concat(F.lit('{"transcript": "'), body, F.lit('"}')).alias("value"))
    return first_results(files, F.col("j")).select("job", F.col("transcript").cast("long").alias("file"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", text.xml_escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("SELECT c_custkey, concat(c_name[1:6], '...') AS masked FROM customer")
def mask_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "customer").select("c_custkey", text.mask(F.col("c_name")).alias("masked"))


@query("SELECT event_id, CASE WHEN value < 30 AND event_id % 2 = 0 THEN 'realtime' ELSE 'batch' END AS route FROM events")
def speech_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").select("event_id", route(F.col("value"), F.col("event_id") % 2 == 1).alias("route"))


@query(f"WITH {X.TEXTS} SELECT meeting_id, transcript_text AS cleaned_transcript, CAST(NULL AS VARCHAR) AS error FROM texts")
def cleanup_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleanup verb through a backend that returns the transcript it was given."""
    t = X.meeting_texts(spark, sf_dir).select("meeting_id", text.strip(F.col("transcript_text")).alias("transcript_text"))

    class Echo:
        def generate(self, prompt, *, system_prompt=None):
            return prompt.split("<transcript>\n", 1)[1].rsplit("\n</transcript>", 1)[0]

    return tasks.run_task(t, "cleanup", Echo)[0].select("meeting_id", "cleaned_transcript", "error")


