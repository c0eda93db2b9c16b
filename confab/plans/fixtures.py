"""Deterministic meetings derived from the supplied tables, in Spark and in DuckDB SQL.

All rows are used; the number of meetings grows with the tables, so that each has a few items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.operators.segments import transcripts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as speaker segments with running times."""
    t = table(spark, sf_dir, "conversations")
    dur = ((F.length("text") % 61) + 1).cast("double") / 2
    end = F.sum(dur).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    speaker = F.when(F.col("turn") % 7 == 6, None).when(F.col("role") == "user", "0").when(F.col("role") == "assistant", "1").otherwise("Host")
    return t.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seg_no"), speaker.alias("speaker_id"), F.when(F.col("turn") % 5 != 4, end - dur).alias("start_s"), end.alias("end_s"), F.col("text").alias("transcript"))


def action_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    verb = F.when(key % 2 == 1, F.lit("Ship")).otherwise(F.lit("Review"))
    tail = F.when(key % 3 == 0, "...").when(key % 3 == 1, ".").otherwise("")
    due = F.when(F.col("o_orderpriority") == "1-URGENT", "today").when(F.col("o_orderpriority") == "2-HIGH", "Friday").when(F.col("o_orderpriority") == "3-MEDIUM", "n/a")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").otherwise("Blocked")
    owner = F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("Owner "), (F.col("o_custkey") % 17).cast("string")))
    return o.select(F.floor(key / 40).alias("meeting_id"), key.alias("ord"), F.concat(verb, F.lit(" order "), key.cast("string"), tail).alias("task"), owner.alias("owner"), due.alias("due_date"), F.lit(None).cast("string").alias("timestamp"), status.alias("status"))


def decided_in(doc: Column) -> Column:
    """The meeting of a decision: ten in a row; some meetings have decisions alone."""
    m = F.floor(doc / 10)
    return F.when(m % 10 == 3, -m).otherwise(m)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels")
    n = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 11 == 0, F.lit("")).when(F.col("quality") == 1, F.concat(F.lit("they talked about item "), n)).otherwise(F.concat(F.lit("approved item "), n, F.lit("!")))
    confidence = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "HIGH ").otherwise("medium")
    return d.select(decided_in(F.col("doc_id")).alias("meeting_id"), F.col("doc_id").alias("ord"), text.alias("decision"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("timestamp"), confidence.alias("confidence"))


def listed(rows: DataFrame, name: str) -> DataFrame:
    """Items of each meeting in order, as an array ``name``."""
    fields = [c for c in rows.columns if c not in ("meeting_id", "ord")]
    each = F.struct("ord", F.struct(*fields).alias("x"))
    return rows.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda e: e["x"]).alias(name))


def responses(items: DataFrame, key: str) -> DataFrame:
    """Model answers in six shapes, whole and broken, from items with a JSON text ``item``."""
    rows = items.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda e: e["item"]), ", ").alias("body"))
    whole = F.concat(F.lit(f'{{"{key}": ['), F.col("body"), F.lit("]}"))
    k = F.abs("meeting_id") % 6
    text = (
        F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("["), F.col("body"), F.lit("]")))
        .when(k == 3, F.lit("not json")).when(k == 4, F.lit(f'{{"{key}": "oops"}}')).otherwise(F.concat(F.lit(f'{{"{key}": ['), F.col("body"), F.lit(", 7]}")))
    )
    return rows.select("meeting_id", text.alias("response"))


def decision_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit('{"decision": "'), F.col("decision"), F.lit('", "owner": null, "timestamp": "  ", "confidence": "'), F.col("confidence"), F.lit('"}'))
    return responses(decisions(spark, sf_dir).select("meeting_id", "ord", item.alias("item")), "decisions")


def action_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    item = F.concat(F.lit('{"task": '), quoted("task"), F.lit(', "owner": '), quoted("owner"), F.lit(', "due_date": '), quoted("due_date"), F.lit(', "status": '), quoted("status"), F.lit("}"))
    return responses(action_items(spark, sf_dir).select("meeting_id", "ord", item.alias("item")), "action_items")


def meeting_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(segments(spark, sf_dir))


SEGMENTS = """
segments AS (
  SELECT conv_id AS meeting_id, turn AS seg_no, CASE WHEN turn % 7 = 6 THEN NULL WHEN role = 'user' THEN '0' WHEN role = 'assistant' THEN '1' ELSE 'Host' END AS speaker_id,
         CASE WHEN turn % 5 <> 4 THEN end_s - dur END AS start_s, end_s, text AS transcript
  FROM (SELECT *, sum(dur) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS end_s
        FROM (SELECT *, CAST(length(text) % 61 + 1 AS DOUBLE) / 2 AS dur FROM conversations)))"""


def clock_sql(c: str) -> str:
    t = f"CAST(round_even({c}, 0) AS BIGINT)"
    return f"CASE WHEN {c} IS NULL THEN '--:--' WHEN {t} >= 3600 THEN printf('%02d:%02d:%02d', {t} // 3600, {t} // 60 % 60, {t} % 60) ELSE printf('%02d:%02d', {t} // 60, {t} % 60) END"


LABEL = "CASE WHEN speaker_id IS NULL THEN 'Speaker' WHEN regexp_matches(speaker_id, '^[0-9]+$') THEN concat('Speaker ', TRY_CAST(speaker_id AS BIGINT) + 1) WHEN starts_with(lower(speaker_id), 'speaker') THEN speaker_id ELSE concat('Speaker ', speaker_id) END"
LABELLED = f"{SEGMENTS}, labelled AS (SELECT *, {LABEL} AS label, {clock_sql('start_s')} AS start_clock, {clock_sql('end_s')} AS end_clock FROM segments)"
TEXTS = f"{LABELLED}, texts AS (SELECT meeting_id, string_agg(concat(label, ' [', start_clock, ' - ', end_clock, ']', chr(10), transcript), chr(10) || chr(10) ORDER BY seg_no) AS transcript_text FROM labelled GROUP BY meeting_id)"
ACTIONS = """
actions AS (
  SELECT o_orderkey // 40 AS meeting_id, o_orderkey AS ord,
         concat(CASE WHEN o_orderkey % 2 = 1 THEN 'Ship' ELSE 'Review' END, ' order ', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '...' WHEN 1 THEN '.' ELSE '' END) AS task,
         CASE WHEN o_custkey % 5 <> 0 THEN concat('Owner ', o_custkey % 17) END AS owner,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'today' WHEN '2-HIGH' THEN 'Friday' WHEN '3-MEDIUM' THEN 'n/a' END AS due_date,
         CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'Blocked' END AS status
  FROM orders)"""
DECISIONS = """
decided AS (
  SELECT CASE WHEN doc_id // 10 % 10 = 3 THEN -(doc_id // 10) ELSE doc_id // 10 END AS meeting_id, doc_id AS ord,
         CASE WHEN doc_id % 11 = 0 THEN '' WHEN quality = 1 THEN concat('they talked about item ', doc_id) ELSE concat('approved item ', doc_id, '!') END AS decision,
         CASE WHEN toxic = 1 THEN 'low' WHEN quality = 1 THEN 'HIGH ' ELSE 'medium' END AS confidence FROM labels)"""
#: The phrase of a decision without its closing full stop (no stock phrase occurs in these rows in its exact case).
PHRASE = "CASE WHEN decision = '' THEN '' ELSE rtrim(concat(upper(decision[1]), decision[2:], CASE WHEN right(decision, 1) IN ('.', '?', '!') THEN '' ELSE '.' END), '.') END"
STEP = "concat(coalesce(owner, 'Team'), ' will ', lower(rtrim(task, '.')[1]), rtrim(task, '.')[2:], CASE WHEN due_date IS NOT NULL AND upper(due_date) <> 'N/A' THEN concat(' by ', due_date) ELSE '' END, '.')"
