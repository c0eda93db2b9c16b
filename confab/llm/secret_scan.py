"""Secret scan by a trigram inverted index, in DataFrame functions only.

Each rule's regex yields a Boolean query over trigrams (:mod:`.trigrams`): a text that matches
holds all trigrams of one of its clauses.  The index lists, for each trigram that some query
names, the texts that hold it (by a hash of the text, so equal texts are one posting).  Posting
lists are kept in buckets of texts, so that none grows with the corpus; in each bucket the lists
of a clause are intersected and the clauses of a rule united.  The candidates (hash and rules, a
few bytes a text) go back to the rows, where the regexes of their rules verify them; rules
without mandatory trigrams verify every text.  A hash that two texts share makes a needless
verification at most.

Candidates are sent to all tasks while they are few (counted), else joined by hash.  Null and
empty texts have no spans.  Positions are code points, ends exclusive.  Spans are in order of
start, then rule.  Repeated rows give repeated results, texts of any length are scanned whole,
an empty table gives an empty result; columns other than the text are passed on unread, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams
from .common import let, named, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules. Runs shorter than asked for are left out by the pattern where that changes no other match.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
RULES = BASE_RULES + (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("gh_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
)
#: Texts of a bucket of posting lists, about.
BUCKET_TEXTS = 2_000
#: So many candidates are sent to all tasks; beyond, texts are joined by their hash.
BROADCAST_TEXTS = 1_000_000


def needed_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    """Every trigram that a rule's query names, sorted."""
    return sorted({t for r in rules for clause in trigrams.query(r.pattern) or () for t in clause})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """(``trigram``, ``hash``) of every text and trigram that the rules name."""
    text = F.coalesce(named(text_col), F.lit(""))
    low = docs.select(F.xxhash64(text).alias("hash"), F.lower(text).alias("low"))
    terms = F.array(*map(F.lit, needed_trigrams(rules))).cast("array<string>")
    return low.select(F.explode(F.filter(terms, lambda t: F.contains(F.col("low"), t))).alias("trigram"), "hash")


def posting_lists(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The index: ``bucket``, ``lists`` (trigram to the hashes of its texts, each once)."""
    buckets = docs.count() // BUCKET_TEXTS + 1
    dealt = postings(docs, rules, text_col).select(F.pmod("hash", F.lit(buckets)).alias("bucket"), "trigram", "hash")
    lists = dealt.groupBy("bucket", "trigram").agg(F.collect_set("hash").alias("hashes"))
    return lists.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "hashes"))).alias("lists"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(``hash``, ``rules``): texts whose trigrams satisfy the queries; bit k of ``rules`` is rule k."""
    none = F.array().cast("array<bigint>")
    each = []
    for k, rule in enumerate(rules):
        clauses = trigrams.query(rule.pattern)
        if clauses is None:
            continue
        found = none
        for clause in clauses:
            lists = [F.coalesce(F.try_element_at("lists", F.lit(t)), none) for t in sorted(clause)]
            both = lists[0]
            for other in lists[1:]:
                both = F.array_intersect(both, other)
            found = F.array_union(found, both)
        each.append(F.struct(F.lit(1 << k).alias("bit"), found.alias("hashes")))
    if not each:
        return index.select(F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("rules")).limit(0)
    rows = index.select(F.explode(F.array(*each)).alias("x")).select(F.col("x.bit").cast("long").alias("bit"), F.explode("x.hashes").alias("hash"))
    return rows.groupBy("hash").agg(F.bit_or("bit").alias("rules"))


def matches(text: Column, rule: Rule, number: int) -> Column:
    """The spans of one rule in a text: array of (start, kind, end), in order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def spans(m: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(m))
        value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else m
        steps = F.arrays_zip(gaps.alias("gap"), m.alias("all"), value.alias("value"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["all"])
            one = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    return let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scanned(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``t`` (its text) and ``spans``: array of (start, kind, end)."""
    hits = written(candidates(posting_lists(docs, rules, text_col), rules), "secret-candidates")
    if hits.count() <= BROADCAST_TEXTS:
        hits = F.broadcast(hits)
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.coalesce(named(text_col), F.lit("")).alias("t"))
    met = rows.select("*", F.xxhash64("t").alias("hash")).join(hits, "hash", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = [
        matches(F.col("t"), r, k) if trigrams.query(r.pattern) is None else F.when(F.col("rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0, matches(F.col("t"), r, k)).otherwise(none)
        for k, r in enumerate(rules)
    ]
    return met.select("row", "t", F.sort_array(F.concat(*each)).alias("spans"))


def field(name: str) -> Column:
    """A column inside ``row``."""
    return F.col("row").getField(name)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out_col: str = "spans") -> DataFrame:
    """``id_col`` (or the columns ``keep``) with ``out_col``: array of (start, kind, end) by start, then kind.

    A kept column called ``out_col`` gives way to it.
    """
    keep = [c for c in keep or [id_col] if c.lower() != out_col.lower()]
    return scanned(docs, rules, text_col).select(*[field(c).alias(c) for c in keep], F.col("spans").alias(out_col))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``[kind]``; overlapping spans become one.

    A null text stays null, a text without spans is unchanged.
    """
    found = scanned(docs, rules, text_col)
    names = F.array(*[F.lit(r.kind) for r in rules])
    text = F.col("t")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, mark)).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(field(text_col))
    return found.select(*[(clean if c == text_col else field(c)).alias(c) for c in docs.columns])
