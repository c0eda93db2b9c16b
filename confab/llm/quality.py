"""Quality rules: a threshold table compiled into one Spark projection, no user functions.

A null or blank text has zero words and every count zero (it fails the length rule).
A measure that equals its bound passes.  Repeated rows give repeated results, texts of any
length are measured whole, an empty table gives an empty result; columns other than the id and
the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, window_hashes

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was with as on be at by this are from or an "
    "der die und in den von zu das mit sich des auf ist im nicht ein eine "
    "de la le et les des en un une du que est pour dans qui sur au par "
    "el los las del y se con por una para su al lo como "
).split()


@dataclass(frozen=True)
class Rule:
    """Fails where ``measure`` is below ``low`` or above ``high``, for texts of ``from_words`` words or more."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Measures are columns of :func:`measures`; the first two rows are the base rules.
BASE_RULES = (
    Rule("too_short", "n_words", low=10),
    Rule("repeats_itself", "repeat_percent", high=20.0),
)
RULES = (
    Rule("word_length", "mean_word_chars", low=1.5, high=25.0),
    Rule("symbols", "symbols_per_word", high=0.5),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("no_stop_words", "stop_word_ratio", low=0.002, from_words=200),
    Rule("bullets", "bullet_line_ratio", high=0.95, from_words=50),
    Rule("cut_lines", "ellipsis_line_ratio", high=0.5, from_words=50),
)


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows found twice or more in the text, the first ones included.

    Windows are compared by 64-bit hash; only texts that repeat a window sort them.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        m = F.size(hashes)
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same_next = F.zip_with(s, F.slice(s, 2, m), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))

            def flagged(e: Column) -> Column:
                before = F.slice(F.concat(F.array(F.lit(False)), e), 1, m)
                either = F.zip_with(e, before, lambda a, b: a | b)
                hit = F.zip_with(s, either, lambda a, b: F.when(b, a["i"]))
                return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

            return let(same_next, flagged)

        def total(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)

        return let(let(by_hash, starts), lambda p: F.when(F.size(p) > 0, total(p)).otherwise(F.lit(0).cast("long")))

    hashes = window_hashes(words, width)
    zero = F.lit(0).cast("long")
    return F.when(n > width, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h)))).otherwise(zero)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and ratios that rules refer to, one row per document."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pieces = base.select("id", "t", F.split("t", r"[\x20\x09-\x0D]", -1).alias("p"))
    split = pieces.select("id", "t", F.size("p").alias("gaps"), F.array_remove("p", "").alias("w"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n, lines = F.size("w"), F.size("lines")
    share = lambda count, of: F.when(of > 0, count / of).otherwise(F.lit(0.0))
    counted = split.select(
        "id",
        n.cast("long").alias("n_words"),
        (F.length("t") - F.col("gaps") + 1).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        share(F.size(F.filter("w", lambda x: x.isin(STOP_WORDS + [s.capitalize() for s in STOP_WORDS]))), n).alias("stop_word_ratio"),
        share(F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))), lines).alias("bullet_line_ratio"),
        share(F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))), lines).alias("ellipsis_line_ratio"),
        lines.alias("n_lines"),
    )
    w = F.col("n_words")
    return counted.select(
        "*",
        share(F.col("word_chars"), w).alias("mean_word_chars"),
        share(F.col("n_symbols"), w).alias("symbols_per_word"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        share(100 * F.col("n_repeat_words"), w).alias("repeat_percent"),
    )


def failed(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of :func:`measures` breaks."""

    def broken(r: Rule) -> Column:
        c, out = F.col(r.measure), F.lit(False)
        if r.low is not None:
            out = out | (c < r.low)
        if r.high is not None:
            out = out | (c > r.high)
        return out & (F.col("n_words") >= r.from_words)

    return F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of every document, the names of broken rules, ``base_failed`` and ``kept``."""
    m = measures(docs, id_col, text_col).select("*", failed(base).alias("broken_base"), failed(rules).alias("broken"))
    m = m.select("*", (F.size("broken_base") > 0).alias("base_failed"))
    return m.select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept")).withColumnRenamed("id", id_col)
