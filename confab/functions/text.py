"""Text functions on columns (JVM side).  Blanks are Unicode white space, as in Python."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space plus the separators that Java's class leaves out.
BLANK = r"[\s\x1c-\x1f]"
# The same as characters, and what ends a line.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside higher-order functions too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trims Unicode white space."""
    return F.btrim(c, F.lit(BLANKS))


def lines_of(c: Column) -> Column:
    """The lines of a text; the end of the last line begins no further one."""
    lines = F.split(c, LINE_END, -1)
    return let(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def blank_to_null(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    s = strip(c)
    return F.when(s != "", s)


def optional(c: Column) -> Column:
    """Optional text field: null stays null, blank becomes null."""
    return blank_to_null(c)


def or_else(c: Column, default: str | Column) -> Column:
    """``c``, or the default where it is null or empty."""
    return F.when(c.isNotNull() & (c != ""), c).otherwise(default if isinstance(default, Column) else F.lit(default))


def normalise(c: Column) -> Column:
    """LF line ends, trimmed lines, at most one blank line in a row, trimmed ends."""
    lf = F.regexp_replace(c, r"\r\n?", "\n")
    lines = F.array_join(F.transform(F.split(lf, "\n", -1), strip), "\n")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def strip_fence(c: Column) -> Column:
    """The inside of a text that is one fenced block; any other text unchanged."""
    lines = lines_of(c)
    fenced = F.startswith(c, F.lit("```")) & (F.size(lines) >= 2) & (strip(F.try_element_at(lines, F.lit(-1))) == "```")
    return F.when(fenced, strip(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))).otherwise(c)


def fill(template: str, transcript: Column, name: str = "transcript") -> Column:
    """The template with every ``{name}`` replaced literally."""
    return F.replace(F.lit(template), F.lit("{" + name + "}"), transcript)


def prompt_payload(prompt: Column) -> Column:
    """What stands between the transcript tags; the whole prompt without them."""
    pattern = rf"(?sU)<transcript>{BLANK}*(.*?){BLANK}*</transcript>"
    return F.when(prompt.rlike(pattern), strip(F.regexp_extract(prompt, pattern, 1))).otherwise(prompt)


# Stock phrases and what the report says instead, in this order.
PHRASES = {
    "The discussion revolves around": "The meeting addressed",
    "The discussion centered around": "The meeting addressed",
    "The discussion focused on": "The meeting focused on",
    "The conversation focused on": "The meeting focused on",
    "They talked about": "Participants reviewed",
}


def replace_all(c: Column, table: Mapping[str, str]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), table.items(), c)


def sanitise(c: Column) -> Column:
    return replace_all(c, PHRASES)


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def end_sentence(c: Column) -> Column:
    """With a full stop unless it ends in one of ``.?!``."""
    return F.when(F.right(c, F.lit(1)).isin(".", "?", "!"), c).otherwise(F.concat(c, F.lit(".")))


def professional(c: Column) -> Column:
    """Sanitised, trimmed, first letter upper case, closed by a full stop; blank stays empty."""
    s = sanitise(strip(F.coalesce(c, F.lit(""))))
    return F.when(s == "", s).otherwise(end_sentence(upper_first(s)))


def strip_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def xml_escape(c: Column) -> Column:
    return replace_all(c, {"&": "&amp;", "<": "&lt;", ">": "&gt;"})


def html_escape(c: Column) -> Column:
    return replace_all(c, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"})


def mask(c: Column, missing: str | None = None) -> Column:
    """The first six characters and dots; ``missing`` for empty values, if given."""
    shown = F.concat(F.substring(c, 1, 6), F.lit("..."))
    return shown if missing is None else F.when(c.isNull() | (c == ""), F.lit(missing)).otherwise(shown)


def content_key(c: Column) -> Column:
    """SHA-256 of the trimmed text."""
    return F.sha2(strip(c), 256)


def versioned_key(template: str, system_prompt: str | None, text: Column) -> Column:
    """SHA-256 of prompt template, system prompt and text."""
    return F.sha2(F.concat(F.lit(f"{template}\n\n{system_prompt or ''}\n\n"), text), 256)


def suffix(name: Column) -> Column:
    """Lower-case file extension without the dot."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


# The demonstration replacements of the rule-based cleaner.
CLEANUP = {"lets": "let's", "teh": "the", "api": "API", "rahul": "Rahul", "okay": "Okay"}


def rule_cleanup(c: Column, table: Mapping[str, str] = CLEANUP) -> Column:
    """Whole-word replacements in any case, sentences begun and ended; headers and blank lines kept."""

    def line(x: Column) -> Column:
        s = strip(x)
        words = reduce(lambda t, kv: F.regexp_replace(t, rf"(?iU)\b{kv[0]}\b", kv[1]), table.items(), s)
        return F.when((s == "") | F.startswith(F.lower(s), F.lit("speaker ")), s).otherwise(end_sentence(upper_first(words)))

    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


def blocks(c: Column, joined_by_blank: bool = False) -> Column:
    """Blocks between blank lines: array of (header, body); the body's trimmed lines joined by LF, or non-blank ones by a space."""

    def block(b: Column) -> Column:
        lines = lines_of(strip(b))
        rest = F.transform(F.slice(lines, 2, F.size(lines)), strip)
        body = F.array_join(F.filter(rest, lambda x: x != ""), " ") if joined_by_blank else F.array_join(rest, "\n")
        return F.struct(strip(F.element_at(lines, 1)).alias("header"), strip(body).alias("body"))

    return F.transform(F.filter(F.split(strip(c), r"(?U)\n\s*\n", -1), lambda b: strip(b) != ""), block)


def upload_signature(name: Column, size: Column) -> Column:
    return F.concat_ws(":", name, size.cast("string"))


def size_mb(size: Column) -> Column:
    return F.coalesce(size, F.lit(0)) / float(1 << 20)


def size_label(size: Column) -> Column:
    return F.format_string("%.2f MB", F.bround(size_mb(size), 2))


def duration_estimate(size: Column) -> Column:
    """How long a file of that many bytes takes, about."""
    mb = size_mb(size)
    return F.when(mb <= 10, F.lit("about 1-3 minutes")).when(mb <= 50, F.lit("about 3-7 minutes")).otherwise(F.lit("7+ minutes"))


def log_line(stage: Column, message: Column, details: Column) -> Column:
    """``stage: message (k='v' ...)`` of a log row; details is a map."""
    pairs = F.transform(F.map_entries(details), lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'")))
    return F.concat(stage, F.lit(": "), message, F.when(F.size(details) > 0, F.concat(F.lit(" ("), F.array_join(pairs, " "), F.lit(")"))).otherwise(F.lit("")))
