"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words are runs of letters and digits in lower case; numbers (in digits or words), names
(capitalised words that are none of the frequent words that begin sentences; never a text's first
word) and units (after a number) become typed placeholders, and numbers or names in a row become
one, so that a name of two words fits one of one word.  Windows of the templates of
documents and items are joined by hash; a window of hardly any other words is hashed as it is
instead.  Windows on one diagonal, or on diagonals a few words apart (words were put in or
left out), are one occurrence of the item.  An occurrence counts if enough of the item's
windows match and its slots are consistent: one value of the item always stands for one value
of the document and the other way round, so a question asked again with other numbers or names
is caught, and a text that merely has slots in the same places is not.

Null and blank texts have no windows; an empty table gives an empty result.  Items of fewer
words than a window are searched by windows of their own length (with names inside sentences only,
as a short item may begin a sentence in one text and not in another), items of fewer than
``SHORTEST`` are compared with whole documents.  Of several occurrences of an item in a
document the one with most windows is returned, then the first.  Rows that repeat an id count
as one document.  Texts of any length are searched whole.  Columns other than the ids and the
texts are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, named, window_hashes, written

WINDOW = 8
#: Windows with fewer words that are no placeholders are hashed as they are.
LITERALS = 3
#: Items of fewer words are found in documents that consist of them alone.
SHORTEST = 4
#: Diagonals within so many words count as one occurrence.
BAND = 8
SHARE = 0.5
#: So many matching windows are enough, however long the item is.
ENOUGH = 25
#: Above so many windows of items the join is left to Spark instead of broadcast.
BROADCAST_WINDOWS = 200_000
# The units.
UNITS = (
    "kg g mg lb lbs oz ton tons km m cm mm mile miles foot feet ft inch inches yard yards second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars euro euros cent cents percent liter liters litre litres ml gallon gallons degree degrees mph kmh"
).split()
# Words that are no names when they are capitalised, in English, German, French and Spanish.
FREQUENT = (
    "the this that these those there they then than what when where which who whose why how if in is it its an and are as at by do does did each every find for from give given had has have he her his she "
    "let many much no not of on one our some to two was we were with you your after all because before but can consider calculate compute determine during "
    "der die das ein eine einen er sie es wir ihr ich und oder aber wenn als wie was wer wo warum welche welcher welches dann im in am an auf aus bei mit nach von vor zu nicht "
    "le la les un une des il elle nous vous je et ou mais si que qui quoi quand comment pourquoi combien quel dans avec pour sur ce ces "
    "el los las una nosotros pero como donde cuando quien cual cuantos porque con para por sobre este esta en"
).split()
# Numbers in words, in the same languages; words that are articles or units as well are left out.
NUMERALS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce veinte treinta cuarenta cincuenta cien mil"
).split()
_SEP = "\u001f"
_NAME, _UNIT = "\u0002", "\u0003"


def _any_of(words) -> str:
    """A pattern for one of the words, by common beginnings, so that few branches are tried."""
    heads: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        heads.setdefault(w[:1], []).append(w[1:])
    return "(?:" + "|".join(c + (_any_of(rest) if len(rest) > 1 else rest[0]) for c, rest in sorted(heads.items(), reverse=True)) + ")"


_BEGINS, _ENDS = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# A name, and a unit (after a number).
NAME_PATTERN = rf"(?=\p{{Lu}}\p{{Ll}}){_BEGINS}(?!{_any_of(w.capitalize() for w in FREQUENT + NUMERALS)}{_ENDS})(\p{{Lu}})"
#: Names inside a sentence only; what is before one is looked at, not consumed, so names can follow each other.
INSIDE_PATTERN = r"(?<=[\p{L}\p{N},;)] )(\p{Lu}\p{Ll})"
UNIT_PATTERN = rf"([0-9] ?)({'|'.join(UNITS)})([^\p{{L}}]|$)"
_LETTERS = r"[a-z0-9\p{L}\p{N}]+"  # the plain ones first: they are looked up at once
_NUMBER = rf"(?:[0-9]+(?:[.,][0-9]+)*\p{{L}}*|{_any_of(NUMERALS)}{_ENDS})"
TOKEN_PATTERN = rf"{_NUMBER}(?:[ ,;-]+{_NUMBER})*|\x02{_LETTERS}(?: \x02{_LETTERS})*|\x03?{_LETTERS}"


def marked(text: Column, inside: bool = False) -> Column:
    """The text in lower case, with a mark before names (with ``inside``, only those inside a sentence) and units."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.rlike("[\\x02\\x03]"), F.translate(t, _NAME + _UNIT, "")).otherwise(t)
    named_ = F.regexp_replace(t, INSIDE_PATTERN if inside else NAME_PATTERN, f"{_NAME}$1")
    if not inside:
        named_ = F.regexp_replace(named_, "^([^\\p{L}\\p{N}\\x02]*)\\x02", "$1")
    return let(F.lower(named_), lambda m: F.when(m.rlike("[0-9]"), F.regexp_replace(m, UNIT_PATTERN, f"$1{_UNIT}$2$3")).otherwise(m))


def is_number(token: Column) -> Column:
    """In digits or words; of other tokens only names in a row hold a separator, and they begin with their mark."""
    return ((token >= "0") & (token < ":")) | token.isin(NUMERALS) | ((token > "\u0004") & token.rlike("[ ,;-]"))


def template(token: Column) -> Column:
    return F.when(F.startswith(token, F.lit(_NAME)), F.lit("<name>")).when(F.startswith(token, F.lit(_UNIT)), F.lit("<unit>")).when(is_number(token), F.lit("<num>")).otherwise(token)


def value(token: Column) -> Column:
    """What a placeholder stands for; null for other words."""
    return F.when(token < "\u0004", F.translate(token, _NAME + _UNIT, "")).when(is_number(token), token)


def is_slot(token: Column) -> Column:
    return (token < "\u0004") | is_number(token)


def window_sums(numbers: Column, width: int) -> Column:
    """Sums of all ``width`` numbers in a row, grown as the hashes of windows are."""
    n = F.size(numbers)

    def grown(cur: Column, k: int) -> Column:
        if k == width:
            return F.slice(cur, 1, n - (width - 1))
        double = 2 * k <= width
        other = F.slice(cur if double else numbers, k + 1, n)
        return let(F.zip_with(cur, other, lambda a, b: a + b), lambda c: grown(c, k + (k if double else 1)))

    return grown(numbers, 1)


def hash_array(text: Column, width: int, whole: bool = True) -> Column:
    """The hashes of :func:`window_array` alone, at a fraction of the cost: no window is cut out."""

    def hashes(t: Column) -> Column:
        one = F.array(F.xxhash64(F.array_join(t, " "), F.lit(width))) if whole else F.array().cast("array<bigint>")
        return F.when(F.size(t) < width, one).otherwise(window_hashes(t, width))

    # of all templates only placeholders begin below the letters
    slot = lambda x: x < "="

    def counts(t: Column) -> Column:
        flags = F.transform(t, lambda x: F.when(slot(x), 1).otherwise(0))
        return F.when(F.size(t) < width, F.array(F.size(F.filter(t, slot)))).otherwise(let(flags, lambda f: window_sums(f, width)))

    def slotted(w: Column, t: Column) -> Column:
        literal = lambda n: n > width - LITERALS
        ours = hashes(t)
        both = F.zip_with(ours, hashes(w), lambda t, x: F.struct(t.alias("t"), x.alias("x")))
        mixed = lambda c: F.filter(F.zip_with(both, c, lambda b, n: F.when(literal(n), F.xxhash64(b["x"], F.lit(1))).otherwise(b["t"])), lambda h: h.isNotNull())
        # words are hashed for the few texts alone that have such a window, and windows counted where the text has slots for one
        some = let(counts(t), lambda c: F.when(F.exists(c, literal), mixed(c)).otherwise(ours))
        return F.when(literal(F.size(F.filter(t, slot))), some).otherwise(ours)

    def of(m: Column) -> Column:
        none = F.array().cast("array<bigint>")
        each = lambda w, t: F.when(F.size(t) == 0, none).when(F.exists(t, slot), slotted(w, t)).otherwise(hashes(t))
        return let(F.regexp_extract_all(m, F.lit(TOKEN_PATTERN), F.lit(0)), lambda w: let(F.transform(w, template), lambda t: each(w, t)))

    return let(marked(text, not whole), of)


def window_array(text: Column, width: int, whole: bool = True) -> Column:
    """Array of (``h``, ``slots``: values, in order, null if none) of a text's windows.

    A shorter text is one window if ``whole``, else none (and names are those inside sentences).  One nested expression, so that each
    step is computed once for whatever follows.
    """

    def hashes(t: Column) -> Column:
        one = F.array(F.xxhash64(F.array_join(t, " "), F.lit(width))) if whole else F.array().cast("array<bigint>")
        return F.when(F.size(t) < width, one).otherwise(window_hashes(t, width))

    plain = lambda t: F.transform(hashes(t), lambda h: F.struct(h.alias("h"), F.lit(None).cast("string").alias("slots")))

    def slotted(w: Column) -> Column:
        def both(v: Column, literal: Column) -> Column:
            part = lambda i: F.slice(v, i + 1, width)
            filled = lambda p: let(F.array_join(p, _SEP), lambda s: F.when(s != "", s))
            few = lambda p: F.size(F.array_compact(p)) > width - LITERALS
            window = lambda h, i: let(part(i), lambda p: F.struct(F.when(few(p), F.xxhash64(F.element_at(literal, i + 1), F.lit(1))).otherwise(h).alias("h"), filled(p).alias("slots")))
            return F.transform(let(F.transform(w, template), hashes), window)

        return let(F.transform(w, value), lambda v: let(hashes(w), lambda literal: both(v, literal)))

    def of(m: Column) -> Column:
        none = F.array().cast("array<struct<h:bigint,slots:string>>")
        each = lambda w: F.when(F.size(w) == 0, none).when(F.exists(w, is_slot), slotted(w)).otherwise(plain(w))
        return let(F.regexp_extract_all(m, F.lit(TOKEN_PATTERN), F.lit(0)), each)

    return let(marked(text, not whole), of)


def windows(rows: DataFrame, id_col: str, text_col: str, width: int = WINDOW, whole: bool = True) -> DataFrame:
    """``id``, ``pos`` (word of the template), ``h`` and ``slots`` of every template window."""
    out = rows.select(named(id_col).cast("long").alias("id"), F.posexplode(window_array(named(text_col), width, whole)).alias("pos", "x"))
    return out.select("id", "pos", F.col("x.h").alias("h"), F.col("x.slots").alias("slots"))


def consistent(pairs: Column) -> Column:
    """Whether (item slots, document slots) pairs pair their values one to one."""
    values = F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.arrays_zip(F.split(p["a"], _SEP).alias("a"), F.split(p["b"], _SEP).alias("b")))))
    one = lambda v: (F.size(F.array_distinct(F.transform(v, lambda x: x["a"]))) == F.size(v)) & (F.size(F.array_distinct(F.transform(v, lambda x: x["b"]))) == F.size(v))
    return let(values, one)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, share: float = SHARE, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Documents that hold an item: ``id_col``, ``item_col``, ``matched`` of ``windows``, ``place`` (word of the template), ``changed`` slots."""
    words = lambda inside: F.size(F.regexp_extract_all(marked(named(item_text_col), inside), F.lit(TOKEN_PATTERN), F.lit(0)))
    short = benchmark.where(words(False) < width)
    lengths = [r["n"] for r in short.select(words(True).alias("n")).where(f"n >= {SHORTEST}").distinct().collect()]  # about a window's words at most
    hits = found(docs, windows(benchmark, item_col, item_text_col, width), id_col, text_col, width, True)
    for n in sorted(lengths):
        hits = hits.unionByName(found(docs, windows(short.where(words(True) == n), item_col, item_text_col, n, False), id_col, text_col, n, False))
    groups = F.array(*[F.struct(F.lit(k).alias("kind"), x.cast("long").alias("line")) for k, x in enumerate((F.col("d"), F.floor(F.col("d") / BAND), F.floor((F.col("d") + BAND // 2) / BAND)))])
    pair = F.when(F.col("a").isNotNull(), F.struct("a", "b"))
    spread = hits.select("id", "item", "windows", "at", "d", pair.alias("pair"), F.explode(groups).alias("g"))
    seen = spread.groupBy("id", "item", "windows", "g").agg(F.count_distinct("at").alias("matched"), F.min("d").alias("place"), F.collect_set("pair").alias("pairs"))
    enough = F.least(F.ceil(F.col("windows") * F.lit(share)), F.lit(ENOUGH))
    changed = F.size(F.filter(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.arrays_zip(F.split(p["a"], _SEP).alias("a"), F.split(p["b"], _SEP).alias("b"))))), lambda x: x["a"] != x["b"]))
    good = seen.where(F.col("matched") >= enough).where(consistent(F.col("pairs"))).select("id", "item", "windows", "matched", "place", changed.cast("long").alias("changed"))
    best = good.groupBy("id", "item").agg(F.max(F.struct("matched", (-F.col("place")).alias("place"), "windows", (-F.col("changed")).alias("changed"))).alias("m"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("m.matched").alias("matched"), F.col("m.windows").alias("windows"),
        (-F.col("m.place")).cast("long").alias("place"), (-F.col("m.changed")).alias("changed"),
    )


def found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, width: int, whole: bool) -> DataFrame:
    """Document windows that are windows of ``items``: ``id``, ``item``, its ``windows``, ``at``, diagonal ``d``, slots ``a`` and ``b``.

    The hashes of all documents say which hold any such window; slots are read from those alone.
    """
    items = items.withColumnsRenamed({"id": "item", "pos": "at", "slots": "a"})
    items = items.join(items.groupBy("item").agg(F.count("*").alias("windows")), "item")
    few = items.count() <= BROADCAST_WINDOWS
    sent = F.broadcast if few else lambda x: x
    src = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    holders = src.select("id", F.explode(hash_array(F.col("text"), width, whole)).alias("h")).join(sent(items.select("h").distinct()), "h", "left_semi")
    holders = written(holders.select("id").distinct(), "window-holders").withColumnRenamed("id", "holder")
    some = src.join(holders, F.col("id").eqNullSafe(F.col("holder")), "left_semi")
    hits = windows(some, "id", "text", width, whole).withColumnRenamed("slots", "b").join(sent(items), "h")
    return hits.select("id", "item", "windows", "at", (F.col("pos") - F.col("at")).alias("d"), "a", "b")
