"""Shared plumbing: the shared work folder, written tables, file access, let-bindings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from confab.functions.text import let
from confab.sources.tables import discard, shared_dir, work_path, written

__all__ = ["GAP", "WORD", "ascii_lower", "attempt_name", "discard", "filesystem", "fresh", "held", "let", "named", "shared_dir", "sliced", "utf8_bytes", "window_hashes", "words_of", "work_path", "written"]

#: Java regex for a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so (letter case aside)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def sliced(batches, text: int, most: int = 1 << 21):
    """Arrow batches cut so that each has about ``most`` bytes of texts (column number ``text``), one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for at, end in zip(cut, cut[1:]):
            if end > at:
                yield b.slice(at, end - at)


def window_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all ``width``-word windows, in order; the text has ``width`` words at least.

    Windows grow by joining the hashes of shorter ones, so each costs a few steps whatever its width.
    """
    n = F.size(words)

    def grown(h: Column, cur: Column, k: int) -> Column:
        if k == width:
            return F.slice(cur, 1, n - (width - 1))
        double = 2 * k <= width
        other = F.slice(cur if double else h, k + 1, n)
        return let(F.zip_with(cur, other, lambda a, b: F.xxhash64(a, b)), lambda c: grown(h, c, k + (k if double else 1)))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: grown(h, h, 1))


def words_of(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else left alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 byte strings (None for null)."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def filesystem(uri: str):
    """(file system, path) of a URI, for files that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def attempt_name() -> str:
    """A file stem that no other task attempt uses."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"part-{t.partitionId():06d}-{t.taskAttemptId()}"


def held(name, version, make):
    """What ``make`` returns, kept by the Python process until another version of ``name`` is asked for.

    Functions reach workers by value, so a module's own globals would last for one task only.
    """
    import sys

    kept = sys.__dict__.setdefault("_confab_held", {})
    if name not in kept or kept[name][0] != version:
        kept[name] = version, make()
    return kept[name][1]
