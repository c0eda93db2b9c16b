"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

Components are integers (floor of 1024 times the float), so codes, distances and codebooks are
exact and the same on any cluster.  Nearest entries are screened by one float32 matrix product a
part and batch.  Each screened distance has an interval that surely holds the exact one (the
rounding bound of a dot product in any order of summation); every entry whose interval overlaps
the best one's is computed again in 64-bit integers, and equal distances go to the lower number.

Learning is rounds of one narrow pass: tasks add up the parts of each entry, Spark sums these
partial sums (entries times tasks rows), and the driver holds the codebooks alone.

Vectors that are null, or hold null or non-finite components, are dropped.  Vectors of another
length than the commonest (ties: the shorter) are returned without a code and error.  Components
must stay below about 2^30 / sqrt(part width) in size after scaling, lest distances leave 64 bits;
others are an error.  The first entries come from the smallest ids, null ids last, repeated ids by
their vectors.  Repeated rows count as often as they occur; fewer rows than entries make fewer
entries; an empty table gives no rows.  Null labels are one label.  Columns other than those named
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import named, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows screened at once, pairs computed again at once, labels whose sums are sent to all tasks.
ROWS, PAIRS, MOST_SENT = 2048, 1 << 16, 1 << 17
SALTS = 32


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(``id``, ``label``, ``v``) of the usable rows."""
    v = named(vector_col)
    if not isinstance(vectors.schema[vector_col].dataType.elementType, FloatType):
        v = v.cast("array<double>")
    label = named(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(named(id_col).alias("id"), label.alias("label"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def integers(values: np.ndarray, rows: int, length: int, scale: int, width: int) -> np.ndarray:
    """Rows of whole numbers."""
    x = np.floor(values.astype(np.float64) * scale).reshape(rows, length)
    if np.abs(x).max(initial=0) >= 2.0**30 / width**0.5:
        raise ValueError("vector components are too large for exact 64-bit distances")
    return x.astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest entry of each row; ties go to the lower number."""
    first = np.sort(np.unique(book, axis=0, return_index=True)[1])  # a later equal entry never wins
    book = book[first]
    n, width = parts.shape
    norm = (book * book).sum(1)
    narrow, size = book.astype(np.float32), np.sqrt(norm.astype(np.float64))
    # a dot product of `width` terms and both roundings to float32, as a share of |x| |c|
    terms = (width + 2) * 2.0**-24
    share = terms / (1 - terms)
    out = np.empty(n, np.int64)
    for at in range(0, n, ROWS):
        x = parts[at : at + ROWS]
        reach = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * size[None]
        screened = norm - 2.0 * (x.astype(np.float32) @ narrow.T)
        slack = (2 * share * reach + 2.0**-48 * (norm + reach)) * (1 + 1e-6)
        open_ = screened - slack <= (screened + slack).min(1)[:, None]
        best = open_.argmax(1)
        several = np.flatnonzero(open_.sum(1) > 1)
        row, entry = np.nonzero(open_[several])
        if len(row):
            exact = np.concatenate([((x[several[row[k : k + PAIRS]]] - book[entry[k : k + PAIRS]]) ** 2).sum(1) for k in range(0, len(row), PAIRS)])
            starts = np.flatnonzero(np.r_[True, np.diff(row) > 0])
            least = np.flatnonzero(exact == np.minimum.reduceat(exact, starts)[row])
            best[several] = entry[least[np.unique(row[least], return_index=True)[1]]]
        out[at : at + ROWS] = best
    return first[out], ((parts - book[out]) ** 2).sum(1)


def _matrices(batches, column: int, length: int, scale: int, width: int):
    """Arrow batches with their vectors as integers."""
    for b in batches:
        yield b, integers(b.column(column).flatten().to_numpy(zero_copy_only=False), b.num_rows, length, scale, width)


def summed(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(``part``, ``entry``, ``n``, ``s0``, ...): how many parts each entry is nearest to, and their sums."""
    entries, scale, length = books.entries, books.scale, books.length
    parts, count, width = entries.shape
    names = ["part", "entry", "n", *[f"s{j}" for j in range(width)]]

    def run(batches):
        import pyarrow as pa

        n, sums = np.zeros((parts, count), np.int64), np.zeros((parts, count, width), np.int64)
        for _, x in _matrices(batches, 0, length, scale, width):
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                entry, _ = nearest(own, entries[p])
                order = np.argsort(entry, kind="stable")
                which, starts = np.unique(entry[order], return_index=True)
                if len(which):
                    sums[p, which] += np.add.reduceat(own[order], starts)
                    n[p] += np.bincount(entry, minlength=count)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), *(pa.array(sums[p, e, j]) for j in range(width))], names)

    partial = rows.select("v").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(width)))
    return partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _usable(rows: DataFrame, length: int) -> Column:
    return F.size("v") == length


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks from all usable vectors; at most 256 ``entries``, as codes have two hex digits a part."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = kept(vectors, id_col, vector_col, None)
    common = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if common is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    length = common["length"]
    if length == 0 or length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    rows, width = rows.where(_usable(rows, length)), length // parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # the first codebook
    x = integers(np.array([r["v"] for r in first]), len(first), length, scale, width)
    books = np.ascontiguousarray(x.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        for r in summed(rows, Codebooks(books, scale)).collect():  # a row an entry
            books[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return Codebooks(books, scale)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, label, ``code``, ``error``): two hex digits a part, and the squared distances summed over the parts."""
    rows = kept(vectors, id_col, vector_col, label_col)
    entries, scale, length = books.entries, books.scale, books.length
    parts, _, width = entries.shape
    other = rows.where(~_usable(rows, length)).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    digits, names = np.array([f"{k:02x}" for k in range(256)], object), other.columns

    def run(batches):
        import pyarrow as pa

        for b, x in _matrices(batches, 2, length, scale, width):
            got = [nearest(x[:, p * width : (p + 1) * width], entries[p]) for p in range(parts)]
            code = sum((digits[k] for k, _ in got[1:]), digits[got[0][0]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(sum(d for _, d in got), pa.int64())], names)

    out = other
    if entries.size:
        out = rows.where(_usable(rows, length)).select("id", "label", "v").mapInArrow(run, other.schema).unionByName(other)
    return out.select(F.col("id").alias(id_col), *([F.col("label").alias(label_col)] if label_col else []), "code", "error")


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code", vector_col: str = "vector") -> DataFrame:
    """``coded`` with the vectors that the codes stand for (null codes: null), by look-ups in the entries."""
    parts = books.entries.shape[0]
    value = lambda p: F.get(F.lit([[float(x) / books.scale for x in e] for e in books.entries[p].tolist()]), F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int"))
    return coded.select("*", F.when(F.col(code_col).isNotNull(), F.concat(*map(value, range(parts)))).alias(vector_col))


def with_label_errors(coded: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """``coded`` (a written table) with ``label_error``: the errors of equal labels added up, nulls together."""
    added = coded.groupBy(named(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    if added.count() <= MOST_SENT:
        return coded.join(F.broadcast(added), named(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64(named(id_col)), F.lit(SALTS)).cast("int"))
    spread = added.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, named(label_col).eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_to")), "left").drop("_label", "_salt", "_to")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **fitting) -> tuple[DataFrame, Codebooks]:
    """(id, label, ``code``, ``error``, ``label_error`` of each usable vector; the codebooks)."""
    books = fit(vectors, id_col, vector_col, **fitting)
    return with_label_errors(written(encode(vectors, books, id_col, vector_col, label_col), "vector-codes"), id_col, label_col), books
