"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` ids (only longer documents are cut).  Lengths
are counted over all pieces; the histogram has ``capacity`` entries whatever the input's size,
so the plan is made on the driver from counts alone: lengths indexed by single, pair and
triple sums fill gaps exactly while their counts last, and what remains is packed best fit,
longest first.  A plan line is a pattern of lengths and how often it is used.

Pieces then take their places in parallel: each gets its rank among the pieces of its length
(ranked inside hash buckets, with the buckets' counts summed beforehand, so a length that a
third of all pieces share is no single task), and a rank falls into one plan slot.

Null and empty texts are one piece with the end id alone.  Repeated rows are packed as often
as they occur; which of equally long pieces takes which place is settled by hash, id and piece.
Texts of any length are encoded whole, an empty table gives an empty result; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, written
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces: start and length in its own ids, and the CRC-32 of the ids."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(vocabulary)
        for b in sliced(batches, 1):
            out = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(enc.encode(text), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for c, x in zip(out, (doc, k, at, len(part), zlib.crc32(part.tobytes()))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


class Complements:
    """Which one, two or three available lengths have a given sum.

    Pairs are indexed by their sum (all pairs of the lengths present, the longer length
    descending); triples by their sum through their longest length and the pair index.
    """

    def __init__(self, counts: np.ndarray, most: int):
        self.n = counts
        self.lengths = np.flatnonzero(counts)[::-1]
        shorter = [self.lengths[(self.lengths <= a) & (self.lengths <= most - a)] for a in self.lengths]
        longer = np.repeat(self.lengths, [len(b) for b in shorter]).astype(np.int32)
        sums = longer + np.concatenate([np.empty(0, np.int64), *shorter]).astype(np.int32)
        order = np.argsort(sums, kind="stable")
        self.longer = longer[order].astype(np.int64)
        self.first = np.searchsorted(sums[order], np.arange(most + 2))

    def single(self, gap: int) -> list[int] | None:
        return [gap] if gap < len(self.n) and self.n[gap] > 0 else None

    def pair(self, gap: int, most: int | None = None) -> list[int] | None:
        """Two lengths with sum ``gap``, the longer one first, as long as can be, not above ``most``."""
        a = self.longer[self.first[gap] : self.first[gap + 1]]
        if most is not None:
            a = a[a <= most]
        free = np.flatnonzero((self.n[a] > 0) & (self.n[gap - a] > (2 * a == gap)))
        return [int(a[free[0]]), gap - int(a[free[0]])] if len(free) else None

    def triple(self, gap: int) -> list[int] | None:
        """Three lengths with sum ``gap``, the longest first."""
        for a in self.lengths[(self.lengths <= gap - 2) & (3 * self.lengths >= gap) & (self.n[self.lengths] > 0)].tolist():
            self.n[a] -= 1
            rest = self.pair(gap - a, a)
            self.n[a] += 1
            if rest:
                return [a, *rest]
        return None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns for the lengths ``left``: the longest first, each into the smallest gap that holds it."""
    open_: dict[int, list[list]] = {}  # gap: [pattern, sequences]
    gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, pattern: list[int], times: int) -> None:
        open_.setdefault(gap, []).append([pattern, times])
        gaps[gap] = True

    for x in np.flatnonzero(left)[::-1].tolist():
        m = int(left[x])
        while m:
            at = x + int(gaps[x:].argmax())
            if gaps[at]:
                group = open_[at][-1]
                k = min(m, group[1])
                group[1] -= k
                pattern = group[0]
                if not group[1]:
                    open_[at].pop()
                    gaps[at] = bool(open_[at])
                put(at - x, [*pattern, x], k)
                m -= k
            else:
                fit = capacity // x
                times, copies = (m // fit, fit) if m >= fit else (1, m)
                put(capacity - x * copies, [x] * copies, times)
                m -= times * copies
    return [(pattern, times) for groups in open_.values() for pattern, times in groups]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, times used) that place all ``counts[length]`` pieces.

    First, the longest pieces first, combinations that fill a sequence exactly are used as
    often as their lengths are available; then what is left goes best fit.
    """
    left, out = counts.astype(np.int64).copy(), []
    index = Complements(left, capacity)
    for first in index.lengths.tolist():
        while left[first]:
            left[first] -= 1
            fill = index.exact(capacity - first) if first < capacity else []
            left[first] += 1
            if fill is None:
                break
            sizes, need = np.unique([first, *fill], return_counts=True)
            times = int((left[sizes] // need).min())
            left[sizes] -= need * times
            out.append(([first, *fill], times))
    return out + best_fit(left, capacity)


def slots(patterns: list[tuple[list[int], int]]) -> list[np.ndarray]:
    """Per plan slot, sorted by (length, first rank): length, first rank, copies a sequence, first sequence, first offset."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset, k = 0, 0
        while k < len(pattern):
            length = pattern[k]
            copies = next((i for i, x in enumerate(pattern[k:]) if x != length), len(pattern) - k)
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset, k = offset + copies * length, k + copies
        sequence += times
    rows.sort()
    return [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 5


def ranked(parts: DataFrame, buckets: int) -> DataFrame:
    """``rank``: a number from 0 among the pieces of the same length, each used once."""
    dealt = parts.select("*", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).alias("bucket"))
    per = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    row = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    inside = dealt.select("*", row.alias("row"))
    return inside.join(base, ["length", "bucket"]).select(*parts.columns, (F.col("base") + F.col("row") - 1).alias("rank"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there."""
    spark = docs.sparkSession
    parts = written(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    table = slots(plan(counts, capacity))
    sent = spark.sparkContext.broadcast([x.tobytes() for x in table])  # grows with the capacity, not with the input
    span = int(counts.max()) + 1

    def run(batches):
        import pyarrow as pa

        length, first, copies, sequence, offset = (np.frombuffer(x, np.int64) for x in sent.value)
        key = length * span + first
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, size * span + rank, "right") - 1
            k = rank - first[at]
            cols = [b.column(c) for c in ("doc_id", "piece", "start")]
            more = [size, b.column("ids_crc32"), sequence[at] + k // copies[at], offset[at] + (k % copies[at]) * size]
            yield pa.RecordBatch.from_arrays([*cols, *[x if isinstance(x, pa.Array) else pa.array(x) for x in more]], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
