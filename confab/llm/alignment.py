"""Alignment of two tokenizers' tokens over the same bytes.

Both token sequences of a text cut the same bytes.  The union of all token ends makes elementary
intervals, each inside one token of either side (found by binary search); an interval is one
overlap of two tokens, a link.  Ends that both sides share close groups.  All of it is done in
arrays for many texts at once.

How often a pair of ids is linked is counted over the whole corpus.  Texts are worked on in
blocks; a block's row holds its distinct pairs with their counts, and its texts refer to them by
number.  Only the blocks' distinct pairs are shuffled for the totals, which then go back to their
blocks: a pair has at most one row a block, so no key is hot, and texts are tokenized once.

A byte-level BPE file (A) encodes a blank and the text, a sentencepiece model (B) the text, before
which it puts a blank itself; strings of special tokens are plain text.  Texts that are null or
empty, and texts whose joined tokens differ from blank and text on either side, have no tokens:
their counts are zero and their groups ''.  Repeated rows (also of one id) are texts of their own.
Whole texts of any length are aligned, empty tables stay empty, and columns other than the id and
the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held, named, sliced, written
from .forced_bpe import byte_bpe, piece_bpe

#: Links of a block, about (a text is never cut), and bytes of texts tokenized at once.
BLOCK_LINKS, SLICE = 1 << 21, 1 << 20


def encoded(texts: list[str | None], a_path: str, b_path: str) -> tuple[np.ndarray, ...]:
    """(ids of A, their lengths in bytes, tokens of A per text, the same three of B); texts that differ have no tokens."""
    a, b = byte_bpe(a_path, special=False), piece_bpe(b_path)
    if not a.plain:
        raise ValueError("A must be a byte-level BPE file whose tokens are bytes of the text")
    filled = [t or "" for t in texts]
    ids_a, n_a = a.encode([" " + t if t else "" for t in filled])
    ids_b, n_b = b.encode(filled)
    size_a, size_b = a.size[ids_a], b.size[ids_b]
    same = np.zeros(len(texts), bool)
    ends_a, ends_b = (np.r_[0, np.r_[0, np.cumsum(size)][np.cumsum(n)]].tolist() for size, n in ((size_a, n_a), (size_b, n_b)))
    raw_a, raw_b = a.joined(ids_a), b.joined(ids_b)
    for k, t in enumerate(filled):
        if t:
            want = b" " + t.encode()
            same[k] = raw_a[ends_a[k] : ends_a[k + 1]] == want and raw_b[ends_b[k] : ends_b[k + 1]] == want
    keep_a, keep_b = np.repeat(same, n_a), np.repeat(same, n_b)
    return ids_a[keep_a], size_a[keep_a], n_a * same, ids_b[keep_b], size_b[keep_b], n_b * same


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``np.union1d`` of two ascending arrays, which a stable sort merges in one go."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both


def elementary(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, token of A and token of B of each elementary interval, whether both end with it)."""
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    ends = union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, own_a, own_b, (ends_a[own_a] == ends) & (ends_b[own_b] == ends)


def group_products(group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of A, token of B) of the same group, from the ascending group of each token."""
    n = int(max(group_a[-1:].max(initial=-1), group_b[-1:].max(initial=-1))) + 1
    in_b = np.bincount(group_b, minlength=n)
    times = in_b[group_a]
    first = (np.cumsum(in_b) - in_b)[group_a]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(np.arange(len(group_a)), times), np.repeat(first, times) + within


class _Shown:
    """Decimal ids with each of the separators behind them."""

    def __init__(self, n: int):
        names = [str(i) for i in range(n)]
        self.table = np.array([[s + mark for s in names] for mark in (",", "|", ";", "")], object)


def shown_groups(ids_a, group_a, per_a, ids_b, group_b, per_b) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each text: the ids of its groups, in order."""
    shown = held("shown-ids", size := 1 << int(max(ids_a.max(initial=1), ids_b.max(initial=1))).bit_length(), lambda: _Shown(size))
    at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
    at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    n = len(ids_a) + len(ids_b)
    ids, key = np.empty(n, np.int64), np.empty(n, np.int64)
    ids[at_a], ids[at_b] = ids_a, ids_b
    key[at_a], key[at_b] = 2 * group_a, 2 * group_b + 1
    mark = np.full(n, 3)
    mark[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2))
    ends = np.cumsum(per_a + per_b)
    mark[ends[ends > 0] - 1] = 3
    parts, edges = shown.table[mark, ids].tolist(), [0, *ends.tolist()]
    return ["".join(parts[x:y]) for x, y in zip(edges, edges[1:])]


def aligned(texts: list[str | None], a_path: str, b_path: str) -> dict:
    """Counts and groups of each text, and the links of all texts in order."""
    ids_a, size_a, n_a, ids_b, size_b, n_b = encoded(texts, a_path, b_path)
    ends, own_a, own_b, shared = elementary(size_a, size_b)
    closes = ends[shared]
    group_a, group_b = np.searchsorted(closes, np.cumsum(size_a)), np.searchsorted(closes, np.cumsum(size_b))
    upto = np.r_[0, np.cumsum(size_a)][np.cumsum(n_a)]  # where each text ends
    per = lambda x: np.diff(np.r_[0, np.searchsorted(x, upto, "right")])
    return {
        "n_a": n_a, "n_b": n_b, "n_links": per(ends), "n_groups": per(closes), "link_a": ids_a[own_a].astype(np.int64), "link_b": ids_b[own_b].astype(np.int64),
        "groups": shown_groups(ids_a, group_a, n_a, ids_b, group_b, n_b),
    }


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, bytes of equal weight together, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


_TEXT = "n_a long, n_b long, n_groups long, n_links long, {groups}, links binary, block long, pair_a array<int>, pair_b array<int>, pair_n array<long>"


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Rows of texts, and a row (``pair_a`` not null) of each block's distinct pairs and their counts, commonest first."""
    from pyspark.sql.types import StructType

    src = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    groups = "groups_sha256" if digest else "groups"
    schema = StructType([src.schema["id"], *StructType.fromDDL(_TEXT.format(groups=f"{groups} string")).fields])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        types, number = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        kept, held_links = [], 0

        def block():
            nonlocal number
            a, b = (np.concatenate([r[k] for _, r in kept]) for k in ("link_a", "link_b"))
            pairs, which, counts = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            which, at = rank[which], 0
            for ids, r in kept:
                edges = (at + np.r_[0, np.cumsum(r["n_links"])]).tolist()
                at = edges[-1]
                shown = [hashlib.sha256(g.encode()).hexdigest() if digest and g else g for g in r["groups"]]
                columns = [ids, *(pa.array(r[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(shown, pa.string()), pa.array([_packed(which[x:y]) for x, y in zip(edges, edges[1:])], pa.binary()), pa.array(np.full(len(ids), number))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(ids), types.field(k).type) for k in ("pair_a", "pair_b", "pair_n"))], types.names)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            pairs = pairs[order]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(types)[:7]), pa.array([number]), one(pairs >> 32, pa.int32()), one(pairs & 0xFFFFFFFF, pa.int32()), one(counts[order], pa.int64())], types.names)
            number += 1
            kept.clear()

        for part in sliced(batches, 1, SLICE):
            got = aligned(part.column(1).to_pylist(), a_path, b_path)
            kept.append((part.column(0), got))
            held_links += len(got["link_a"])
            if held_links >= BLOCK_LINKS:
                yield from block()
                held_links = 0
        if kept:
            yield from block()

    return src.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(``block``, ``place``, ``a``, ``b``, ``n``) of every block's distinct pairs."""
    pairs = F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "p")
    return rows.where("pair_a is not null").select("block", pairs).select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def totals(pairs: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``count``, ``best``): corpus-wide links of each pair; ``best`` if no pair of that ``b`` has more.

    A ``b`` has as many pairs at most as A has ids, and there are as many ``b`` as B has ids.
    """
    count = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = count.groupBy("b").agg(F.max("count").alias("most"))
    return count.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs).

    Texts: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` and ``count_sum`` over their links, ``groups``
    (with ``digest`` only its SHA-256, ``groups_sha256``).  Pairs: as :func:`totals`.
    """
    rows = written(blocks(docs, a_path, b_path, id_col, text_col, digest), "token-links")
    pairs = pair_counts(rows)
    found = written(totals(pairs), "token-pairs")
    back = pairs.join(found, ["a", "b"]).select(F.col("block").alias("to_block"), "place", "count", "best")
    texts = rows.where("pair_a is null").drop("pair_a", "pair_b", "pair_n")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if digest else "groups"]
    schema = texts.select("id", "n_a", "n_b", "n_groups", "n_links", F.col("n_links").alias("n_best"), F.col("n_links").alias("count_sum"), names[-1]).schema

    def sums(left, right):
        import pyarrow as pa

        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        links = [_unpacked(x.as_py()) for x in left.column("links")]
        edges = np.cumsum([0, *map(len, links)])
        at = np.concatenate([np.empty(0, np.uint32), *links])
        per = lambda x: np.diff(np.r_[0, np.cumsum(x[at])][edges])
        out = {**{n: left.column(n) for n in names if n in left.column_names}, "n_best": pa.array(per(best), pa.int64()), "count_sum": pa.array(per(count), pa.int64())}
        return pa.table([out[n] for n in names], names)

    out = texts.groupBy("block").cogroup(back.groupBy("to_block")).applyInArrow(sums, schema)
    return out.select(F.col("id").alias(id_col), *names[1:]), found
