"""SimHash near-dedup on a Gray-order hierarchical index.

Fingerprints are computed in place, one document at a time.  Distinct fingerprints are then
routed by blocks of bits (two that differ in at most d bits agree on one of d + 1 blocks);
each partition sorts its fingerprints by Gray rank, so that near ones stand close, and builds
a hierarchy whose nodes keep the bits that all below them share.  A self-join walks pairs of
nodes from the top, adds up the differences on the bits that each level settles, and drops a
pair of groups once the sum passes d.  A partition returns a spanning forest of its links,
never the links themselves; forests are joined into components by alternating star
contractions.  Exact copies share one fingerprint and so cost one entry.

A block that very many fingerprints share is split again on its remaining bits, exactly,
until the groups are small (at most 2^bits can be left), so no task depends on a hot block.

Null and blank texts have fingerprint zero, linked like any other.  Null ids are kept: their
component is the smallest id reachable, null if there is none.  Repeated rows and repeated
ids are allowed: each row gets its own fingerprint, and links by all of its id's rows.  Texts of
any length count whole, a shingle after the other.  A bit that exactly half of the hashes have
is 0.  An empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, sliced, utf8_bytes, written
from .elements import majority, mixed, per_text, pieces_of, text_shingles, word_hashes

#: A routing block with more fingerprints than this is split on its remaining bits.
HOT_BLOCK = 1 << 16
#: Rows of a join partition.
PART_ROWS = 1 << 16


def shingles_of(text: bytes | None, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased words joined by spaces, and where each shingle starts and ends in them."""
    words = (text or b"").lower().split()
    if not words:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    k = min(width, len(words))
    return b" ".join(words), starts[: len(words) - k + 1], ends[k - 1 :]


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set where over half of the shingle hashes have it; zero without words."""
    from xxhash import xxh64_digest

    buffer, starts, ends = shingles_of(text, width)
    n = len(starts)
    if not n:
        return 0
    some = lambda k: b"".join([xxh64_digest(buffer[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist())])
    return majority(np.frombuffer(some(k), np.uint64) for k in range(0, n, 1 << 16))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and signed 64-bit ``fp`` of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches, 1):
            fps = np.array([fingerprint(t, width) for t in utf8_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return src.mapInArrow(run, "id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Distinct codes in Gray order below nodes that keep the bits on which all codes under them agree."""

    def __init__(self, codes: np.ndarray, fanout: int = 8):
        codes = np.unique(codes.astype(np.uint64))
        self.fanout = fanout
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.levels = [(self.codes, np.full(len(codes), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), fanout)
            low, high = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(low ^ high)
            self.levels.append((low & shared, shared))

    def links(self, most: int, chunk: int = 1 << 14, done: np.ndarray | None = None):
        """Batches (i, j) of places of codes that differ in ``most`` bits at most, i < j, each pair once.

        Codes that the caller sets in ``done`` meanwhile need no further links: pairs of which
        both are done may be left out, so a dense group does not cost the square of its size.
        """
        if len(self.codes) < 2:
            return
        zero = np.zeros(1, np.int64)
        todo = [(len(self.levels) - 1, zero, zero, np.zeros(1, np.int64), np.zeros(1, np.uint64))]
        while todo:
            level, a, b, sum_, seen = todo.pop()
            if len(a) > chunk:
                todo += [(level, *(x[k : k + chunk] for x in (a, b, sum_, seen))) for k in range(0, len(a), chunk)]
                continue
            if done is not None:
                open_ = np.concatenate([[0], np.cumsum(~done)])
                width, last = self.fanout**level, len(done)
                left = [open_[np.minimum((x + 1) * width, last)] > open_[np.minimum(x * width, last)] for x in (a, b)]
                a, b, sum_, seen = (x[left[0] | left[1]] for x in (a, b, sum_, seen))
            if level == 0:
                if len(a):
                    yield a, b
                continue
            pattern, mask = self.levels[level - 1]
            f = self.fanout
            child = np.arange(f)
            i = (a[:, None, None] * f + child[None, :, None]).repeat(f, 2).ravel()
            j = (b[:, None, None] * f + child[None, None, :]).repeat(f, 1).ravel()
            up = np.arange(len(a)).repeat(f * f)
            ok = (i < len(pattern)) & (j < len(pattern)) & ((i < j) | ((i == j) & (level > 1)))
            i, j, up = i[ok], j[ok], up[ok]
            both = mask[i] & mask[j]
            new = both & ~seen[up]
            total = sum_[up] + np.bitwise_count((pattern[i] ^ pattern[j]) & new)
            near = total <= most
            if near.any():
                todo.append((level - 1, i[near], j[near], total[near], both[near]))


def forest(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, smallest code of its group) for every code that is linked to another one and isn't the smallest."""
    index = GrayIndex(codes)
    order = np.argsort(index.codes.view(np.int64), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = np.arange(len(order))

    def top(x):
        while True:
            up = root[x]
            if (up == x).all():
                return x
            root[x] = root[up]
            x = up

    for i, j in index.links(most):
        i, j = rank[i], rank[j]
        while True:
            i, j = top(i), top(j)
            apart = i != j
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
    at = np.arange(len(order))
    low = top(at)
    sorted_codes = index.codes[order].view(np.int64)
    moved = low != at
    return sorted_codes[moved], sorted_codes[low[moved]]


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` dealt into ``parts`` runs, each joined with ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def routed(codes: DataFrame, most: int, hot: int = HOT_BLOCK, by: list[str] | None = None) -> DataFrame:
    """``codes`` with the ``mask`` of a block and its bits ``key``; near ``fp`` (of equal ``by``) meet in one block at least."""
    own, done, masks, block = codes.columns, None, [0], [*(by or []), "mask", "key"]
    now = codes.select("*", F.lit(0).cast("long").alias("mask"))
    while True:
        deal = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(b)).cast("long") for b in _blocks(m, most + 1)]))])
        now = now.select(*own, F.explode(F.element_at(deal, F.col("mask"))).alias("mask")).select("*", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        masks = sorted({b for m in masks for b in _blocks(m, most + 1)})
        last = 64 - max(bin(m).count("1") for m in masks) <= hot.bit_length() - 1  # so few free bits cannot make a hot block
        crowded = None if last else written(now.groupBy(*block).count().where(F.col("count") > hot).select(*block), "hot-blocks")
        if last or crowded.isEmpty():
            return now if done is None else done.unionByName(now)
        calm = now.join(crowded, block, "left_anti").select(*own, "mask", "key")
        done = calm if done is None else done.unionByName(calm)
        now = written(now.join(crowded, block, "left_semi").select(*own, "mask"), "crowded")


def links(codes: DataFrame, most: int = 2, hot: int = HOT_BLOCK) -> DataFrame:
    """A spanning forest (``a``, ``b``), b < a, of all links between the distinct ``fp`` of ``codes``."""
    spark = codes.sparkSession
    n = codes.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (most + 1) * n // PART_ROWS + 1)

    def run(batches):
        import pyarrow as pa

        seen = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if seen:
            a, b = forest(np.concatenate(seen).view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return routed(codes, most, hot).repartition(parts, "mask", "key").select("fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(``node``, ``label``) of every node of ``edges``: the smallest node that it reaches.

    Alternating large-star and small-star contractions; each round is written to the shared
    folder.  Two rounds with the same edges end it.
    """
    now, before = written(edges.select("a", "b").where("a <> b"), "edges"), None
    for _ in range(rounds):
        stat = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if stat == before or not stat["n"]:
            break
        before = stat
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, written(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        discard(old)
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def simhash(docs: DataFrame, most: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits), ``fp`` (signed) and ``component_id`` of every document."""
    each = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    codes = written(each.groupBy("fp").agg(F.min("id").alias("first")), "codes")
    labels = components(links(codes.select("fp"), most))
    grouped = written(labels.join(codes, F.col("node") == F.col("fp")).select("fp", "label", "first"), "grouped")
    lowest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    moved = grouped.select("fp", "label").join(lowest, "label").select("fp", "component_id")
    of = codes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return each.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "fp", "component_id")


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words has one, of all of them."""
    return np.unique(text_shingles(words, width))


def crowd(fps: list[np.ndarray], table: int, size: np.ndarray, mask: int, most: int, ratio: float) -> np.ndarray:
    """Which members of a block of a table have a candidate partner there.

    A pair belongs to the first table in which it is near, and there to the first of the
    ``most`` + 1 top blocks that it agrees on (and to the blocks split from that one), so that
    near pairs do not meet in every block.
    """
    codes, first, inverse, times = np.unique(fps[table], return_index=True, return_inverse=True, return_counts=True)
    tops = _blocks(0, most + 1)

    def owned(diff):
        out, rest = np.zeros(len(diff), bool), np.ones(len(diff), bool)
        for top in tops:
            same = rest & (diff & np.uint64(top) == 0)
            if top & mask == top:
                out |= same
            rest &= ~same
        return out

    # codes of several members: all of them are kept where the block owns equal codes, or a near one does
    many = times > 1
    near = many & owned(np.zeros(len(codes), np.uint64))
    index = GrayIndex(fps[table])
    at = np.searchsorted(codes, index.codes)
    done = near[at]
    for i, j in index.links(most, done=done):
        x, y = at[i], at[j]
        p, q = first[x], first[y]
        fits = np.minimum(size[p], size[q]) >= ratio * np.maximum(size[p], size[q])
        for f in fps[:table]:
            fits &= np.bitwise_count(f[p] ^ f[q]) > most
        ok = owned(codes[x] ^ codes[y]) & (fits | many[x] | many[y])
        near[x[ok]] = near[y[ok]] = True
        done[i[ok]] = done[j[ok]] = True
    return near[inverse]


def verified_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join the members of a block as all their pairs of the similarity would.

    Two sets of the similarity share one of the rarest shingles of each (all but the
    similarity's share of it, plus one), so a member is compared only with earlier ones that
    it shares such a shingle with, and with none of its own group.
    """
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(values))
    place, single = rank[inverse], int((times == 1).sum())
    root, out, at = list(range(len(sets))), [], 0
    held: dict[int, dict[int, list[int]]] = {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for v, mine in enumerate(sets):
        n = len(mine)
        rare = np.sort(place[at : at + n])[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
        rare, at = rare[rare >= single].tolist(), at + n
        tried: set[int] = set()
        for s in rare:
            for r, members in held.get(s, {}).items():
                if top(r) == top(v):
                    continue
                for u in members:
                    if u in tried:
                        continue
                    tried.add(u)
                    other = len(sets[u])
                    if min(other, n) < similarity * max(other, n):
                        continue
                    common = len(np.intersect1d(sets[u], mine, assume_unique=True))
                    if common >= similarity * (n + other - common):
                        out.append((v, u))
                        a, b = top(u), top(v)
                        root[max(a, b)] = min(a, b)
                        break
        for s in rare:
            groups: dict[int, list[int]] = {}
            for r, members in held.get(s, {}).items():
                k = top(r)
                if k in groups:
                    groups[k] += members
                else:
                    groups[k] = members
            groups.setdefault(top(v), []).append(v)
            held[s] = groups
    return out


def near_copies(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, most: int = 7, index_width: int = 2, tables: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(``id_col``, ``group_id``): documents joined by verified near copies, the smallest id names the group.

    Two texts are near copies if their sets of ``width``-word shingles have a Jaccard similarity
    of ``similarity`` or more.  Candidates come from Gray-order indexes over ``tables``
    independent fingerprints of ``index_width``-word shingles (they move less than longer ones
    when a word changes), at ``most`` bits in any of them; the numbers of distinct shingles
    drop pairs that cannot have the similarity.  The shingle sets of documents with a candidate
    partner are dealt to the blocks of their pairs and verified exactly there: groups are those
    of all verified pairs of a block.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    src = src.where("id is not null")
    keyed = src.select("id", F.xxhash64("t").alias("th"), "t")
    fps = [f"fp{k}" for k in range(tables)]

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches, 2):
            each, size = [], []
            for words in per_text(*word_hashes(utf8_bytes(b.column(2)))):
                short = text_shingles(words, index_width)
                each.append([majority(pieces_of(mixed(short + np.uint64(k)))) for k in range(tables)])
                size.append(len(shingle_set(words, width)))
            cols = np.array(each, np.uint64).reshape(-1, tables).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, cols), pa.array(size, pa.int64())], ["id", "th", *fps, "size"])

    each = written(keyed.mapInArrow(run, f"id long, th long, {', '.join(f'{c} long' for c in fps)}, size long"), "signatures")
    own = ["th", *fps, "size"]
    nodes = written(each.groupBy(*own).agg(F.min("id").alias("node")), "nodes")
    names = ["tab", "mask", "key", "node", "th", "size", *fps]

    def partnered(batches):
        import pyarrow as pa

        cols = [np.concatenate(c) for c in zip(*([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))] for b in batches))]
        if not cols:
            return
        order = np.lexsort((cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        tab, mask, key, size, codes = cols[0], cols[1], cols[2], cols[5], [c.view(np.uint64) for c in cols[6:]]
        cut = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]), True])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a > 1:
                near = a + np.flatnonzero(crowd([c[a:b] for c in codes], int(tab[a]), size[a:b], int(mask[a]) & (1 << 64) - 1, most, similarity))
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(c[near]) for c in cols[:5]], names[:5])

    def with_sets(batches):
        import pyarrow as pa

        for b in sliced(batches, 1):
            sets = [shingle_set(w, width) for w in per_text(*word_hashes(utf8_bytes(b.column(1))))]
            blocks = b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(blocks.offsets.to_numpy()))
            for k in range(0, len(row), 512):
                some, pair = row[k : k + 512], blocks.flatten().slice(k, 512)
                parts = [sets[i] for i in some]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in parts]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pair.field(c) for c in range(3)), b.column(0).take(pa.array(some)), lists], ["tab", "mask", "key", "node", "s"])

    def joined(batches):
        import pyarrow as pa

        def links_of(rows):
            node, sets = zip(*rows)
            found = [(node[i], node[j]) for i, j in verified_forest(sets, similarity) if node[i] != node[j]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], pa.int64()), pa.array([min(x) for x in found], pa.int64())], ["a", "b"])

        now, rows = None, []
        for b in batches:
            lists = b.column(4)
            for i, (tab, mask, key, node) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                if (tab, mask, key) != now:
                    if len(rows) > 1:
                        yield from links_of(rows)
                    now, rows = (tab, mask, key), []
                rows.append((node, lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64).copy()))
        if len(rows) > 1:
            yield from links_of(rows)

    def parts(rows: int, each: int) -> int:
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // each + 1)

    codes = nodes.select("node", *own, F.posexplode(F.array(*fps)).alias("tab", "fp"))
    dealt = routed(codes, most, by=["tab"]).repartition(parts(tables * (most + 1) * nodes.count(), PART_ROWS), "tab", "mask", "key").select(*names)
    wanted = written(dealt.mapInArrow(partnered, "tab int, mask long, key long, node long, th long"), "candidates")
    blocks = wanted.groupBy("node", "th").agg(F.collect_list(F.struct("tab", "mask", "key")).alias("blocks"))  # at most the blocks of the fingerprints
    texts = keyed.withColumnRenamed("id", "node").join(blocks, ["node", "th"]).select("node", "t", "blocks")
    sets = texts.mapInArrow(with_sets, "tab int, mask long, key long, node long, s array<long>")
    met = sets.repartition(parts(wanted.count(), PART_ROWS >> 4), "tab", "mask", "key").sortWithinPartitions("tab", "mask", "key", "node")
    edges = written(met.mapInArrow(joined, "a long, b long").distinct(), "near-copies")
    discard(wanted)
    label = components(edges)
    discard(edges)
    of = nodes.join(label, "node", "left").select(*own, F.coalesce("label", "node").alias("group_id"))
    return each.join(of, own).select(F.col("id").alias(id_col), "group_id")
