"""Token ids in a binary file format coded by a static range asymmetric numeral system.

All files share one frequency table, made from the counts of all ids.  A file is a run of
independent blocks; a block interleaves many coder lanes, so each step codes a row of ids at
once.  The footer holds a checkpoint per block (place, first id, checksums) and the document
table, so blocks can be decoded in parallel, in any order, and damage is found where it is:
reading takes the footers first, then every task decodes blocks from their checkpoints.  The
number of files follows the number of ids.

File layout, little-endian: magic, length and CRC of the table, the table (symbols, frequencies);
blocks; footer (zlib: numbers of blocks and documents, checkpoints, document ids, which are
null, lengths); footer length and CRC; magic.
Block: ids, lanes, words, CRC of the payload, CRC of the ids; final lane states; words.

Null and empty texts have the end id alone.  Documents without an id come first; the order of
rows with one id is not defined.  Repeated rows are encoded as often as they occur.  Texts of
any length are encoded whole, over as many blocks as they need.  An empty table has no files.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attempt_name, discard, filesystem, held, named, sliced, work_path, written
from .tokens import encoder

MAGIC = b"RANSIDS1"
BITS = 20
LOW = np.uint64(1 << 31)
BLOCK_IDS = 1 << 20
LANES = 2048
#: Ids of a file, about.
FILE_IDS = 1 << 24
_HEAD = "<IIIII"


class Table:
    """Frequencies of the symbols that occur, in 2^20ths."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols.astype("<u4"), freqs.astype("<u4")
        order = int(self.symbols[-1]) + 1 if len(symbols) else 0
        self.freq, self.cum = np.zeros(order, np.uint64), np.zeros(order, np.uint64)
        self.freq[self.symbols] = self.freqs
        self.cum[self.symbols] = np.cumsum(self.freqs, dtype=np.uint64) - self.freqs
        self._slot = None

    @classmethod
    def of_counts(cls, counts: dict[int, int]) -> Table:
        """Shares rounded to 2^20ths, at least one each, the rounding taken from the largest."""
        symbols = np.array(sorted(counts), np.int64)
        n = np.array([counts[int(s)] for s in symbols], np.float64)
        if not len(n):
            return cls(symbols, symbols)
        if len(n) > 1 << BITS:
            raise ValueError("more symbols than the table has room for")
        freqs = np.maximum(1, np.floor(n / n.sum() * (1 << BITS))).astype(np.int64)
        over = int(freqs.sum()) - (1 << BITS)
        if over < 0:
            freqs[np.argmax(freqs)] -= over
        for i in np.argsort(-freqs, kind="stable"):
            if over <= 0:
                break
            take = min(over, int(freqs[i]) - 1)
            freqs[i] -= take
            over -= take
        return cls(symbols, freqs)

    def slot(self) -> np.ndarray:
        """The symbol of each of the 2^20 slots."""
        if self._slot is None:
            self._slot = np.repeat(self.symbols, self.freqs)
        return self._slot

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.symbols)) + self.symbols.tobytes() + self.freqs.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        n = struct.unpack_from("<I", data)[0]
        both = np.frombuffer(data, "<u4", 2 * n, 4)
        return cls(both[:n], both[n:])


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """One independent block."""
    ids = ids.astype("<u4")
    lanes = max(1, min(lanes, len(ids)))
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    bits, half = np.uint64(BITS), np.uint64(32)
    top = np.uint64((int(LOW) >> BITS) << 32)
    freqs, cums = table.freq[ids], table.cum[ids]
    for at in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
        f, c = freqs[at : at + lanes], cums[at : at + lanes]
        x = state[: len(f)]
        full = x >= top * f
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> half, x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
    payload = state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))
    return struct.pack(_HEAD, len(ids), lanes, sum(map(len, words)), zlib.crc32(payload), zlib.crc32(ids.tobytes())) + payload


def decode_block(data: bytes, table: Table) -> np.ndarray:
    """The ids of one block; raises ValueError on damage."""
    n, lanes, count, crc, ids_crc = struct.unpack_from(_HEAD, data)
    payload = memoryview(data)[struct.calcsize(_HEAD) : struct.calcsize(_HEAD) + 8 * lanes + 4 * count]
    if len(payload) != 8 * lanes + 4 * count or zlib.crc32(payload) != crc:
        raise ValueError("block checksum does not match")
    state = np.frombuffer(payload, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(payload, "<u4", count, 8 * lanes).astype(np.uint64)
    out, used, slots = np.empty(n, "<u4"), 0, table.slot()
    bits, half, rest = np.uint64(BITS), np.uint64(32), np.uint64((1 << BITS) - 1)
    for at in range(0, n, lanes):
        x = state[: min(lanes, n - at)]
        low = x & rest
        symbol = slots[low]
        out[at : at + len(x)] = symbol
        x = table.freq[symbol] * (x >> bits) + low - table.cum[symbol]
        short = np.flatnonzero(x < LOW)
        x[short] = (x[short] << half) | words[used : used + len(short)]
        used += len(short)
        state[: len(x)] = x
    if zlib.crc32(out.tobytes()) != ids_crc:
        raise ValueError("ids checksum does not match")
    return out


class Writer:
    """Writes documents to one file; memory holds one block and the document table."""

    def __init__(self, sink, table: Table, block_ids: int = BLOCK_IDS):
        self.sink, self.table, self.block_ids = sink, table, block_ids
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.marks: list[tuple[int, int, int]] = []
        self.pending: list[np.ndarray] = []
        self.waiting = self.ids = 0
        data = table.to_bytes()
        self.at = 0
        self._put(MAGIC + struct.pack("<II", len(data), zlib.crc32(data)) + data)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        while self.waiting >= self.block_ids:
            self._flush(self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if len(self.pending) > 1 else self.pending[0]
        data = encode_block(ids[:n], self.table)
        self.marks.append((self.at, len(data), self.ids))
        self._put(data)
        self.ids += n
        self.pending, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        docs = np.array([0 if d is None else d for d in self.docs], "<i8")
        parts = (np.array([len(self.marks), len(docs)], "<i8"), np.array(self.marks, "<i8"), docs, np.array([d is None for d in self.docs], np.uint8), np.array(self.sizes, "<i8"))
        foot = zlib.compress(b"".join(x.tobytes() for x in parts), 1)
        self._put(foot + struct.pack("<II", len(foot), zlib.crc32(foot)) + MAGIC)


class Reader:
    """Random access to the blocks and documents of a file."""

    def __init__(self, source: io.RawIOBase, size: int):
        self.source = source
        tail = self._get(size - 16, 16)
        n, crc = struct.unpack("<II", tail[:8])
        head = self._get(0, 16)
        if tail[8:] != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a file of this format")
        foot = self._get(size - 16 - n, n)
        m, table_crc = struct.unpack("<II", head[8:])
        data = self._get(16, m)
        if zlib.crc32(foot) != crc or zlib.crc32(data) != table_crc:
            raise ValueError("checksum does not match")
        info = zlib.decompress(foot)
        self.table = Table.from_bytes(data)
        blocks, n = struct.unpack_from("<qq", info)
        self.marks = np.frombuffer(info, "<i8", 3 * blocks, 16).reshape(blocks, 3).tolist()
        at = 16 + 24 * blocks
        null = np.frombuffer(info, np.uint8, n, at + 8 * n).tolist()
        self.docs = [None if x else d for d, x in zip(np.frombuffer(info, "<i8", n, at).tolist(), null)]
        self.sizes = np.frombuffer(info, "<i8", n, at + 9 * n)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        return decode_block(self._get(*self.marks[k][:2]), self.table)

    def starts(self) -> np.ndarray:
        """The place of each document's first id in the file."""
        return np.cumsum(self.sizes) - self.sizes


def span(get, table: Table, marks: list, first: int, sizes: list[int]):
    """The ids of consecutive documents whose first id is at ``first``, from the blocks at ``marks`` alone."""
    have, k = np.empty(0, "<u4"), 0
    skip = first - marks[0][2]
    for n in sizes:
        parts, need = [], n
        while need:
            if not len(have):
                have, k = decode_block(get(*marks[k][:2]), table)[skip:], k + 1
                skip = 0
            parts.append(have[:need])
            have, need = have[len(parts[-1]) :], need - len(parts[-1])
        yield parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, "<u4")


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Table, int]:
    """(``doc_id``, ``ids`` as 16- or 32-bit numbers) of every document, the table of all ids' counts, and how many there are.

    The rows are those of a written table (its other rows are the counts of each task).
    """

    def run(batches):
        import pyarrow as pa

        enc = encoder(vocabulary)
        wide = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        kind = "<u2" if wide <= 1 << 16 else "<u4"
        seen = np.zeros(wide, np.int64)
        no = pa.array([], pa.int64())
        for b in sliced(batches, 1):
            each = [np.append(enc.encode(text), np.uint32(end_id)).astype(kind) for text in b.column(1).to_pylist()]
            seen += np.bincount(np.concatenate(each), minlength=wide)
            out = [ids.tobytes() for ids in each]
            empty = pa.array([None] * len(out), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array([kind == "<u4"] * len(out)), empty, empty], ["doc_id", "ids", "wide", "symbols", "counts"])
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.bool_()), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([seen[at].tolist()], pa.list_(pa.int64()))], ["doc_id", "ids", "wide", "symbols", "counts"])

    src = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    both = written(src.mapInArrow(run, "doc_id long, ids binary, wide boolean, symbols array<long>, counts array<long>"), "ids")
    each = both.where("symbols is not null").select(F.explode(F.arrays_zip("symbols", "counts")).alias("x"))
    total = each.groupBy(F.col("x.symbols").alias("symbol")).agg(F.sum("x.counts").alias("n")).collect()  # at most the vocabulary's size
    return both, Table.of_counts({r["symbol"]: r["n"] for r in total}), sum(r["n"] for r in total)


def write_files(rows: DataFrame, table: Table, path: str, files: int) -> DataFrame:
    """Writes ``rows`` in ascending ``doc_id`` order; returns (``number``, ``path``, ``ids``) of each file.

    A file has a name of its own task attempt, and only the files of attempts that Spark
    accepted are on the returned (written) list.
    """
    data = table.to_bytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        writer = sink = None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs, root = filesystem(path)
                fs.create_dir(root, recursive=True)
                name = f"{attempt_name()}.rans"
                sink = fs.open_output_stream(f"{root}/{name}")
                writer = Writer(sink, Table.from_bytes(data))
            for doc, ids, wide in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                writer.add(doc, np.frombuffer(ids, "<u4" if wide else "<u2"))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([writer.ids], pa.int64())], ["number", "path", "ids"])

    ordered = rows.where("ids is not null").select("doc_id", "ids", "wide").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(run, "number int, path string, ids long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """Each document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, ``ids``.

    Footers are read first; then the documents that begin in a block are decoded together, from
    the block's checkpoint, wherever their file lies.
    """
    before = F.sum("ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    unit = "path string, base long, first long, marks array<array<long>>, docs array<long>, sizes array<long>"

    def units(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in unit.split(", ")]
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    r = Reader(f, f.size())
                starts, firsts = r.starts(), [m[2] for m in r.marks]
                cut = [*np.searchsorted(starts, firsts).tolist(), len(starts)]
                for k, (a, z) in enumerate(zip(cut, cut[1:])):
                    if a == z:
                        continue
                    last = int(np.searchsorted(firsts, starts[z - 1] + r.sizes[z - 1]))  # a long document goes on in further blocks
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    row = (path, base, int(starts[a]), r.marks[k : max(last, k + 1)], r.docs[a:z], r.sizes[a:z].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, base, first, marks, docs, sizes in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    n = struct.unpack("<I", f.read_at(4, 8))[0]
                    table = held("table", path, lambda: Table.from_bytes(f.read_at(n, 16)))
                    out, kept, at = [[], [], [], [], []], 0, first
                    for doc, ids in zip(docs, span(lambda p, m: f.read_at(m, p), table, marks, first, sizes)):
                        raw = ids.tobytes()
                        for c, x in zip(out, (doc, base + at, len(ids), zlib.crc32(raw), raw)):
                            c.append(x)
                        at += len(ids)
                        kept += len(raw)
                        if kept > 8 << 20:
                            yield _rows(pa, out)
                            out, kept = [[], [], [], [], []], 0
                yield _rows(pa, out)

    n = max(1, files.count())
    found = placed.repartition(n, "path").mapInArrow(units, unit)
    spread = found.repartition(max(n, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "first")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _rows(pa, out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def encode_corpus(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises and writes all documents; the list of files."""
    rows, frequencies, ids = tokenised(docs, vocabulary, end_id, id_col, text_col)
    files = write_files(rows, frequencies, path or work_path(docs.sparkSession, "rans"), ids // FILE_IDS + 1)
    discard(rows)
    return files
