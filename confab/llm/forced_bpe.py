"""Byte-pair encoding in fragments: text is cut wherever no token of the vocabulary can lie across.

Merges join neighbours to vocabulary entries only.  Two symbols that stand next to each other
inside no entry are therefore never joined, whatever stands around them: such a place is a
certain cut, and the fragments on both sides can be encoded independently and concatenated.
Cuts are found for whole batches of texts in arrays, and a worker encodes each distinct
fragment once.

:class:`ByteBpe` reads byte-level files of the tokenizers library (pairs of bytes, and the word
boundaries of the file's own pattern); :class:`PieceBpe` reads sentencepiece BPE models (pairs of
characters).  Files with other pipelines are encoded by their library, text by text.
"""

from __future__ import annotations

import json
import re
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np

from .common import held

#: Distinct fragments, and the length of long ones together, that a worker keeps before it starts afresh.
MOST_FRAGMENTS, MOST_LONG, LONG = 300_000, 1 << 23, 64
#: Fixed values of the byte-level format: bytes that stand for themselves; the others are U+0100 and on, in order.
_SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Fixed values of the byte-level pattern: word parts after an apostrophe.
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
#: Symbols up to which all neighbours are looked at for every merge.
SHORT = 48
_INF = float("inf")
_NEVER = (_INF, -1)
_LETTER, _NUMBER, _OTHER, _WHITE, _UNSEEN = range(5)


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[float, int]]) -> list[int]:
    """What is left of ``symbols`` (changed in place) after all merges: best rank first, then leftmost."""
    if len(symbols) > SHORT:
        return _merge_long(symbols, pairs)
    get = pairs.get
    ranks = [get(p, _NEVER)[0] for p in zip(symbols, symbols[1:])]
    while ranks and (best := min(ranks)) < _INF:
        i = ranks.index(best)
        symbols[i : i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = get((symbols[i], symbols[i + 1]), _NEVER)[0]
        if i:
            ranks[i - 1] = get((symbols[i - 1], symbols[i]), _NEVER)[0]
    return symbols


def _merge_long(symbols: list[int], pairs: dict[tuple[int, int], tuple[float, int]]) -> list[int]:
    """The same for long runs, by a heap over a linked list."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(p[0], i, symbols[i], symbols[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get((symbols[i], symbols[i + 1])))]
    heapify(heap)
    while heap:
        _, i, left, right, new = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j], k, h = new, -1, after[j], before[i]
        after[i] = k
        if k < n:
            before[k] = i
            if p := pairs.get((new, symbols[k])):
                heappush(heap, (p[0], i, new, symbols[k], p[1]))
        if h >= 0 and (p := pairs.get((symbols[h], new))):
            heappush(heap, (p[0], h, symbols[h], new, p[1]))
    return [x for x in symbols if x >= 0]


class Merges:
    """All merges of a vocabulary, for many short fragments at once.

    Every round joins in each fragment its best pair (the leftmost of equal ones), until none is left;
    ranks are looked up for the neighbours of what was joined alone.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[float, int]]):
        at = np.array([a << 32 | b for a, b in pairs] or [0], np.int64)
        order = np.argsort(at)
        self.at = at[order]
        self.rank = np.unique(np.array([r for r, _ in pairs.values()] or [0]), return_inverse=True)[1][order]
        self.new = np.array([n for _, n in pairs.values()] or [0], np.int64)[order]
        self.never = len(pairs)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, what the pair becomes) of neighbours."""
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
        return np.where((self.at[k] == key) & (left >= 0) & (right >= 0), self.rank[k], self.never), self.new[k]

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols that are left, in order; how many of each fragment); no fragment is empty."""
        out, left, number = [], np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        symbols, rank, new = symbols.astype(np.int64), np.full(len(symbols), self.never), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], new[:-1] = self._ranks(symbols[:-1], symbols[1:])
            rank[np.cumsum(sizes) - 1] = self.never
        while len(sizes):
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            best = np.minimum.reduceat(rank, starts)
            over = best == self.never
            if over.any():
                ends = over[owner]
                out.append((number[over], symbols[ends], sizes[over]))
                left[number[over]] = sizes[over]
                symbols, rank, new, number, sizes, best = symbols[~ends], rank[~ends], new[~ends], number[~over], sizes[~over], best[~over]
                if not len(sizes):
                    break
                owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == best[owner])
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            symbols[at] = new[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            closes = (at + 2 >= len(symbols)) | (owner[np.minimum(at + 2, len(symbols) - 1)] != owner[at])
            symbols, owner, rank, new, sizes = symbols[keep], owner[keep], rank[keep], new[keep], sizes - 1
            at = at - np.arange(len(at))
            rank[at] = self.never
            own = at[~closes]
            rank[own], new[own] = self._ranks(symbols[own], symbols[own + 1])
            own = at[(at > 0) & (owner[np.maximum(at - 1, 0)] == owner[at])] - 1
            rank[own], new[own] = self._ranks(symbols[own], symbols[own + 1])
        if not out:
            return symbols, left
        number, sizes = np.concatenate([o[0] for o in out]), np.concatenate([o[2] for o in out])
        flat, starts = np.concatenate([o[1] for o in out]), np.cumsum(sizes) - sizes
        order = np.argsort(number)
        return gathered(flat, starts[order], sizes[order]), left


class Fragments:
    """Ids of fragments in one growing array; ``encode`` gives those of new ones, one after the other, and their numbers."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.long = 0
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def _learn(self, new: list) -> None:
        ids, sizes = self.encode(new)
        k, end = len(self.number), len(self.number) + len(new)
        while end > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k:end], self.size[k:end] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.number.update(zip(new, range(k, end)))
        self.long += sum(n for n in map(len, new) if n > LONG)

    def ids(self, fragments: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all fragments, in order, and the number of ids of each."""
        if len(self.number) > MOST_FRAGMENTS or self.long > MOST_LONG:
            self.clear()
        known = self.number
        at = np.fromiter(map(known.get, fragments, repeat(-1)), np.int64, len(fragments))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = [fragments[k] for k in unknown.tolist()]
            self._learn(list(dict.fromkeys(new)))
            at[unknown] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        size = self.size[at].astype(np.int64)
        return gathered(self.flat, self.start[at], size), size


def _in_turn(parts: list, short: np.ndarray, many: tuple[np.ndarray, np.ndarray], one) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``parts``: of those marked ``short`` as worked out together, of others by ``one``."""
    if short.all():
        return many
    ids, sizes = many
    ends, at = np.cumsum(sizes), iter(range(len(sizes)))
    rows = [ids[ends[k] - sizes[k] : ends[k]] if (k := next(at) if s else -1) >= 0 else np.array(one(p), np.int64) for p, s in zip(parts, short.tolist())]
    return np.concatenate([np.empty(0, np.int64), *rows]), np.fromiter(map(len, rows), np.int64, len(rows))


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + size]``, one after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of all texts as numbers, and where each text ends."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


class ByteBpe:
    """A byte-level BPE file; ``special``: strings of special tokens in a text are those tokens."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.as_tokens = path, special
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        byte_of = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
        added = spec.get("added_tokens", [])
        self.special = {t["content"]: t["id"] for t in added} if special else {}
        vocab = model["vocab"] if model["type"] == "BPE" else {}
        self.plain = (
            bool(vocab)
            and spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and all(c in vocab for c in byte_of)
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
            and all(t["special"] or special for t in added)
            and (spec.get("decoder") or {}).get("type") == "ByteLevel"
        )
        if not self.plain:
            return
        as_bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        as_bytes |= {t["id"]: t["content"].encode() for t in added}
        #: The bytes of every id, one after the other; ids that do not exist have none.
        self.size = np.zeros(max(as_bytes) + 1, np.int64)
        for i, b in as_bytes.items():
            self.size[i] = len(b)
        self.bytes = np.frombuffer(b"".join(as_bytes.get(i, b"") for i in range(len(self.size))), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.single = [vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]

    @cached_property
    def tokenizer(self):
        """The library's own tokenizer."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        out.encode_special_tokens = not self.as_tokens
        return out

    @cached_property
    def words(self):
        """The library's own pattern."""
        from tokenizers import pre_tokenizers

        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    @cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, what the pair becomes) of each pair of ids that merges."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}

    @cached_property
    def inside(self) -> np.ndarray:
        """Whether two bytes (first << 8 | second) stand next to each other inside some token."""
        number = self.bytes.astype(np.int64)
        ends = np.zeros(len(number) + 1, bool)
        ends[self.start] = True  # no pair goes from one token to the next
        key = number[:-1] << 8 | number[1:]
        out = np.zeros(1 << 16, bool)
        out[key[~ends[1 : len(number)]]] = True
        return out

    @cached_property
    def fragments(self) -> Fragments:
        self.merges, self.symbols = Merges(self.pairs), np.array(self.single, np.int64)
        return Fragments(self._encode)

    @cached_property
    def split(self):
        """Cuts texts around the strings of special tokens."""
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def kind(self) -> np.ndarray:
        return np.full(0x110000, _UNSEEN, np.int8)

    def _encode(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        short = sizes <= SHORT
        joined = b"".join(new if short.all() else [f for f in new if len(f) <= SHORT])
        return _in_turn(new, short, self.merges.apply(self.symbols[np.frombuffer(joined, np.uint8)], sizes[short]), lambda f: merge([self.single[b] for b in f], self.pairs))

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, white space or other, as the library's own pattern sees each character."""
        kinds = self.kind[points]
        if (kinds == _UNSEEN).any():
            for p in np.unique(points[kinds == _UNSEEN]).tolist():
                joined = [len(self.words.pre_tokenize_str(chr(p) + c)) == 1 for c in "a1!"]
                self.kind[p] = _WHITE if chr(p) == " " or True not in joined else joined.index(True)
            kinds = self.kind[points]
        return kinds

    def word_starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where words of the pattern begin; no word goes over the end of a text."""
        n = len(points)
        kinds, edge = self.kinds(points), np.zeros(n + 1, bool)
        edge[0] = True
        edge[ends] = True
        run = edge.copy()
        run[1:n] |= kinds[1:] != kinds[:-1]
        start = run[:n].copy()
        # the last of some white space goes with what follows if it is a blank, else it stands alone
        last = np.flatnonzero((kinds[:-1] == _WHITE) & (kinds[1:] != _WHITE) & ~edge[1:n])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # an apostrophe by itself, no blank before it, takes a known suffix from the letters behind it
        tick = np.flatnonzero((points[:-1] == 39) & run[: n - 1] & (kinds[1:] == _LETTER) & ~edge[1:n])
        tick = tick[edge[tick] | (points[np.maximum(tick - 1, 0)] != 32)]
        for suffix in _SUFFIXES:
            at = tick[tick + len(suffix) < n]
            for k, c in enumerate(suffix, 1):
                at = at[(points[at + k] == ord(c)) & ~edge[at + k]]
            start[at + 1] = False
            behind = at + 1 + len(suffix)
            start[behind[behind < n]] = True
        return start

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Stretches between special tokens, the text of each, and the special id behind it (-1: none)."""
        if self.split is None or not any(s in t for t in texts for s in self.special):
            return texts, np.arange(len(texts)), np.full(len(texts), -1)
        parts, owner, behind = [], [], []
        for k, t in enumerate(texts):
            cut = self.split.split(t)
            parts += cut[::2]
            owner += [k] * len(cut[::2])
            behind += [self.special[s] for s in cut[1::2]] + [-1]
        return parts, np.array(owner, np.int64), np.array(behind, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, in order, and the number of ids of each."""
        if not self.plain:
            ids = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
            return np.concatenate([np.empty(0, np.int32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))
        parts, owner, behind = self._segments(texts)
        points, ends = code_points(parts)
        raw = "".join(parts).encode()
        if len(points):
            number = np.frombuffer(raw, np.uint8)
            cut = np.ones(len(number), bool)
            cut[1:] = ~self.inside[number[:-1].astype(np.uint16) << np.uint16(8) | number[1:]]
            lead = np.flatnonzero((number & 0xC0) != 0x80)  # the first byte of each character
            cut[lead[self.word_starts(points, ends)]] = True
            at = np.flatnonzero(cut)
            edges = [*at.tolist(), len(raw)]
            ids, size = self.fragments.ids([raw[a:b] for a, b in zip(edges, edges[1:])])
            place = np.r_[lead, len(raw)][ends]  # where each segment ends, in bytes
            per = np.diff(np.r_[0, np.r_[0, np.cumsum(size)][np.searchsorted(at, place)]])
        else:
            ids, per = np.empty(0, np.int32), np.zeros(len(parts), np.int64)
        if (behind >= 0).any():
            put = np.flatnonzero(behind >= 0)
            ids, per = np.insert(ids, np.cumsum(per)[put], behind[put]), per + (behind >= 0)
        return ids, np.bincount(owner, per, len(texts)).astype(np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return gathered(self.bytes, self.start[ids], self.size[ids]).tobytes()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD, ids that do not exist nothing."""
        if not self.plain:
            ends = np.cumsum(counts)
            return [self.tokenizer.decode(ids[e - n : e].tolist(), skip_special_tokens=False) for e, n in zip(ends.tolist(), counts.tolist())]
        ids, counts = self._known(ids, counts)
        raw, ends = self.joined(ids), np.r_[0, np.cumsum(self.size[ids])][np.r_[0, np.cumsum(counts)]].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def _known(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (ids >= 0) & (ids < len(self.size))
        if ok.all():
            return ids, counts
        left = np.r_[0, np.cumsum(ok)][np.r_[0, np.cumsum(counts)]]
        return ids[ok], np.diff(left)


class PieceBpe:
    """A sentencepiece BPE model: characters, blanks as U+2581, one before each text, bytes for what is unknown."""

    def __init__(self, path: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sp.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        norm, n = spec.normalizer_spec, self.model.get_piece_size()
        kinds = [p.type for p in spec.pieces]
        self.plain = (
            spec.trainer_spec.model_type == 2 and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix
            and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
            and set(kinds) <= {1, 2, 3, 6}
        )
        names = [self.model.id_to_piece(i) for i in range(n)]
        as_bytes = [bytes([int(t[1:-1], 16)]) if k == 6 else t.replace("▁", " ").encode() for t, k in zip(names, kinds)]
        self.size = np.array([len(b) for b in as_bytes], np.int64)
        self.bytes, self.start = np.frombuffer(b"".join(as_bytes), np.uint8), np.cumsum(self.size) - self.size
        if not self.plain:
            return
        normal = {t: i for i, (t, k) in enumerate(zip(names, kinds)) if k == 1}
        long = [t for t in normal if len(t) > 1]
        chars = sorted({c for t in long for c in t})
        self.count = n
        self.symbol = {c: n + k for k, c in enumerate(chars)} | {t: i for t, i in normal.items() if len(t) == 1}
        self.byte = {bytes([int(t[1:-1], 16)])[0]: i for i, (t, k) in enumerate(zip(names, kinds)) if k == 6}
        self.names = {v: c for c, v in self.symbol.items()}
        known = normal | self.symbol
        self.pairs = {(known[t[:k]], known[t[k:]]): (-spec.pieces[normal[t]].score, normal[t]) for t in long for k in range(1, len(t)) if t[:k] in known and t[k:] in known}
        self.merges = Merges(self.pairs)
        #: The symbol of each character, and whether it is a piece by itself.
        self.symbols, self.single = np.full(0x110000, -1, np.int64), np.zeros(0x110000, bool)
        for c, i in self.symbol.items():
            self.symbols[ord(c)], self.single[ord(c)] = i, i < n
        #: Numbers of the characters of longer pieces (others: 0), and pairs that stand next to each other inside some piece.
        self.index = np.zeros(0x110000, np.uint16)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.inside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for t in long:
            at = self.index[[ord(c) for c in t]]
            self.inside[at[:-1], at[1:]] = True
        self.fragments = Fragments(self._encode)

    def _one(self, fragment: str) -> list[int]:
        """The ids of a fragment by itself; characters that are no pieces become bytes."""
        out: list[int] = []
        for s in merge([self.symbol.get(c, -ord(c) - 2) for c in fragment], self.pairs):
            out += [s] if 0 <= s < self.count else [self.byte[b] for b in (self.names[s] if s >= 0 else chr(-s - 2)).encode()]
        return out

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, ends = code_points(new)
        symbols, sizes = self.symbols[points], np.diff(np.r_[0, ends])
        plain = np.minimum.reduceat(self.single[points], ends - sizes)
        short = (sizes <= SHORT) & plain
        kept = np.repeat(short, sizes)
        return _in_turn(new, short, self.merges.apply(symbols[kept], sizes[short]), self._one)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, in order, and the number of ids of each; empty texts have none."""
        if not self.plain:
            ids = [np.array(self.model.encode(t), np.int32) for t in texts]
            return np.concatenate([np.empty(0, np.int32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))
        shown = [f"▁{t}".replace(" ", "▁") if t else "" for t in texts]
        points, ends = code_points(shown)
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        at, cut = self.index[points], np.ones(len(points), bool)
        cut[1:] = ~self.inside[at[:-1], at[1:]]
        cut[ends[ends < len(points)]] = True
        at, joined = np.flatnonzero(cut), "".join(shown)
        edges = [*at.tolist(), len(joined)]
        ids, size = self.fragments.ids([joined[a:b] for a, b in zip(edges, edges[1:])])
        return ids, np.diff(np.r_[0, np.r_[0, np.cumsum(size)][np.searchsorted(at, ends)]])

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return gathered(self.bytes, self.start[ids], self.size[ids]).tobytes()


def byte_bpe(path: str, special: bool = True) -> ByteBpe:
    """This worker's encoder of a byte-level file."""
    return held(f"byte-bpe-{special}", path, lambda: ByteBpe(path, special))


def piece_bpe(path: str) -> PieceBpe:
    """This worker's encoder of a sentencepiece model."""
    return held("piece-bpe", path, lambda: PieceBpe(path))
