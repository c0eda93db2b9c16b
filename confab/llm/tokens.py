"""Whole-text token ids by the tokenizers library, fast where texts are plain.

The library encodes about a million characters a second.  Its pipeline for word-end BPE files
(NFC, white space to blanks, lower case, a fixed word pattern, byte-level BPE inside each word)
works on words alone, so texts of well-understood characters are split here and each distinct
word is encoded once, by the library's own model.  Every other text, and every file with
another pipeline, goes through ``Tokenizer.encode`` unchanged.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .common import held

# The pipeline that the fast path stands for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Precomposed Latin letters (normalised, no special casing), ASCII without controls, some punctuation.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡-©«-¬®-±´¶-¸»¿-İĲ-ž–—‘-„•…€]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ž"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")
#: Distinct words kept by a worker before it starts afresh.
MOST_WORDS = 1_000_000


class Encoder:
    """Token ids of whole texts as uint32 arrays, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = (
            spec.get("normalizer") == _NORMALIZER
            and steps[0] == {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
            and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and spec["model"]["type"] == "BPE"
        )
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)

    def _learn(self, word: str) -> int:
        text = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
        ids = [t.id for t in self.tokenizer.model.tokenize(text)]
        k = len(self.number)
        if k == len(self.start):
            self.start, self.size = np.resize(self.start, 2 * k), np.resize(self.size, 2 * k)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k], self.size[k] = self.used, len(ids)
        self.used += len(ids)
        self.number[word] = k
        return k

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if not self.fast or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.number) > MOST_WORDS:
            self.clear()
        known = self.number
        words = _WORDS.findall(text.lower())
        try:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            learn = self._learn
            for w in set(words).difference(known):
                learn(w)
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        ends = np.cumsum(size)
        if not len(ends):
            return np.empty(0, np.uint32)
        place = np.arange(ends[-1]) + np.repeat(self.start[at] - (ends - size), size)
        return self.flat[place]


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    return held("encoder", path, lambda: Encoder(path))
