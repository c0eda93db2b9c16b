"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's
probability is the sum over all of its segmentations into pieces (a forward pass), a text's
the product over its words, so no single tokenisation is trusted.  Piece probabilities are
fitted by expectation maximisation from uniform ones: each round is a Spark job that sums
expected piece counts of a bounded sample of labelled documents.

Words are maximal runs of letters, lower-cased, of any length; the forward pass over runs above
``LONG`` letters keeps its sums near one and their logarithms apart.  Null texts and texts without a letter are ``und`` with score 0.  Without any labelled
document every text is ``und``.  Of equally likely languages the first by name is taken.
Repeated rows give repeated results; rows without an id are held out.  Texts of any length are
scored whole, an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import held, named, sliced, written

#: Labelled documents per language that the fit takes, about (all if there are fewer).
FIT_ROWS = 500
ROUNDS = 3
#: Longer runs of letters take the pass with logarithms, one by one.
LONG = 32
#: Each letter counts this much in the forward pass, against underflow; taken back in the logarithm.
SCALE = 20.0
UNKNOWN = 1e-7
MOST_WORDS = 500_000
_WORD = re.compile(r"[^\W\d_]+")
_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def vocabulary_pieces(path: str) -> list[str]:
    """The distinct lower-cased pieces of letters of a public sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in every if p and re.fullmatch(r"▁?[^\W\d_]*", p)})


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; numeric characters such as fractions are no letters."""
    found = _WORD.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def _codes(words: list[str]) -> np.ndarray:
    """One row of code points per word; all have the same length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


class Pieces:
    """Finds all pieces inside words, many words at a time."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.most = max(map(len, pieces), default=1)
        self.key = np.zeros(self.n + 1, np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
            self.key[i] = h
        self.bits = max(12, (8 * self.n).bit_length())
        self.slot = np.full(1 << self.bits, self.n, np.int32)
        self.tries = 1
        for i in range(self.n):
            at, tries = self._home(self.key[i : i + 1])[0], 1
            while self.slot[at] != self.n:
                at, tries = (at + 1) % len(self.slot), tries + 1
            self.slot[at], self.tries = i, max(self.tries, tries)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers; ``n`` where there is none."""
        at = self._home(h)
        out = self.slot[at]
        off = (out != self.n) & (self.key[out] != h)
        for _ in range(1, self.tries):
            if not off.any():
                break
            i = np.nonzero(off)
            at[i] = (at[i] + 1) % len(self.slot)
            out[i] = self.slot[at[i]]
            off[i] = (out[i] != self.n) & (self.key[out[i]] != h[i])
        out[off] = self.n
        return out

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For lengths 1, 2, ...: (word, start) → piece number."""
        codes = _codes(words) + np.uint64(1)
        width, h, out = codes.shape[1], np.zeros(codes.shape, np.uint64), []
        for k in range(1, min(self.most, width) + 1):
            h = h[:, : width - k + 1] * _BASE + codes[:, k - 1 :]
            out.append(self.of_hashes(h))
        return out


class Model:
    """Piece probabilities by language."""

    def __init__(self, pieces: Pieces, probs: np.ndarray, languages: list[str], prior: np.ndarray):
        self.pieces, self.languages, self.prior = pieces, languages, prior
        scaled = np.zeros((pieces.n + 1, probs.shape[1]))
        scaled[:-1] = probs
        self.probs = scaled
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.empty((1 << 12, len(self.languages)))

    def _steps(self, lattice, i: int, k: int) -> np.ndarray:
        """Scaled probability of the piece of ``k`` letters that starts at ``i``, by word and language."""
        p = self.probs[lattice[k - 1][:, i]]
        if k == 1:
            p = np.maximum(p, UNKNOWN)
        return p * SCALE**k

    def forward(self, lattice, width: int) -> list[np.ndarray]:
        out = [np.ones((len(lattice[0]), len(self.languages)))]
        for i in range(1, width + 1):
            out.append(sum(out[i - k] * self._steps(lattice, i - k, k) for k in range(1, min(len(lattice), i) + 1)))
        return out

    def by_length(self, words: list[str]):
        """(places, marked words) in groups of one length, up to the long ones."""
        marked = ["▁" + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        for n in np.unique(size[size <= LONG + 1]).tolist():
            at = np.flatnonzero(size == n)
            for k in range(0, len(at), 20_000):
                yield at[k : k + 20_000], [marked[i] for i in at[k : k + 20_000]], n

    def log_probs(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)))
        for at, some, n in self.by_length(words):
            end = self.forward(self.pieces.lattice(some), n)[n]
            out[at] = np.log(np.maximum(end, 1e-300)) - n * np.log(SCALE)
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.forward_log(self.edges("▁" + w))[-1]
        return out

    def edges(self, word: str) -> np.ndarray:
        """(start, length - 1, language): the probability of the piece of each length at each place of one word."""
        lattice, n = self.pieces.lattice([word]), len(word)
        out = np.zeros((n, len(lattice), len(self.languages)))
        for k, ids in enumerate(lattice):
            out[: n - k, k] = self.probs[ids[0]]
        out[:, 0] = np.maximum(out[:, 0], UNKNOWN)
        return out

    @staticmethod
    def forward_log(edges: np.ndarray) -> np.ndarray:
        """(place, language): logarithms of the sums over the segmentations of each beginning of a word."""
        n, most, languages = edges.shape
        # what ends at a place: row k of it began k + 1 letters before
        ending = np.zeros((n, most, languages))
        for k in range(most):
            ending[k:, k] = edges[: n - k, k]
        window, scale, out = np.zeros((most, languages)), np.zeros(languages), np.zeros((n + 1, languages))
        window[0] = 1
        for i in range(n):
            total = (ending[i] * window).sum(0)
            window[1:] = window[:-1]
            window[0] = total
            if total.min() < 1e-100:  # edges are probabilities, so sums only shrink
                window /= total
                scale += np.log(total)
            out[i + 1] = np.log(window[0]) + scale
        return out

    def _expected_long(self, word: str, weights: np.ndarray, total: np.ndarray) -> None:
        edges, lattice = self.edges("▁" + word), self.pieces.lattice(["▁" + word])
        n, most, _ = edges.shape
        turned = np.zeros_like(edges)  # edges by where they end, from the back
        for k in range(most):
            turned[: n - k, k] = edges[: n - k, k][::-1]
        alpha, beta = self.forward_log(edges), self.forward_log(turned)[::-1]
        for k in range(most):
            share = np.exp(alpha[: n - k] + beta[k + 1 :] - alpha[n]) * edges[: n - k, k] * weights
            for c in range(share.shape[1]):
                total[:, c] += np.bincount(lattice[k][0], share[:, c], self.pieces.n + 1)

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected count of every piece in (distinct) words that occur ``weights[word, language]`` times."""
        total = np.zeros((self.pieces.n + 1, len(self.languages)))
        for at, some, n in self.by_length(words):
            lattice = self.pieces.lattice(some)
            alpha = self.forward(lattice, n)
            beta = [None] * n + [np.ones_like(alpha[0])]
            for i in range(n - 1, -1, -1):
                beta[i] = sum(beta[i + k] * self._steps(lattice, i, k) for k in range(1, min(len(lattice), n - i) + 1))
            share = weights[at] / np.maximum(alpha[n], 1e-300)
            for i in range(n):
                for k in range(1, min(len(lattice), n - i) + 1):
                    ids = lattice[k - 1][:, i]
                    add = alpha[i] * self._steps(lattice, i, k) * beta[i + k] * share
                    for c in range(add.shape[1]):
                        total[:, c] += np.bincount(ids, add[:, c], self.pieces.n + 1)
        for w, own in zip(words, weights):
            if len(w) > LONG:
                self._expected_long(w, own, total)
        return total[:-1]

    def _know(self, words: set[str]) -> None:
        """Scores words that aren't known yet, all at once."""
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > MOST_WORDS:
            self.clear()
            new = list(words)
        n = len(self.known)
        if n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:n], np.empty((n + 2 * len(new), len(self.languages)))])
        if new:
            self.rows[n : n + len(new)] = self.log_probs(new)
            self.known.update(zip(new, range(n, n + len(new))))

    def predict(self, texts: list[str | None], together: int = 64) -> list[tuple[str, float]]:
        """(language, posterior) of each text."""
        out = []
        for k in range(0, len(texts), together):
            lists = [words_of(t) if t and self.languages else [] for t in texts[k : k + together]]
            self._know(set().union(*lists))
            for words in lists:
                if not words:
                    out.append(("und", 0.0))
                    continue
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                scores = self.prior + self.rows[at].sum(0)
                best = int(scores.argmax())
                out.append((self.languages[best], float(1 / np.exp(scores - scores[best]).sum())))
        return out


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(True))


def fit(docs: DataFrame, vocabulary: str, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the labelled documents that aren't held out.

    At most about ``fit_rows`` documents per language are read, chosen by a hash of the id;
    their whole texts count.  The driver receives piece counts, bounded by the vocabulary.
    """
    spark = docs.sparkSession
    pieces = vocabulary_pieces(vocabulary)
    train = docs.where(~is_held_out(id_col) & F.col(lang_col).isNotNull())
    have = {r["lang"]: r["n"] for r in train.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(have)
    if not languages:
        return Model(Pieces(pieces), np.zeros((len(pieces), 0)), [], np.zeros(0))
    share = F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(min(1.0, fit_rows / have[c])))])
    chance = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    some = train.where(chance < F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        for b in sliced(batches, 1):
            seen = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in Counter(words_of(text or "")).items():
                    seen[lang, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words = written(some.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "fit-words")
    prior = np.log(np.array([have[c] for c in languages], float) / sum(have.values()))
    model = Model(Pieces(pieces), np.full((len(pieces), len(languages)), 1 / len(pieces)), languages, prior)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, model.probs[:-1].tobytes(), languages))

        def expect(batches, sent=sent):
            import pyarrow as pa

            names, probs, langs = sent.value
            m = Model(held("pieces", tuple(names), lambda: Pieces(names)), np.frombuffer(probs).reshape(len(names), len(langs)), langs, np.zeros(len(langs)))
            total = np.zeros((len(names), len(langs)))
            for b in batches:
                place: dict[str, int] = {}
                at = [place.setdefault(w, len(place)) for w in b.column(1).to_pylist()]
                weights = np.zeros((len(place), len(langs)))
                np.add.at(weights, (at, [langs.index(c) for c in b.column(0).to_pylist()]), b.column(2).to_numpy(zero_copy_only=False))
                if place:
                    total += m.expected(list(place), weights)
            p, c = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(total[p, c])], ["piece", "lang", "n"])

        rows = words.repartition(parts, "word").mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(pieces), len(languages)))
        counts[rows["piece"], rows["lang"]] = rows["n"]
        pooled = counts.sum(1, keepdims=True) / max(counts.sum(), 1)
        counts += 50 * pooled + 0.01 / len(pieces)  # a few pooled pieces, so that none is impossible
        model = Model(model.pieces, counts / counts.sum(0), languages, prior)
    return model


def identify(
    docs: DataFrame, model: Model, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, pred_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """``keep`` (the id alone by default) with ``pred_col`` and ``score_col``; only texts are looked at.

    Kept columns of these two names give way to the results.
    """
    names = vocabulary_pieces(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((names, model.probs[:-1].tobytes(), model.languages, model.prior))
    keep = [c for c in keep or [id_col] if c.lower() not in (pred_col.lower(), score_col.lower())]

    def run(batches):
        import pyarrow as pa

        pieces, probs, langs, prior = sent.value
        m = held("langid", (langs, probs), lambda: Model(Pieces(pieces), np.frombuffer(probs).reshape(len(pieces), len(langs)), langs, prior))
        for b in sliced(batches, at):
            out = m.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], out_names)

    at = keep.index(text_col) if text_col in keep else len(keep)
    # numbered names in between: columns may have names that Spark cannot pass to Python
    src = docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(keep)], *[named(text_col).alias("text")][: at == len(keep)])
    schema = StructType([*src.schema.fields[: len(keep)], StructField("pred", StringType()), StructField("score", DoubleType())])
    out_names = schema.names
    return src.mapInArrow(run, schema).toDF(*keep, pred_col, score_col)
