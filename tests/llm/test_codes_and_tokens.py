"""Vector codes, token alignment and BPE against brute force and the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import alignment, bpe, forced_bpe, queries, vector_codes

ODD = list("abcdeghilmnorstuvxABZ    \n\n\t\r''’019.,;:!?-_<|>#äöß½²٣中文日本語éÀ 　😀🇩🇪́‍\u0000\u0085\u001c\U00013000ⅧΩа")
PARTS = ["<|endoftext|>", "don't", "I'll", "'re", "'s", "'sx", "''s", " 's", "\n's", "the", "  ", "   \n  ", "<0x41>", "</s>", "<s>", "<unk>", "we've", "'D", "house", "Häuser", "q'", "'vest", " 'll", "▁"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    out = ["", " ", "  ", "\n", "x" * 5000, " " * 300 + "a" + " " * 300, "'", "'s", "a'", "<|endoftext|>", "<|endoftext|><|endoftext|> x <|endoftext|>", "  <|endoftext|>  x"]
    out += ["".join(r.choice(PARTS) if r.random() < 0.2 else r.choice(ODD) for _ in range(r.randint(1, 60))) for _ in range(n)]
    return out + ["".join(chr(c) for c in (r.randrange(0x110000) for _ in range(12)) if not 0xD800 <= c < 0xE000) for _ in range(n // 4)]


def library(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.byte_vocabulary())
    t.encode_special_tokens = not special
    return t


@pytest.mark.parametrize("special", [True, False])
def test_fragments_against_the_library(special):
    texts, own, t = odd_texts(1500), forced_bpe.ByteBpe(queries.byte_vocabulary(), special), library(special)
    assert own.plain
    ids, counts = own.encode(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert own.decode(ids, counts) == [t.decode(i, skip_special_tokens=False) for i in want] == texts


def test_pieces_against_the_library():
    import sentencepiece

    texts, own = odd_texts(1500, 2), forced_bpe.PieceBpe(queries.pieces())
    assert own.plain
    ids, counts = own.encode(texts)
    assert [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])] == sentencepiece.SentencePieceProcessor(model_file=queries.pieces()).encode(texts)


def test_decoding_of_any_ids(spark):
    r, t = random.Random(5), library(True)
    lists = [[r.randrange(50257) for _ in range(r.randint(0, 12))] for _ in range(500)]
    rows = [(k, x) for k, x in enumerate(lists)] + [(900, None), (901, [40, None, 50256, -1, 99999])]
    got = {x["doc_id"]: x["decoded"] for x in bpe.decode(spark.createDataFrame(rows, "doc_id int, ids array<int>"), queries.byte_vocabulary()).collect()}
    assert [got[k] for k in range(500)] == [t.decode(x, skip_special_tokens=False) for x in lists]
    assert got[900] is None and got[901] == t.decode([40, 50256], skip_special_tokens=False)


def test_a_forgetful_worker_encodes_the_same(monkeypatch):
    texts = odd_texts(300, 4)
    want = forced_bpe.ByteBpe(queries.byte_vocabulary()).encode(texts)
    monkeypatch.setattr(forced_bpe, "MOST_FRAGMENTS", 3)
    monkeypatch.setattr(forced_bpe, "MOST_LONG", 100)
    own = forced_bpe.ByteBpe(queries.byte_vocabulary())
    got = [own.encode(texts[k : k + 7]) for k in range(0, len(texts), 7)]
    assert np.array_equal(np.concatenate([g[0] for g in got]), want[0]) and np.array_equal(np.concatenate([g[1] for g in got]), want[1])


def test_long_runs_merge_as_short_ones(monkeypatch):
    own = forced_bpe.ByteBpe(queries.byte_vocabulary())
    words = ["internationalisation", "xxxxxxxxyyyyyyyy", "abababababab", "unbelievable" * 3]
    want = own.encode(words)[0].tolist()
    monkeypatch.setattr(forced_bpe, "SHORT", 0)
    assert forced_bpe.ByteBpe(queries.byte_vocabulary()).encode(words)[0].tolist() == want


def brute_alignment(rows):
    """Per row the expected columns, by walking both token lists byte by byte."""
    import sentencepiece

    t, sp, own = library(False), sentencepiece.SentencePieceProcessor(model_file=queries.pieces()), forced_bpe.ByteBpe(queries.byte_vocabulary())
    seen, links = [], Counter()
    for d, x in rows:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        bytes_a = [own.joined(np.array([i])) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not x or b"".join(bytes_a) != (" " + x).encode() or b"".join(bytes_b) != (" " + x).encode():
            seen.append((d, [], [], [], ""))
            continue
        of_a, of_b = ([k for k, s in enumerate(parts) for _ in s] for parts in (bytes_a, bytes_b))
        own_links = [(a[i], b[j]) for i, j in sorted(set(zip(of_a, of_b)))]
        ends = sorted(set(np.cumsum([len(s) for s in bytes_a]).tolist()) & set(np.cumsum([len(s) for s in bytes_b]).tolist()))
        shown = [(",".join(str(a[i]) for i in dict.fromkeys(of_a[s:e])), ",".join(str(b[j]) for j in dict.fromkeys(of_b[s:e]))) for s, e in zip([0, *ends], ends)]
        links.update(own_links)
        seen.append((d, a, b, own_links, ";".join("|".join(g) for g in shown)))
    most = {}
    for (_, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    return links, [(d, len(a), len(b), g.count(";") + 1 if g else 0, len(k), sum(links[p] == most[p[1]] for p in k), sum(links[p] for p in k), g) for d, a, b, k, g in seen]


def test_alignment_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 500)
    monkeypatch.setattr(alignment, "SLICE", 2000)
    rows = list(enumerate(odd_texts(500, 3) + [None, "a ▁ b", "the house and the garden"] * 5))
    links, want = brute_alignment(rows)
    texts, pairs = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.byte_vocabulary(), queries.pieces())
    got = texts.collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(links)
    digests, _ = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), queries.byte_vocabulary(), queries.pieces(), digest=True)
    assert {(r["doc_id"], r["groups_sha256"]) for r in digests.collect()} == {(w[0], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want}


def test_group_products():
    a, b = alignment.group_products(np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1, 1, 2]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 4), (4, 4)]
    assert [len(x) for x in alignment.group_products(np.array([], int), np.array([], int))] == [0, 0]


def test_screening_never_misses_the_nearest():
    r = np.random.default_rng(3)
    for spread, width in ((3, 4), (500, 16), (10**6, 8), (10**8, 5)):
        book = r.integers(-spread, spread, (64, width))
        book[40:] = book[r.integers(0, 40, 24)] + r.integers(-1, 2, (24, width)) * r.integers(0, 2, (24, 1))
        x = np.concatenate([r.integers(-spread, spread, (3000, width)), (book[r.integers(0, 64, 500)] + book[r.integers(0, 64, 500)]) // 2])
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        entry, distance = vector_codes.nearest(x, book)
        assert np.array_equal(entry, d.argmin(1)) and np.array_equal(distance, d.min(1))


def brute_codes(rows, entries=256, rounds=4):
    rows = sorted((r for r in rows if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all()), key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) for c in r[1]] for r in rows]).reshape(len(rows), 4, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(4)]
    for _ in range(rounds):
        for p, d in enumerate(near()):
            own = d.argmin(1)
            for e in range(books.shape[1]):
                if (own == e).any():
                    books[p, e] = x[own == e, p].sum(0) // (own == e).sum()
    d = near()
    errors, labels = sum(m.min(1) for m in d), Counter()
    for r, e in zip(rows, errors):
        labels[r[2]] += int(e)
    return sorted(((r[0], "".join(f"{m[k].argmin():02x}" for m in d), int(errors[k]), labels[r[2]]) for k, r in enumerate(rows)), key=repr), hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


@pytest.mark.parametrize("sent", [1 << 17, 0])
def test_codes_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(vector_codes, "MOST_SENT", sent)
    r = random.Random(2)
    rows = [(i, [r.uniform(-0.3, 0.3) for _ in range(16)], r.choice([0, 1, None])) for i in range(700)]
    rows += [(i, [0.25] * 16, 1) for i in range(700, 1000)] + [(5, [0.1] * 16, 2), (None, [0.2] * 16, 2)]
    rows += [(2000, None, 1), (2001, [0.1] * 15 + [None], 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] * 16, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    coded, books = vector_codes.compress(d)
    want, digest = brute_codes(rows)
    assert sorted((tuple(x[c] for c in ("vec_id", "code", "error", "label_error")) for x in coded.collect()), key=repr) == want and books.sha256() == digest
    restored = {(x["vec_id"], x["code"]): x["vector"] for x in vector_codes.decode(coded, books).collect()}
    assert all(np.array_equal(np.array(v) * 1024, np.concatenate([books.entries[p][int(c[2 * p : 2 * p + 2], 16)] for p in range(4)])) for (_, c), v in restored.items())


def test_codes_of_odd_vectors(spark):
    d = spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.25] * 8, None), (3, [0.1] * 4, None), (4, [], 1)], "vec_id long, embedding array<double>, label int")
    rows = {r["vec_id"]: r for r in vector_codes.compress(d)[0].collect()}
    assert [rows[k]["code"] for k in (1, 2, 3, 4)] == ["00000000", "01010101", None, None] and rows[3]["label_error"] == 0 and rows[1]["error"] == 0
    with pytest.raises(ValueError):
        vector_codes.fit(d.where("vec_id = 3").select("vec_id", F.slice("embedding", 1, 3).alias("embedding")))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(d.select("vec_id", "label", F.transform("embedding", lambda x: x * 1e30).alias("embedding")))[0].count()
