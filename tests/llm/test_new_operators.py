"""Whitening against numpy, collocations against plain counting, BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tamarack.llm import bpe, phrases, queries, whitening
from tests.llm.frames import DOCUMENTS, write_documents

# --- whitening ---------------------------------------------------------------------------


def spectrum(kind, m, rng):
    return {
        "plain": rng.random(m) + 0.1,
        "repeated": np.repeat([3.0, 1.0], [m // 2, m - m // 2]),
        "wide": 10.0 ** -rng.integers(0, 16, m),
        "singular": np.r_[np.zeros(m // 2), rng.random(m - m // 2)],
    }[kind]


@pytest.mark.parametrize("kind", ["plain", "repeated", "wide", "singular"])
@pytest.mark.parametrize("m", [1, 2, 3, 5, 16, 64])
def test_divide_and_conquer(kind, m):
    rng = np.random.default_rng(m)
    q = np.linalg.qr(rng.standard_normal((m, m)))[0]
    a = (q * spectrum(kind, m, rng)) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components_of(a)
    scale = np.abs(a).max() * m
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-13 * scale, rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale


def test_matrices_that_shifts_hit():
    for a in (np.ones((2, 2)), np.zeros((3, 3)), np.ones((5, 5)), np.diag([1.0, 1, 1, 2]), np.array([[0.0, 1], [1, 0]])):
        values, vectors = whitening.components_of(a)
        assert np.allclose((vectors * values) @ vectors.T, a, atol=1e-14)


def brute_whitening(rows):
    """Per length: {(vec_id, component): values}, with components up to sign."""
    proper = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for length in {len(v) for _, v in proper}:
        own = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in proper if len(v) == length]
        fit = np.array(sorted({tuple(x) for _, x in own}), object)
        n, sums = len(fit), fit.sum(axis=0)
        centred = np.array([[float(n * x - s) / n for x, s in zip(row, sums, strict=True)] for row in fit])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        for rank, at in enumerate(np.argsort(-values)[:4], 1):
            if values[at] <= 1e-12 * values.sum():
                continue
            for i, x in own:
                y = np.array([float(n * a - s) / n for a, s in zip(x, sums, strict=True)])
                deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                out.append((i, rank, n, deviation, abs(y @ vectors[:, at]) / np.sqrt(values[at]), values[at] / values.sum()))
    return sorted(out, key=str)


def compare_whitening(found, want):
    got = sorted([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found], key=str)
    key = lambda r: (str(r[0]), r[2], r[1], str(r[3]), r[4])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-7, atol=1e-9)
    assert all(r.identity_error < 1e-9 for r in found)


def test_whitening_of_embeddings(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare_whitening(queries.op11_whitening(spark, folder).collect(), brute_whitening(rows))


def test_whitening_edges(spark, tmp_path):
    rng = np.random.default_rng(3)
    plain = [(i, (rng.standard_normal(3) * [5, 2, 1]).tolist()) for i in range(40)]
    odd = [(50, None), (51, []), (52, [None, 1.0, 2.0]), (53, [float("nan"), 1, 2]), (54, [float("inf"), 1, 2]), (None, [0.5, -0.25, 1.0])]
    rows = [*plain, *plain[:5], *odd, *[(60 + i, rng.standard_normal(6).tolist()) for i in range(9)], (90, [1.0, 2.0])]
    names = {"x": "key", "vec_id_": "n"}
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
    for column in names.values():
        table = table.append_column(column, pa.array(range(len(rows))))
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    compare_whitening(queries.op11_whitening(spark, str(tmp_path)).collect(), brute_whitening(rows))


def test_whitening_of_extreme_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    found = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], schema)).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in found)
    assert [r.deviation for r in found if r.vec_id == 1] == [None] * sum(r.vec_id == 1 for r in found)


# --- collocations ------------------------------------------------------------------------

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_collocations(rows, least, returned=2_000):
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            own.update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        n, frequent = sum(f for p, f in own.items() if len(p) == 1), {p: f for p, f in own.items() if f >= least}
        inside = Counter()
        for p, f in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], f)
        scored = []
        for p, a in frequent.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:returned], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("least", [1, 2, 5])
def test_collocations_of_awkward_texts(spark, tmp_path, least):
    rng = random.Random(least)
    words = ["the", "of", "New", "york", "é", "漢字", "a b", "x\x1cy", "it's"]
    made = [
        (100 + i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(40))), rng.choice(["en", "é", None, "a-very-long-language-name"]), "s")
        for i in range(60)
    ]
    folder = write_documents(tmp_path, [*DOCUMENTS, *made])
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
    found = phrases.collocations(docs, least=least, returned=50).drop("k").collect()
    assert sorted(map(tuple, found)) == brute_collocations([(r[2], r[1]) for r in [*DOCUMENTS, *made]], least, 50)


def test_collocations_of_the_small_table(spark, small):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_collocations(spark, small).collect())) == brute_collocations(rows, 100)


def test_no_documents(spark, tmp_path):
    folder = write_documents(tmp_path, [])
    assert queries.op12_collocations(spark, folder).count() == 0
    assert queries.op13_bpe(spark, folder).count() == 0


def test_long_texts_are_cut_at_breaks():
    text = b"a b c\n" * 400_000 + b"d " * 900_000 + b"\n\ne f"
    blocks = list(phrases._cut("en", text))
    assert len(blocks) > 2 and b"\n".join(block[1:-1] for _, block in blocks) == text


# --- BPE ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def ids_of(text):
    return np.frombuffer(b"".join(bpe.encode(bpe.vocabulary(bpe.VOCABULARY), text)), bpe.PACKED).tolist()


ALPHABET = [*"abcthein 's'lldm  \n\t\r 12é漢　\xa0\x85՘!.,-😀\U0002ebf0\U00010d50", "<|endoftext|>", "<|endof", "'re", "'ve", "  "]


@pytest.mark.parametrize("block,window", [(3, 1), (7, 5), (64, 4_096), (1 << 16, 1)])
def test_streams_of_any_block_give_the_ids_of_the_library(library, monkeypatch, block, window):
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "WINDOW", window)
    rng = random.Random(block)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
        if rng.random() < 0.4:
            text += rng.choice(ALPHABET) * rng.randrange(900) + text[:9]
        assert ids_of(text) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("unit", ["a", " ", "\n", "-", "a1", "qj", "漢"])
def test_million_character_runs(library, unit):
    text = unit * (1_000_000 // len(unit)) + "x"
    assert ids_of(text) == library.encode(text, add_special_tokens=False).ids


def test_a_window_stays_bounded():
    voc = bpe.vocabulary(bpe.VOCABULARY)
    encoder = bpe.Encoder(voc)
    for _ in range(20):
        list(encoder.feed("a" * bpe.BLOCK))
        held = len(encoder.tail) + len(encoder.unread) + (len(encoder.merger.held) if encoder.merger else 0)
        assert held <= bpe.BLOCK + voc.lookahead + bpe.WINDOW


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2  # abc: whether a takes b depends on c
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c")])


def test_any_ids_decode_as_in_the_library(library):
    rng, voc = random.Random(5), bpe.vocabulary(bpe.VOCABULARY)
    for _ in range(2_000):
        ids = [rng.randrange(50_300) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(40))]
        assert "".join(bpe.decode(voc, np.array(ids, bpe.PACKED).tobytes())) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_documents_are_encoded_and_decoded(spark, tmp_path, library, small, which):
    rows = [*DOCUMENTS, (90, "a<|endoftext|> b <|endoftext|>", "en", "a"), (91, "😀" * 70_000, "en", "a")]
    folder = write_documents(tmp_path, rows) if which == "awkward" else small
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()] += 1
    assert Counter(map(tuple, queries.op13_bpe(spark, folder).collect())) == want
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id = 9").select("text")
    got = docs.select(bpe.id_list(bpe.token_ids(docs["text"])).alias("ids"), "text").first()
    assert got is None or got.ids == library.encode(got.text or "", add_special_tokens=False).ids


def test_word_counts_of_a_task_hold_no_object_for_each_word():
    """700,000 different words of 1.4 million: some 250 MB as Python objects, a few arrays otherwise."""
    texts = [" ".join(f"w{i}" for i in range(low, low + 100_000)) + ("." if low % 200_000 else "") for low in range(0, 700_000, 100_000)]
    langs = ["en", "en", "de", "de", "und", "und", "und"]  # the words of each language are its own
    batch = pa.RecordBatch.from_arrays([pa.array(langs * 2), pa.array(texts * 2)], ["lang", "text"])
    tracemalloc.start()
    found = list(phrases._word_counts(0)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
    rows = [r for b in found for r in zip(*b.to_pydict().values(), strict=True)]
    want = {(lang, word): 2 for lang, text in zip(langs, texts, strict=True) for word in text.rstrip(".").split()}
    assert {(lang, word): n for lang, _, word, n in rows} == want and len(rows) == len(want)
