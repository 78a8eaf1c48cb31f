"""Packing, quality classifier and vector search against brute force, by held-out labels and on awkward tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarack.llm import packing, quality, queries, vector_search
from tests.llm.frames import write_documents

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    return write_documents(tmp_path_factory.mktemp("awkward"))


# --- packing -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_packing(spark, awkward, tokenizer, which):
    folder = awkward if which == "awkward" else SMALL
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = Counter()
    for d in docs:
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : (first if piece == 0 else start + 2048)]
            want[(d["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    got = queries.op1_best_fit_packing(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1 + (which == "awkward")


def test_special_strings_are_text(spark, tmp_path, tokenizer):
    folder = write_documents(tmp_path, [(1, "a <|endoftext|> b", "en", "s"), (2, "퟿ \U0001f600\r\n　x", "en", "s")])
    for r in queries.op1_best_fit_packing(spark, folder).collect():
        text = {1: "a <|endoftext|> b", 2: "퟿ \U0001f600\r\n　x"}[r["doc_id"]]
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_fullest_is_fullest():
    random = np.random.default_rng(3)
    for _ in range(200):
        capacity = int(random.integers(5, 30))
        counts = {int(x): int(random.integers(1, 4)) for x in random.integers(1, capacity + 1, 4)}
        got = packing.fullest(counts, capacity)
        largest = max(counts)
        best = 0
        for size in range(0, 8):
            for extra in combinations_with_replacement(sorted(counts), size):
                used = Counter(extra) + Counter([largest])
                if all(counts[x] >= n for x, n in used.items()) and sum(x * n for x, n in used.items()) <= capacity:
                    best = max(best, sum(x * n for x, n in used.items()))
        assert sum(x * n for x, n in got.items()) >= best and sum(x * n for x, n in got.items()) <= capacity
        assert got[largest] >= 1 and all(counts[x] >= n for x, n in got.items())


def test_plan_takes_all():
    counts = {2048: 10, 1025: 1000, 1000: 900, 7: 5, 1: 100_000_000_000}
    taken, room = Counter(), 0
    for times, combination in packing.plan(counts):
        room += times * 2048
        for length, n in combination:
            taken[length] += times * n
    assert taken == Counter(counts)
    assert room - sum(x * n for x, n in counts.items()) < 2048


# --- quality -------------------------------------------------------------------------


def test_held_out_quality(spark):
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, MEDIUM).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    for doc_id, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[i]["score"], got[i]["predicted"], y) for i, y in labels.items() if i in got and got[i]["held_out"]]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(p == y for _, p, y in held) / len(held) > 0.93


def test_labels_of_held_out_rows_do_not_matter(spark, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels, 120), quality.fit(docs, turned, 120)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_quality_edges(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    labels = spark.createDataFrame([(1, 1), (9, 0), (7, 1), (12, 0), (4, 1), (5, None), (None, 1), (3, 5), (2, 0)], "doc_id long, quality int")
    out = quality.with_quality(docs, labels, "my_score")
    assert out.columns == [*docs.columns, "my_score"]
    scores = {}
    for r in out.collect():
        assert 0 <= r["my_score"] <= 1
        scores.setdefault((r["text"] or "").strip(), set()).add(r["my_score"])
    assert len(scores[""]) == 1  # null, empty and white space alone
    assert len(scores["the same text for all"]) == 1
    none = quality.with_quality(docs, labels.filter("quality = 1"), "my_score")
    assert {r["my_score"] for r in none.select("my_score").collect()} == {0.5}


def test_long_text_is_read_to_its_end():
    model = quality.train([(*quality.counted(b"good words here"), 1), (*quality.counted(b"### $$$ %%%"), 0)] * 20)
    filler = b"good words here " * 40_000
    start, end = model.scores([filler + b"### $$$ %%% " * 40_000]), model.scores([filler])
    assert start[0] < end[0]
    assert model.scores([b"x" * 1_000_000]).shape == (1,)


def test_repeats_stay_within_a_text():
    model = quality.Model(np.random.default_rng(3).normal(size=1 << quality.BITS), 0.0)
    texts = [b"copy", b"copy", b"copy", b"", b"copy", b"end and end", b"end of it", b"  ", b"it"]
    assert list(model.scores(texts)) == [model.scores([t])[0] for t in texts]


def test_repeats_go_on_across_blocks():
    fresh, again = quality._buckets(np.array([0, 1], np.uint64) + np.uint64(1 << 60), quality.BITS)

    def found(text):
        counts = dict(zip(*(x.tolist() for x in quality.counted(text)), strict=True))
        return counts.get(fresh, 0), counts.get(again, 0)

    n = quality.BLOCK // 5 + 100
    assert found(b"word " * n) == (1, n - 1)
    assert found(b"a" * (quality.BLOCK - 10) + b" b b") == (2, 1)
    assert found(b"b " + b" " * (2 * quality.BLOCK) + b"b c") == (2, 1)
    long = b"word " * n + b" " * quality.BLOCK
    model = quality.Model(np.random.default_rng(3).normal(size=1 << quality.BITS), 0.0)
    assert list(model.scores([long, b"word"])) == [model.scores([t])[0] for t in (long, b"word")]


# --- vector search -------------------------------------------------------------------


def brute(vectors, k=5, every=50):
    """{query place: [(vec_id, score)]}; vectors: (vec_id, components) in their order."""
    ok = [i for i, (v, x) in enumerate(vectors) if v is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    answers = {}
    for i in ok:
        if vectors[i][0] % every == 0:
            q, scored = np.array(vectors[i][1], float), []
            for j in ok:
                if j != i:
                    x = np.array(vectors[j][1], float)
                    scored.append((-(x * q).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum())), vectors[j][0]))
            answers[i] = [(v, -s) for s, v in sorted(scored)[:k]]
    return answers


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in table], float)
    ids = np.array([r["vec_id"] for r in table])
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    found = defaultdict(list)
    for r in queries.op6_vector_search(spark, "/root/testdata/sf0.1").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[i]
        scores[i] = -2
        best = set(ids[np.argsort(-scores)[:5]])
        answers = sorted(found[ids[i]])
        assert [rank for rank, *_ in answers] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] for a, b in zip(answers, answers[1:], strict=False))
        for _, v, s in answers:
            assert abs(s - unit[ids.tolist().index(v)] @ unit[i]) < 1e-12
        hits += len(best & {v for _, v, _ in answers})
        total += 5
    assert hits / total >= 0.9, hits / total


def test_exact_search_finds_all_that_brute_force_finds(spark):
    random = np.random.default_rng(3)
    around = random.standard_normal((12, 40))[random.integers(0, 12, 3000)]
    # clusters from wide to so narrow that single precision hardly tells their members apart
    x = around + random.standard_normal((3000, 40)) * 10.0 ** random.integers(-6, 1, 3000)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vector_search.search(vector_search.build_index(rows), F.col("_id") % 50 == 0, share=1.0, strictness=np.inf).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    for q in range(0, 3000, 50):
        score = vector_search.exact(x[q], x)
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:5]
        assert [got[q, i + 1] for i in range(5)] == [(i, score[i]) for i in best]


def test_vector_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0, i) for i in range(40, 120)] + [(i, [float(i % 7), 1.0, float(i % 3)], 1, i) for i in range(120, 260)]
    rows += [(0, None, 0, 0), (50, [], 0, 0), (100, [0.0, 0.0, 0.0], 0, 0), (150, [1.0, None, 2.0], 0, 0), (200, [nan, 1.0, 1.0], 0, 0),
             (250, [inf, 1.0, 1.0], 0, 0), (None, same, 0, 0), (300, [1.0, 2.0], 0, 0), (100, same, 0, 0), (350, [1e300, 2e300, 3e300], 0, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = defaultdict(list)
    for r in queries.op6_vector_search(spark, str(tmp_path)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {50, 100, 150, 200, 250, 350}
    # equal scores go to the smaller id; that of 350, whose entries are rounded multiples, may differ in the last digit
    assert [v for _, v, _ in sorted(got[50]) if v != 350][:4] == [40, 41, 42, 43]
    assert all(abs(s - 1) < 1e-15 for _, _, s in got[50])
    assert len(got[100]) == 10  # two rows have this id
    assert all(len(got[q]) == 5 for q in (50, 150, 200, 250, 350))
    assert [v for _, v, _ in sorted(got[350])] == [40, 41, 42, 43, 44]
    assert all(abs(s - 1) < 1e-15 for _, _, s in got[350])


def test_cosines_of_extreme_rows():
    base = np.array([1.0, 2.0, 3.0])
    rows = np.array([base, base * 1e300, base * 1e-200, base * 2.0**-1070, -base * 1e-300, [3e300, 0, -1e300]])
    for query in rows[:3]:
        got = vector_search.exact(query, rows)
        assert np.allclose(got, [1, 1, 1, 1, -1, 0], atol=1e-15)
    plain = np.random.default_rng(1).standard_normal((50, 8))
    want = (plain * plain[0]).sum(axis=1) / (np.sqrt((plain * plain).sum(axis=1)) * np.sqrt((plain[0] * plain[0]).sum()))
    assert (vector_search.exact(plain[0], plain) == want).all()


def test_fewer_candidates_than_asked(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = vector_search.search(vector_search.build_index(rows), F.col("_id") % 50 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    alone = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert vector_search.search(vector_search.build_index(alone), F.col("_id") % 50 == 0).count() == 0


def test_each_length_has_its_answers(spark, tmp_path):
    random = np.random.default_rng(5)
    lengths = {i: 3 if i < 120 else 2 for i in range(200)} | {201: 7}  # the last length has no query
    vectors = [(i, random.standard_normal(d).tolist()) for i, d in lengths.items()]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = defaultdict(list)
    for r in queries.op6_vector_search(spark, str(tmp_path)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    want = {}
    for d in (2, 3):
        own = [v for v in vectors if len(v[1]) == d]
        want |= {own[i][0]: [v for v, _ in answer] for i, answer in brute(own).items()}
    assert set(want) == {0, 50, 100, 150} and {q: [v for _, v in sorted(a)] for q, a in got.items()} == want


def test_scan_keeps_the_nearest():
    random = np.random.default_rng(1)
    x = vector_search.normed(random.standard_normal((3000, 64)))
    turned = (x @ vector_search.rotation(64)).astype(np.float32)
    cuts = list(range(16, 64, 16))
    blocks = np.split(turned, cuts, axis=1)
    hits = 0
    for i in range(40):
        left = vector_search.scan(turned[i], blocks, np.split(turned[i], cuts), 5, i)
        scores = x @ x[i]
        scores[i] = -2
        hits += len(set(np.argsort(-scores)[:5]) & set(left))
        assert i not in left and len(left) < 1000
    assert hits >= 0.95 * 200


@pytest.mark.parametrize("unit", [" ", "\n", "a", "漢", "-", "<|endoftext|>"])
def test_packing_reads_runs_of_millions(unit):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    encode = packing.encoder(packing.VOCABULARY)
    for text in (unit * (1_000_000 // len(unit)), f"before {unit * (packing.LONG_RUN + 7)} after"):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encode(" " * 5_000_000)) == 5_000_000


@pytest.mark.parametrize("strictness", [vector_search.EPSILON, np.inf])
def test_queries_scanned_together_find_what_each_finds_alone(strictness):
    """Also where the k-th best distance is 0: the test multiplies it by an infinite margin."""
    random = np.random.default_rng(4)
    x = vector_search.normed(np.concatenate([random.standard_normal((900, 40)), np.repeat(random.standard_normal((20, 40)), 12, axis=0)]))
    turned = (x @ vector_search.rotation(40)).astype(np.float32)
    blocks = np.split(turned, [16, 32], axis=1)
    asked = np.arange(0, len(x), 7)
    for i, left in zip(asked, vector_search.scan_all(turned[asked], blocks, 5, asked, strictness), strict=True):
        distance = ((turned.astype(float) - turned[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        fifth = np.sort(distance)[4]
        assert i not in left and len(left) == len(set(left)) and set(np.flatnonzero(distance <= fifth)) <= set(left)
