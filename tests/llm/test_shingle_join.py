"""The n-gram join against brute force: near copies, common passages, hot groups and awkward tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tamarack.llm import queries, shingle_join
from tamarack.llm.components import components
from tests.llm.frames import write_documents

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
SPACE = re.compile("[\x20\x09-\x0d]+")


def tokens_of(text):
    words = [w for w in SPACE.split("".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(documents):
    """[(doc_id, n_shingles, component_id)] of (doc_id, text)."""
    sets = [tokens_of(t) for _, t in documents]
    holders, links = defaultdict(list), []
    for i, s in enumerate(sets):
        met = Counter(j for token in s for j in holders[token])
        links += [(i, j) for j, both in met.items() if 100 * both >= 80 * (len(s) + len(sets[j]) - both)]
        for token in s:
            holders[token].append(i)
    roots, least = roots_of(len(sets), links), {}
    for i, r in enumerate(roots):
        ids = [x for x in (least.get(r), documents[i][0]) if x is not None]
        least[r] = min(ids, default=None)
    return [(d[0], len(s), least[r]) for d, s, r in zip(documents, sets, roots, strict=True)]


def check(spark, folder):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op10_ngram_join(spark, folder).collect())
    want = Counter(brute(documents))
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])
    return want


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_given_tables(spark, folder):
    check(spark, folder)


def test_awkward(spark, tmp_path):
    check(spark, write_documents(tmp_path))


def words_of(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed):
    """Chains of near copies, a hot group of near copies, and passages that many unlike documents share."""
    rng, texts = random.Random(seed), []
    for _ in range(60):
        base = words_of(rng, rng.choice([3, 5, 9, 12, 30, 80, 300]))
        texts.append(base)
        for _ in range(rng.randrange(6)):  # chains drift away from their first text
            base = list(base)
            for _ in range(max(1, len(base) // 60)):
                base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            texts.append(base)
    hot = words_of(rng, 150)
    for _ in range(150):
        copy = list(hot)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10**6)}"
        texts.append(copy)
    passage = words_of(rng, 70)
    for i in range(120):  # mostly the passage, but unlike: the frequent tokens reach into the prefix
        texts.append(words_of(rng, 1 + i % 25) + passage + words_of(rng, i % 17))
    texts += [[w.upper() for w in t] for t in texts[:40]]
    rng.shuffle(texts)
    return [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted(spark, tmp_path, seed):
    want = check(spark, write_documents(tmp_path, corpus(seed)))
    assert max(Counter(c for _, _, c in want).values()) > 100


def test_common_tokens_sent_directly(monkeypatch):
    monkeypatch.setattr(shingle_join, "FREQUENT", 3)
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randrange(400) for _ in range(60)], np.uint64)) for _ in range(40)]
    keys = [shingle_join.set_hash(s) for s in sets]
    packed = shingle_join._flush(keys, sets, 5)
    returned = [shingle_join._count_classes(packed.filter(pc.equal(packed.column("bucket"), b)), 5) for b in range(5)]
    got = defaultdict(dict)
    for table in returned:
        for row in table.to_pylist():
            at = 0
            for key, take in zip(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["takes"], np.uint32), strict=True):
                for i in range(at, at + take):
                    got[int(key)][int(np.frombuffer(row["tokens"], np.uint64)[i])] = row["counts"][i]
                at += take
    counts = Counter(int(t) for s in sets for t in s)
    for key, s in zip(keys, sets, strict=True):
        assert got[key] == {int(t): min(4, counts[int(t)]) for t in s if counts[int(t)] > 1}


def test_similar_sets_share_a_signature():
    """The guarantee itself, for sets whose tokens are frequent, rare or their own, in any mixture."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(4, 400))
        universe = shingle_join.mixed(rng.integers(0, 1 << 62, 2 * n + 10).astype(np.uint64))
        share = rng.random(2)
        counts = {int(t): (2 + int(rng.integers(0, 20)) if rng.random() < share[0] else 33) for t in universe}
        x = set(map(int, universe[:n]))
        gone = int(rng.integers(0, max(1, n // 9) + 1))
        y = set(map(int, universe[gone : n + int(rng.integers(0, max(1, n // 9) + 1))]))
        if 100 * len(x & y) < 80 * len(x | y) or x == y:
            continue
        found = []
        for s in (x, y):
            own = np.array([t for t in s if t in x & y or rng.random() < 0.5], np.uint64)  # the others are in no other class
            found.append(set(shingle_join.signatures(len(s), own, np.array([counts[int(t)] for t in own], np.uint8)).tolist()))
        assert found[0] & found[1], n


def test_words_across_blocks():
    rng = random.Random(6)
    text = " ".join(words_of(rng, 120_000)) + " " + "z" * 600_000 + " " + " ".join(words_of(rng, 50))
    short = [b"one two", None, b"", b" \n", b"a b c d e", b"a b c d e f"]
    alone = [list(shingle_join.shingle_sets([t]))[0] for t in [*short, text.encode()]]
    together = list(shingle_join.shingle_sets([*short, text.encode(), *short]))
    assert [x.tolist() for x in together] == [x.tolist() for x in [*alone, *alone[:-1]]]
    assert [len(x) for x in alone] == [1, 0, 0, 0, 1, 2, len(tokens_of(text))]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 5), (2000, 2001), (2001, 2002), (7, 7), (3000, 2002)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1000: 0, 2001: 2000, 2002: 2000, 3000: 2000}


def test_components_of_awkward_links(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    pairs += pairs[:50] + [(b, a) for a, b in pairs[:50]] + [(500, None), (None, None)]
    roots = roots_of(400, [p for p in pairs if None not in p])
    least = {r: min(i for i in range(400) if roots[i] == r) for r in set(roots)}
    got = [(r["node"], r["root"]) for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()]
    assert sorted(got) == [(i, least[roots[i]]) for i in range(400) if least[roots[i]] != i]
    assert components(spark.createDataFrame([(4, 4)], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands_lose_no_possible_pair(spark):
    """Every pair that sizes and the pivot's bound allow meets exactly once, and few others do."""
    rng = random.Random(12)
    rows = []
    for key in range(700):
        n = rng.choice([1, 2, 4, 5, 8, 10, 64, 80, 100, 125, rng.randrange(1, 3000)])
        shared = rng.randrange(n) + 1
        rows.append((key, n, shared, rng.choice([0, shared, rng.randrange(shared + 1)])))
    here = spark.createDataFrame(rows, "key long, n int, shared int, inside int")
    smaller, larger = shingle_join._bands(here)
    met = smaller.alias("a").join(larger.alias("b"), ["band", "cell"]).select("a.key", F.col("b.key").alias("other"))
    got = Counter((r["key"], r["other"]) for r in met.collect())
    want = set()
    for x, n, shared, inside in rows:
        for y, m, y_shared, y_inside in rows:
            bound = min(inside, y_inside) + min(shared - inside, y_shared - y_inside)
            if (n, x) < (m, y) and 100 * n >= 80 * m and 180 * bound >= 80 * (n + m):
                want.add((x, y))
    assert len(want) > 500 and all(got[pair] == 1 for pair in want)
    assert max(got.values()) == 1 and len(got) < len(rows) ** 2 / 4


def test_one_per_component(spark, tmp_path):
    docs = spark.read.parquet(f"{write_documents(tmp_path)}/documents.parquet")
    kept = shingle_join.one_per_component(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = {c for _, n, c in brute(rows) if n}
    assert {i for i, t in got if tokens_of(t)} == want and set(got.values()) == {1}
    assert sum(1 for _, t in got if not tokens_of(t)) == 4
    assert docs.filter(F.col("doc_id") == 3).count() == 2
