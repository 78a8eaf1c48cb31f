"""Token counts against greedy longest match done piece by piece."""

from __future__ import annotations

import base64
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from tamarack.llm import queries, token_counts
from tests.llm.frames import write_documents

SPACE = re.compile(b"[\x20\x09-\x0d]+")


def greedy(word, pieces, longest):
    n = 0
    while word:
        for size in range(min(longest, len(word)), 0, -1):
            if word[:size] in pieces:
                break
        else:
            return 1
        word, n = word[size:], n + 1
    return n


@pytest.mark.parametrize("seed", range(30))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
    automaton = token_counts.Automaton(pieces)
    for _ in range(300):
        word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randrange(12)))
        assert automaton.count(word) == greedy(word, pieces, 5), (pieces, word)


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_documents(spark, tmp_path, which):
    folder = write_documents(tmp_path) if which == "awkward" else "/root/testdata/sf0.001"
    with open(public_tokenizers.path(token_counts.VOCABULARY), "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines}
    longest, known, want = max(map(len, pieces)), {}, Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = [w for w in SPACE.split((r["text"] or "").encode()) if w]
        for w in words:
            if w not in known:
                known[w] = greedy(b" " + w, pieces, longest)
        want[(r["doc_id"], len(words), sum(known[w] for w in words))] += 1
    assert Counter(tuple(r) for r in queries.op9_token_counts(spark, folder).collect()) == want


def test_long_words_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counts = token_counts._Remembered(token_counts.Automaton([b" ", b"a", b"aa", b"b"]))
    assert [counts[w] for w in (b"a", b"aa", b"aaa", b"ab", b"a")] == [2, 2, 3, 3, 2] and len(counts) <= 3
    assert counts[b"a" * 1_000_001] == 500_002 and b"a" * 1_000_001 not in counts
