"""Token counts by a linear longest-match automaton.

Each word, with the space before it, is cut greedily into the longest pieces of
a vocabulary. The vocabulary is a trie; a node's failure link leads to what is
left of its text after the longest pieces are taken off, and the number of
those pieces is stored with it. Reading a word then moves along trie edges and
failure links, never back, and adds numbers: no piece is ever built, and the
time is linear in the word's length.

Defined results: a null or empty text, or white space alone, has no words and
no tokens; a word that cannot be cut counts as one token; words and texts of
any length are read whole; repeated rows get equal counts; an empty table gives
an empty result; columns of any name stay, since one column is added under a
name of the caller's choice.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public vocabulary by name (or a path): byte strings, among them every single byte.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words whose counts a task remembers at most, and the longest of them in bytes.
REMEMBERED, SHORT = 500_000, 64

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


class Automaton:
    """Trie of the pieces with failure links; ``popped`` is how many pieces a link takes off."""

    def __init__(self, pieces: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                after = self.edges[node].get(byte)
                if after is None:
                    after = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    whole.append(False)
                node = after
            whole[node] = node > 0
        self.link, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        waiting = deque([0])
        while waiting:  # parents before children
            parent = waiting.popleft()
            for byte, node in self.edges[parent].items():
                waiting.append(node)
                if whole[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, taken = self.link[parent], self.popped[parent]
                while at >= 0 and byte not in self.edges[at]:
                    taken += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.edges[at][byte], taken

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 if some part of it is in no piece."""
        edges, link, popped, node, n = self.edges, self.link, self.popped, 0, 0
        for byte in word:
            while (after := edges[node].get(byte)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = after
        while node:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n


class _Remembered(dict):
    """Counts of words met before; it starts anew when full, so its size is bounded."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counts(vocabulary: str) -> _Remembered:
    path = vocabulary
    if "/" not in vocabulary:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        return _Remembered(Automaton(base64.b64decode(line.split()[0]) for line in lines))


def token_counts(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Struct (words, tokens) of each text; Arrow batches of texts go to Python and two numbers come back."""

    @F.arrow_udf("struct<words:long,tokens:long>")
    def of(texts: pa.Array) -> pa.Array:
        counts, words, tokens = _counts(vocabulary), [], []
        for text in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist():
            found = [w for w in (text or b"").translate(_BLANKS).split(b" ") if w]
            words.append(len(found))
            tokens.append(sum(map(counts.__getitem__, found)))
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["words", "tokens"])

    return of(text)


def with_token_counts(docs: DataFrame, name: str = "counts", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` and a struct column ``name`` with words and tokens."""
    return docs.withColumn(name, token_counts(F.col(text_column), vocabulary))
