"""Quality classifier: supervised subword embeddings, averaged per document, softmax on top.

Words and character n-grams (3 and 5 bytes, word edges included) are hashed to
rows of an embedding matrix, and so is whether a word repeats the one before. A document is the mean of its rows; a softmax over
two classes reads it. Both are learned by numpy stochastic gradient descent on
at most ``SAMPLE_ROWS`` labelled documents, in one task; only the model, a number
per hashed row, reaches the driver. Scoring needs only the dot product of each row with the
difference of the two class vectors, so every text is scored whole by looking up
one number per n-gram.

Defined results: a null or empty text, or white space alone, has no n-grams and
gets the score of the intercept; without both labels in the training rows every
score is 0.5; labels other than 0 and 1 are left out; repeated rows get equal
scores; an empty table gives an empty result; columns of any name stay, since
only one column is added, under a name of the caller's choice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are fitted at most; hashed rows; dimensions; passes; learning rate.
SAMPLE_ROWS, BITS, DIMENSIONS, EPOCHS, RATE = 2_000, 17, 12, 8, 0.2
#: Scores from here on count as label 1.
THRESHOLD = 0.3
#: Bytes of text that are hashed at a time; longer texts are cut at a space and their parts added.
BLOCK = 1 << 18

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(BLOCK + 8, _BASE)
_DOWN = _powers(BLOCK + 8, np.uint64(pow(int(_BASE), -1, 1 << 64)))


def _buckets(packed: np.ndarray, bits: int) -> np.ndarray:
    return ((packed * _MIX) >> np.uint64(64 - bits)).astype(np.int32)


def grams(block: np.ndarray, bits: int = BITS, heads: Sequence[int] = (0,), last: bytes = b"") -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of 3-grams, 5-grams and words of a block that starts and ends with a space.

    ``heads`` are the places where texts begin: their first words have none before
    them. ``last`` is the word before the block, if its first text began in an
    earlier one.
    """
    u, space = block.astype(np.uint64), block == 32
    if len(block) < 3:
        return []
    two = u[:-1] | (u[1:] << np.uint64(8))
    at = np.flatnonzero(~space[1:-1])
    found = [(at, _buckets((two[:-1] | (u[2:] << np.uint64(16)))[at], bits))]
    if len(block) >= 5:
        five = two[:-3] | (two[2:-1] << np.uint64(16)) | (u[4:] << np.uint64(32)) | np.uint64(1 << 40)
        at = np.flatnonzero(~(space[1:-3] | space[2:-2] | space[3:-1]))
        found.append((at, _buckets(five[at], bits)))
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    total = np.cumsum(u * _UP[: len(u)])
    word = (total[end - 1] - total[start - 1]) * _DOWN[start]
    word ^= word >> np.uint64(29)
    found.append((start, _buckets(word, bits)))
    # whether a word repeats the one before: the one thing about word pairs that holds for unseen words
    again = np.zeros(len(word), np.uint64)
    again[1:] = word[1:] == word[:-1]
    if last and len(word):
        again[0] = block[start[0] : end[0]].tobytes() == last
    firsts = np.searchsorted(start, heads)
    again[firsts[firsts < len(word)]] = 0
    found.append((start, _buckets(again + np.uint64(1 << 60), bits)))
    return found


def _pieces(text: bytes) -> Iterator[bytes]:
    while len(text) > BLOCK - 2:
        cut = text.rfind(b" ", 1, BLOCK - 2)
        cut = cut if cut > 0 else BLOCK - 2
        yield text[:cut]
        text = text[cut:]
    yield text


def _blocks(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int], bytes]]:
    """Blocks of texts, a space around each; where each piece starts, its text's number, and ``heads`` and ``last`` for the grams."""
    parts, starts, owners, heads, last, at = [b" "], [], [], [], b"", 1
    for owner, text in enumerate(texts):
        before = b""
        for i, piece in enumerate(_pieces(text.translate(_BLANKS))):
            if at + len(piece) + 1 > BLOCK and owners:
                yield np.frombuffer(b"".join(parts), np.uint8), starts, owners, heads, last
                parts, starts, owners, heads, at = [b" "], [], [], [], 1
            # a piece that goes on in the middle of a word has no word before it
            goes_on = i > 0 and piece.startswith(b" ")
            if not owners:
                last = before if goes_on else b""
            if not goes_on:
                heads.append(at - 1)
            starts.append(at - 1)
            owners.append(owner)
            parts += [piece, b" "]
            at += len(piece) + 1
            before = piece.rstrip(b" ").rpartition(b" ")[2] or before
    if owners:
        yield np.frombuffer(b"".join(parts), np.uint8), starts, owners, heads, last


def _bytes(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def counted(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    found = [b for block, _, _, heads, last in _blocks([text]) for _, b in grams(block, bits, heads, last)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))


@dataclass
class Model:
    """``weights``: logit per bucket; a document's logit is their mean plus ``bias``."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        bits = len(self.weights).bit_length() - 1
        for block, starts, owners, heads, last in _blocks(texts):
            value, weight = np.zeros(len(block)), np.zeros(len(block))
            for places, buckets in grams(block, bits, heads, last):
                value[places] += self.weights[buckets]
                weight[places] += 1
            np.add.at(total, owners, np.add.reduceat(value, starts))
            np.add.at(n, owners, np.add.reduceat(weight, starts))
        logit = np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)
        return 1 / (1 + np.exp(-logit))


def train(
    documents: Sequence[tuple[np.ndarray, np.ndarray, int]],
    bits: int = BITS,
    dimensions: int = DIMENSIONS,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 7,
) -> Model:
    """SGD over (buckets, counts, label): one document a step, the rate falling to zero."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (1 << bits, dimensions)).astype(np.float32) / dimensions
    classes, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    if len({label for _, _, label in documents}) < 2:
        return Model(np.zeros(1 << bits), 0.0)
    step, steps = 0, epochs * len(documents)
    for _ in range(epochs):
        for i in random.permutation(len(documents)):
            buckets, counts, label = documents[i]
            now = rate * (1 - step / steps)
            step += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(dimensions, np.float32)
            output = classes @ hidden + bias
            p = np.exp(output - output.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ classes
            classes -= now * np.outer(error, hidden)
            bias -= now * error
            # a row's step is scaled up with the document's distinct rows: a mean over thousands moves each too little
            vectors[buckets] -= np.outer(now * share * min(len(buckets), 1024) ** 0.5, back)
    return Model((vectors @ (classes[1] - classes[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from ``labels`` (doc_id, quality) outside the held-out rows: the ``sample_rows`` of smallest id hash."""
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(11))
    sample = usable.select(F.col("doc_id").alias("_labelled"), F.col("quality").alias("_quality")).orderBy(F.xxhash64("_labelled", F.lit(11)), "_labelled", "_quality").limit(sample_rows)
    # sample_rows bounds the broadcast, and again what comes of ids that repeat
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled"))
    found = found.orderBy(order, "doc_id", "_quality", F.xxhash64("text")).limit(sample_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = []
        for batch in batches:
            for text, label in zip(_bytes(batch.column("text")), batch.column("_quality").to_pylist(), strict=True):
                buckets, counts = counted(text)
                documents.append((buckets, counts.astype(np.int32), label))
        model = train(documents)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    # the sorted sample is one partition of at most sample_rows, so one task has it in its order
    learnt = found.select("text", "_quality").coalesce(1).mapInArrow(learn, "weights binary, bias double").collect()
    return Model(np.frombuffer(learnt[0]["weights"]), learnt[0]["bias"]) if learnt else train([])


def quality_score(model: Model, text: Column) -> Column:
    """Score of each text; Arrow batches of texts go to Python and numbers come back."""
    shared = Model(model.weights.astype(np.float32), model.bias)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.scores(_bytes(texts)))

    return score(text)


def with_quality(docs: DataFrame, labels: DataFrame, name: str = "score", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` and column ``name``, the probability that quality is 1."""
    return docs.withColumn(name, quality_score(fit(docs, labels, sample_rows), F.col("text")))
