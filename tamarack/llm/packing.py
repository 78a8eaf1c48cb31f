"""Best-fit packing by minimum bin slack.

Texts become token ids; those longer than a sequence are cut. How often each
length occurs is all that packing needs: at most ``capacity`` numbers. For each
bin the longest length left is set, and a subset-sum search over the available
lengths, with a bit per sum, finds the fullest combination that fits beside it.
It is taken as often as its lengths last, which is what bin after bin would do,
so the plan has a few thousand combinations at most, whatever the input. Pieces
are then numbered within their length, and the numbers are looked up in the
plan.

Defined results: a null or empty text is one piece, the closing id alone;
texts and runs of blanks, letters or
signs of any length are read whole; special-token strings in a text are ordinary text; repeated rows are packed
each for itself; an empty table gives an empty result; of the columns of
``docs`` only id and text are read, so other names do not matter.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm import bpe
from tamarack.session import stored

CAPACITY = 2_048
#: Public byte-level vocabulary by name, as ids equal to those of ``byte_bpe_50k.json``; the id that closes a document.
VOCABULARY, CLOSING = "byte_bpe_50k.tiktoken", 0

#: The same vocabulary for the streaming transducer, and the runs that take it.
STREAMING, LONG_RUN = "byte_bpe_50k.json", 50_000
LONG = re.compile(f"(?<!\\s)\\s{{{LONG_RUN}}}|(?<!\\S)\\S{{{LONG_RUN}}}")

Pattern = tuple[int, list[tuple[int, int]]]


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a rank file; found on each machine by its public name, or by a path."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A function from texts to ids. The tokenizer's splits recurse, so runs of ``LONG_RUN`` or more characters without
    a change from blank to other characters or back go through the streaming transducer, which gives the same ids."""
    plain = encoding(vocabulary).encode_ordinary

    def encode(text: str) -> array:
        if len(text) < LONG_RUN or LONG.search(text) is None:
            return array("I", plain(text))
        streaming = bpe.vocabulary(STREAMING)
        ids = array("I")
        for packed in bpe.encode(streaming, text, specials=False):
            ids.frombytes(np.frombuffer(packed, bpe.PACKED).astype(np.uint32).tobytes())
        return ids

    return encode


def pieces(ids: array, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces; only the first may be shorter than the others."""
    raw = np.frombuffer(ids, np.uint32).astype("<u4").tobytes()
    start, length = 0, len(ids) % capacity or capacity
    while start < len(ids):
        yield start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])
        start, length = start + length, capacity


def fullest(counts: Mapping[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination that has the longest length left: bit s of ``reach`` says that sum s can be made."""
    largest = max(counts)
    slack, reach, taken = capacity - largest, 1, []
    mask = (1 << (slack + 1)) - 1
    for length in sorted((x for x in counts if x <= slack), reverse=True):
        left, share = min(counts[length] - (length == largest), slack // length), 1
        while left > 0:  # in powers of two, so that many of one length are a few steps
            n = min(share, left)
            taken.append((reach, length, n))
            reach |= (reach << (length * n)) & mask
            left, share = left - n, 2 * share
        if reach >> slack:
            break
    rest, combination = reach.bit_length() - 1, {largest: 1}
    for before, length, n in reversed(taken):
        if not before >> rest & 1:
            combination[length] = combination.get(length, 0) + n
            rest -= length * n
    return combination


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """(how often, [(length, how many)]) until no piece is left."""
    left, patterns = {length: n for length, n in counts.items() if n}, []
    while left:
        combination = fullest(left, capacity)
        times = min(left[length] // n for length, n in combination.items())
        patterns.append((times, sorted(combination.items(), reverse=True)))
        for length, n in combination.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
    return patterns


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For runs of numbers within a length: first number, how many in a sequence, its first sequence, its first place."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, combination in patterns:
        offset = 0
        for length, n in combination:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        sequence += times
    rows.sort()
    names = ("length", "first", "many", "sequence", "offset")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str, closing: int, id_column: str, text_column: str) -> DataFrame:
    """A row per piece, with its number within its length and task (``_part``, ``_local``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(closing)
                for number, (start, length, crc) in enumerate(pieces(ids, capacity)):
                    rows.append((doc_id, number, start, length, crc, part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_local"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _local long"
    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(cut, schema)


def packed(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    closing: int = CLOSING,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    rows = stored(token_pieces(docs, capacity, vocabulary, closing, id_column, text_column), "pack-pieces")
    counts = rows.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    # a row for each length, at most ``capacity``
    lengths = dict(map(tuple, rows.groupBy("length").count().collect()))
    run = slots(plan(lengths, capacity))

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "pack-starts")
    numbered = rows.join(starts, ["_part", "length"]).withColumn("_number", F.col("_before") + F.col("_local"))

    bits = 63 - capacity.bit_length()  # for the numbers; 51 at 2048

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        length, number = length.to_numpy(), number.to_numpy()
        # runs are sorted by length and first number, which make one key
        at = np.searchsorted(run["length"] << bits | run["first"], length << bits | number, side="right") - 1
        into = number - run["first"][at]
        sequence = run["sequence"][at] + into // run["many"][at]
        offset = run["offset"][at] + into % run["many"][at] * length
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"])

    found = numbered.withColumn("_place", place("length", "_number"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
