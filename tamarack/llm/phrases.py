"""Phrase collocations by stripes.

A stripe is a prefix with a counter of its next words. The empty prefix of a
language has the stripe of all its words, whose total is the number of words;
stripes of prefixes of one to four words give the phrases of two to five words.
A task counts stripes of the texts it reads and sends them packed, several
thousand stripes in a row; they are merged entry by entry in buckets of (prefix,
block of next words), so that the stripe of a very frequent prefix is divided.
Entries give the extensions and, as prefixes of the next length, their totals;
the largest entry of a stripe, and the largest of those that share a suffix, are
the subsumption maxima.

A phrase can only be frequent if both its prefix and its suffix are. Bits set at
the frequent phrases of one word less (8 MB, whatever the input) tell a task
what it need not count; a bit set by chance costs work, never a result.

Defined results: a null or empty text has no words; a null language counts as
``und``; texts are read whole; repeated rows count each; ties of scores go to
the shorter first part, ties of phrases to the larger count, then the byte order
of the phrase; an empty table gives an empty result; of the columns only
language and text are read, so other names do not matter. Words and phrases are
compared by 64-bit hashes; that no two words of the corpus share one is checked,
and another seed is taken where they do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import WORD_BITS, membership
from tamarack.operators.joins import divisible_join
from tamarack.session import stored

#: Occurrences that a phrase needs; words in the longest phrase; phrases returned for each language.
LEAST, LONGEST, RETURNED = 100, 5, 2_000
#: Words counted in a task before stripes are sent; entries that a bucket has on average at most; bytes hashed at a time.
FLUSH, BUCKET_ENTRIES, BLOCK = 2_000_000, 2_000_000, 1 << 20
#: Texts of a batch that are copied at a time.
ROWS = 256
#: Blocks of next words into which each stripe is divided.
BLOCKS = 64
#: Languages whose texts a task gathers at the same time.
LANGUAGES = 64

#: A-Z become a-z, line breaks and punctuation end a piece, blanks end a word.
_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x100000001B3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K1
    return (x ^ (x >> np.uint64(29))) * _K2


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of a phrase and one word more."""
    return _mixed(left * _K2 + (right ^ (right >> np.uint64(32))))


class _Words:
    """Keys of the words of a block of one language, and the piece each stands in."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = self._powers(BLOCK, _BASE), self._powers(BLOCK, pow(_BASE, -1, 1 << 64))

    @staticmethod
    def _powers(n: int, base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def of(self, block: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, key and piece of each word; the block starts and ends with a line break."""
        b = np.frombuffer(block, np.uint8)
        if len(b) > len(self.up):
            self.up, self.down = self._powers(len(b), _BASE), self._powers(len(b), pow(_BASE, -1, 1 << 64))
        breaks = b == 10
        blank = breaks | (b == 32)
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        total = np.cumsum(self.bytes[b] * self.up[: len(b)])
        keys = _mixed((total[end - 1] - total[start - 1]) * self.down[start] + (end - start).astype(np.uint64))
        own = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        return start, end, _mixed(keys + np.uint64(own)), np.cumsum(breaks)[start]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Folded texts of one language, some at a time; a long text is cut at its breaks only."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for part in (batch.slice(low, ROWS) for batch in batches for low in range(0, batch.num_rows, ROWS)):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist(), strict=True):
            if not text:
                continue
            text = text.translate(_FOLDED)
            if len(text) > BLOCK:
                yield from _cut(lang, text)
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            if sizes[lang] >= BLOCK:
                yield lang, b"\n" + b"\n".join(held.pop(lang)) + b"\n"
                del sizes[lang]
            elif len(held) > LANGUAGES:  # so many languages hold no more than a few blocks together
                yield from ((known, b"\n" + b"\n".join(texts) + b"\n") for known, texts in held.items())
                held, sizes = {}, {}
    for lang, texts in held.items():
        yield lang, b"\n" + b"\n".join(texts) + b"\n"


def _cut(lang: str, text: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at < len(text):
        end = text.rfind(b"\n", at, at + BLOCK)
        if end <= at:  # one piece fills the block
            end = text.find(b"\n", at + BLOCK)
        end = len(text) if end < 0 or len(text) - at <= BLOCK else end
        yield lang, b"\n" + text[at:end] + b"\n"
        at = end + 1


def _word_counts(seed: int):
    """Rows (lang, key, word, n) of a task's texts, summed over some blocks at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, seen = _Words(seed), [], 0
        for lang, block in _blocks(batches):
            start, end, keys, _ = hasher.of(block, lang)
            if not len(keys):
                continue
            values, first, counts = np.unique(keys, return_index=True, return_counts=True)
            held.append((lang, values, _slices(block, start[first], end[first]), counts))
            seen += len(keys)
            if seen >= FLUSH:
                yield _word_rows(held)
                held, seen = [], 0
        yield _word_rows(held)

    return count


def _slices(block: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The given parts of a block, end to end in one buffer."""
    sizes = end - start
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1]) + np.repeat(start - (ends - sizes), sizes)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(block, np.uint8)[places])])


def _word_rows(held: list[tuple[str, np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """Words of several blocks, summed. Different words of one key stay apart: they go out and are found there."""
    names = ["lang", "key", "word", "n"]
    if not held:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64())], names)
    langs = sorted({lang for lang, *_ in held})
    code = np.repeat([langs.index(lang) for lang, *_ in held], [len(keys) for _, keys, *_ in held]).astype(np.int32)
    keys, counts = np.concatenate([x[1] for x in held]), np.concatenate([x[3] for x in held])
    order = np.lexsort((keys, code))
    code, keys, words = code[order], keys[order], pa.concat_arrays([x[2] for x in held]).take(pa.array(order))
    new = np.ones(len(order), bool)
    new[1:] = (code[1:] != code[:-1]) | (keys[1:] != keys[:-1]) | pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    columns = [
        pa.array(langs, pa.string()).take(pa.array(code[at])),
        pa.array(keys[at].view(np.int64)),
        words.take(pa.array(at)).cast(pa.string()),
        pa.array(np.add.reduceat(counts[order], at).astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def _word_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, key, word and n of every word, stored, and the seed under which no two words share a key."""
    for seed in range(8):
        rows = docs.mapInArrow(_word_counts(seed), "lang string, key long, word string, n long")
        word = F.struct("lang", "word")
        words = rows.groupBy("key").agg(F.min(word).alias("of"), F.max(word).alias("last"), F.sum("n").alias("n"))
        words = stored(words.select("of.lang", "key", "of.word", "n", (F.col("of") != F.col("last")).alias("shared")), "phrase-words")
        if words.filter("shared").isEmpty():
            return words.drop("shared"), seed
    raise RuntimeError("words share a key under every seed")


# --- stripes ----------------------------------------------------------------------------

STRIPES = "bucket int, prefixes binary, takes binary, nexts binary, counts binary"
ENTRIES = "prefix long, next long, n long"


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(values)])


def _merged(prefixes: np.ndarray, nexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries summed: of equal (prefix, next) one is left."""
    order = np.lexsort((nexts, prefixes))
    prefixes, nexts = prefixes[order], nexts[order]
    first = np.flatnonzero(np.r_[True, (prefixes[1:] != prefixes[:-1]) | (nexts[1:] != nexts[:-1])]) if len(order) else order
    return prefixes[first], nexts[first], np.add.reduceat(counts[order], first) if len(order) else counts


def _packed(prefixes: np.ndarray, nexts: np.ndarray, buckets: int) -> pa.RecordBatch:
    prefixes, nexts, counts = _merged(prefixes, nexts, np.ones(len(prefixes), np.uint32))
    block = (nexts >> np.uint64(40)) % np.uint64(BLOCKS)
    bucket = (_mixed(prefixes + block * _K1) >> np.uint64(20)).astype(np.int64) % buckets
    order = np.lexsort((prefixes, bucket))
    rows = []
    for low, many in zip(*_runs(bucket[order]), strict=True):
        own = order[low : low + many]
        at, takes = _runs(prefixes[own])
        rows.append((int(bucket[own[0]]), prefixes[own][at].tobytes(), takes.astype(np.uint32).tobytes(), nexts[own].tobytes(), counts[own].astype(np.uint32).tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(columns)], [f.split()[0] for f in STRIPES.split(", ")]
    )


def _stripes(words: int, seed: int, bits, buckets: int):
    """Stripes of prefixes of ``words - 1`` words, where the bits allow the prefix and the suffix."""

    def possible(keys: np.ndarray) -> np.ndarray:
        own = bits.value[(keys >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
        return (own >> (keys & np.uint64(63))) & np.uint64(1) == 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, many = _Words(seed), [], 0
        for lang, block in _blocks(batches):
            _, _, keys, piece = hasher.of(block, lang)
            phrases = keys
            for size in range(2, words):
                phrases = _joined(phrases[:-1], keys[size - 1 :]) if len(phrases) > 1 else phrases[:0]
            if len(phrases) < 2:
                continue
            good = possible(phrases)
            at = np.flatnonzero(good[:-1] & good[1:] & (piece[: len(phrases) - 1] == piece[words - 1 :]))
            held.append((phrases[at], keys[at + words - 1]))
            many += len(at)
            if many >= FLUSH:
                yield _packed(*map(np.concatenate, zip(*held, strict=True)), buckets)
                held, many = [], 0
        if many:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)), buckets)

    return pack


def _merge_stripes(table: pa.Table, least: int) -> pa.Table:
    """One bucket: stripes added up entry by entry; frequent entries stay."""

    def all_of(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    prefixes = np.repeat(all_of("prefixes", np.uint64), all_of("takes", np.uint32))
    prefixes, nexts, counts = _merged(prefixes, all_of("nexts", np.uint64), all_of("counts", np.uint32).astype(np.int64))
    kept = counts >= least
    columns = [prefixes[kept].view(np.int64), nexts[kept].view(np.int64), counts[kept]]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["prefix", "next", "n"])


def _bits(spark, phrases: DataFrame):
    """The bits of the phrases' keys, for all tasks: 2^20 words, whatever the input."""
    bits = np.zeros(1 << WORD_BITS, np.uint64)
    found = membership(phrases, F.col("key")).toArrow()
    bits[found["_word"].to_numpy()] = found["_bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _keyed(phrases: DataFrame) -> DataFrame:
    """Adds ``key``, ``suffix`` (the key without the first word) and ``cuts`` (k, left and right key) to phrases with ``words``."""
    cut = "array<struct<k:int,left:long,right:long>>"

    @F.arrow_udf(f"struct<key:long,suffix:long,cuts:{cut}>")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for words in rows.to_pylist():
            keys = np.array(words, np.int64).view(np.uint64).reshape(-1, 1)

            def key(low: int, high: int, keys: np.ndarray = keys) -> int:
                return int(reduce(_joined, keys[low:high]).view(np.int64)[0])

            m = len(words)
            cuts = [{"k": k, "left": key(0, k), "right": key(k, m)} for k in range(1, m)]
            out.append({"key": key(0, m), "suffix": key(1, m), "cuts": cuts})
        cuts = pa.list_(pa.struct([("k", pa.int32()), ("left", pa.int64()), ("right", pa.int64())]))
        return pa.array(out, pa.struct([("key", pa.int64()), ("suffix", pa.int64()), ("cuts", cuts)]))

    return phrases.withColumn("_of", of("words")).select("*", "_of.*").drop("_of")


def frequent_phrases(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Every word with its count, and every phrase of 2 to ``LONGEST`` words that occurs often enough."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    words, seed = _word_table(texts)
    total = words.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ENTRIES))
    known = words.filter(F.col("n") >= least)
    # phrases of one word less, which the next stripes have as prefixes
    before = known.select("lang", "key", "word", "n").withColumn("phrase", F.col("word")).withColumn("words", F.array("key"))
    found = []
    for size in range(2, LONGEST + 1):
        bits = _bits(spark, before)
        packed = texts.mapInArrow(_stripes(size, seed, bits, buckets), STRIPES)
        entries = stored(packed.groupBy("bucket").applyInArrow(lambda t: _merge_stripes(t, least), ENTRIES), "phrase-entries")
        prefixes = before.select("lang", F.col("key").alias("prefix"), F.col("phrase").alias("start"), F.col("words").alias("first"))
        phrases = divisible_join(entries, prefixes, ["prefix"])
        last = known.select(F.col("key").alias("next"), "word")
        phrases = divisible_join(phrases, last, ["next"]).select(
            "lang", F.concat_ws(" ", "start", "word").alias("phrase"), F.concat("first", F.array("next")).alias("words"), "prefix", "n"
        )
        before = stored(_keyed(phrases), "phrase-phrases")
        bits.unpersist()
        found.append(before)
    return words, reduce(DataFrame.unionByName, found)


def collocations(
    docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = LEAST, returned: int = RETURNED
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language, and ``k``, where they are cut."""
    words, phrases = frequent_phrases(docs, lang_column, text_column, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("all"))
    counts = words.filter(F.col("n") >= least).select("key", "n").union(phrases.select("key", "n"))
    longer = phrases.filter(F.size("words") > 2)  # maxima of stripes, and of what shares a suffix
    most = longer.select(F.col("prefix").alias("key"), "n").union(longer.select(F.col("suffix").alias("key"), "n"))
    most = most.groupBy("key").agg(F.max("n").alias("most"))
    whole = divisible_join(phrases, most, ["key"], "left").filter("most IS NULL OR 100 * most < 100 * n")

    cuts = whole.select("lang", "phrase", "key", F.col("n").alias("a"), F.inline("cuts"))
    cuts = divisible_join(cuts, counts.select(F.col("key").alias("left"), F.col("n").alias("l")), ["left"])
    cuts = divisible_join(cuts, counts.select(F.col("key").alias("right"), F.col("n").alias("r")), ["right"])
    cuts = divisible_join(cuts, totals, ["lang"])

    def wide(name: str):
        return F.col(name).cast("decimal(18,0)")

    top = (F.lit(1000).cast("decimal(4,0)") * wide("a")) * F.col("all").cast("decimal(15,0)")
    cuts = cuts.withColumn("_top", top).withColumn("_under", wide("l") * wide("r"))
    lowest = F.min(F.struct(F.expr("_top div _under").alias("score"), "k", "l", "r")).alias("low")
    scored = cuts.groupBy("lang", "phrase", "a", F.col("all").alias("n")).agg(lowest)
    best = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= returned)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score", "low.k")
