"""Jaccard self-join of word n-gram sets by prefixes of token combinations.

A document's tokens are its distinct hashed shingles. Documents with equal sets
are one class and go on as one. Tokens are ordered by how many classes have
them: those of one class alone first, then the rare ones, the frequent ones
last. A class then needs to be known by its first tokens only: two sets that are
similar enough share a token among the first ``n - ceil(0.8 n) + 1`` of each. A
rare token there is a signature of its own. Where this prefix reaches frequent
tokens, it is extended by one token for each of ``m`` sub-classes of the frequent
tokens, so that similar sets without a rare token in common share at least
``m + 1`` frequent ones, two of them in one sub-class: pairs within a sub-class
are the signatures of frequent tokens. ``m`` grows with the set, so that there
are fewer signatures than tokens.

Candidates are verified exactly. Each class is first compared with one other
class of its signatures, round after round, until no new link turns up: groups
of near copies become components by stars, not by pairs. Then all candidates
that still lie in different components and may be similar by their sizes and their overlaps with a
common third set are compared. No link between classes of
different components is lost, which is all that components need.

Shuffled are tokens packed by bucket (8 bytes and a little for each), then only
those that several classes have. A token of many classes in one task is counted
there and sent on without going through its bucket, so common tokens are split.

Defined results: a null or empty text, or white space alone, has an empty set
and is linked with nothing; with fewer words than a shingle the whole sequence
is the one token; texts are read whole; repeated rows have equal sets and are
linked; a null id counts only if no row of the component has an id; an empty
table gives an empty result; of the columns of ``docs`` only id and text are
read. Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import maybe_in, membership
from tamarack.llm.components import components
from tamarack.session import stored

#: Words in a shingle; the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Tokens of more classes than this are frequent.
FREQUENT = 32
#: Centers that a class is compared with in a round.
PARTNERS = 3
#: Bands of sizes grow by more than similar sizes differ; overlaps with a pivot differ by less than this share of the smaller
#: size, which is (100 - PERCENT) / (100 + PERCENT) of both sizes. Both have a hundredth to spare for rounding.
STEP = 1.01 * 100 / PERCENT
REACH = 1.01 * (100 - PERCENT) / (100 + PERCENT) * (1 + 100 / PERCENT)
#: Tokens gathered in a task before they are sent; tokens that a bucket has on average at most; bytes hashed at a time.
FLUSH, BUCKET_TOKENS, BLOCK = 2_000_000, 2_000_000, 1 << 18

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x100000001B3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BLOCK + 2, _BASE), _powers(BLOCK + 2, pow(_BASE, -1, 1 << 64))
#: A number for each byte, so that sums of bytes do not cancel.
_BYTES = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K1
    return (x ^ (x >> np.uint64(29))) * _K2


def _word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a block that starts and ends with a space."""
    b = np.frombuffer(block, np.uint8)
    space = b == 32
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = (_UP, _DOWN) if len(b) <= len(_UP) else (_powers(len(b), _BASE), _powers(len(b), pow(_BASE, -1, 1 << 64)))
    total = np.cumsum(_BYTES[b] * up[: len(b)])
    return start, mixed((total[end - 1] - total[start - 1]) * down[start] + (end - start).astype(np.uint64))


def _long_hashes(text: bytes) -> np.ndarray:
    """Word hashes of one text of any length, block by block, cut at spaces."""
    found, at = [], 0
    while at < len(text):
        cut = text.rfind(b" ", at, at + BLOCK - 2) if len(text) - at > BLOCK - 2 else len(text)
        if cut <= at:  # one word fills the block
            cut = text.find(b" ", at + BLOCK - 2)
            cut = len(text) if cut < 0 else cut
        found.append(_word_hashes(b" " + text[at:cut] + b" ")[1])
        at = cut + 1 if cut < len(text) else cut
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _folded(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    count = len(words) - n + 1
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(32))) * _K1 + words[i : i + count]
    return mixed(out)


def _tokens(words: np.ndarray, shingles: np.ndarray | None = None) -> np.ndarray:
    if len(words) == 0:
        return words
    if len(words) < WORDS:
        return _folded(words, len(words))
    return np.unique(_folded(words, WORDS) if shingles is None else shingles)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text, in order."""
    waiting: list[bytes] = []
    size = 1

    def together() -> Iterator[np.ndarray]:
        start, words = _word_hashes(b" " + b" ".join(waiting) + b" ")
        ends = np.cumsum([len(t) + 1 for t in waiting])
        cuts = [0, *np.searchsorted(start, ends).tolist()]
        runs = _folded(words, WORDS) if len(words) >= WORDS else words[:0]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield _tokens(words[low:high], runs[low : high - WORDS + 1] if high - low >= WORDS else None)

    for text in texts:
        text = (text or b"").translate(_LOWER)
        if waiting and size + len(text) + 1 > BLOCK - 2:
            yield from together()
            waiting, size = [], 1
        if len(text) > BLOCK - 4:
            yield _tokens(_long_hashes(text))
        else:
            waiting.append(text)
            size += len(text) + 1
    if waiting:
        yield from together()


def set_hash(tokens: np.ndarray) -> int:
    """64-bit signature of a set."""
    total = mixed(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))
    return int(mixed(total)[0]) if len(tokens) else 0


def _bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# --- packed tokens ----------------------------------------------------------------------

#: bucket; kind (0 tokens of classes, 1 counts of common tokens, 2 common tokens of classes); then packed arrays:
#: class keys, set sizes, tokens taken of each class (or counts), tokens.
PACKED = "bucket int, kind int, target int, keys binary, sizes binary, takes binary, tokens binary"
#: target (a bucket of classes); class keys, set sizes, tokens taken of each, tokens, classes that have each (at most FREQUENT + 1).
RETURNED = "target int, keys binary, sizes binary, takes binary, tokens binary, counts binary"


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * _K2) >> np.uint64(33)).astype(np.int64) % buckets


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and how long it is."""
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(sorted_values)])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _by_class(targets: np.ndarray, keys: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> Iterator[tuple]:
    """(target, keys, sizes, takes, order) for each target; all arrays have an entry per token."""
    order = np.lexsort((keys, targets))
    target_start, target_length = _runs(targets[order])
    for first, length in zip(target_start, target_length, strict=True):
        own = order[first : first + length]
        start, takes = _runs(keys[own])
        at = own[start]
        yield int(targets[own[0]]), keys[at], sizes[at], takes.astype(np.uint32), own


def _flush(keys: list[int], sets: list[np.ndarray], buckets: int) -> pa.Table:
    key, size = np.array(keys, np.uint64), np.array([len(s) for s in sets], np.uint32)
    tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    values, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    common = counts > FREQUENT
    rows = []
    if common.any():
        hot = np.flatnonzero(common[inverse])
        for target, k, n, takes, own in _by_class(_bucket(key[of[hot]], buckets), key[of[hot]], size[of[hot]], tokens[hot]):
            rows.append((target, 2, target, k.tobytes(), n.tobytes(), takes.tobytes(), tokens[hot][own].tobytes()))
        bucket = _bucket(values[common], buckets)
        for b in np.unique(bucket):
            chosen = bucket == b
            rows.append((int(b), 1, 0, b"", b"", counts[common][chosen].astype(np.uint32).tobytes(), values[common][chosen].tobytes()))
        cold = np.flatnonzero(~common[inverse])
        tokens, of = tokens[cold], of[cold]
    bucket = _bucket(tokens, buckets)
    order = np.argsort(bucket, kind="stable")
    start, length = _runs(bucket[order])
    for first, n in zip(start, length, strict=True):
        own = order[first : first + n]
        at, takes = _runs(of[own])
        which = of[own[at]]
        rows.append((int(bucket[own[0]]), 0, 0, key[which].tobytes(), size[which].tobytes(), takes.astype(np.uint32).tobytes(), tokens[own].tobytes()))
    return _table(rows, PACKED)


def _packed(buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, held, seen = [], [], 0, set()
        for batch in batches:
            for tokens in shingle_sets(_bytes(batch.column(0))):
                key = set_hash(tokens)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(tokens)
                    held += len(tokens)
                    if held >= FLUSH:
                        yield from _flush(keys, sets, buckets).to_batches()
                        keys, sets, held, seen = [], [], 0, set()
        if keys:
            yield from _flush(keys, sets, buckets).to_batches()

    return pack


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _count_classes(table: pa.Table, buckets: int) -> pa.Table:
    """One bucket of tokens: those of several classes go back to the classes, with their count."""
    kind = table.column("kind").to_numpy()
    sent, counted, direct = (table.filter(pa.array(kind == k)) for k in (0, 1, 2))
    takes = _joined(sent, "takes", np.uint32)
    keys, sizes = (np.repeat(_joined(sent, c, t), takes) for c, t in (("keys", np.uint64), ("sizes", np.uint32)))
    tokens = _joined(sent, "tokens", np.uint64)
    order = np.lexsort((keys, tokens))
    keys, sizes, tokens = keys[order], sizes[order], tokens[order]
    if len(tokens):  # a class that came twice counts once
        first = np.r_[True, (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])]
        keys, sizes, tokens = keys[first], sizes[first], tokens[first]
    start, count = _runs(tokens)
    common, times = _joined(counted, "tokens", np.uint64), _joined(counted, "takes", np.uint32)
    if len(common) and len(start):
        at = np.searchsorted(tokens[start], common)
        held = at < len(start)
        held[held] = tokens[start][at[held]] == common[held]
        np.add.at(count, at[held], times[held])
    count = np.repeat(np.minimum(count, FREQUENT + 1), np.diff(np.r_[start, len(tokens)])).astype(np.uint8)
    shared = count > 1
    keys, sizes, tokens, count = keys[shared], sizes[shared], tokens[shared], count[shared]
    rows = [
        (target, k.tobytes(), n.tobytes(), take.tobytes(), tokens[own].tobytes(), count[own].tobytes())
        for target, k, n, take, own in _by_class(_bucket(keys, buckets), keys, sizes, tokens)
    ]
    for row in direct.select(["target", "keys", "sizes", "takes", "tokens"]).to_pylist():
        rows.append((*row.values(), bytes([FREQUENT + 1]) * (len(row["tokens"]) // 8)))
    return _table(rows, RETURNED)


# --- signatures -------------------------------------------------------------------------


def least_overlap(n: int) -> int:
    """Tokens that any similar set shares at least with a set of n."""
    return -(-PERCENT * n // 100)


def sub_classes(level: int) -> int:
    """Sub-classes of the frequent tokens for sets of 2^level up to 2^(level + 1) tokens."""
    return max(1, (1 << level) // 10)


def signatures(n: int, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signatures of a set of n tokens, of which ``tokens`` (with their counts) are in several classes; none if it has no partner."""
    alone, prefix = n - len(tokens), n - least_overlap(n) + 1
    rare = counts <= FREQUENT
    singles = tokens[rare][np.lexsort((tokens[rare], counts[rare]))][: max(0, prefix - alone)]
    rest = prefix - alone - int(rare.sum())
    if rest <= 0:
        return singles
    frequent, found = np.sort(tokens[~rare]), [singles]
    for level in {least_overlap(n).bit_length() - 1, n.bit_length() - 1, (n * 100 // PERCENT).bit_length() - 1}:
        m = sub_classes(level)
        first = frequent[: rest + m]
        own = _bucket(first, m)
        order = np.lexsort((first, own))
        first, own = first[order], own[order]
        for step in range(1, int(_runs(own)[1].max(initial=0))):
            pair = own[step:] == own[:-step]
            found.append(mixed(mixed(first[:-step][pair]) + first[step:][pair] + np.uint64(level)))
    return np.unique(np.concatenate(found))


SETS = "key long, n int, shared int, tokens array<long>, signatures array<long>"


def _assemble(table: pa.Table) -> pa.Table:
    """One bucket of classes: shared tokens and signatures of each class that has any."""
    takes = _joined(table, "takes", np.uint32)
    keys, sizes = (np.repeat(_joined(table, c, t), takes) for c, t in (("keys", np.uint64), ("sizes", np.uint32)))
    tokens, counts = _joined(table, "tokens", np.uint64), _joined(table, "counts", np.uint8)
    order = np.lexsort((tokens, keys))
    keys, sizes, tokens, counts = keys[order], sizes[order], tokens[order], counts[order]
    if len(tokens):
        first = np.r_[True, (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])]
        keys, sizes, tokens, counts = keys[first], sizes[first], tokens[first], counts[first]
    start, length = _runs(keys)
    kept = [[], [], [], [], []]
    for low, size in zip(start, length, strict=True):
        own = tokens[low : low + size]
        found = signatures(int(sizes[low]), own, counts[low : low + size])
        if len(found):
            for column, value in zip(kept, (int(keys[low : low + 1].view(np.int64)[0]), int(sizes[low]), len(own), own.view(np.int64), found.view(np.int64)), strict=True):
                column.append(value)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(kept, kinds, strict=True)], names=["key", "n", "shared", "tokens", "signatures"])


# --- candidates, links, components ----------------------------------------------------------


def _similar(overlap: str) -> str:
    return f"(100 + {PERCENT}) * CAST({overlap} AS BIGINT) >= {PERCENT} * (CAST(x_n AS BIGINT) + y_n)"


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) with x_n, y_n and their overlap; tokens that one class alone has cannot be shared."""
    x = sets.select(F.col("key").alias("x"), F.col("n").alias("x_n"), F.col("tokens").alias("x_tokens"))
    y = sets.select(F.col("key").alias("y"), F.col("n").alias("y_n"), F.col("tokens").alias("y_tokens"))
    both = pairs.select("x", "y").join(x, "x").join(y, "y")
    return both.select("x", "y", "x_n", "y_n", F.size(F.array_intersect("x_tokens", "y_tokens")).alias("overlap"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar, as links."""
    linked = _overlaps(pairs, sets).filter(F.expr(_similar("overlap")))
    return stored(linked.select(F.col("x").alias("u"), F.col("y").alias("v")), "shingle-links")


def class_links(sets: DataFrame) -> DataFrame | None:
    """node, root of all classes that are linked with a smaller key, or None if nothing is linked."""
    members = sets.select("key", "n", "shared", F.explode("signatures").alias("signature"))
    links, roots, turn = None, None, 0
    own = (F.col("n") - F.col("shared")).cast("long")
    while True:
        now = members.withColumn("part", F.col("key"))
        if roots is not None:
            now = members.join(roots, F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("root", "key")).drop("node", "root")
        # first the class with the fewest tokens of its own, the most like all others; then any
        first = own if turn == 0 else F.xxhash64("key", F.lit(turn))
        center = F.min(F.struct(first.alias("first"), "key", "n", "shared", "part")).alias("center")
        pivot = F.min(F.struct(own.alias("own"), "key"))["key"].alias("pivot")
        spread = now.groupBy("signature").agg(F.min("part").alias("low"), F.max("part").alias("high"), center, pivot)
        # a group within one component stays so and is not looked at again
        now = stored(now.join(stored(spread.filter("low != high").drop("low", "high"), "shingle-open"), "signature"), "shingle-members")
        meet = now.filter("part != center.part").select(
            F.col("key").alias("x"), F.col("n").alias("x_n"), "shared", *[F.col(f"center.{a}").alias(b) for a, b in (("key", "y"), ("n", "y_n"), ("shared", "y_shared"))]
        )
        # of the centers of its groups a class is compared with those that it shares most groups with
        often = F.slice(F.sort_array(F.collect_list(F.struct("count", "y")), asc=False), 1, PARTNERS)
        pairs = _possible(meet).select("x", "y").repartition("x").groupBy("x", "y").count().groupBy("x").agg(often.alias("often"))
        found = _verified(pairs.select("x", F.explode("often.y").alias("y")), sets)
        if found.isEmpty():
            break
        roots = components(found if links is None else links.union(found))
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        members = now.select("key", "n", "shared", "signature")
        turn += 1

    found = _verified(_rest(now, sets), sets)
    if found.isEmpty():
        return roots
    return components(found if links is None else links.union(found))


def _rest(now: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs of different components that share a signature and may be similar.

    The exact overlap of each class with one of its group, the pivot, bounds the
    overlap of any two: what they share is in the pivot, no more than either has
    there, or outside of it. Near copies share many groups, mostly with one
    pivot; they meet once for it. Of the classes of a pivot only those meet
    whose sizes and whose overlaps with the pivot are near enough (``_bands``).
    """
    met = now.filter("pivot != key").select(F.col("key").alias("x"), F.col("pivot").alias("y")).distinct()
    common = _overlaps(met, sets).select(F.col("x").alias("key"), F.col("y").alias("pivot"), "overlap")
    here = now.select("key", "n", "shared", "part", "pivot").distinct().join(stored(common, "shingle-overlaps"), ["key", "pivot"], "left")
    here = stored(here.select("pivot", "key", "n", "shared", "part", F.coalesce("overlap", "shared").alias("inside")), "shingle-rest")
    smaller, larger = _bands(here)
    other = larger.select("pivot", "band", "cell", *[F.col(a).alias(b) for a, b in (("key", "y"), ("n", "y_n"), ("shared", "y_shared"), ("part", "y_part"), ("inside", "y_inside"))])
    rest = smaller.withColumnsRenamed({"key": "x", "n": "x_n"}).join(other, ["pivot", "band", "cell"])
    rest = rest.filter("part != y_part AND (x_n < y_n OR x_n = y_n AND x < y)")
    bound = "least(inside, y_inside) + least(shared - inside, y_shared - y_inside)"
    return _possible(rest).filter(F.expr(_similar(bound))).select("x", "y").distinct()


def _bands(here: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as the smaller and as the larger one of a pair, with ``band`` and ``cell``; a pair that the bounds allow agrees in both once.

    Sizes of similar sets differ by a factor of 100 / PERCENT at most, so the larger one lies in the smaller one's band of sizes
    or in the next. Overlaps with the pivot that differ by d lower the bound to (x_n + y_n - d) / 2, so d is at most
    ``REACH`` of the smaller size, and cells of that width are equal or neighbours.
    """
    band, cell = f"CAST(floor(ln(n) / ln({STEP})) AS INT)", f"CAST(floor(inside / ({REACH} * pow({STEP}, band + 1))) AS INT)"
    smaller = here.withColumn("band", F.expr(band)).withColumn("cell", F.explode(F.expr(f"transform(array(-1, 0, 1), i -> i + {cell})")))
    larger = here.withColumn("band", F.explode(F.expr(f"transform(array(0, 1), i -> {band} - i)"))).withColumn("cell", F.expr(cell))
    return smaller, larger


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs whose sizes, and whose numbers of tokens that others have as well, allow the similarity."""
    sizes = f"100 * least(x_n, y_n) >= {PERCENT} * greatest(x_n, y_n)"
    return pairs.filter(F.expr(sizes)).filter(F.expr(_similar("least(shared, y_shared)")))


def document_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``_id``, ``_row`` (a hash of id and text), n and key of every row's set, stored."""

    @F.arrow_udf("struct<n:long,key:long>")
    def of(texts: pa.Array) -> pa.Array:
        found = [(len(s), _signed(set_hash(s))) for s in shingle_sets(_bytes(texts))]
        n, key = (list(c) for c in zip(*found, strict=True)) if found else ([], [])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(key, pa.int64())], ["n", "key"])

    rows = docs.select(F.col(id_column).alias("_id"), F.xxhash64(id_column, text_column).alias("_row"), of(text_column).alias("_set"))
    return stored(rows.select("_id", "_row", "_set.n", "_set.key"), "shingle-documents")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row ``_id``, ``_row``, ``n`` (size of its set), ``_root`` (of its component) and ``component`` (its smallest id)."""
    spark = docs.sparkSession
    rows = document_sets(docs, id_column, text_column)
    classes = stored(rows.filter("n > 0").groupBy("key").agg(F.min("_id").alias("_id"), F.max("n").alias("n")), "shingle-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TOKENS))

    # one row for each class, and some more by chance, which changes nothing
    first = maybe_in(docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")), F.xxhash64("_id"), membership(classes, F.xxhash64("_id")), "_first")
    packed = first.filter("_first").select("_text").mapInArrow(_packed(buckets), PACKED)
    returned = packed.groupBy("bucket").applyInArrow(lambda t: _count_classes(t, buckets), RETURNED)
    sets = stored(returned.groupBy("target").applyInArrow(_assemble, SETS), "shingle-sets")

    roots = class_links(sets)
    named = classes.select("key", "_id", F.col("key").alias("root"))
    if roots is not None:
        named = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "_id", F.coalesce("root", "key").alias("root"))
    named = stored(named, "shingle-roots")
    smallest = stored(named.groupBy("root").agg(F.min("_id").alias("component")), "shingle-components")
    # stored, so that both sides are plain shuffles and a class with a third of all rows is split
    labels = stored(named.join(smallest, "root").select(F.col("key").alias("_key"), F.col("root").alias("_root"), "component"), "shingle-labels")
    found = rows.join(labels, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    return found.select("_id", "_row", "n", "_root", component.alias("component"))


def one_per_component(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of smallest id, and every row without words.

    Rows that agree in id and text count as one.
    """
    # stored, since the components are read three times
    rows = stored(near_duplicates(docs, id_column, text_column), "shingle-rows")
    best = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))
    linked = rows.filter("n > 0").groupBy("_root").agg(best.alias("best")).select(F.col("best._row").alias("_row"))
    kept = stored(linked.union(rows.filter("n = 0").select("_row")).distinct(), "shingle-kept")
    repeated = rows.groupBy("_row").count().filter("count > 1").join(kept, "_row", "left_semi")
    hashed = docs.select(F.struct("*").alias("_doc"), F.xxhash64(id_column, text_column).alias("_row"))
    found = hashed.join(kept, "_row", "left_semi")
    return (found if repeated.isEmpty() else found.dropDuplicates(["_row"])).select("_doc.*")
