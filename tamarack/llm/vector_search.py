"""Approximate nearest neighbours: inverted lists, scanned by adaptive dimension sampling.

Vectors are normed, turned by a fixed random rotation and dealt to the nearest of
``lists`` centroids, which are fitted on a bounded sample; every vector is
indexed. A query probes its nearest lists. In a list the rotated vectors stand
in column blocks: after each block a hypothesis test compares the distance
estimated from the columns seen with the k-th best so far, and candidates that
fail are read no further. What is left is measured exactly, in double precision,
on the original vectors.

Lists are cut into chunks and their queries into blocks of bounded size, so a
list that holds a third of all rows is many tasks, each of known memory.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without id; vectors of each length have an
index and answers of their own; equal scores go to the smaller id; rows that repeat an id are
rows of their own; a query gets fewer than k answers only if there are fewer
candidates; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import stored

#: Answers per query; most lists; sampled vectors per list for the centroids; share of the lists probed, and least number.
K, MAX_LISTS, SAMPLE_PER_LIST, PROBED_SHARE, LEAST_PROBED = 5, 1024, 32, 0.75, 16
#: Candidates in a chunk and queries in a block, which bound a task; candidates of the first step, which doubles up to the last.
CHUNK_ROWS, BLOCK_ROWS, FIRST, LAST = 8_192, 2_048, 64, 1_024
#: Queries whose distances are one matrix product, which bounds its memory.
TOGETHER = 256
#: One in so many pairs is few.
FEW = 16
#: Columns per block, and the strictness of the test: the probability of losing a true neighbour falls with its square.
COLUMNS, EPSILON = 16, 2.1
#: What rounding to single precision may change in the distance of two unit vectors.
ROUNDING = 1e-5
SEED = 20_230_601


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


def normed(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """Spherical k-means on the bounded sample; an empty centroid keeps its place."""
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centers)
    return centers


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scan(query: np.ndarray, blocks: list[np.ndarray], turned: list[np.ndarray], k: int, skip: int = -1, strictness: float = EPSILON) -> np.ndarray:
    """Rows that may be among the ``k`` nearest to ``query``; ``turned`` is the query in the same column blocks."""
    return scan_all(np.concatenate(turned)[None], blocks, k, np.array([skip]), strictness)[0]


def scan_all(queries: np.ndarray, blocks: list[np.ndarray], k: int, skip: np.ndarray, strictness: float = EPSILON) -> list[np.ndarray]:
    """For each query the rows that may be among its ``k`` nearest, ``skip`` (a row, or -1) left out.

    Queries go together: a step's distances over a block of columns are one matrix product, until few (query, row)
    pairs are left; these are measured again by their differences, block by block. The first step sets each query's k-th best and each step
    betters it; pairs are dropped as soon as their estimate is beyond it by more than the test allows; with an
    infinite ``strictness`` none is before its whole distance is known.
    """
    n, d = len(blocks[0]), sum(b.shape[1] for b in blocks)
    asked = np.split(queries, np.cumsum([b.shape[1] for b in blocks])[:-1], axis=1)
    norms = [[np.einsum("ij,ij->i", x, x) for x in side] for side in (asked, blocks)]
    bound, best = np.full(len(queries), np.inf), np.full((len(queries), k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first, step = 0, FIRST

    def allowed(seen: int) -> np.ndarray:
        if seen == d:  # equal distances stay, and so does what rounding might have moved
            return (np.sqrt(bound) + ROUNDING) ** 2
        if np.isinf(strictness):
            return np.full(len(bound), np.inf)
        return bound * (seen / d) * (1 + strictness / np.sqrt(seen)) ** 2 + ROUNDING**2

    while first < n:
        last = min(n, first + step)
        head, seen = np.zeros((len(queries), last - first), np.float32), 0
        stays = np.ones(head.shape, bool)
        own = np.flatnonzero((skip >= first) & (skip < last))
        stays[own, skip[own] - first] = False
        for part, block, x, y in zip(asked, blocks, *norms, strict=True):
            head += x[:, None] + y[None, first:last] - 2 * (part @ block[first:last].T)
            seen += block.shape[1]
            # products round otherwise than differences do: what is near the limit is left to these
            stays &= head <= ((np.sqrt(allowed(seen)) + ROUNDING) ** 2 + ROUNDING).astype(np.float32)[:, None]
            if np.count_nonzero(stays) * FEW < stays.size:
                break
        who, rows = np.nonzero(stays)
        rows = rows + first
        first, step = last, min(LAST, 2 * step)
        partial = np.zeros(len(rows), np.float64)
        seen = 0
        for block, part in zip(blocks, asked, strict=True):
            difference = block[rows] - part[who]
            partial = partial + np.einsum("ij,ij->i", difference, difference)
            seen += block.shape[1]
            stays = partial <= allowed(seen)[who]
            who, rows, partial = who[stays], rows[stays], partial[stays]
        found.append((who, rows))
        # the k smallest of the pairs that are left, beside those known
        order = np.lexsort((partial, who))
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < k
        more = np.full((len(queries), k), np.inf)
        more[who[top], place[top]] = partial[order][top]
        best = np.partition(np.concatenate([best, more], axis=1), k - 1, axis=1)[:, :k]
        bound = best.max(axis=1)
    who, rows = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(who, kind="stable")
    return np.split(rows[order], np.searchsorted(who[order], np.arange(1, len(queries))))


def in_range(rows: np.ndarray) -> np.ndarray:
    most = np.abs(rows).max(axis=1, initial=0)
    extreme = (most > 1e100) | (most < 1e-100)
    if not extreme.any():
        return rows
    return np.ldexp(rows, np.where(extreme, -np.frexp(most)[1], 0)[:, None])


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; summed row by row, so that equal rows give equal numbers.

    Rows whose squares would leave the range of doubles are divided by a power of two first, which changes no digit.
    """
    rows, query = in_range(rows), in_range(query[None])[0]
    product = (rows * query).sum(axis=1)
    return product / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _scan_cell(queries: pa.Table, rows: pa.Table, k: int, strictness: float) -> pa.Table:
    """The k best of one chunk for each query of one block."""
    names = ["query_at", "query_id", "vec_id", "at", "score"]
    out: list[list] = [[] for _ in names]
    if queries.num_rows and rows.num_rows:
        at, ids = (rows.column(x).to_numpy() for x in ("_at", "_id"))
        order = np.argsort(at)  # a task that runs again scans in the same order
        at, ids, x = at[order], ids[order], _matrix(rows.column("_vec"))[order]
        turn = rotation(x.shape[1]).astype(np.float32)
        cuts = range(COLUMNS, x.shape[1], COLUMNS)
        blocks = [np.ascontiguousarray(b) for b in np.split(normed(x).astype(np.float32) @ turn, list(cuts), axis=1)]
        asked = _matrix(queries.column("_vec"))
        turned = normed(asked).astype(np.float32) @ turn
        asked_at = queries.column("_at").to_numpy()
        own = np.minimum(np.searchsorted(at, asked_at), len(at) - 1)
        own = np.where(at[own] == asked_at, own, -1)
        lefts = [x for i in range(0, len(asked), TOGETHER) for x in scan_all(turned[i : i + TOGETHER], blocks, k, own[i : i + TOGETHER], strictness)]
        for i, (query_at, query_id, left) in enumerate(zip(asked_at.tolist(), queries.column("_id").to_pylist(), lefts, strict=True)):
            if len(left):
                score = exact(asked[i], x[left])
                top = np.lexsort((at[left], ids[left], -score))[:k]
                for column, values in zip(out, ([query_at] * len(top), [query_id] * len(top), ids[left][top], at[left][top], score[top]), strict=True):
                    column.extend(values)
    types = [pa.int64()] * 4 + [pa.float64()]
    return pa.table([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``_id`` and ``_vec`` (doubles) of the rows that take part, before their length is looked at."""
    vec = F.col(vector_column).cast("array<double>")
    sound = ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0)
    return rows.select(F.col(id_column).alias("_id"), vec.alias("_vec")).filter(F.col("_id").isNotNull() & F.col("_vec").isNotNull() & sound)


@dataclass
class Index:
    """``rows``: _id, _vec, _list, _at, stored; ``centers`` and the ``sizes`` of their lists (both of bounded length)."""

    rows: DataFrame
    centers: np.ndarray
    sizes: list[int]


def _nearest(centers: np.ndarray) -> callable:
    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        return pa.array((normed(_matrix(vectors)) @ centers.T).argmax(axis=1).astype(np.int32)) if len(vectors) else pa.array([], pa.int32())

    return nearest


def build_index(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> Index | None:
    """The index of the most frequent vector length."""
    rows = usable(rows, id_column, vector_column)
    top = _lengths(rows).first()
    return None if top is None else _index(rows, *top)


def build_indexes(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> list[Index]:
    """An index for each vector length, the most frequent one first."""
    rows = usable(rows, id_column, vector_column)
    return [_index(rows, d, n) for d, n in _lengths(rows).collect()]


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.size("_vec").alias("_d")).count().orderBy(F.desc("count"), "_d")


def _index(rows: DataFrame, d: int, n: int) -> Index:
    """Fits at most ``MAX_LISTS`` centroids, about the square root of the ``n`` rows of length ``d``, and deals each to the nearest one."""
    rows = rows.filter(F.size("_vec") == d)
    lists = max(1, min(MAX_LISTS, int(n**0.5)))
    sample = rows.orderBy(F.xxhash64("_id", F.lit(SEED)), F.xxhash64("_vec")).limit(lists * SAMPLE_PER_LIST).select("_vec").toArrow()
    centers = k_means(normed(_matrix(sample.column("_vec"))), lists)
    dealt = rows.withColumn("_list", _nearest(centers)("_vec")).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, "vector-lists")
    counts = dict(map(tuple, dealt.groupBy("_list").count().collect()))
    return Index(dealt, centers, [counts.get(i, 0) for i in range(len(centers))])


def _probe(index: Index, k: int, share: float) -> callable:
    """Nearest lists of each query: the probed share, and on until they hold more than k rows."""
    centers, sizes = index.centers, np.array(index.sizes)
    least = max(LEAST_PROBED, int(np.ceil(share * len(sizes))))

    @F.arrow_udf("array<int>")
    def probe(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        order = np.argsort(-(normed(_matrix(vectors)) @ centers.T), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        n = np.maximum(least, (held <= k).sum(axis=1) + 1)
        return pa.array([o[:m][sizes[o[:m]] > 0].astype(np.int32) for o, m in zip(order, n, strict=True)], pa.list_(pa.int32()))

    return probe


def search(index: Index, is_query: Column, k: int = K, share: float = PROBED_SHARE, strictness: float = EPSILON) -> DataFrame:
    """The k nearest rows of each query (a condition on ``_id``): query_id, rank, vec_id, score.

    ``share`` of the lists are probed, 16 at least, and ``strictness`` is the margin of the test that abandons candidates.
    ``share=1, strictness=math.inf`` is the exact search: every row is compared by its whole distance.
    """
    spark = index.rows.sparkSession
    queries = index.rows.filter(is_query)
    probing = stored(queries.select("_at", "_id", "_vec", F.explode(_probe(index, k, share)("_vec")).alias("_list")), "vector-probes")
    asked = dict(map(tuple, probing.groupBy("_list").count().collect()))
    cells = [{"_of": i, "_chunks": -(-size // CHUNK_ROWS), "_blocks": -(-asked[i] // BLOCK_ROWS)} for i, size in enumerate(index.sizes) if asked.get(i) and size]
    # a row for each list, at most MAX_LISTS
    plan = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(cells)), "array<struct<_of:int,_chunks:int,_blocks:int>>"))))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one part by its hash, and in all parts of the other side."""
        mine, theirs = ("_chunk", "_block") if own == "_chunks" else ("_block", "_chunk")
        placed = rows.join(plan, F.col("_list") == F.col("_of")).withColumn(mine, F.pmod(F.xxhash64("_at"), F.col(own)).cast("int"))
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("_list", "_chunk", "_block", "_at", "_id", "_vec")

    keys = ["_list", "_chunk", "_block"]
    left, right = dealt(probing, "_blocks", "_chunks").groupBy(*keys), dealt(index.rows, "_chunks", "_blocks").groupBy(*keys)
    schema = "query_at long, query_id long, vec_id long, at long, score double"
    found = left.cogroup(right).applyInArrow(lambda a, b: _scan_cell(a, b, k, strictness), schema)
    best = Window.partitionBy("query_at").orderBy(F.desc("score"), "vec_id", "at")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
