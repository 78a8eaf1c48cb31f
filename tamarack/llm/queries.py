"""The dealt operators as queries over one folder of tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.bpe import with_round_trip
from tamarack.llm.common import table, without_spaces
from tamarack.llm.exact_dedup import exact_groups
from tamarack.llm.license_scan import license_scan
from tamarack.llm.mixing import mix
from tamarack.llm.packing import packed
from tamarack.llm.phrases import collocations
from tamarack.llm.quality import THRESHOLD, held_out, with_quality
from tamarack.llm.sharding import sharded
from tamarack.llm.shingle_join import near_duplicates
from tamarack.llm.token_counts import with_token_counts
from tamarack.llm.url_filter import url_verdicts
from tamarack.llm.vector_search import build_indexes, search
from tamarack.llm.whitening import whitened

Query = Callable[[SparkSession, str], DataFrame]

c = F.col


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = mix(table(spark, folder, "documents"), carry=["doc_id"]).rows
    taken = (c("size") * c("copies")).cast("long").alias("taken")
    return rows.select("_row.doc_id", "size", "source_size", "target", taken)


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.sha2(without_spaces(F.coalesce("text", F.lit(""))), 256)
    docs = table(spark, folder, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    rows = exact_groups(docs, carry=["doc_id", "text_sha256"])
    return rows.select(
        "_row.doc_id", c("_keep_id").alias("keep_id"), c("_size").alias("group_size"), c("_kept").alias("kept"), "_row.text_sha256"
    )


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = url_verdicts(table(spark, folder, "pages"), carry=["page_id"])
    return rows.select(
        "_row.page_id", *[c(f"_{x}").alias(x) for x in ("host", "path", "rule", "verdict")], c("_score").alias("block_score")
    )


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    scored = with_quality(docs, labels)
    predicted = (c("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(held_out(c("doc_id")), F.lit(False)).alias("held_out"), "score", predicted)


def op6_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    indexes = build_indexes(table(spark, folder, "embeddings"))
    if not indexes:
        return spark.range(0).selectExpr("id AS query_id", "0 AS rank", "id AS vec_id", "0D AS score")
    return reduce(DataFrame.unionByName, [search(index, c("_id") % 50 == 0) for index in indexes])


def op7_exact_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharded(table(spark, folder, "documents"), carry=["doc_id"])
    return rows.select(
        "_row.doc_id",
        c("_size").alias("size"),
        c("_crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        c("_shard").alias("shard"),
        c("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = license_scan(table(spark, folder, "documents"), carry=["doc_id"])
    starts = F.transform("_base", lambda b: b["start"])
    base, found = F.transform("_base", lambda b: b["label"]), F.transform("_found", lambda d: d["label"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    doubt = F.aggregate("_found", F.lit(1.0), lambda acc, d: acc * (1.0 - d["confidence"]))
    return rows.select(
        "_row.doc_id",
        c("_n_words").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, found)).alias("labels"),
        (1.0 - doubt).alias("score"),
    )


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_token_counts(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", c("counts.words").alias("n_words"), c("counts.tokens").alias("n_tokens"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_duplicates(table(spark, folder, "documents"))
    return rows.select(c("_id").alias("doc_id"), c("n").alias("n_shingles"), c("component").alias("component_id"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents")).drop("k")


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_round_trip(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        (F.octet_length("bpe.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe.ids", 256).alias("ids_sha256"),
        F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )


#: Queries by name; each is one dealt operator over its whole table.
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_source_mix,
        op3_exact_dedup,
        op4_url_filter,
        op5_quality,
        op6_vector_search,
        op7_exact_shards,
        op8_license_scan,
        op9_token_counts,
        op10_ngram_join,
        op11_whitening,
        op12_collocations,
        op13_bpe,
    )
}

#: SQL for the operators that SQL can express. The others are tested against brute force.
SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
            row_number() OVER best = 1 AS kept, sha256(bare) AS text_sha256
        FROM rows
        WINDOW best AS (PARTITION BY bare ORDER BY points DESC, doc_id NULLS LAST)
    """,
    "op10_ngram_join": rf"""
        WITH RECURSIVE split AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM split
        ), tokens AS (
            SELECT r, unnest(s) AS t FROM sets
        ), common AS (
            SELECT a.r AS x, b.r AS y, count(*) AS n FROM tokens a JOIN tokens b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r
        ), links AS (
            SELECT x, y FROM common JOIN sets a ON a.r = x JOIN sets b ON b.r = y WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)
        ), edges AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reached AS (
            SELECT r AS x, r AS y FROM sets UNION SELECT reached.x, edges.y FROM reached JOIN edges ON edges.x = reached.y
        )
        SELECT a.doc_id, len(a.s) AS n_shingles, min(b.doc_id) AS component_id
        FROM reached JOIN sets a ON a.r = reached.x JOIN sets b ON b.r = reached.y GROUP BY a.r, a.doc_id, a.s
    """,
    "op12_collocations": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), split AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
        ), counts AS (
            SELECT lang, m, phrase, count(*) AS f FROM (
                SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
                FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS m)
            ) GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang
        ), frequent AS (
            SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 100
        ), longer AS (
            SELECT lang, array_to_string(w[2:], ' ') AS phrase, f FROM frequent WHERE m > 2
            UNION ALL SELECT lang, array_to_string(w[:m - 1], ' '), f FROM frequent WHERE m > 2
        ), kept AS (
            SELECT * FROM frequent a WHERE m > 1 AND NOT EXISTS (
                FROM longer b WHERE b.lang = a.lang AND b.phrase = a.phrase AND 100 * b.f >= 100 * a.f)
        ), cuts AS (
            SELECT lang, phrase, f AS a, w, unnest(range(1, m)) AS k FROM kept
        ), scores AS (
            SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n,
                ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN totals t ON t.lang = c.lang
            JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
            JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
        ), lowest AS (
            SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER best AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
        FROM lowest
        WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
        QUALIFY rank <= 2000
    """,
}
