"""One registered query per operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.llm import (
    bpe, exact_dedup, jaccard, language, licenses, mixing, packing, quality, search, substrings, topk, trie, warc,
)
from airtally.llm.tables import saved, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@query("op1_quality")
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = saved(quality.measure(table(spark, sf_dir, "documents")), "quality")
    model, weights = quality.fit_measured(measured)
    return quality.judge(measured, model, weights)


@query("op2_topk", """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), q AS (
        SELECT vec_id AS query_id, unnest(e) AS x, generate_subscripts(e, 1) AS i, len(e) AS n
        FROM v WHERE vec_id % 50 = 0
    ), c AS (
        SELECT vec_id, unnest(e) AS y, generate_subscripts(e, 1) AS i, len(e) AS n FROM v
    ), s AS (
        SELECT query_id, vec_id, CAST(sum(x * y) AS BIGINT) AS score
        FROM q JOIN c USING (i, n) WHERE query_id <> vec_id GROUP BY query_id, vec_id
    ), r AS (
        SELECT query_id,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s
    )
    SELECT * FROM r WHERE rank <= 5
""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query("op3_exact_dedup", """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY sha256(coalesce(text, '')))
""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


@query("op4_licenses")
def license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarize(licenses.scan(table(spark, sf_dir, "documents")))


@query("op5_repeats")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op6_bpe")
def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, VOCABULARY, PATTERN, round_trip=True).select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_jaccard")
def near_duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_language")
def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.predict(docs, model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op9_packing")
def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


@query("op10_mixing")
def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op11_trie", """
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
                   strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
        FROM conversations WHERE conv_id IS NOT NULL
    ), lengths AS (
        SELECT conv_id, count(*) AS own FROM turns GROUP BY conv_id
    ), crc AS (
        SELECT conv_id, own, xor(list_reduce(
            list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 9 AS h
        FROM lengths
    ), known AS (
        SELECT c.conv_id, c.own, c.h, c.conv_id - c.conv_id % 5 AS base_id, least(c.h, coalesce(b.own, 0)) AS taken
        FROM crc c LEFT JOIN lengths b ON b.conv_id = c.conv_id - c.conv_id % 5
    ), rebuilt AS (
        SELECT k.conv_id, t.place, t.role, t.text FROM known k JOIN turns t ON t.conv_id = k.base_id AND t.place <= k.taken
        UNION ALL
        SELECT k.conv_id, t.place - k.h + k.taken, t.role, t.text FROM known k JOIN turns t USING (conv_id) WHERE t.place > k.h
    ), prefixes AS (
        SELECT conv_id, place AS depth, strlen(text) AS size,
               list(strlen(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY place) AS path
        FROM rebuilt
        UNION ALL SELECT conv_id, 0, 0, [] FROM known
    ), ends AS (
        SELECT conv_id, max(depth) AS last FROM prefixes GROUP BY conv_id
    ), nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
               coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last), '') AS ended
        FROM prefixes JOIN ends USING (conv_id) GROUP BY path, depth
    ), children AS (
        SELECT p.path, count(*) AS n_children FROM nodes c JOIN nodes p
        ON p.depth = c.depth - 1 AND p.path = c.path[:c.depth - 1] GROUP BY p.path
    ), below AS (
        SELECT p.path, sum((c.n_convs - 1) * c.size) AS saved_tokens,
               count(*) FILTER (WHERE k.path IS NULL) AS n_leaves
        FROM nodes p JOIN nodes c ON c.depth >= p.depth AND c.path[:p.depth] = p.path
        LEFT JOIN children k ON k.path = c.path GROUP BY p.path
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
           coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens,
           sha256(n.ended) AS ends_sha256
    FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children k ON k.path = n.path
    LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
""")
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_warc", """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
""")
def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_search", """
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM documents
    ), tf AS (
        SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
    ), docs AS (
        SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id
    ), totals AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs
    ), df AS (
        SELECT term, count(*) AS df FROM tf GROUP BY term
    ), asked AS (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM benchmark
    ), wanted AS (
        SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY item_id, term
    ), scored AS (
        SELECT item_id, doc_id, CAST(sum(
            repeats * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
            * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * CAST(n AS BIGINT) * docs) // length)))) AS BIGINT) AS score
        FROM wanted JOIN df USING (term) JOIN tf USING (term) JOIN docs USING (doc_id), totals
        GROUP BY item_id, doc_id
    ), ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
               doc_id, score
        FROM scored WHERE score > 0
    )
    SELECT * FROM ranked WHERE rank <= 10
""")
def benchmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
