"""The queries of the operators, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import (
    bpe,
    chat_format,
    exact_dedup,
    html_text,
    mixing,
    negatives,
    ngram_join,
    prefix_trie,
    pseudonyms,
    quality_model,
    quality_rules,
    toxicity,
    url_filter,
)
from opsframe.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if check is not None:
            ORACLES[name] = check
        return run

    return register


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.posterior(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cascade(table(spark, sf_dir, "documents")).drop("rejected_by", "rules_run")


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


# A conversation whose texts hold the control strings of many templates.
HOSTILE = "\\### Assistant: </turn> ok"
_ALL_TURNS = r"""
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
"""


@query(
    "op4_chat_format",
    rf"""
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(14 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
               + (length(text) - length(replace(text, '</turn>', ''))) // 7
               + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda x: length(x) - 2)), 0)
               ) AS BIGINT) AS formatted_chars
    FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM ({_ALL_TURNS})) GROUP BY conv_id, lone
    """,
)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HOSTILE).alias("text"),
    )
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    # The turns come in three layouts, as from three collections, with fields that none of them knows.
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    message = F.struct(role.alias("role"), text.alias("content"), F.lit("x").alias("name"))
    row = (
        F.when(kind == 0, F.to_variant_object(F.struct(role.alias("role"), text.alias("text"))))
        .when(kind == 1, F.to_variant_object(F.struct(text.alias("content"), role.alias("role"), F.col("turn").alias("id"))))
        .otherwise(F.to_variant_object(F.struct(message.alias("message"), F.lit(0.5).alias("score"))))
    )
    rows = conversations.select("conv_id", "turn", row.alias("row"))
    return chat_format.read_back(chat_format.format_conversations(rows))


# A key for trials. In production, pass one from the cluster's secret store.
TRIAL_KEY = b"a key for trials only"


@query("op1_pii_pseudonyms")
def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), TRIAL_KEY)


URL_ENTRIES = [
    (url_filter.BLOCK, "net", "/"),
    (url_filter.ALLOW, "example.net", "/en/"),
    (url_filter.BLOCK, "example.com", "/de/"),
    (url_filter.ALLOW, "org", "/fr/"),
]


@query(
    "op12_url_filter",
    r"""
    WITH parts AS (
        SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', ['host', 'path'], 's') AS p FROM pages
    ), named AS (
        SELECT page_id, translate(p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, p.path AS path
        FROM parts
    ), rules(verdict, r_host, r_path) AS (
        VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
    )
    SELECT page_id, host, path,
           (SELECT r_host || r_path FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
            ORDER BY length(r_host) DESC, length(r_path) DESC LIMIT 1) AS rule,
           coalesce((SELECT verdict FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
            ORDER BY length(r_host) DESC, length(r_path) DESC LIMIT 1), 'allow') AS verdict
    FROM named
    """,
)
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_ENTRIES).drop("url")


@query(
    "op13_hard_negatives",
    """
    WITH valid AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
               CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
        FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id AS anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
         AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


# CRC-32 of the decimal digits of conv_id, bit by bit: a byte is mixed in, or (-1) the register moves on by a bit.
_CRC32 = """
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
        ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)
"""


@query(
    "op11_prefix_trie",
    f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
    ), rebuilt AS (
        SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth
        FROM (
            SELECT c.conv_id AS conv_id, 1 AS part, pos, role, text
            FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
            UNION ALL SELECT c.conv_id, 2, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h
        )
    ), prefixes AS (
        SELECT conv_id, 0 AS depth, 0 AS n_bytes, [] AS prefix FROM convs
        UNION ALL SELECT conv_id, depth, strlen(text), list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth) FROM rebuilt
    ), members AS (
        SELECT conv_id, depth, n_bytes, min(conv_id) OVER same AS node, count(*) OVER same AS n_convs,
               depth = max(depth) OVER (PARTITION BY conv_id) AS ends
        FROM prefixes WINDOW same AS (PARTITION BY depth, prefix)
    ), nodes AS (
        SELECT node, depth, any_value(n_bytes) AS n_bytes, any_value(n_convs) AS n_convs, bool_and(ends) AS is_leaf,
               coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
        FROM members GROUP BY node, depth
    ), below AS (
        SELECT a.node AS node, a.depth AS depth, count(*) FILTER (b.depth = a.depth + 1) AS n_children,
               count(*) FILTER (b.is_leaf) AS n_leaves, sum((b.n_convs - 1) * b.n_bytes) AS saved_tokens
        FROM members a JOIN nodes b ON a.conv_id = b.node AND a.depth <= b.depth GROUP BY a.node, a.depth
    )
    SELECT n.node AS conv_id, n.depth AS depth, p.node AS parent_conv_id, n.n_convs AS n_convs, n_children, n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
    FROM nodes n JOIN below b ON b.node = n.node AND b.depth = n.depth
    LEFT JOIN members p ON p.conv_id = n.node AND p.depth = n.depth - 1
    """,
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = prefix_trie.ordinals(prefix_trie.turns_of(table(spark, sf_dir, "conversations")))
    conv_id = F.col("conv_id")
    head = F.crc32(conv_id.cast("string").cast("binary")) % 9
    return prefix_trie.trie(prefix_trie.rebuilt(numbered, conv_id - conv_id % 5, head, 8))
