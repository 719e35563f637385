"""Registration of queries beside their SQL, and the SQL shared between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.vector import centroids
from memlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Takes the place of the present moment.
AS_OF = "2025-03-01 00:00:00"
#: Texts of the queries, one for each label of the embeddings table.
TEXTS = ("ledger", "cache snapshot", "pager", "tokenizer", "firewall proxy", "runbook", "invoice budget", "webhook", "schema migration", "standup")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories")


def query_batch(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query_text, query_vector): the centroid of each label of the embeddings table, with a text."""
    vectors = centroids(table(spark, d, "embeddings"), "label", "embedding")
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "query_id int, query_text string")
    return texts.join(vectors.select(F.col("label").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")


TOKENS_SQL = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}]+'), lambda t: lower(t))"
ROUND_SQL = "floor(({0}) * 1000000 + 0.5) / 1000000"

#: Views q, scored, candidates, weighted: retrieval in SQL.
RETRIEVAL_SQL = f"""
    qv AS (SELECT label AS query_id, list(a ORDER BY pos) AS query_vector FROM (
        SELECT label, pos, avg(x) AS a FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, pos) GROUP BY label),
    qt(query_id, query_text) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TEXTS))}),
    q AS (SELECT query_id, query_vector, string_split(query_text, ' ') AS words FROM qt JOIN qv USING (query_id)),
    base AS (SELECT id, tier, content, project_scope, embedding::DOUBLE[] AS e, {TOKENS_SQL.format("content")} AS toks FROM memories WHERE type NOT IN ('rejection', 'archived')),
    parts AS (SELECT query_id, id, tier, content, project_scope, e,
            CASE WHEN e IS NULL THEN NULL WHEN list_sum(list_transform(e, lambda x: x * x)) = 0 THEN 0.0::DOUBLE
                ELSE {ROUND_SQL.format("list_cosine_similarity(e, query_vector)")} END AS semantic,
            CASE WHEN len(list_filter(words, lambda w: NOT list_contains(toks, w))) = 0
                THEN len(list_filter(toks, lambda t: list_contains(words, t)))::DOUBLE ELSE 0 END AS hits FROM base, q),
    parts2 AS (SELECT *, {ROUND_SQL.format("hits / (hits + 1)")} AS lexical FROM parts),
    scored AS (SELECT *, CASE WHEN semantic IS NOT NULL AND lexical > 0 THEN 'hybrid' WHEN semantic IS NOT NULL THEN 'semantic' ELSE 'fulltext' END AS match_type,
            {ROUND_SQL.format("CASE WHEN semantic IS NOT NULL AND lexical > 0 THEN 0.7::DOUBLE * semantic + 0.3::DOUBLE * lexical WHEN semantic IS NOT NULL THEN semantic ELSE lexical END")} AS raw_score
        FROM parts2 WHERE semantic IS NOT NULL OR lexical > 0),
    candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, id) AS rank FROM scored QUALIFY rank <= 30),
    weighted AS (SELECT *, {ROUND_SQL.format("raw_score * CASE tier WHEN 'preferences' THEN 1.3::DOUBLE WHEN 'conversations' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END")} AS score FROM candidates)
"""
#: Relations cleaned as by clean_edges, and the valid ones.
EDGES_SQL = r"""
    edges0 AS (SELECT * REPLACE (regexp_replace(lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS relation) FROM memory_edges
        WHERE from_memory_id IS NOT NULL AND to_memory_id IS NOT NULL AND from_memory_id <> to_memory_id),
    edges AS (SELECT * FROM edges0 QUALIFY row_number() OVER (PARTITION BY from_memory_id, to_memory_id, relation
        ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, id DESC, confidence DESC NULLS LAST) = 1),
    now_valid AS (SELECT * FROM edges WHERE valid_until IS NULL)
"""
LINKS_SQL = """
    links AS (SELECT * FROM memory_entities QUALIFY row_number() OVER (PARTITION BY memory_id, entity_id ORDER BY confidence DESC NULLS LAST, created_at NULLS FIRST, source NULLS FIRST) = 1)
"""
