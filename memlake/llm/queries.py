"""Queries of the training-data operators over the store's tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import components, mih, names, neardup, pii, setsim, spam, tokens, winnow
from memlake.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsim.similar_sets(table(spark, sf_dir, "memories"), "id", ["topics", "people"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "memories"), "id", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_information(table(spark, sf_dir, "memories"), "id", "content")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "memories"), "id", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_names(
        table(spark, sf_dir, "entities"), table(spark, sf_dir, "memories"), table(spark, sf_dir, "given_name_forms")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest_neighbours(table(spark, sf_dir, "memories"), "id", "embedding")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.version_groups(table(spark, sf_dir, "memory_edges"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p3_redacted, p4_found, p5_found, p6_found, p7_ids, p8_found, p9_found)
}

_P1_VALUE = r"regexp_replace(regexp_replace(lower(v), '^\s+|\s+$', '', 'g'), '[\s_-]+', '-', 'g')"
_P2_PLAIN = r"regexp_replace(regexp_replace(content, '<!--.*?-->', '', 'gs'), '\[see also:.*?\]', '', 'gsi')"

ORACLE: dict[str, str] = {
    "p1_found": f"""
        WITH flat AS (SELECT DISTINCT id, {_P1_VALUE} AS v FROM (
                SELECT id, unnest(list_concat(coalesce(topics, []), coalesce(people, []))) AS v FROM memories) WHERE v IS NOT NULL),
            kept AS (SELECT id, v FROM flat WHERE v <> ''),
            sizes AS (SELECT id, count(*) AS n FROM kept GROUP BY id HAVING count(*) >= 4),
            shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM kept a JOIN kept b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE s * 8 >= (x.n + y.n) * 3""",
    "p2_found": f"""
        WITH kept AS (SELECT DISTINCT id, lower(v) AS v FROM (
                SELECT id, unnest(regexp_extract_all({_P2_PLAIN}, '[\\p{{L}}\\p{{N}}]+')) AS v FROM memories)),
            sizes AS (SELECT id, count(*) AS n FROM kept GROUP BY id HAVING count(*) >= 8),
            shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM kept a JOIN kept b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE s * 17 >= (x.n + y.n) * 7""",
    "p5_found": """
        WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM memories WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
            s AS (SELECT a.id, b.id AS neighbour_id, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.id <> b.id)
        SELECT id, neighbour_id FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbour_id) <= 5""",
    "p6_found": r"""
        WITH RECURSIVE linking AS (
                SELECT from_memory_id AS a, to_memory_id AS b FROM memory_edges
                WHERE regexp_replace(lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') IN ('supersedes', 'evolved_into')
                    AND valid_until IS NULL AND from_memory_id <> to_memory_id),
            both_ways AS (SELECT a, b FROM linking UNION SELECT b, a FROM linking),
            reached AS (SELECT a AS memory_id, a AS other FROM both_ways
                UNION SELECT r.memory_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other)
        SELECT memory_id, min(other) AS group_id FROM reached GROUP BY memory_id""",
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM eval_items),
            dg AS (SELECT DISTINCT doc_id, lower(array_to_string(w[p:p + 7], ' ')) AS g
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
            ig AS (SELECT DISTINCT item_id, lower(array_to_string(w[p:p + 7], ' ')) AS g
                FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
