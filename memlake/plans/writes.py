"""Queries of writes, sources and model cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import cascade, edges, entities
from memlake.plans.base import EDGES_SQL, as_of, memories, query
from memlake.sources import backup, markdown, store
from memlake.sources.tables import table
from memlake.streaming.ingest import windowed_counts

_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '<!--.*?-->', '', 'gs'), '\[see also:.*?\]', '', 'gsi'), '[\s\x0B\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"


@query(f"""WITH inc AS (SELECT DISTINCT project_scope, sha256({_NORMAL.format("text")}) AS fp FROM documents WHERE text IS NOT NULL),
    fresh AS (SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.project_scope = inc.project_scope AND m.fingerprint = inc.fp)),
    rows AS (SELECT project_scope, 0 AS new FROM memories UNION ALL SELECT project_scope, 1 FROM fresh)
    SELECT project_scope, count(*)::BIGINT AS n, sum(new)::BIGINT AS added FROM rows GROUP BY 1""")
def remember_batch(spark, d):
    own = memories(spark, d)
    incoming = table(spark, d, "documents").where(F.col("text").isNotNull()).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.col("text").alias("content"), F.lit("conversations").alias("tier"), F.lit("observation").alias("type"),
        "project_scope", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("section", "topics", "people", "date", "embedding", "source_file", "source_line")],
    )
    after = store.remember(own, incoming, as_of())
    return after.groupBy("project_scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").startswith("doc-")).alias("added"))


@query(f"""WITH {EDGES_SQL}, old AS (SELECT DISTINCT to_memory_id AS id FROM now_valid WHERE relation = 'supersedes')
    SELECT CASE WHEN id IN (SELECT id FROM old) THEN 'archived' ELSE type END AS type, count(*)::BIGINT AS n FROM memories GROUP BY 1""")
def archive_superseded(spark, d):
    newer = edges.valid(edges.clean_edges(table(spark, d, "memory_edges"))).where("relation = 'supersedes'")
    after = store.archived(memories(spark, d), newer.select(F.col("to_memory_id").alias("id")), as_of())
    return after.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EDGES_SQL}, bad AS (SELECT DISTINCT to_memory_id AS id FROM now_valid WHERE relation = 'contradicts' AND to_memory_id IN (SELECT id FROM memories))
    SELECT t AS type, count(*)::BIGINT AS n FROM (SELECT CASE WHEN id IN (SELECT id FROM bad) THEN 'rejection' ELSE type END AS t FROM memories UNION ALL SELECT 'rejection' FROM bad) GROUP BY 1""")
def reject_contradicted(spark, d):
    wrong = edges.valid(edges.clean_edges(table(spark, d, "memory_edges"))).where("relation = 'contradicts'")
    reasons = wrong.groupBy(F.col("to_memory_id").alias("id")).agg(F.min("rationale").alias("reason")).withColumn("reason", F.coalesce("reason", F.lit("")))
    return store.rejected(memories(spark, d), reasons, as_of()).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EDGES_SQL}, g AS (SELECT id FROM memories WHERE project_scope = 'global'), e AS (SELECT id FROM entities WHERE project_scope = 'global')
    SELECT 'memories' AS "table", count(*)::BIGINT AS n FROM g UNION ALL SELECT 'entities', count(*) FROM e
    UNION ALL SELECT 'memory_edges', count(*) FROM edges WHERE from_memory_id IN (SELECT id FROM g) AND to_memory_id IN (SELECT id FROM g)
    UNION ALL SELECT 'memory_entities', count(*) FROM memory_entities WHERE memory_id IN (SELECT id FROM g) AND entity_id IN (SELECT id FROM e)""")
def backup_rows(spark, d):
    tables = {t: table(spark, d, t) for t in backup.TABLES}
    tables["memory_edges"] = edges.clean_edges(tables["memory_edges"])
    rows = backup.lines(tables, "global").where("place <> '0'")
    return rows.select(F.get_json_object("value", "$.table").alias("table")).groupBy("table").agg(F.count(F.lit(1)).alias("n"))


@query()
def markdown_import(spark, d):
    notes = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("source_file"), "text")
    return markdown.entries(notes)


@query()
def classify_cascade(spark, d):
    rows = memories(spark, d)
    outcomes = cascade.classify(edges.candidate_pairs(rows), rows, cap_usd=1e9)
    return outcomes.groupBy("stage", "relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


@query()
def entity_extraction(spark, d):
    found = cascade.extract(memories(spark, d), entities.dictionary(table(spark, d, "entities")))
    return found.groupBy("type", F.col("entity_id").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark, d):
    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))
