"""Queries of statistics, maintenance, relations, lint and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions.text import fingerprint, nfkc
from memlake.operators import edges, entities, lint, stats
from memlake.plans.base import AS_OF, EDGES_SQL, LINKS_SQL, as_of, memories, query
from memlake.sources.tables import table

NOW = f"TIMESTAMPTZ '{AS_OF}+00'"


def edge_rows(spark, d):
    return edges.clean_edges(table(spark, d, "memory_edges"))


@query("SELECT t.tier, count(m.id)::BIGINT AS n FROM (VALUES ('preferences'), ('project-context'), ('conversations')) t(tier) LEFT JOIN memories m ON m.tier = t.tier GROUP BY 1")
def stats_by_tier(spark, d):
    return stats.counted(memories(spark, d), "tier", stats.TIERS)


@query("SELECT t.type, count(m.id)::BIGINT AS n FROM (VALUES ('preference'), ('decision'), ('context'), ('relationship'), ('observation'), ('rejection')) t(type) LEFT JOIN memories m ON m.type = t.type GROUP BY 1")
def stats_by_type(spark, d):
    return stats.counted(memories(spark, d), "type", stats.TYPES)


@query(f"""SELECT count(*)::BIGINT AS total, count(embedding)::BIGINT AS with_embedding, (count(*) - count(embedding))::BIGINT AS without_embedding,
    min(created_at)::TIMESTAMP AS oldest, round(avg((epoch_us({NOW}) - epoch_us(created_at)) / 86400000000.0::DOUBLE), 2) AS mean_age_days, max(updated_at)::TIMESTAMP AS last_write FROM memories""")
def stats_overview(spark, d):
    return stats.overview(memories(spark, d), as_of())


@query("SELECT value, count(*)::BIGINT AS n FROM (SELECT unnest(topics) AS value FROM memories) WHERE value IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_topics(spark, d):
    return stats.top_values(memories(spark, d), "topics", 10)


@query("SELECT value, count(*)::BIGINT AS n FROM (SELECT unnest(people) AS value FROM memories) WHERE value IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_people(spark, d):
    return stats.top_values(memories(spark, d), "people", 10)


@query("SELECT project_scope, count(embedding)::BIGINT AS embedded, (count(*) - count(embedding))::BIGINT AS missing FROM memories GROUP BY 1")
def embedding_coverage(spark, d):
    return memories(spark, d).groupBy("project_scope").agg(F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("missing"))


@query("SELECT project_scope, fingerprint, count(*)::BIGINT AS n FROM memories GROUP BY 1, 2 HAVING count(*) > 1")
def dup_fingerprints(spark, d):
    return stats.duplicate_fingerprints(memories(spark, d))


@query(r"""WITH f AS (SELECT id, project_scope, sha256(trim(regexp_replace(regexp_replace(regexp_replace(content, '<!--.*?-->', '', 'gs'), '\[see also:.*?\]', '', 'gsi'), '\s+', ' ', 'g'))) AS fp FROM memories)
    SELECT project_scope, fp AS fingerprint, min(id) AS kept, (count(*) - 1)::BIGINT AS dropped FROM f GROUP BY 1, 2 HAVING count(*) > 1""")
def fingerprint_dedup(spark, d):
    rows = memories(spark, d).select("id", "project_scope", fingerprint(F.col("content")).alias("fingerprint"))
    return rows.groupBy("project_scope", "fingerprint").agg(F.min("id").alias("kept"), (F.count(F.lit(1)) - 1).alias("dropped")).where("dropped > 0")


_BAG = """flat AS (SELECT id, project_scope, created_at, type, unnest(topics) AS t FROM memories),
    kept AS (SELECT * FROM flat WHERE t IS NOT NULL), sets AS (SELECT DISTINCT * FROM kept)"""


@query(f"""WITH {_BAG}, pairs AS (SELECT a.id AS x, b.id AS y, a.project_scope FROM kept a JOIN sets b ON a.t = b.t AND a.project_scope = b.project_scope AND a.id < b.id
    GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT project_scope, count(*)::BIGINT AS pairs FROM pairs GROUP BY 1""")
def crossref_pairs_bag(spark, d):
    return stats.cross_references(memories(spark, d))


@query("SELECT project_scope, count(DISTINCT t)::BIGINT AS topics FROM (SELECT project_scope, unnest(topics) AS t FROM memories) GROUP BY 1")
def distinct_topics(spark, d):
    return stats.distinct_topics(memories(spark, d))


@query("""SELECT project_scope, unnest(topics) AS topic FROM memories WHERE tier = 'preferences' AND topics IS NOT NULL
    EXCEPT SELECT project_scope, unnest(topics) FROM memories WHERE tier = 'project-context' EXCEPT SELECT project_scope, NULL FROM memories""")
def topic_gap_except(spark, d):
    return stats.topic_gaps(memories(spark, d))


@query(f"""SELECT id, tier, type FROM memories WHERE type <> 'archived' AND ((tier = 'conversations' AND created_at < {NOW} - INTERVAL 90 DAY)
    OR (tier = 'project-context' AND created_at < {NOW} - INTERVAL 180 DAY))""")
def stale_candidates(spark, d):
    return stats.stale(memories(spark, d), as_of()).select("id", "tier", "type")


@query(f"""WITH s AS (SELECT project_scope, count(*)::BIGINT AS n FROM memories WHERE type <> 'archived' AND ((tier = 'conversations' AND created_at < {NOW} - INTERVAL 90 DAY)
        OR (tier = 'project-context' AND created_at < {NOW} - INTERVAL 180 DAY)) GROUP BY 1),
    f AS (SELECT project_scope, sum(n - 1)::BIGINT AS n FROM (SELECT project_scope, fingerprint, count(*) AS n FROM memories GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
    t AS (SELECT project_scope, count(DISTINCT t)::BIGINT AS n FROM (SELECT project_scope, unnest(topics) AS t FROM memories) GROUP BY 1)
    SELECT m.project_scope, coalesce(s.n, 0) AS archived, coalesce(f.n, 0) AS deduplicated, coalesce(t.n, 0) AS topics, coalesce(s.n, 0) + coalesce(f.n, 0) AS total_changes
    FROM (SELECT DISTINCT project_scope FROM memories) m LEFT JOIN s USING (project_scope) LEFT JOIN f USING (project_scope) LEFT JOIN t USING (project_scope)""")  # fmt: skip
def maintenance_counts(spark, d):
    return stats.maintenance(memories(spark, d), as_of())


_CANDIDATES = """tt AS (SELECT DISTINCT id, project_scope, created_at, unnest(topics) AS v FROM memories), pp AS (SELECT DISTINCT id, project_scope, created_at, unnest(people) AS v FROM memories),
    met AS (SELECT a.id AS id_a, b.id AS id_b, a.project_scope, a.created_at AS ca, b.created_at AS cb FROM tt a JOIN tt b ON a.v = b.v AND a.project_scope = b.project_scope AND a.id < b.id GROUP BY ALL HAVING count(*) >= 2
        UNION SELECT a.id, b.id, a.project_scope, a.created_at, b.created_at FROM pp a JOIN pp b ON a.v = b.v AND a.project_scope = b.project_scope AND a.id < b.id)"""


@query(f"WITH {_CANDIDATES} SELECT id_a, id_b, project_scope, substr(sha256(id_a || '|' || id_b), 1, 16) AS pair_hash FROM met")
def candidate_pairs_set(spark, d):
    return edges.with_pair_hash(edges.candidate_pairs(memories(spark, d)))


@query(f"WITH {_CANDIDATES} SELECT id_a, id_b, project_scope FROM met WHERE ca > TIMESTAMPTZ '2024-03-01 00:00:00+00' OR cb > TIMESTAMPTZ '2024-03-01 00:00:00+00'")
def candidate_pairs_since(spark, d):
    return edges.candidate_pairs(memories(spark, d), since=F.lit("2024-03-01 00:00:00").cast("timestamp"))


_UN = "m AS (SELECT * FROM memories WHERE type <> 'archived')"
_CONTRADICTIONS = """SELECT 'contradictions' AS "check", e.from_memory_id AS memory_id, e.to_memory_id AS other_id, e.confidence::DOUBLE AS confidence,
    CASE WHEN a.created_at > b.created_at AND e.confidence >= 0.7 THEN 'add_supersedes_edge' WHEN e.confidence >= 0.85 THEN 'archive_one' ELSE 'human_review' END AS action
    FROM now_valid e JOIN m a ON a.id = e.from_memory_id JOIN m b ON b.id = e.to_memory_id WHERE e.relation = 'contradicts' AND a.project_scope = b.project_scope"""
_STALE = f"""SELECT 'stale' AS "check", id AS memory_id, NULL::VARCHAR AS other_id, CASE WHEN EXISTS (SELECT 1 FROM now_valid e WHERE e.from_memory_id = m.id) THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS confidence, 'archive' AS action
    FROM m WHERE tier = 'project-context' AND created_at < {NOW} - INTERVAL 90 DAY AND NOT EXISTS (SELECT 1 FROM now_valid e WHERE e.to_memory_id = m.id)"""
_ORPHANS = f"""SELECT 'orphans' AS "check", id AS memory_id, NULL::VARCHAR AS other_id, 0.6::DOUBLE AS confidence, 'human_review' AS action
    FROM m WHERE created_at < {NOW} - INTERVAL 30 DAY AND id NOT IN (SELECT from_memory_id FROM now_valid UNION SELECT to_memory_id FROM now_valid)"""
_DRIFT = """SELECT 'drift' AS "check", x AS memory_id, y AS other_id, 0.55::DOUBLE AS confidence, 'reclassify' AS action FROM (
    SELECT a.id AS x, b.id AS y FROM kept a JOIN sets b ON a.t = b.t AND a.project_scope = b.project_scope AND a.created_at > b.created_at + INTERVAL 30 DAY
    WHERE a.type <> 'archived' AND b.type <> 'archived' GROUP BY 1, 2 HAVING count(*) >= 2)
    WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE least(e.from_memory_id, e.to_memory_id) = least(x, y) AND greatest(e.from_memory_id, e.to_memory_id) = greatest(x, y))"""
_SUPERSEDED = """SELECT 'superseded_unflagged' AS "check", e.to_memory_id AS memory_id, e.from_memory_id AS other_id,
    CASE WHEN len(list_filter(coalesce(a.topics, []), lambda t: t IS NOT NULL AND list_contains(coalesce(b.topics, []), t))) >= 1
        AND round((epoch_us(a.created_at) - epoch_us(b.created_at)) / 86400000000.0::DOUBLE) >= 90 THEN 0.92::DOUBLE ELSE 0.85::DOUBLE END AS confidence, 'archive' AS action
    FROM now_valid e JOIN m a ON a.id = e.from_memory_id JOIN m b ON b.id = e.to_memory_id WHERE e.relation = 'supersedes' AND a.project_scope = b.project_scope"""
_LINT = f"WITH {EDGES_SQL}, {_UN}, {_BAG}, found AS ({_CONTRADICTIONS} UNION ALL {_STALE} UNION ALL {_ORPHANS} UNION ALL {_DRIFT} UNION ALL {_SUPERSEDED})"


@query(f"WITH {EDGES_SQL}, {_UN} {_CONTRADICTIONS}")
def lint_contradictions(spark, d):
    return lint.contradictions(memories(spark, d), edge_rows(spark, d))


@query(f"WITH {EDGES_SQL}, {_UN} {_STALE}")
def lint_stale(spark, d):
    return lint.stale(memories(spark, d), edge_rows(spark, d), as_of())


@query(f"WITH {EDGES_SQL}, {_UN} {_ORPHANS}")
def lint_orphans(spark, d):
    return lint.orphans(memories(spark, d), edge_rows(spark, d), as_of())


@query(f"WITH {EDGES_SQL}, {_BAG} {_DRIFT}")
def lint_drift(spark, d):
    return lint.drift(memories(spark, d), edge_rows(spark, d))


@query(f"WITH {EDGES_SQL}, {_UN} {_SUPERSEDED}")
def lint_superseded(spark, d):
    return lint.superseded_unflagged(memories(spark, d), edge_rows(spark, d))


@query(f"""{_LINT} SELECT c."check", count(f.memory_id)::BIGINT AS findings, count(CASE WHEN f.confidence >= 0.9 THEN 1 END)::BIGINT AS fixable
    FROM (VALUES ('contradictions'), ('stale'), ('orphans'), ('drift'), ('superseded_unflagged')) c("check") LEFT JOIN found f ON f."check" = c."check" GROUP BY 1""")
def lint_summary(spark, d):
    return lint.summary(lint.lint(memories(spark, d), table(spark, d, "memory_edges"), as_of()))


@query(f"""{_LINT}, due AS (SELECT DISTINCT memory_id FROM found WHERE confidence >= 0.9 AND action = 'archive')
    SELECT CASE WHEN id IN (SELECT memory_id FROM due) THEN 'archived' ELSE type END AS type, count(*)::BIGINT AS n FROM memories GROUP BY 1""")
def lint_fix_records(spark, d):
    found = lint.lint(memories(spark, d), table(spark, d, "memory_edges"), as_of())
    return lint.fixed_records(memories(spark, d), found).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_LINT}, due AS (SELECT DISTINCT memory_id, other_id FROM found WHERE confidence >= 0.9 AND action = 'add_supersedes_edge')
    SELECT r AS relation, count(*)::BIGINT AS n FROM (SELECT CASE WHEN e.relation = 'contradicts' AND (e.from_memory_id, e.to_memory_id) IN (SELECT (memory_id, other_id) FROM due)
        AND NOT EXISTS (SELECT 1 FROM edges s WHERE s.relation = 'supersedes' AND s.from_memory_id = e.from_memory_id AND s.to_memory_id = e.to_memory_id) THEN 'supersedes' ELSE e.relation END AS r FROM edges e) GROUP BY 1""")  # fmt: skip
def lint_fix_edges(spark, d):
    found = lint.lint(memories(spark, d), table(spark, d, "memory_edges"), as_of())
    return lint.fixed_edges(edge_rows(spark, d), found).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EDGES_SQL}, incoming AS (SELECT 'new-' || id AS id, created_at, from_memory_id, to_memory_id, relation, 0.99::DECIMAL(3,2) AS confidence FROM edges WHERE relation = 'supports'
        UNION ALL SELECT 'new-' || id, created_at, from_memory_id, to_memory_id, 'supports', 0.99 FROM edges WHERE relation = 'depends_on')
    SELECT e.id, e.created_at, e.from_memory_id, e.to_memory_id, e.relation, coalesce(i.confidence, e.confidence) AS confidence
    FROM edges e LEFT JOIN (SELECT DISTINCT from_memory_id, to_memory_id, relation, confidence FROM incoming) i USING (from_memory_id, to_memory_id, relation)
    UNION SELECT i.id, i.created_at, i.from_memory_id, i.to_memory_id, i.relation, i.confidence FROM incoming i ANTI JOIN edges e USING (from_memory_id, to_memory_id, relation)""")  # fmt: skip
def edge_upsert(spark, d):
    rows = edge_rows(spark, d)
    surer = F.lit("0.99").cast("decimal(3,2)")
    incoming = rows.where("relation = 'supports'").unionByName(rows.where("relation = 'depends_on'").withColumn("relation", F.lit("supports")))
    incoming = incoming.withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("confidence", surer).withColumn("updated_at", as_of())
    return edges.upserted(rows, incoming).select("id", "created_at", "from_memory_id", "to_memory_id", "relation", "confidence")


@query(f"""WITH {EDGES_SQL} SELECT e.id, e.from_memory_id, e.to_memory_id, e.relation FROM edges e JOIN memories a ON a.id = e.from_memory_id JOIN memories b ON b.id = e.to_memory_id
    WHERE a.project_scope = 'global' AND b.project_scope = 'global'""")
def export_scoped_edges(spark, d):
    return edges.exported_edges(edge_rows(spark, d), memories(spark, d), "global").select("id", "from_memory_id", "to_memory_id", "relation")


@query(f"""WITH {EDGES_SQL} SELECT e.id, e.from_memory_id, e.to_memory_id, e.relation, e.confidence, a.type AS from_type, b.type AS to_type
    FROM now_valid e JOIN memories a ON a.id = e.from_memory_id JOIN memories b ON b.id = e.to_memory_id""")
def sidecar_edges(spark, d):
    return edges.sidecar_edges(edge_rows(spark, d), memories(spark, d), None)


_MERGE = "SELECT project_scope, type, normalized_name, min(id) AS id, max(last_seen_at) AS seen, list_sort(list_distinct(flatten(list(coalesce(aliases, []))))) AS al FROM {0} GROUP BY ALL"


@query(f"""WITH o AS ({_MERGE.format("(SELECT * FROM entities WHERE project_scope <> 'global')")}), n AS ({_MERGE.format("(SELECT * REPLACE ('global' AS project_scope) FROM entities) ")})
    SELECT coalesce(o.id, n.id) AS id, coalesce(o.normalized_name, n.normalized_name) AS normalized_name,
        list_sort(list_distinct(list_concat(coalesce(o.al, []), coalesce(n.al, []))))::VARCHAR[] AS aliases, o.id IS NULL AS created
    FROM o FULL JOIN n ON o.project_scope = n.project_scope AND o.type = n.type AND o.normalized_name = n.normalized_name""")  # fmt: skip
def entity_upsert(spark, d):
    rows = table(spark, d, "entities")
    merged = entities.upserted(rows.where("project_scope <> 'global'"), rows.withColumn("project_scope", F.lit("global")))
    return merged.select("id", "normalized_name", F.array_compact("aliases").alias("aliases"), "created")


@query("""SELECT e.id, e.type, e.canonical_name, count(DISTINCT l.memory_id)::BIGINT AS memories FROM entities e LEFT JOIN memory_entities l ON l.entity_id = e.id
    GROUP BY ALL ORDER BY memories DESC, canonical_name, e.id LIMIT 20""")
def top_entities(spark, d):
    return entities.top_entities(table(spark, d, "entities"), table(spark, d, "memory_entities"), 20)


@query("""SELECT id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM memory_entities l WHERE l.memory_id = m.id)
    OR updated_at > (SELECT max(created_at) FROM memory_entities l WHERE l.memory_id = m.id)""")
def extraction_candidates(spark, d):
    return entities.extraction_candidates(memories(spark, d), table(spark, d, "memory_entities"))


_DICT = """dict AS (SELECT id AS entity_id, project_scope, normalized_name AS name, TRUE AS canonical FROM entities
    UNION ALL SELECT id, project_scope, lower(a), FALSE FROM (SELECT id, project_scope, unnest(aliases) AS a FROM entities) WHERE a IS NOT NULL)"""


@query(f"""WITH {_DICT}, names AS (SELECT DISTINCT lower(n) AS name FROM (SELECT unnest(people) AS n FROM memories) WHERE n IS NOT NULL)
    SELECT name, entity_id FROM names JOIN dict USING (name) WHERE trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY canonical DESC, (project_scope = 'global') DESC, entity_id) = 1""")
def entity_resolve(spark, d):
    names = memories(spark, d).select(F.explode("people").alias("name")).where(F.col("name").isNotNull())
    return entities.resolve(names, table(spark, d, "entities"))


@query(f"WITH {LINKS_SQL} SELECT memory_id, entity_id, confidence FROM links")
def clean_links(spark, d):
    return entities.clean_links(table(spark, d, "memory_entities")).select("memory_id", "entity_id", "confidence")


# The signs that are added have forms of their own only in NFKC: a ligature, a wide letter, a number in a circle.
@query("SELECT id, nfc_normalize(canonical_name) || ' fi A 1' AS name FROM entities")
def nfkc_entities(spark, d):
    return table(spark, d, "entities").select("id", nfkc(F.concat("canonical_name", F.lit(" \ufb01 \uff21 \u2460"))).alias("name"))
