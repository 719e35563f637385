"""Queries of retrieval and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions.text import fingerprint, jaccard, lexemes, pair_hash, word_set
from memlake.operators import edges, entities, filters, retrieve
from memlake.plans.base import AS_OF, EDGES_SQL, LINKS_SQL, RETRIEVAL_SQL, TOKENS_SQL, as_of, memories, query, query_batch
from memlake.sources.tables import table

W = f"WITH {RETRIEVAL_SQL}"


@query(f"{W} SELECT query_id, id, semantic AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, id) AS r FROM scored WHERE semantic IS NOT NULL) WHERE r <= 10")
def semantic_topk(spark, d):
    found = retrieve.scored(memories(spark, d), query_batch(spark, d), keep=10, by="semantic", columns=["tier"]).where(F.col("semantic").isNotNull())
    return retrieve.best(found, 10, by="semantic").select("query_id", "id", F.col("semantic").alias("score"))


@query(f"{W} SELECT query_id, match_type, count(*)::BIGINT AS n, round(sum(raw_score), 3) AS total FROM scored GROUP BY 1, 2")
def hybrid_scored(spark, d):
    rows = retrieve.scored(memories(spark, d), query_batch(spark, d), columns=["tier"])
    return rows.groupBy("query_id", "match_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("raw_score"), 3).alias("total"))


@query(f"{W} SELECT query_id, id, match_type, raw_score, score FROM weighted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def tier_weighted_topk(spark, d):
    rows = retrieve.hybrid_search(memories(spark, d), query_batch(spark, d))
    return retrieve.best(rows.drop("rank"), 10, by="score").select("query_id", "id", "match_type", "raw_score", "score")


@query(f"{W} SELECT query_id, id FROM parts WHERE hits > 0")
def lexical_and_match(spark, d):
    words_only = query_batch(spark, d).withColumn("query_vector", F.lit(None).cast("array<double>"))
    return retrieve.scored(memories(spark, d), words_only, columns=["tier"]).select("query_id", "id")


@query(f"{W} SELECT query_id, id, lexical FROM parts2 WHERE lexical > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, id) <= 20")
def lexical_topk(spark, d):
    words_only = query_batch(spark, d).withColumn("query_vector", F.lit(None).cast("array<double>"))
    rows = retrieve.scored(memories(spark, d), words_only, keep=20, by="lexical", columns=["tier"])
    return retrieve.best(rows, 20, by="lexical").select("query_id", "id", "lexical")


# The queries of the mode 'english' have no SQL, since the offline DuckDB has no stemmer; tests compare them with hand-made cases.


@query()
def english_and_match(spark, d):
    words_only = query_batch(spark, d).withColumn("query_vector", F.lit(None).cast("array<double>"))
    return retrieve.scored(memories(spark, d), words_only, columns=["tier"], mode="english").select("query_id", "id")


@query()
def english_topk(spark, d):
    words_only = query_batch(spark, d).withColumn("query_vector", F.lit(None).cast("array<double>"))
    rows = retrieve.scored(memories(spark, d), words_only, keep=20, by="lexical", columns=["tier"], mode="english")
    return retrieve.best(rows, 20, by="lexical").select("query_id", "id", "lexical")


@query()
def english_hybrid_scored(spark, d):
    rows = retrieve.scored(memories(spark, d), query_batch(spark, d), columns=["tier"], mode="english")
    return rows.groupBy("query_id", "match_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("raw_score"), 3).alias("total"))


@query(f"{W} SELECT query_id, id, raw_score, score FROM weighted WHERE raw_score >= 0.5")
def relevance_floor(spark, d):
    return retrieve.hybrid_search(memories(spark, d), query_batch(spark, d), min_score=0.5).select("query_id", "id", "raw_score", "score")


@query(f"""{W}, tiered AS (SELECT *, CASE tier WHEN 'preferences' THEN 0 WHEN 'project-context' THEN 1 WHEN 'conversations' THEN 2 ELSE 3 END AS place,
        row_number() OVER (PARTITION BY query_id, tier ORDER BY raw_score DESC, id) AS r FROM scored QUALIFY r <= 30),
    reach AS (SELECT *, coalesce(max(raw_score) OVER (PARTITION BY query_id ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reached FROM tiered)
    SELECT query_id, tier, id, raw_score FROM reach WHERE reached < 0.6""")  # fmt: skip
def progressive_tiers(spark, d):
    return retrieve.progressive_search(memories(spark, d), query_batch(spark, d)).select("query_id", "tier", "id", "raw_score")


@query(f"""{W}, counted AS (SELECT query_id, id, score, ceil(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT AS tokens,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM weighted)
    SELECT query_id, id, tokens, used_tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place)::BIGINT AS used_tokens FROM counted)
    WHERE used_tokens <= 400 AND place <= 10""")  # fmt: skip
def token_budget(spark, d):
    rows = retrieve.hybrid_search(memories(spark, d), query_batch(spark, d)).drop("rank")
    ranked = retrieve.best(rows, 30, by="score")
    return retrieve.within_budget(ranked, 400, 10).select("query_id", "id", "tokens", "used_tokens")


_SIM = """CASE WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN
        CASE WHEN list_sum(list_transform(a.e, lambda x: x * x)) = 0 OR list_sum(list_transform(b.e, lambda x: x * x)) = 0 THEN 0.0::DOUBLE ELSE list_cosine_similarity(a.e, b.e) END
    ELSE len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(list_distinct(list_concat(a.w, b.w))), 1) END"""


@query(f"""{W}, c AS (SELECT query_id, id, score, e, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS w FROM weighted),
    first AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1),
    s1 AS (SELECT a.query_id, a.id, a.score, a.e, a.w, greatest(0, {_SIM}) AS near1 FROM c a JOIN first b USING (query_id) WHERE a.id <> b.id),
    second AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * score - 0.3::DOUBLE * near1, 9) DESC, score DESC, id) = 1),
    s2 AS (SELECT a.query_id, a.id, a.score, greatest(a.near1, {_SIM}) AS near2 FROM s1 a JOIN second b USING (query_id) WHERE a.id <> b.id),
    third AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * score - 0.3::DOUBLE * near2, 9) DESC, score DESC, id) = 1)
    SELECT query_id, id, 1 AS position FROM first UNION ALL SELECT query_id, id, 2 FROM second UNION ALL SELECT query_id, id, 3 FROM third""")  # fmt: skip
def mmr_k3(spark, d):
    return retrieve.diversified(retrieve.hybrid_search(memories(spark, d), query_batch(spark, d)), 3)


#: Every candidate's similarity to every other one of its query, and the picks one after another.
PICKS_SQL = f"""c AS (SELECT query_id, id, score, match_type, content, e, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS w FROM weighted),
    sims AS (SELECT a.query_id, a.id AS a, b.id AS b, greatest(0, {_SIM}) AS sim FROM c a JOIN c b USING (query_id) WHERE a.id <> b.id),
    picks AS (SELECT query_id, id, 1 AS position, [id] AS chosen FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1
        UNION ALL
        SELECT query_id, id, position, chosen FROM (
            SELECT query_id, id, position, list_append(chosen, id) AS chosen, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * score - 0.3::DOUBLE * near, 9) DESC, score DESC, id) AS r
            FROM (SELECT c.query_id, c.id, c.score, p.position + 1 AS position, p.chosen, max(s.sim) AS near FROM picks p JOIN c ON c.query_id = p.query_id AND NOT list_contains(p.chosen, c.id)
                JOIN sims s ON s.query_id = c.query_id AND s.a = c.id AND list_contains(p.chosen, s.b) WHERE p.position < 30 GROUP BY ALL)) WHERE r = 1)"""
RW = f"WITH RECURSIVE {RETRIEVAL_SQL}, {PICKS_SQL}"
WORDS_SQL = "ceil(len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT"


@query(f"{RW} SELECT query_id, id, position FROM picks WHERE position <= 10")
def mmr_topk(spark, d):
    return retrieve.diversified(retrieve.hybrid_search(memories(spark, d), query_batch(spark, d)), 10)


@query(f"""{RW}, spent AS (SELECT p.query_id, p.id, c.score, c.match_type, p.position, sum({WORDS_SQL.format("c.content")}) OVER (PARTITION BY p.query_id ORDER BY p.position) AS used,
        row_number() OVER (PARTITION BY p.query_id ORDER BY p.position) AS place FROM picks p JOIN c ON c.query_id = p.query_id AND c.id = p.id)
    SELECT query_id, id, score, match_type, position FROM spent WHERE used <= 400 AND place <= 10""")  # fmt: skip
def recall_full(spark, d):
    return retrieve.recall(memories(spark, d), query_batch(spark, d), k=10, max_tokens=400)


@query()
def english_recall_full(spark, d):
    return retrieve.recall(memories(spark, d), query_batch(spark, d), k=10, max_tokens=400, mode="english")


@query(f"""WITH {LINKS_SQL}, top AS (SELECT entity_id FROM links GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 3)
    SELECT entity_id, id, position FROM (SELECT l.entity_id, m.id, row_number() OVER (PARTITION BY l.entity_id ORDER BY m.updated_at DESC NULLS FIRST, m.id) AS position
        FROM links l JOIN top USING (entity_id) JOIN memories m ON m.id = l.memory_id WHERE m.type NOT IN ('rejection', 'archived')) WHERE position <= 20""")  # fmt: skip
def entity_only_recall(spark, d):
    links = entities.clean_links(table(spark, d, "memory_entities"))
    top = links.groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").limit(3).select("entity_id")
    return retrieve.entity_records(memories(spark, d), links, top).where("position <= 20").select("entity_id", "id", "position")


@query(f"""{W}, {EDGES_SQL}, ids AS (SELECT DISTINCT id FROM candidates)
    SELECT 'contradicts' AS kind, from_memory_id AS memory_id, to_memory_id AS other_id, id AS edge_id FROM now_valid WHERE relation = 'contradicts' AND from_memory_id IN (SELECT id FROM ids)
    UNION ALL SELECT 'superseded_by', to_memory_id, from_memory_id, id FROM now_valid WHERE relation = 'supersedes'
        AND (from_memory_id IN (SELECT id FROM ids) OR to_memory_id IN (SELECT id FROM ids))""")  # fmt: skip
def recall_signals(spark, d):
    hits = retrieve.hybrid_search(memories(spark, d), query_batch(spark, d))
    return edges.signals(edges.clean_edges(table(spark, d, "memory_edges")), hits)


@query(f"""{W}, {LINKS_SQL} SELECT memory_id AS id, list_sort(list_distinct(list(canonical_name || ':' || confidence::VARCHAR))) AS entities
    FROM links l JOIN entities n ON n.id = l.entity_id WHERE memory_id IN (SELECT id FROM candidates) GROUP BY memory_id""")
def entity_links(spark, d):
    hits = retrieve.hybrid_search(memories(spark, d), query_batch(spark, d))
    return entities.links_of(hits, entities.clean_links(table(spark, d, "memory_entities")), table(spark, d, "entities"))


@query("""SELECT id, created_at FROM memories WHERE type <> 'rejection' AND tier = 'project-context' AND list_has_any(topics, ['memory', 'deploy', 'docs'])
    ORDER BY created_at DESC NULLS FIRST, id LIMIT 50""")
def search_filters(spark, d):
    rows = memories(spark, d).where(filters.not_rejected() & (F.col("tier") == "project-context") & filters.overlaps("topics", ["memory", "deploy", "docs"]))
    return rows.select("id", "created_at").orderBy(F.desc_nulls_first("created_at"), "id").limit(50)


@query(f"""SELECT id, type FROM memories WHERE type <> 'rejection' AND created_at >= TIMESTAMPTZ '2023-06-01 00:00:00+00' AND created_at <= TIMESTAMPTZ '2024-01-01 00:00:00+00'
    AND list_contains({TOKENS_SQL.format("content")}, 'ledger')""")
def search_time_range(spark, d):
    rows = memories(spark, d).where(filters.not_rejected() & filters.within("created_at", "2023-06-01 00:00:00", "2024-01-01 00:00:00"))
    return rows.where(filters.matches_all(lexemes(F.col("content")), F.array(F.lit("ledger")))).select("id", "type")


@query()
def english_time_range(spark, d):
    rows = memories(spark, d).where(filters.not_rejected() & filters.within("created_at", "2023-06-01 00:00:00", "2024-01-01 00:00:00"))
    asked = spark.range(1).select(lexemes(F.lit("the ledgers"), "english").alias("q")).first()["q"]
    return rows.where(filters.matches_all(lexemes(F.col("content"), "english"), F.array(*map(F.lit, asked)))).select("id", "type")


@query("SELECT project_scope, count(*)::BIGINT AS n FROM memories WHERE project_scope IN ('scope-fabubrigri', 'global') GROUP BY 1")
def scope_union(spark, d):
    rows = memories(spark, d).where(filters.in_scopes(filters.read_scopes("scope-fabubrigri")))
    return rows.groupBy("project_scope").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT project_scope FROM memories")
def scopes(spark, d):
    return memories(spark, d).select("project_scope").distinct()


@query(f"""WITH {EDGES_SQL}, w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')) AS w FROM memories)
    SELECT n.id AS edge_id, round(len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(list_distinct(list_concat(a.w, b.w))), 1), 6) AS similarity
    FROM now_valid n JOIN w a ON a.id = n.from_memory_id JOIN w b ON b.id = n.to_memory_id""")
def jaccard_pairs(spark, d):
    rows = memories(spark, d).select("id", word_set(F.col("content")).alias("w"))
    both = edges.with_ends(edges.valid(edges.clean_edges(table(spark, d, "memory_edges"))), rows, ["w"])
    return both.select(F.col("id").alias("edge_id"), F.round(jaccard(F.col("from_w"), F.col("to_w")), 6).alias("similarity"))


@query(f"WITH {EDGES_SQL} SELECT id AS edge_id, substr(sha256(least(from_memory_id, to_memory_id) || '|' || greatest(from_memory_id, to_memory_id)), 1, 16) AS pair_hash FROM edges")
def pair_hashes(spark, d):
    rows = edges.clean_edges(table(spark, d, "memory_edges"))
    return rows.select(F.col("id").alias("edge_id"), pair_hash(F.col("from_memory_id"), F.col("to_memory_id")).alias("pair_hash"))


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(content, '<!--.*?-->', '', 'gs'), '\[see also:.*?\]', '', 'gsi'), '\s+', ' ', 'g'))"


@query(f"SELECT id, sha256({_NORMAL}) AS computed, sha256({_NORMAL}) = lower(fingerprint) AS agrees FROM memories")
def fingerprints(spark, d):
    own = fingerprint(F.col("content"))
    return memories(spark, d).select("id", own.alias("computed"), (own == F.lower("fingerprint")).alias("agrees"))


@query(f"SELECT tier, count(*)::BIGINT AS n FROM memories WHERE created_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 365 DAY GROUP BY 1")
def older_than_a_year(spark, d):
    return memories(spark, d).where(filters.older_than("created_at", 365, as_of())).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
