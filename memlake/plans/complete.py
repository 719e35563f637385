"""Queries of whole answers, checks before writing, hints, reply readers, evaluation views, writes by key and compile runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import cascade, corpus, edges, entities, filters, guard, lint, measures, report, retrieve
from memlake.operators import compile as compiled
from memlake.plans.assess import J, judged
from memlake.plans.base import EDGES_SQL, LINKS_SQL, TOKENS_SQL, as_of, memories, query, query_batch
from memlake.plans.retrieval import RW, WORDS_SQL, W
from memlake.plans.upkeep import _LINT, edge_rows
from memlake.plans.writes import _NORMAL
from memlake.sources import backup, store
from memlake.sources.tables import table


def links(spark, d):
    return entities.clean_links(table(spark, d, "memory_entities"))


def ask(spark, d, **settings):
    return retrieve.answer(memories(spark, d), edge_rows(spark, d), links(spark, d), table(spark, d, "entities"), query_batch(spark, d), mode="simple", **settings)


_SIGNALS = """told AS (SELECT memory_id, count(DISTINCT kind || other_id) AS n_signals FROM (
        SELECT 'contradicts' AS kind, from_memory_id AS memory_id, to_memory_id AS other_id FROM now_valid WHERE relation = 'contradicts' AND from_memory_id IN (SELECT id FROM given)
        UNION ALL SELECT 'superseded_by', to_memory_id, from_memory_id FROM now_valid WHERE relation = 'supersedes'
            AND (from_memory_id IN (SELECT id FROM given) OR to_memory_id IN (SELECT id FROM given))) GROUP BY 1),
    linked AS (SELECT memory_id, count(DISTINCT canonical_name || ':' || confidence::VARCHAR) AS n_entities FROM links l JOIN entities n ON n.id = l.entity_id GROUP BY 1)"""


@query(f"""{RW}, {EDGES_SQL}, {LINKS_SQL}, given AS (SELECT p.query_id, p.id, c.score, c.match_type, p.position FROM picks p JOIN c ON c.query_id = p.query_id AND c.id = p.id WHERE p.position <= 5), {_SIGNALS}
    SELECT query_id, id, floor(score * 1000 + 0.5) / 1000 AS score, match_type, position, 'semantic' AS search_mode, coalesce(n_signals, 0)::BIGINT AS signals, coalesce(n_entities, 0)::BIGINT AS entities
    FROM given g LEFT JOIN told t ON t.memory_id = g.id LEFT JOIN linked k ON k.memory_id = g.id""")  # fmt: skip
def answer_full(spark, d):
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    rows = ask(spark, d, k=5).withColumn("signals", F.coalesce("signals", F.array())).withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    return rows.select("query_id", "id", "score", "match_type", "position", "search_mode", count("signals"), count("entities"))


@query(f"""SELECT id, created_at FROM memories WHERE type <> 'rejection' AND type = 'context' AND project_scope IN ('global') AND created_at >= TIMESTAMPTZ '2023-02-01 00:00:00+00'
    AND list_contains({TOKENS_SQL.format("content")}, 'the') AND list_has_any(topics, ['memory', 'deploy', 'docs', 'index', 'queue']) ORDER BY created_at DESC NULLS FIRST, id LIMIT 20""")
def search_all(spark, d):
    rows = retrieve.search(memories(spark, d), "the", kind="context", topics=["memory", "deploy", "docs", "index", "queue"], since="2023-02-01 00:00:00", scopes=["global"], mode="simple")
    return rows.select("id", "created_at")


@query("SELECT project_scope, CASE WHEN count(embedding) > 0 THEN 'semantic' ELSE 'fulltext_only' END AS search_mode FROM memories WHERE project_scope IN ('global', 'scope-fabubrigri', 'no-such-scope') GROUP BY 1")
def search_modes(spark, d):
    rows = [(s, retrieve.search_mode(memories(spark, d), True, [s])) for s in ("global", "scope-fabubrigri")]
    return spark.createDataFrame(rows, "project_scope string, search_mode string")


@query(f"""{W}, best AS (SELECT query_id, id, score FROM weighted WHERE raw_score >= 0.8 AND rank <= 30 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1)
    SELECT q.query_id, b.id, b.score, CASE WHEN b.score >= 0.92 THEN 'NOOP' WHEN b.score >= 0.8 THEN 'UPDATE' ELSE 'ADD' END AS operation FROM q LEFT JOIN best b USING (query_id)""")  # fmt: skip
def nearest_operation(spark, d):
    rows = retrieve.nearest_records(memories(spark, d), query_batch(spark, d).withColumn("kind", F.lit("observation")))
    return rows.select("query_id", "id", "score", "operation")


@query(f"""{_LINT}, k AS (SELECT f.*, CASE f."check" WHEN 'contradictions' THEN (-f.confidence * 1000000)::BIGINT WHEN 'drift' THEN -len(list_filter(coalesce(a.topics, []), lambda t: t IS NOT NULL AND list_contains(coalesce(b.topics, []), t)))
            WHEN 'superseded_unflagged' THEN -(epoch_us(b.created_at) - epoch_us(a.created_at)) ELSE coalesce(epoch_us(a.created_at), 4611686018427387904) END AS k1,
        CASE f."check" WHEN 'drift' THEN -coalesce(epoch_us(a.created_at), -4611686018427387904) ELSE 0 END AS k2
        FROM found f LEFT JOIN memories a ON a.id = f.memory_id LEFT JOIN memories b ON b.id = f.other_id)
    SELECT "check", memory_id, other_id, confidence, action, row_number() OVER (PARTITION BY "check" ORDER BY k1 NULLS FIRST, k2, memory_id, other_id NULLS FIRST)::INT AS place FROM k QUALIFY place <= 20""")  # fmt: skip
def lint_ordered(spark, d):
    found = lint.lint(memories(spark, d), table(spark, d, "memory_edges"), as_of())
    return lint.ordered(found, memories(spark, d), 20)


def contradictions_with_topic(spark, d):
    first = memories(spark, d).select(F.col("id").alias("memory_id"), F.try_element_at("topics", F.lit(1)).alias("topic"))
    return lint.contradictions(memories(spark, d), edge_rows(spark, d)).join(first, "memory_id")


_TOPICS = """topics AS (SELECT m.topics[1] AS topic, count(*)::BIGINT AS n FROM found f JOIN memories m ON m.id = f.memory_id
    WHERE f."check" = 'contradictions' AND coalesce(m.topics[1], '') <> '' GROUP BY 1 ORDER BY n DESC, topic LIMIT 3)"""


@query(f"{_LINT}, {_TOPICS} SELECT topic, n FROM topics")
def contradicted_topics(spark, d):
    return report.contradicted_topics(contradictions_with_topic(spark, d))


@query(f"{_LINT}, {_TOPICS} SELECT 'compile' AS name, 'compile --topic=' || topic AS usage, 'Contradictions on this topic; recompile the wiki view' AS why FROM topics")
def hints_after_lint(spark, d):
    return report.after_lint(contradictions_with_topic(spark, d))


@query(f"""WITH {EDGES_SQL} SELECT 'lint' AS name, 'lint --check=contradictions --memory-id=' || from_memory_id AS usage, 'recall flagged a contradiction on this memory; lint diagnoses it' AS why
    FROM now_valid WHERE relation = 'contradicts' GROUP BY from_memory_id ORDER BY min(id), from_memory_id LIMIT 3""")
def hints_after_recall(spark, d):
    told = edges.signals(edge_rows(spark, d), memories(spark, d)).withColumn("place", F.col("edge_id"))
    return report.after_recall(told)


@query(r"""SELECT id, 'recall' AS name, 'recall --query=' || to_json(trim(regexp_replace(substr(content, 1, 80), '\s+', ' ', 'g')))::VARCHAR || ' --tier=' || tier AS usage,
    'Verify the memory was indexed correctly' AS why FROM memories WHERE trim(content) <> ''""")
def hints_after_remember(spark, d):
    return report.after_remember(memories(spark, d))


@query(f"""WITH {LINKS_SQL} SELECT 'recall' AS name, 'recall --entity=' || canonical_name AS usage, 'Confirm the newly extracted entity links to expected memories' AS why
    FROM links l JOIN entities e ON e.id = l.entity_id ORDER BY coalesce(confidence, 0) DESC, canonical_name LIMIT 1""")
def hints_after_extraction(spark, d):
    named = links(spark, d).join(table(spark, d, "entities").select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    return report.after_extraction(named.select("canonical_name", "confidence"))


@query(f"""SELECT id, CASE WHEN regexp_matches(x, '{guard.SECRET[4:].replace("'", "''")}', 'i') THEN 'secret' WHEN regexp_matches(x, '{guard.HEALTH[4:].replace("'", "''")}', 'i') THEN 'health' END AS reason
    FROM (SELECT id, content || CASE WHEN id < '1' THEN ' password: x1' WHEN id < '3' THEN ' saw the doctor' ELSE '' END || ' ' || coalesce(array_to_string(list_filter(topics, lambda t: t IS NOT NULL), ' '), '') AS x FROM memories) WHERE reason IS NOT NULL""")
def refused_texts(spark, d):
    told = F.concat("content", F.when(F.col("id") < "1", F.lit(" password: x1")).when(F.col("id") < "3", F.lit(" saw the doctor")).otherwise(F.lit("")))
    return memories(spark, d).select("id", guard.refusal(told, F.coalesce("topics", F.array().cast("array<string>"))).alias("reason")).where("reason IS NOT NULL")


@query(f"""WITH f AS (SELECT doc_id, {_NORMAL.format("text")} AS x FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g') AS text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '<!--|\\[see', 'i')))
    SELECT doc_id, CASE WHEN x = '' THEN 'no-prompt' WHEN regexp_matches(x, '{guard.ACKNOWLEDGED[4:].replace("'", "''")}', 'i') THEN 'acknowledgement' WHEN doc_id % 2 = 0 AND length(x) < 200 THEN 'too-small' WHEN doc_id % 5 >= 4 THEN 'cap' END AS reason FROM f""")
def skip_reasons(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"(?i)<!--|\[see"))
    return rows.select("doc_id", guard.skip_reason(F.col("text"), F.col("doc_id") % 2, F.col("doc_id") % 5, 4).alias("reason"))


@query("SELECT project_scope IN ('global', 'scope-fabubrigri') AS may_leave, count(*)::BIGINT AS n FROM memories GROUP BY 1")
def egress_scopes(spark, d):
    allowed = guard.allowed_scopes("global, scope-fabubrigri,")
    return memories(spark, d).groupBy(guard.may_leave(sorted(allowed)).alias("may_leave")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT tier, round(sum({WORDS_SQL.format('content')} / 1000000.0::DOUBLE * 3 + 200 / 1000000.0::DOUBLE * 15), 9) AS usd FROM memories GROUP BY 1")
def token_prices(spark, d):
    priced = guard.token_price("medium", text.estimate_tokens(F.col("content")), F.lit(200))
    return memories(spark, d).groupBy("tier").agg(F.round(F.sum(priced), 9).alias("usd"))


@query(f"""{J} SELECT 'pass' AS metric, round(count(*) FILTER (probability >= 0.5)::DOUBLE / count(*), 6) AS value FROM judged
    UNION ALL SELECT 'cost', round(sum(latency * 0.000001::DOUBLE) / count(*) * 1000, 6) FROM judged""")
def pass_rate_and_cost(spark, d):
    rows = judged(spark, d).withColumn("cost", F.col("latency") * 0.000001)
    one = measures.pass_rate(rows, 0.5).select(F.lit("pass").alias("metric"), F.round("pass_rate", 6).alias("value"))
    return one.unionByName(measures.cost_per_thousand(rows, "cost").select(F.lit("cost").alias("metric"), F.round("cost_per_1k_usd", 6).alias("value")))


_STAGED = f"""{J}, staged AS (SELECT id, probability, CASE WHEN id < '8' THEN truth END AS truth_pass, CASE WHEN id < 'c' THEN relation END AS truth_relation,
    CASE WHEN id >= '4' THEN CASE WHEN probability >= 0.7 THEN relation ELSE 'related_to' END END AS relation, probability AS confidence FROM judged),
    views AS (SELECT 'gate' AS view, truth_pass::VARCHAR AS actual, (probability >= 0.5)::VARCHAR AS predicted, greatest(probability, 1 - probability) AS confidence FROM staged WHERE truth_pass IS NOT NULL
        UNION ALL SELECT 'fixed', truth_relation, relation, confidence FROM staged WHERE truth_relation IS NOT NULL AND relation IS NOT NULL
        UNION ALL SELECT 'cascade', truth_relation, CASE WHEN probability >= 0.5 AND relation IS NOT NULL THEN relation ELSE 'none' END, NULL FROM staged WHERE truth_relation IS NOT NULL)"""


def staged(spark, d):
    relation = F.when(F.col("probability") >= 0.7, F.col("relation")).otherwise("related_to")
    return judged(spark, d).select(
        F.col("id").alias("pair_id"), "probability", F.when(F.col("id") < "8", F.col("truth")).alias("truth_pass"), F.when(F.col("id") < "c", F.col("relation")).alias("truth_relation"),
        F.when(F.col("id") >= "4", relation).alias("relation"), F.col("probability").alias("confidence"),
    )


@query(f"{_STAGED} SELECT view, actual, predicted, count(*)::BIGINT AS n, round(coalesce(sum(confidence), 0), 4) AS confidence FROM views GROUP BY 1, 2, 3")
def stage_judgments(spark, d):
    rows = measures.stage_judgments(staged(spark, d))
    return rows.groupBy("view", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("confidence"), F.lit(0.0)), 4).alias("confidence"))


_LABELS = (*edges.RELATIONS, "none")
_LABELS_SQL = "labels(label) AS (VALUES " + ", ".join(f"('{x}')" for x in _LABELS) + ")"


@query(f"{_STAGED}, {_LABELS_SQL} SELECT a.label AS actual, p.label AS predicted, count(v.view)::BIGINT AS n FROM labels a CROSS JOIN labels p LEFT JOIN views v ON v.view = 'cascade' AND v.actual = a.label AND v.predicted = p.label GROUP BY 1, 2")
def label_confusion(spark, d):
    return measures.label_confusion(measures.stage_judgments(staged(spark, d)).where("view = 'cascade'"), _LABELS)


@query(f"""{_STAGED}, {_LABELS_SQL} SELECT l.label, count(*) FILTER (v.actual = l.label)::BIGINT AS support, round(coalesce(count(*) FILTER (v.actual = l.label AND v.predicted = l.label)::DOUBLE / nullif(count(*) FILTER (v.actual = l.label), 0), 0), 6) AS recall,
    round(coalesce(count(*) FILTER (v.actual = l.label AND v.predicted = l.label)::DOUBLE / nullif(count(*) FILTER (v.predicted = l.label), 0), 0), 6) AS precision FROM labels l CROSS JOIN (SELECT * FROM views WHERE view = 'cascade') v GROUP BY 1""")  # fmt: skip
def label_scores(spark, d):
    rows = measures.label_scores(measures.stage_judgments(staged(spark, d)).where("view = 'cascade'"), _LABELS)
    return rows.select("label", "support", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '^---\n.*?\n---\n', '', 's'), '(?m)^#{1,6}\s.*$', '', 'g'), '<m:[a-zA-Z0-9-]+>|\[m:[a-zA-Z0-9-]+\]', '', 'g'), '[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))) AS body
    FROM (SELECT doc_id, '---' || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || '---' || chr(10) || '# Title' || chr(10) || text || ' <m:a-1> [m:b-2]' AS body FROM documents WHERE text IS NOT NULL)""")
def stripped_bodies(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").isNotNull())
    body = F.concat(F.lit("---\nsource: "), F.coalesce("source", F.lit("")), F.lit("\n---\n# Title\n"), "text", F.lit(" <m:a-1> [m:b-2]"))
    return rows.select("doc_id", F.sha2(text.body_text(body), 256).alias("body"))


@query("""SELECT e.type, count(*)::BIGINT AS read, sum(CASE WHEN e.type = 'decision' THEN 1 ELSE 0 END)::BIGINT AS dropped, sum(len(list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL)))::BIGINT AS aliases FROM entities e GROUP BY 1""")
def extraction_replies(spark, d):
    rows = table(spark, d, "entities")
    new = F.array(F.struct("type", "canonical_name", "aliases", F.lit(1.4).alias("confidence")))
    none = F.array().cast("array<struct<type: string, canonical_name: string, aliases: array<string>, confidence: double>>")
    reply = F.to_json(F.struct(none.alias("matched"), new.alias("new_entities")))
    read = rows.select("type", "aliases", text.extraction_reply(reply, ("project", "person", "tool")).alias("r")).where("r.error IS NULL")
    kept = F.coalesce(F.size(F.try_element_at("r.new_entities", F.lit(1))["aliases"]), F.size(F.array_compact(F.coalesce("aliases", F.array().cast("array<string>")))))
    return read.groupBy("type").agg(F.count(F.lit(1)).alias("read"), F.sum("r.dropped").alias("dropped"), F.sum(kept).alias("aliases"))


@query(f"""WITH {EDGES_SQL} SELECT relation, trim('so ' || relation || ': ' || coalesce(rationale, '')) AS rationale, count(*)::BIGINT AS n FROM edges GROUP BY 1, 2""")
def relation_replies(spark, d):
    said = F.concat(F.lit("so "), "relation", F.lit(": "), F.coalesce("rationale", F.lit("")))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.upper("relation").alias("relation"), F.lit(0.5).alias("confidence"), said.alias("rationale"))), F.lit("\n```"))
    rows = edge_rows(spark, d).select(text.relation_reply(reply, edges.RELATIONS).alias("r")).where("r.error IS NULL")
    return rows.groupBy("r.relation", "r.rationale").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, CASE WHEN id < '8' THEN true WHEN id < 'c' THEN false END AS verdict FROM memories""")
def reply_verdicts(spark, d):
    reply = F.when(F.col("id") < "8", F.lit("**Answer: yes**, they are")).when(F.col("id") < "c", F.lit("`NO` - they differ")).otherwise(F.lit("maybe, yes"))
    return memories(spark, d).select("id", text.verdict(reply).alias("verdict"))


@query(f"""WITH {EDGES_SQL}, changed AS (SELECT m.id, 'changed: ' || coalesce(e.rationale, '') AS content FROM memories m JOIN (SELECT to_memory_id, min(rationale) AS rationale FROM edges WHERE relation = 'evolved_into' GROUP BY 1) e ON e.to_memory_id = m.id)
    SELECT m.id, coalesce(c.content, m.content) AS content, CASE WHEN c.id IS NULL THEN m.fingerprint ELSE sha256({_NORMAL.format("c.content")}) END AS fingerprint,
        CASE WHEN c.id IS NOT NULL THEN TIMESTAMPTZ '2025-03-01 00:00:00+00' ELSE m.updated_at END AS updated_at FROM memories m LEFT JOIN changed c ON c.id = m.id""")  # fmt: skip
def updated_records(spark, d):
    told = edge_rows(spark, d).where("relation = 'evolved_into'").groupBy(F.col("to_memory_id").alias("id")).agg(F.min("rationale").alias("why"))
    changes = memories(spark, d).join(told, "id").select("id", "project_scope", F.concat(F.lit("changed: "), F.coalesce("why", F.lit(""))).alias("content"))
    return store.updated(memories(spark, d), changes, as_of()).select("id", "content", "fingerprint", "updated_at")


@query("""SELECT id, list_sort(list_distinct(list_concat(list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL), [upper(canonical_name), canonical_name]))) AS aliases FROM entities""")
def added_aliases(spark, d):
    rows = table(spark, d, "entities")
    more = rows.select(F.col("id").alias("entity_id"), F.explode(F.array(F.upper("canonical_name"), F.col("canonical_name"))).alias("alias"))
    return entities.with_aliases(rows, more).select("id", F.array_compact("aliases").alias("aliases"))


@query(f"""WITH {LINKS_SQL}, incoming AS (SELECT m.id AS memory_id, e.id AS entity_id FROM memories m, entities e WHERE list_contains(m.people, e.canonical_name)),
    after AS (SELECT memory_id, entity_id FROM links UNION SELECT memory_id, entity_id FROM incoming)
    SELECT entity_id, count(*)::BIGINT AS n FROM after GROUP BY 1""")
def added_links(spark, d):
    named = table(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    own = links(spark, d)
    mentions = memories(spark, d).select(F.col("id").alias("memory_id"), F.explode("people").alias("name")).join(named, "name")
    incoming = mentions.select("memory_id", "entity_id", F.lit(0.5).cast("decimal(3,2)").alias("confidence"), F.lit("people").alias("source"), as_of().alias("created_at"))
    return entities.inserted_links(own, incoming.select(own.columns)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM memories WHERE id < '4')::BIGINT AS skipped, (SELECT count(*) FROM (SELECT DISTINCT project_scope, fingerprint FROM memories))::BIGINT AS keys")
def imported_rows(spark, d):
    rows = memories(spark, d)
    after, fresh = backup.inserted(rows, rows.where("id < '4'"), "memories")
    return after.agg((F.lit(0) + F.count_if(F.col("id") < "4")).alias("skipped"), F.countDistinct("project_scope", "fingerprint").alias("keys"))


@query("""SELECT t AS topic, trim(regexp_replace(list_aggregate(list_transform(list_filter(regexp_split_to_array(t, '[-_\\s]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' '), '', '')) AS title
    FROM (SELECT DISTINCT unnest(topics) AS t FROM memories) WHERE t IS NOT NULL AND trim(t) <> ''""")
def titles(spark, d):
    rows = memories(spark, d).select(F.explode("topics").alias("topic")).distinct().where(F.trim("topic") != "")
    return rows.select("topic", text.topic_title(F.col("topic")).alias("title"))


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '## ') OR starts_with(l, '### ')) AS headers FROM documents WHERE text IS NOT NULL")
def header_lines(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", text.headers(F.col("text")).alias("headers"))


@query(f"""WITH {EDGES_SQL}, m AS (SELECT id FROM memories WHERE type <> 'archived' AND project_scope = 'global')
    SELECT CASE WHEN from_memory_id IN (SELECT id FROM m) THEN from_memory_id ELSE to_memory_id END AS memory_id, id AS edge_id FROM edges WHERE from_memory_id IN (SELECT id FROM m) OR to_memory_id IN (SELECT id FROM m)""")
def compile_edges(spark, d):
    _, touching = compiled.loaded(memories(spark, d), edge_rows(spark, d), "global")
    return touching.select("memory_id", F.col("id").alias("edge_id"))


_TOPIC = "coalesce(list_min(list_filter(topics, lambda t: t IS NOT NULL AND t <> '')), 'uncategorized')"


@query(f"""WITH {EDGES_SQL}, m AS (SELECT id, {_TOPIC} AS topic FROM memories WHERE type <> 'archived')
    SELECT a.topic, e.from_memory_id, e.to_memory_id, '- ' || e.from_memory_id || ' ' || replace(e.relation, 'evolved_into', 'evolved into') || ' ' || e.to_memory_id || ' — ' || coalesce(e.rationale, '') AS note
    FROM edges e JOIN m a ON a.id = e.from_memory_id JOIN m b ON b.id = e.to_memory_id AND b.topic = a.topic WHERE e.relation IN ('supersedes', 'contradicts', 'evolved_into')""")
def edge_notes(spark, d):
    members = memories(spark, d).where("type <> 'archived'").select(compiled.primary_topic(F.col("topics")).alias("topic"), "id")
    return report.edge_notes(edge_rows(spark, d), members)


@query(f"""SELECT tier, {_TOPIC} AS topic, count(*)::BIGINT AS entries FROM memories WHERE type <> 'archived' AND content IS NOT NULL AND tier IN ('preferences', 'project-context', 'conversations') GROUP BY 1, 2""")
def tier_sections(spark, d):
    rows = compiled.tier_documents(memories(spark, d).where("type <> 'archived'"), edge_rows(spark, d))
    entries = F.size(F.regexp_extract_all("body", F.lit("<m:[0-9a-f-]{36}>"), 0))
    return rows.groupBy("tier", "topic").agg(F.sum(entries).cast("long").alias("entries"))


@query(f"""WITH t AS (SELECT DISTINCT {_TOPIC} AS topic FROM memories WHERE type <> 'archived' AND content IS NOT NULL), tiers AS (SELECT DISTINCT tier, {_TOPIC} AS topic FROM memories WHERE type <> 'archived' AND content IS NOT NULL)
    SELECT 'manifest' AS part, ((SELECT count(*) FROM t) + (SELECT count(*) FROM tiers))::BIGINT AS n UNION ALL SELECT 'stale', 1 UNION ALL SELECT 'documents', ((SELECT count(*) FROM t) + (SELECT count(*) FROM tiers))::BIGINT""")
def compile_everything(spark, d):
    previous = spark.createDataFrame([("gone", "topics/gone.md")], "topic string, path string")
    made, manifest, gone = compiled.compile_run(memories(spark, d), edge_rows(spark, d), previous, everything=True)
    count = lambda part, rows: rows.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return count("manifest", manifest).unionByName(count("stale", gone)).unionByName(count("documents", made))


@query(f"""{J}, s AS (SELECT probability, probability >= 0.6 AS passed, truth AS edge FROM judged WHERE id >= '4')
    SELECT t.threshold, count(*)::BIGINT AS compared, round(count(*) FILTER ((probability >= t.threshold) = passed)::DOUBLE / count(*), 6) AS agreement, count(*) FILTER (probability < t.threshold AND edge)::BIGINT AS missed_edges
    FROM s, (VALUES (0.5::DOUBLE), (0.7::DOUBLE)) t(threshold) GROUP BY 1""")
def shadow_agreement(spark, d):
    rows = judged(spark, d).select(
        F.when(F.col("id") < "4", F.lit("egress: scope")).alias("skip_reason"), "probability", (F.col("probability") >= 0.6).alias("passed"), F.col("truth").alias("edge")
    )
    return corpus.shadow_summary(rows, [0.5, 0.7]).withColumn("agreement", F.round("agreement", 6))


_HASH = "substr(sha256(least(from_memory_id, to_memory_id) || '|' || greatest(from_memory_id, to_memory_id)), 1, 16)"


@query(f"WITH {EDGES_SQL} SELECT DISTINCT {_HASH} AS pair_hash FROM edges WHERE relation = 'supports' AND {_HASH} NOT IN (SELECT {_HASH} FROM edges WHERE relation <> 'supports')")
def rejected_pairs(spark, d):
    rows = edge_rows(spark, d)
    ends = rows.where("relation = 'supports'").select(F.col("from_memory_id").alias("id_a"), F.col("to_memory_id").alias("id_b"))
    return corpus.rejected_pairs(ends, edges.with_pair_hash(ends).select("pair_hash"), rows.where("relation <> 'supports'")).select("pair_hash")


@query(f"WITH {EDGES_SQL} SELECT m.id AS pair_id, r.relation AS label FROM memories m JOIN (SELECT from_memory_id, min(relation) AS relation FROM edges WHERE from_memory_id IN (SELECT id FROM memories) GROUP BY 1) r ON r.from_memory_id = m.id")
def corpus_labels(spark, d):
    have = memories(spark, d).select(F.col("id").alias("pair_id"))
    said = edge_rows(spark, d).join(have.withColumnRenamed("pair_id", "from_memory_id"), "from_memory_id", "left_semi").groupBy(F.col("from_memory_id").alias("pair_id")).agg(F.min("relation").alias("label"))
    return corpus.matched_labels(have, said)


@query(f"""{J} SELECT count(*) FILTER (id < 'e')::BIGINT AS stage1_total, count(*) FILTER (id < 'e' AND probability >= 0.5)::BIGINT AS stage1_pass, count(*) FILTER (id < 'e' AND probability < 0.5)::BIGINT AS stage1_skip,
    count(*) FILTER (id < 'e' AND probability >= 0.5 AND relation <> 'related_to')::BIGINT AS edges, count(*) FILTER (id >= 'e')::BIGINT AS cap_reached, round(count(*) FILTER (id < 'e') * 0.0005::DOUBLE, 4) AS cost_usd FROM judged""")
def run_counters(spark, d):
    stage = F.when(F.col("id") >= "e", "cap_reached").when(F.col("probability") >= 0.5, "stage2_done").otherwise("stage1_rejected")
    rows = judged(spark, d).select(stage.alias("stage"), F.when(F.col("relation") == "related_to", "none").otherwise(F.col("relation")).alias("relation"), F.when(F.col("id") < "e", 0.0005).otherwise(0.0).alias("cost_usd"))
    return cascade.run_summary(rows)
