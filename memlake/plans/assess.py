"""Queries of evaluation metrics, sampling and compiled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions.text import estimate_tokens, levenshtein_ratio
from memlake.operators import compile as compiled
from memlake.operators import edges, measures, sensitive
from memlake.operators.sensitive import sensitive_reason
from memlake.plans.base import EDGES_SQL, memories, query
from memlake.sources.tables import table

#: Relations judged by their confidence: those that claim more than being related.
JUDGED_SQL = f"""{EDGES_SQL}, judged AS (SELECT id, relation, confidence::DOUBLE AS probability, relation <> 'related_to' AS truth,
    ((epoch_us(updated_at) - epoch_us(created_at)) / 1000000)::BIGINT AS latency FROM edges WHERE confidence IS NOT NULL)"""
J = f"WITH {JUDGED_SQL}"


def judged(spark, d):
    rows = edges.clean_edges(table(spark, d, "memory_edges")).where(F.col("confidence").isNotNull())
    seconds = F.round((F.unix_micros("updated_at") - F.unix_micros("created_at")) / F.lit(1_000_000.0)).cast("long")
    return rows.select(
        "id", "relation", F.col("confidence").cast("double").alias("probability"), (F.col("relation") != "related_to").alias("truth"), seconds.alias("latency")
    )


@query(f"""{J}, s AS (SELECT t.threshold, count(*) FILTER (probability >= t.threshold AND truth)::BIGINT AS tp, count(*) FILTER (probability >= t.threshold AND NOT truth)::BIGINT AS fp,
        count(*) FILTER (probability < t.threshold AND truth)::BIGINT AS fn, count(*) FILTER (probability < t.threshold AND NOT truth)::BIGINT AS tn
        FROM judged, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) t(threshold) GROUP BY 1)
    SELECT threshold, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision FROM s""")  # fmt: skip
def threshold_sweep(spark, d):
    rows = measures.threshold_sweep(judged(spark, d), [0.3, 0.5, 0.7, 0.9])
    return rows.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


@query(f"""WITH {EDGES_SQL}, c AS (SELECT a.type AS actual, b.type AS predicted, count(*)::BIGINT AS n FROM edges e JOIN memories a ON a.id = e.from_memory_id JOIN memories b ON b.id = e.to_memory_id GROUP BY 1, 2)
    SELECT actual, predicted, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY actual), 6) AS share_of_actual, round(n::DOUBLE / sum(n) OVER (PARTITION BY predicted), 6) AS share_of_predicted FROM c""")
def confusion_matrix(spark, d):
    both = edges.with_ends(edges.clean_edges(table(spark, d, "memory_edges")), memories(spark, d), ["type"])
    rows = measures.confusion(both.select(F.col("from_type").alias("actual"), F.col("to_type").alias("predicted")))
    return rows.withColumn("share_of_actual", F.round("share_of_actual", 6)).withColumn("share_of_predicted", F.round("share_of_predicted", 6))


_BINS = f"""{J}, b AS (SELECT least(9, greatest(0, floor(probability * 10)))::INT AS bin, probability, truth::INT::DOUBLE AS t FROM judged),
    bins AS (SELECT r.bin::INT AS bin, count(b.bin)::BIGINT AS n, coalesce(avg(probability), 0) AS confidence, coalesce(avg(t), 0) AS accuracy FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY 1)"""


@query(f"{_BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins")
def ece_bins(spark, d):
    rows = measures.calibration_bins(judged(spark, d))
    return rows.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(f"{_BINS} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM bins")
def calibration_error(spark, d):
    return measures.calibration_error(judged(spark, d)).select(F.round("ece", 6).alias("ece"))


@query(f"""{J}, grid AS (SELECT 0 AS i, 1.0::DOUBLE AS t UNION ALL SELECT r + 1, 0.25::DOUBLE + 3.75::DOUBLE * r / 150 FROM range(151) x(r)),
    v AS (SELECT i, t, round(avg(-ln(greatest(CASE WHEN truth THEN a ELSE b END / (a + b), 1e-12))), 12) AS nll FROM (
        SELECT i, t, truth, pow(greatest(probability, 1e-12), 1 / t) AS a, pow(greatest(1 - probability, 1e-12), 1 / t) AS b FROM judged, grid) GROUP BY 1, 2)
    SELECT round((SELECT t FROM v ORDER BY nll, i LIMIT 1), 6) AS temperature, round((SELECT nll FROM v WHERE i = 0), 6) AS nll_before, round(min(nll), 6) AS nll_after FROM v""")  # fmt: skip
def temperature_fit(spark, d):
    row = measures.fit_temperature(judged(spark, d))
    return row.select(*[F.round(c, 6).alias(c) for c in ("temperature", "nll_before", "nll_after")])


@query(f"""{J} SELECT round((SELECT sum(CASE WHEN p.probability > n.probability THEN 1.0::DOUBLE WHEN p.probability = n.probability THEN 0.5::DOUBLE ELSE 0 END) FROM judged p, judged n WHERE p.truth AND NOT n.truth)
    / nullif(count(*) FILTER (truth) * count(*) FILTER (NOT truth), 0), 6) AS auc FROM judged""")
def roc_auc(spark, d):
    return measures.roc_auc(judged(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(f"{J} SELECT quantile_disc(latency, 0.5)::DOUBLE AS p50, quantile_disc(latency, 0.95)::DOUBLE AS p95 FROM judged")
def latency_percentiles(spark, d):
    return measures.nearest_rank(judged(spark, d), "latency", [50, 95])


@query("""WITH p AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) AS turn, min(id) OVER (PARTITION BY type) AS first FROM memories)
    SELECT id, type FROM p ORDER BY turn, first, id LIMIT 40""")
def stratified_sample(spark, d):
    return measures.round_robin(memories(spark, d).select("id", "type"), "type", "id", 40)


_TOPIC = "coalesce(list_min(list_filter(topics, lambda t: t IS NOT NULL AND t <> '')), 'uncategorized')"


@query(f"""SELECT {_TOPIC} AS topic, regexp_replace(regexp_replace(lower({_TOPIC}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS topic_slug, count(*)::BIGINT AS n, min(id) AS first_id, max(id) AS last_id
    FROM memories WHERE type <> 'archived' GROUP BY ALL""")
def topic_clusters(spark, d):
    return compiled.clusters(memories(spark, d).where("type <> 'archived'")).drop("title")


@query(r"""WITH r AS (SELECT DISTINCT id, t AS topic, coalesce(date::VARCHAR, strftime(created_at::TIMESTAMP, '%Y-%m-%d'), 'unknown') AS day, trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat
        FROM (SELECT *, unnest(topics) AS t FROM memories) WHERE t IS NOT NULL AND t <> '')
    SELECT topic, id, day, '- ' || day || ' — <m:' || id || '> ' || CASE WHEN length(flat) > 120 THEN substr(flat, 1, 117) || '...' ELSE flat END AS line,
        row_number() OVER (PARTITION BY topic ORDER BY day, id) AS place FROM r""")
def topic_timeline(spark, d):
    return compiled.timeline(memories(spark, d))


# No cluster of the tables reaches the size from which documents are written in parts; tests write smaller parts.
@query(rf"""WITH m AS (SELECT {_TOPIC} AS topic, id, coalesce(date::VARCHAR, strftime(created_at::TIMESTAMP, '%Y-%m-%d'), 'unknown') AS day, content FROM memories WHERE type <> 'archived' AND content IS NOT NULL),
    e AS (SELECT topic, day, id, '- ' || day || ' — ' || regexp_replace(string_split(content, '. ')[1], '^\s+|\s+$', '', 'g') || ' <m:' || id || '>' AS entry FROM m)
    SELECT topic, 'topics/' || regexp_replace(regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.md' AS path,
        '# ' || array_to_string(list_transform(list_filter(regexp_split_to_array(topic, '[-_\s]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ') || chr(10) || chr(10) || '## Timeline' || chr(10) || chr(10)
        || string_agg(entry, chr(10) ORDER BY day, id, entry) || chr(10) AS body FROM e GROUP BY topic""")  # fmt: skip
def compiled_documents(spark, d):
    return compiled.documents(memories(spark, d).where("type <> 'archived'"))


@query(f"""WITH r AS (SELECT id, list_filter(coalesce(topics, []), lambda t: list_contains({list(sensitive.TOPICS)}, lower(t)))[1] AS t,
        CASE WHEN regexp_matches(section, '{sensitive.SECTION}') THEN section END AS s, nullif(lower(regexp_extract(content, '{sensitive.TEXT}', 0)), '') AS x FROM memories)
    SELECT id, coalesce('topic:' || t, 'section:' || s, 'text:' || x) AS reason FROM r WHERE coalesce(t, s, x) IS NOT NULL""")
def sensitive_filter(spark, d):
    rows = memories(spark, d).select("id", sensitive_reason(F.col("topics"), F.col("section"), F.col("content")).alias("reason"))
    return rows.where(F.col("reason").isNotNull())


@query(f"""WITH {EDGES_SQL} SELECT e.id, round(CASE WHEN greatest(length(a.section), length(b.section)) = 0 THEN 1 ELSE 1 - levenshtein(a.section, b.section)::DOUBLE / greatest(length(a.section), length(b.section)) END, 6) AS ratio
    FROM edges e JOIN memories a ON a.id = e.from_memory_id JOIN memories b ON b.id = e.to_memory_id WHERE a.section IS NOT NULL AND b.section IS NOT NULL""")
def levenshtein_ratios(spark, d):
    both = edges.with_ends(edges.clean_edges(table(spark, d, "memory_edges")), memories(spark, d), ["section"])
    both = both.where(F.col("from_section").isNotNull() & F.col("to_section").isNotNull())
    return both.select("id", F.round(levenshtein_ratio(F.col("from_section"), F.col("to_section")), 6).alias("ratio"))


@query(r"""SELECT id, ceil(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT AS tokens FROM memories""")
def token_estimates(spark, d):
    return memories(spark, d).select("id", estimate_tokens(F.col("content")).alias("tokens"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_daily(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
