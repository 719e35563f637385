"""Consistency checks over records and relations: findings of one shape, and the set-based fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.edges import clean_edges, shared_topic_bags, valid, with_ends
from memlake.operators.filters import older_than

CHECKS = ("contradictions", "stale", "orphans", "drift", "superseded_unflagged")
FIX_AT = 0.9


def finding(df: DataFrame, check: str, memory: str, other: Column, confidence: Column, action: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), F.col(memory).alias("memory_id"), other.cast("string").alias("other_id"),
        confidence.cast("double").alias("confidence"), action.alias("action"),
    )


def unarchived(records: DataFrame) -> DataFrame:
    return records.where(F.col("type") != "archived")


def contradictions(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Valid contradictions within a scope: the newer end may supersede, otherwise one end may go."""
    both = with_ends(valid(edges).where("relation = 'contradicts'"), unarchived(records), ["created_at", "project_scope"]).where("from_project_scope = to_project_scope")
    sure = F.col("confidence").cast("double")
    action = F.when((F.col("from_created_at") > F.col("to_created_at")) & (sure >= 0.7), "add_supersedes_edge").when(sure >= 0.85, "archive_one").otherwise("human_review")
    return finding(both, "contradictions", "from_memory_id", F.col("to_memory_id"), sure, action)


def stale(records: DataFrame, edges: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Old rows of a long-lived tier that no valid edge leads to; surer without outgoing edges either."""
    now = valid(edges)
    into = now.select(F.col("to_memory_id").alias("id")).distinct()
    out = now.select(F.col("from_memory_id").alias("id")).distinct().withColumn("leads", F.lit(True))
    old = unarchived(records).where(older_than("created_at", days, as_of) & (F.col("tier") == "project-context"))
    rows = old.join(into, "id", "left_anti").join(out, "id", "left")
    return finding(rows, "stale", "id", F.lit(None), F.when(F.col("leads"), 0.7).otherwise(0.95), F.lit("archive"))


def orphans(records: DataFrame, edges: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Rows older than some days at no end of a valid edge: one anti join against the union of both ends."""
    now = valid(edges)
    ends = now.select(F.col("from_memory_id").alias("id")).union(now.select("to_memory_id")).distinct()
    rows = unarchived(records).where(older_than("created_at", days, as_of)).join(ends, "id", "left_anti")
    return finding(rows, "orphans", "id", F.lit(None), F.lit(0.6), F.lit("human_review"))


def drift(records: DataFrame, edges: DataFrame, days: int = 30) -> DataFrame:
    """Records that share two topics over a gap of days, with no edge of any validity between them."""
    later = F.col("a.created_at") > F.col("b.created_at") + F.expr(f"INTERVAL {int(days)} DAYS")
    pairs = shared_topic_bags(unarchived(records), residual=later, columns=["created_at"])
    linked = edges.select(F.least("from_memory_id", "to_memory_id").alias("x"), F.greatest("from_memory_id", "to_memory_id").alias("y")).distinct()
    free = pairs.withColumn("x", F.least("id_a", "id_b")).withColumn("y", F.greatest("id_a", "id_b")).join(linked, ["x", "y"], "left_anti")
    return finding(free, "drift", "id_a", F.col("id_b"), F.lit(0.55), F.lit("reclassify"))


def superseded_unflagged(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Old versions that are still unarchived; surer with a shared topic (repeats counted) and 90 rounded days between."""
    both = with_ends(valid(edges).where("relation = 'supersedes'"), unarchived(records), ["created_at", "project_scope", "topics"]).where("from_project_scope = to_project_scope")
    gap = F.round((F.unix_micros("from_created_at") - F.unix_micros("to_created_at")) / F.lit(86_400_000_000.0))
    shared = F.size(F.filter(F.coalesce("from_topics", F.array().cast("array<string>")), lambda t: F.coalesce(F.array_contains(F.coalesce("to_topics", F.array().cast("array<string>")), t), F.lit(False))))
    return finding(both, "superseded_unflagged", "to_memory_id", F.col("from_memory_id"), F.when((shared >= 1) & (gap >= 90), 0.92).otherwise(0.85), F.lit("archive"))


def lint(records: DataFrame, raw_edges: DataFrame, as_of: Column) -> DataFrame:
    edges = clean_edges(raw_edges)
    parts = [contradictions(records, edges), stale(records, edges, as_of), orphans(records, edges, as_of), drift(records, edges), superseded_unflagged(records, edges)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered(findings: DataFrame, records: DataFrame, limit: int = 100) -> DataFrame:
    """The first `limit` findings of each check with their place: contradictions by confidence, stale rows and orphans the oldest first,
    drift by shared topics and then the newest, unflagged versions by the widest gap; ties by the ids."""
    empty = F.array().cast("array<string>")
    end = lambda key, s: records.select(F.col("id").alias(key), F.unix_micros("created_at").alias(f"at_{s}"), F.coalesce("topics", empty).alias(f"topics_{s}"))
    both = findings.join(end("memory_id", "a"), "memory_id", "left").join(end("other_id", "b"), "other_id", "left")
    shared = F.size(F.filter("topics_a", lambda t: F.coalesce(F.array_contains("topics_b", t), F.lit(False))))
    late = F.lit(2**62)
    keys = {
        "contradictions": (-F.col("confidence") * 1_000_000, F.lit(0)),
        "stale": (F.coalesce("at_a", late), F.lit(0)),
        "orphans": (F.coalesce("at_a", late), F.lit(0)),
        "drift": (-shared, -F.coalesce("at_a", -late)),
        "superseded_unflagged": (-(F.col("at_b") - F.col("at_a")), F.lit(0)),
    }
    first, second = (F.coalesce(*[F.when(F.col("check") == c, k[i].cast("long")) for c, k in keys.items()]) for i in (0, 1))
    order = Window.partitionBy("check").orderBy("_first", "_second", "memory_id", F.asc_nulls_first("other_id"))
    placed = both.withColumn("_first", first).withColumn("_second", second).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return placed.select("check", "memory_id", "other_id", "confidence", "action", "place")


def summary(findings: DataFrame) -> DataFrame:
    """(check, findings, fixable) with a row for each check."""
    row = findings.groupBy("check").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("confidence") >= FIX_AT).alias("fixable"))
    names = findings.sparkSession.createDataFrame([(c,) for c in CHECKS], "check string")
    return F.broadcast(names).join(row, "check", "left").na.fill(0, ["findings", "fixable"])


def fixed_records(records: DataFrame, findings: DataFrame) -> DataFrame:
    """Records with those archived that a sure finding asks to archive."""
    due = findings.where((F.col("confidence") >= FIX_AT) & (F.col("action") == "archive")).select(F.col("memory_id").alias("id")).distinct().withColumn("_due", F.lit(True))
    return records.join(due, "id", "left").withColumn("type", F.when(F.col("_due"), "archived").otherwise(F.col("type"))).drop("_due").select(*records.columns)


def fixed_edges(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """Edges with sure contradictions turned into supersedes, except where that edge exists already."""
    due = findings.where((F.col("confidence") >= FIX_AT) & (F.col("action") == "add_supersedes_edge")).select(
        F.col("memory_id").alias("from_memory_id"), F.col("other_id").alias("to_memory_id"), F.lit("contradicts").alias("relation"), F.lit(True).alias("_due")
    ).distinct()
    there = edges.where("relation = 'supersedes'").select("from_memory_id", "to_memory_id", F.lit(True).alias("_there")).distinct()
    out = edges.join(due, ["from_memory_id", "to_memory_id", "relation"], "left").join(there, ["from_memory_id", "to_memory_id"], "left")
    return out.withColumn("relation", F.when(F.col("_due") & F.col("_there").isNull(), "supersedes").otherwise(F.col("relation"))).select(*edges.columns)
