"""Corpus statistics and maintenance counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.edges import shared_topic_bags
from memlake.operators.filters import older_than

TIERS = ("preferences", "project-context", "conversations")
#: Types that the report names; archived rows count in the total only.
TYPES = ("preference", "decision", "context", "relationship", "observation", "rejection")
STALE_DAYS = {"conversations": 90, "project-context": 180}


def counted(records: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """(column, n) for the named values in one aggregate, 0 where there are none."""
    row = records.agg(*[F.count_if(F.col(column) == k).alias(k) for k in keys])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias(column), F.col(f"`{k}`").alias("n")) for k in keys])).alias("x")).select("x.*")


def overview(records: DataFrame, as_of: Column) -> DataFrame:
    """All scalar statistics in one pass: total, with and without vector, oldest row, mean age in days, last write."""
    age = (F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(86_400_000_000.0)
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("embedding").isNotNull()).alias("with_embedding"),
        F.count_if(F.col("embedding").isNull()).alias("without_embedding"),
        F.min("created_at").alias("oldest"),
        F.round(F.avg(age), 2).alias("mean_age_days"),
        F.max("updated_at").alias("last_write"),
    )


def top_values(records: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent elements of an array column; ties in order of the alphabet."""
    return (
        records.select(F.explode(column).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value").limit(n)
    )


def duplicate_fingerprints(records: DataFrame) -> DataFrame:
    """(project_scope, fingerprint, n) stored more than once in a scope."""
    return records.groupBy("project_scope", "fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def surplus(records: DataFrame) -> DataFrame:
    """One row: how many rows repeat a fingerprint of their scope."""
    return duplicate_fingerprints(records).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def stale(records: DataFrame, as_of: Column) -> DataFrame:
    """Rows past their tier's age; preferences never are, and rejections may be."""
    due = F.lit(False)
    for tier, days in STALE_DAYS.items():
        due = due | ((F.col("tier") == tier) & older_than("created_at", days, as_of))
    return records.where(due & (F.col("type") != "archived"))


def cross_references(records: DataFrame) -> DataFrame:
    """(project_scope, pairs): pairs of records that share two topics, repeats on the left counted."""
    return shared_topic_bags(records).groupBy("project_scope").agg(F.count(F.lit(1)).alias("pairs"))


def distinct_topics(records: DataFrame) -> DataFrame:
    return records.select("project_scope", F.explode("topics").alias("topic")).groupBy("project_scope").agg(F.countDistinct("topic").alias("topics"))


def topic_gaps(records: DataFrame, have: str = "preferences", lack: str = "project-context") -> DataFrame:
    """(project_scope, topic) of one tier that the other doesn't have."""
    of = lambda tier: records.where(F.col("tier") == tier).select("project_scope", F.explode("topics").alias("topic")).where(F.col("topic").isNotNull())
    return of(have).subtract(of(lack))


def maintenance(records: DataFrame, as_of: Column) -> DataFrame:
    """The dry run's counts for each scope: stale rows, surplus rows, topics, and their sum of changes."""
    late = stale(records, as_of).groupBy("project_scope").agg(F.count(F.lit(1)).alias("archived"))
    twice = duplicate_fingerprints(records).groupBy("project_scope").agg(F.sum(F.col("n") - 1).alias("deduplicated"))
    scopes = records.select("project_scope").distinct()
    return (
        scopes.join(late, "project_scope", "left").join(twice, "project_scope", "left").join(distinct_topics(records), "project_scope", "left")
        .na.fill(0).withColumn("total_changes", F.col("archived") + F.col("deduplicated"))
    )
