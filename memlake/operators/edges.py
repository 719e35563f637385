"""The typed relations between records: cleaning, candidate pairs, signals, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import pair_hash
from memlake.operators.filters import in_scopes

RELATIONS = ("supports", "contradicts", "supersedes", "evolved_into", "depends_on", "related_to")


def relation_name(relation: Column) -> Column:
    """Lower case, outer spaces cut, runs of spaces, hyphens and underscores as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(relation, r"^\s+|\s+$", "")), r"[\s\-_]+", "_")


def clean_edges(edges: DataFrame) -> DataFrame:
    """One row for each (from, to, relation), the latest; without null ends and self edges."""
    latest = Window.partitionBy("from_memory_id", "to_memory_id", "relation").orderBy(
        F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.desc("id"), F.desc_nulls_last("confidence")
    )
    return (
        edges.withColumn("relation", relation_name(F.col("relation")))
        .where(F.col("from_memory_id").isNotNull() & F.col("to_memory_id").isNotNull() & (F.col("from_memory_id") != F.col("to_memory_id")))
        .withColumn("_r", F.row_number().over(latest))
        .where("_r = 1")
        .drop("_r")
    )


def valid(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("valid_until").isNull())


def with_ends(edges: DataFrame, records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Edges with the named columns of both ends, as from_<column> and to_<column>."""
    ends = records.select("id", *columns)
    left = ends.select(F.col("id").alias("from_memory_id"), *[F.col(c).alias(f"from_{c}") for c in columns])
    right = ends.select(F.col("id").alias("to_memory_id"), *[F.col(c).alias(f"to_{c}") for c in columns])
    return edges.join(left, "from_memory_id").join(right, "to_memory_id")


def candidate_pairs(records: DataFrame, scope: str | None = None, since: Column | None = None) -> DataFrame:
    """(id_a, id_b, project_scope): pairs in one scope that share two topics or one person, as sets.

    Sharing two topics is sharing a pair of topics, so the join key is the pair: far fewer records
    stand under a pair of topics than under one frequent topic, and no pair of records is met through
    one shared topic alone. With `since`, one end must have been created after it.
    """
    base = records.where(in_scopes(None if scope is None else [scope])).select("id", "project_scope", "created_at", "topics", "people")
    topics = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("topics", F.array().cast("array<string>")))))
    people = F.array_distinct(F.array_compact(F.coalesce("people", F.array().cast("array<string>"))))
    # The i-th topic with each later one.
    doubles = F.flatten(
        F.transform(topics, lambda x, i: F.transform(F.slice(topics, i + 2, F.greatest(F.size(topics) - i - 1, F.lit(0))), lambda y: F.concat_ws("\u0001", x, y)))
    )
    keys = F.concat(F.transform(doubles, lambda x: F.concat(F.lit("t\u0001"), x)), F.transform(people, lambda x: F.concat(F.lit("p\u0001"), x)))
    rows = base.select("id", "project_scope", "created_at", F.explode(keys).alias("key")).select(
        "id", "project_scope", "created_at", F.xxhash64("project_scope", "key").alias("hash"), "key"
    )
    a, b = rows.alias("a"), rows.alias("b")
    met = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.project_scope") == F.col("b.project_scope"))
    if since is not None:
        met = met & ((F.col("a.created_at") > since) | (F.col("b.created_at") > since))
    return a.join(b, met).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.project_scope").alias("project_scope")).distinct()


def with_pair_hash(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("pair_hash", pair_hash(F.col("id_a"), F.col("id_b")))


def shared_topic_bags(records: DataFrame, least: int = 2, residual: Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """(id_a, id_b, ...) in one scope where at least two topics of a, counted with repeats, are topics of b.

    The same pair-of-topics key as above: a gives pairs of positions of its bag, b pairs from its set with repeats.
    `residual` is a condition over aliases a and b; it replaces id_a < id_b.
    """
    if least != 2:
        raise ValueError("the key holds two topics")
    empty = F.array().cast("array<string>")
    bag = F.array_sort(F.array_compact(F.coalesce("topics", empty)))
    unique = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("topics", empty))))
    later = lambda arr, i, skip: F.slice(arr, i + 1 + skip, F.greatest(F.size(arr) - i - skip, F.lit(0)))
    pairs_of = lambda arr, skip: F.array_distinct(
        F.flatten(F.transform(arr, lambda x, i: F.transform(later(arr, i, skip), lambda y: F.xxhash64(x, y))))
    )
    own = ["id", "project_scope", *columns]
    a = records.select(*own, F.explode(pairs_of(bag, 1)).alias("key")).alias("a")
    b = records.select(*own, F.explode(pairs_of(unique, 0)).alias("key")).alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.project_scope") == F.col("b.project_scope"))
    met = met & (F.col("a.id") < F.col("b.id") if residual is None else residual)
    extra = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in columns for s in "ab"]
    return a.join(b, met).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.project_scope").alias("project_scope"), *extra).distinct()


def signals(edges: DataFrame, results: DataFrame) -> DataFrame:
    """(memory_id, kind, other_id, edge_id) for result ids: contradictions that start there, and newer versions of either end, older first."""
    ids = results.select(F.col("id")).distinct()
    now = valid(edges)
    contradicts = now.where("relation = 'contradicts'").join(ids.select(F.col("id").alias("from_memory_id")), "from_memory_id", "left_semi")
    newer = now.where("relation = 'supersedes'")
    ends = newer.join(ids.select(F.col("id").alias("from_memory_id")), "from_memory_id", "left_semi").unionByName(
        newer.join(ids.select(F.col("id").alias("to_memory_id")), "to_memory_id", "left_semi")
    ).dropDuplicates(["id"])
    shape = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("memory_id"), F.col(b).alias("other_id"), F.col("id").alias("edge_id"))
    return shape(contradicts, "contradicts", "from_memory_id", "to_memory_id").unionByName(shape(ends, "superseded_by", "to_memory_id", "from_memory_id"))


def exported_edges(edges: DataFrame, records: DataFrame, scope: str | None) -> DataFrame:
    """Edges whose ends both lie in the scope."""
    ids = records.where(in_scopes(None if scope is None else [scope])).select("id")
    return edges.join(ids.select(F.col("id").alias("from_memory_id")), "from_memory_id", "left_semi").join(
        ids.select(F.col("id").alias("to_memory_id")), "to_memory_id", "left_semi"
    )


def sidecar_edges(edges: DataFrame, records: DataFrame, scopes: Sequence[str] | None) -> DataFrame:
    """Valid edges between records of the scopes, archived ends included."""
    return with_ends(valid(edges), records.where(in_scopes(scopes)), ["type"]).select(
        "id", "from_memory_id", "to_memory_id", "relation", "confidence", "from_type", "to_type"
    )


def upserted(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges after incoming rows overwrite confidence, rationale and updated_at of their (from, to, relation), keeping id and created_at."""
    key = ["from_memory_id", "to_memory_id", "relation"]
    fresh = Window.partitionBy(*key).orderBy(F.desc("new"), F.desc_nulls_last("updated_at"), F.desc("id"))
    old = Window.partitionBy(*key).orderBy("new", "created_at", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = edges.withColumn("new", F.lit(0)).unionByName(incoming.withColumn("new", F.lit(1)))
    return (
        both.withColumn("id", F.first("id").over(old)).withColumn("created_at", F.first("created_at").over(old))
        .withColumn("_r", F.row_number().over(fresh)).where("_r = 1").drop("_r", "new")
    )
