"""Entities: resolving, merging, linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.filters import in_scopes


def clean_links(links: DataFrame) -> DataFrame:
    """One row for each (memory_id, entity_id): the surest, then the earliest."""
    first = Window.partitionBy("memory_id", "entity_id").orderBy(F.desc_nulls_last("confidence"), "created_at", "source")
    return links.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def dictionary(entities: DataFrame) -> DataFrame:
    """(name, entity_id, canonical): every name under which an entity is known, case folded."""
    names = F.concat(F.array(F.struct(F.col("normalized_name").alias("name"), F.lit(True).alias("canonical"))),
                     F.transform(F.array_compact(F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: F.struct(F.lower(a).alias("name"), F.lit(False).alias("canonical"))))
    return entities.select(F.col("id").alias("entity_id"), "project_scope", F.explode(names).alias("x")).select("entity_id", "project_scope", "x.*").where("name IS NOT NULL AND trim(name) <> ''")


def resolve(names: DataFrame, entities: DataFrame, scope: str = "global") -> DataFrame:
    """(name, entity_id): a canonical match first, then the current scope, then the smaller id. Unknown names drop out."""
    order = Window.partitionBy("name").orderBy(F.desc("canonical"), F.desc(F.col("project_scope") == scope), "entity_id")
    return (
        names.select(F.lower("name").alias("name")).distinct().join(dictionary(entities), "name")
        .withColumn("_r", F.row_number().over(order)).where("_r = 1").select("name", "entity_id")
    )


def upserted(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities after incoming ones merge into those of the same (scope, type, normalised name): aliases united, last_seen_at moved on.

    `created` tells whether the entity is new.
    """
    key = ["project_scope", "type", "normalized_name"]
    fold = lambda df: df.groupBy(*key).agg(
        F.min("id").alias("id"), F.min_by("canonical_name", "id").alias("canonical_name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    old, new = fold(entities).alias("o"), fold(incoming).alias("n")
    both = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    either = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    empty = F.array().cast("array<string>")
    return both.select(
        either("id"), *[either(k) for k in key], either("canonical_name"),
        F.array_sort(F.array_union(F.coalesce("o.aliases", empty), F.coalesce("n.aliases", empty))).alias("aliases"),
        F.greatest("o.last_seen_at", "n.last_seen_at").alias("last_seen_at"), F.col("o.id").isNull().alias("created"),
    )


def with_aliases(entities: DataFrame, additions: DataFrame) -> DataFrame:
    """Entities with the aliases of (entity_id, alias) added."""
    more = additions.groupBy(F.col("entity_id").alias("id")).agg(F.collect_set("alias").alias("_more"))
    empty = F.array().cast("array<string>")
    return entities.join(more, "id", "left").withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", empty), F.coalesce("_more", empty)))).drop("_more")


def inserted_links(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links with those incoming ones added that don't exist yet."""
    fresh = clean_links(incoming).join(links.select("memory_id", "entity_id").distinct(), ["memory_id", "entity_id"], "left_anti")
    return links.unionByName(fresh)


def top_entities(entities: DataFrame, links: DataFrame, n: int, scope: str | None = None) -> DataFrame:
    """The n entities with most linked records, ties by name; unlinked ones count 0."""
    counts = links.select("memory_id", "entity_id").distinct().groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("memories"))
    return (
        entities.where(in_scopes(None if scope is None else [scope])).join(counts, "id", "left").na.fill(0, ["memories"])
        .select("id", "type", "canonical_name", "memories").orderBy(F.desc("memories"), "canonical_name", "id").limit(n)
    )


def extraction_candidates(records: DataFrame, links: DataFrame, since: Column | None = None) -> DataFrame:
    """(id): records without links, or updated after their last link; with `since`, only those created after it."""
    last = links.groupBy(F.col("memory_id").alias("id")).agg(F.max("created_at").alias("last_link"), F.lit(True).alias("_linked"))
    base = records if since is None else records.where(F.col("created_at") > since)
    return base.join(last, "id", "left").where(F.col("_linked").isNull() | (F.col("updated_at") > F.col("last_link"))).select("id")


def links_of(results: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entities): the linked entities of each result as a sorted list of names with their confidence."""
    pairs = links.join(results.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi")
    named = pairs.join(entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    return named.groupBy(F.col("memory_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.concat_ws(":", "canonical_name", F.col("confidence").cast("string")))).alias("entities")
    )
