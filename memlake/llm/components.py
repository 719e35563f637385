"""Problem 6: consolidating pairwise matches into groups.

Method: minimum labels spread over the edges and are accelerated by pointer jumping; each
round is written to the shared folder, until no label changes. After a round the edges are
drawn between the labels instead of the records and made distinct, so the graph shrinks by a
factor at each round and long chains end in a logarithmic number of rounds. Nothing but
an emptiness test reaches the driver.

Hubs: the minimum over an end's edges is pre-aggregated before the shuffle, and a hub's
rows are split by AQE where labels are joined, as the other side has one row for each label.

Defined results: edges with a null end or equal ends link nothing; repeated and reversed edges
count once; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.session import drop_written, materialize


def connected_components(edges: DataFrame, source: str, target: str, max_rounds: int = 100) -> DataFrame:
    """(vertex, label): label is the smallest vertex linked with vertex directly or indirectly, itself included."""
    pairs = (
        edges.select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"))
        .where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
        .distinct()
    )
    pairs = materialize(pairs, "edges")
    rounds: list[DataFrame] = []
    for _ in range(max_rounds):
        if pairs.isEmpty():
            break
        # The smallest label next to each vertex; a vertex without a smaller neighbour keeps itself.
        parent = (
            pairs.select(F.col("b").alias("v"), F.col("a").alias("p"))
            .union(pairs.select(F.col("a").alias("v"), F.col("a").alias("p")))
            .groupBy("v")
            .agg(F.min("p").alias("p"))
        )
        parent = materialize(parent, "parents")
        # Two pointer jumps in one job: to the parent's parent's parent.
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        upper = parent.select(F.col("v").alias("pp"), F.col("p").alias("ppp"))
        jumped = materialize(parent.join(up, "p").join(upper, "pp").select("v", F.col("ppp").alias("p")), "labels")
        drop_written(parent)
        rounds.append(jumped)
        left = jumped.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = jumped.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        contracted = materialize(
            pairs.join(left, "a")
            .join(right, "b")
            .where(F.col("pa") != F.col("pb"))
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
        drop_written(pairs)
        pairs = contracted
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    if not rounds:
        return pairs.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
    # A record's label is that of its label of the round before; later rounds are smaller and smaller.
    last = rounds[-1].select(F.col("v").alias("vertex"), F.col("p").alias("label"))
    for earlier in reversed(rounds[:-1]):
        to = last.select(F.col("vertex").alias("p"), "label")
        last = earlier.join(to, "p", "left").select(F.col("v").alias("vertex"), F.coalesce("label", "p").alias("label"))
    return last


def normal_relation(relation: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(relation, r"^\s+|\s+$", "")), r"[\s\-_]+", "_")


def version_groups(memory_edges: DataFrame) -> DataFrame:
    """(memory_id, group_id) over the valid edges that lead from one version of a record to another."""
    linking = memory_edges.where(
        normal_relation(F.col("relation")).isin("supersedes", "evolved_into") & F.col("valid_until").isNull()
    ).select("from_memory_id", "to_memory_id")
    return connected_components(linking, "from_memory_id", "to_memory_id").select(
        F.col("vertex").alias("memory_id"), F.col("label").alias("group_id")
    )
