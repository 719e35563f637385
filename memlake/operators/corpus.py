"""Labelled corpora, probability replies and shadow runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import trimmed
from memlake.operators.edges import RELATIONS, with_pair_hash

CORPUS = "`from` struct<id: string, content: string, type: string>, `to` struct<id: string, content: string, type: string>, expected_relation string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with their expected relation from JSON lines; a line that breaks a rule fails the read and names the rule."""
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)
    ends = F.col("from.id").isNotNull() & F.col("to.id").isNotNull() & F.col("from.content").isNotNull() & F.col("to.content").isNotNull()
    known = F.col("expected_relation").isin(*RELATIONS, "none")
    verified = F.when(~F.coalesce(ends, F.lit(False)), F.raise_error(F.lit("a corpus pair lacks an id or a content"))).when(
        ~F.coalesce(known, F.lit(False)), F.raise_error(F.concat(F.lit("unknown relation in the corpus: "), F.coalesce("expected_relation", F.lit("null"))))
    )
    return rows.withColumn("expected_relation", F.coalesce(verified.cast("string"), F.col("expected_relation")))


def matched_labels(corpus: DataFrame, labels: DataFrame, key: str = "pair_id") -> DataFrame:
    """Corpus rows that have a label, with it; a label of an unknown row is an error."""
    unknown = labels.join(corpus.select(key).distinct(), key, "left_anti").select(key).limit(3).collect()
    if unknown:
        raise ValueError(f"labels of unknown rows: {', '.join(str(r[key]) for r in unknown)}")
    return corpus.join(labels.dropDuplicates([key]), key)


def rejected_pairs(candidates: DataFrame, rejected: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidate pairs that stage 1 rejected (pair_hash) and that no edge joins."""
    joined = with_pair_hash(edges.select(F.col("from_memory_id").alias("id_a"), F.col("to_memory_id").alias("id_b"))).select("pair_hash").distinct()
    return (
        with_pair_hash(candidates).join(rejected.select("pair_hash").distinct(), "pair_hash", "left_semi").join(joined, "pair_hash", "left_anti").dropDuplicates(["pair_hash"])
    )


def probabilities(reply: Column, labels: Sequence[str]) -> Column:
    """Map of label to probability from a JSON reply: known labels only, none below zero, summing to 1; null if nothing is left."""
    body = F.regexp_replace(F.regexp_replace(trimmed(reply), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    read = F.map_filter(F.from_json(body, "map<string, double>"), lambda k, v: k.isin(*labels) & (v >= 0))
    total = F.aggregate(F.map_values(read), F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.transform_values(read, lambda k, v: v / total))


def most_probable(probs: Column, labels: Sequence[str]) -> Column:
    """The label of the largest probability; the first of `labels` on ties."""
    ranked = F.array(*[F.struct(F.coalesce(F.element_at(probs, F.lit(x)), F.lit(0.0)).alias("p"), F.lit(-i).alias("o"), F.lit(x).alias("label")) for i, x in enumerate(labels)])
    return F.when(probs.isNotNull(), F.array_max(ranked)["label"])


def expected_score(probs: Column) -> Column:
    """Mean of numeric labels under their probabilities."""
    return F.aggregate(F.map_entries(probs), F.lit(0.0), lambda s, e: s + e["key"].cast("double") * e["value"])


def shadow_summary(shadow: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, compared, agreement, missed_edges) of a shadow run against the decisions that counted.

    shadow: skip_reason (null if scored), probability, passed, edge.
    """
    scored = shadow.where(F.col("skip_reason").isNull() & F.col("probability").isNotNull())
    cells = [
        F.struct(F.lit(float(x)).alias("threshold"), F.count(F.lit(1)).alias("compared"), F.count_if((F.col("probability") >= x) == F.col("passed")).alias("agree"),
                 F.count_if((F.col("probability") < x) & F.col("edge")).alias("missed_edges"))
        for x in thresholds
    ]
    rows = scored.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.select("threshold", "compared", F.coalesce(F.try_divide("agree", "compared"), F.lit(0.0)).alias("agreement"), "missed_edges")


def skip_kinds(shadow: DataFrame) -> DataFrame:
    """(kind, n): what kept rows out of a shadow run; the kind is the reason up to its colon."""
    return shadow.where(F.col("skip_reason").isNotNull()).groupBy(F.split_part("skip_reason", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def embedded(records: DataFrame, model: Callable[[list[str]], list[list[float] | None]] | None = None, content: str = "content", batch: int = 256) -> DataFrame:
    """Records with a vector for each that has none yet; without a model they stay without one.

    The model gets lists of texts and answers in their order.
    """
    if model is None:
        return records
    missing = records.where(F.col("embedding").isNull())

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, out = rows[content].tolist(), []
            for at in range(0, len(texts), batch):
                out += model(texts[at : at + batch])
            rows["embedding"] = out
            yield rows

    return records.where(F.col("embedding").isNotNull()).unionByName(missing.mapInPandas(fill, missing.schema))
