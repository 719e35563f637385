"""Two-stage classification of candidate pairs and extraction of entities, with plug-in models, cost caps and resume.

A model is a function from a pandas frame to a list of replies; the default ones are rules, so that everything
runs without a network. Stage outputs are written before the next stage reads them, so a retried task or a lost executor
never asks a model twice for what is written already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import pair_hash, relation_reply, verdict
from memlake.operators.edges import RELATIONS
from memlake.session import materialize

Model = Callable[[pd.DataFrame], list[str]]
STAGE1_COST, STAGE2_COST, PASS_SHARE, STAGE2_TYPICAL = 0.0005, 0.04, 0.2, 0.018
TERMINAL = ("stage1_rejected", "stage2_done", "cap_reached")


def word_overlap(pairs: pd.DataFrame) -> list[str]:
    """Rule for stage 1: texts that share a tenth of their words may be related."""
    out = []
    for a, b in zip(pairs["content_a"], pairs["content_b"]):
        x, y = set((a or "").lower().split()), set((b or "").lower().split())
        out.append("YES - shared words" if len(x & y) >= 0.1 * max(1, len(x | y)) else "NO - different")
    return out


def by_age_and_words(pairs: pd.DataFrame) -> list[str]:
    """Rule for stage 2: near copies supersede, the rest of what passed is related."""
    out = []
    for a, b in zip(pairs["content_a"], pairs["content_b"]):
        x, y = set((a or "").lower().split()), set((b or "").lower().split())
        s = len(x & y) / max(1, len(x | y))
        kind = "supersedes" if s >= 0.6 else "related_to" if s >= 0.15 else "none"
        out.append(f'{{"relation": "{kind}", "confidence": {min(0.99, round(s + 0.3, 2))}, "rationale": "{round(100 * s)} percent of the words"}}')
    return out


def replies(frame: DataFrame, model: Model, tasks: int | None = None, attempts: int = 2) -> DataFrame:
    """The frame with the model's reply and the number of attempts for each row. `tasks` bounds how many calls run at once."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for attempt in range(1, attempts + 1):
                try:
                    batch["reply"], batch["attempts"] = model(batch), attempt
                    break
                except ValueError:
                    batch["reply"], batch["attempts"] = None, attempt
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", reply string, attempts int"
    return (frame if tasks is None else frame.repartition(tasks)).mapInPandas(ask, schema)


def within_cost(pairs: DataFrame, cap_usd: float, reserve_usd: float, order: str = "pair_hash") -> DataFrame:
    """The pairs with `affordable`: the longest prefix by pair hash whose reservations fit under the cap.

    All reservations are alike, so the prefix is a rank; the rank is counted within hash ranges first and
    carried over their (few) counts, not in one sorted task.
    """
    most = int(cap_usd / reserve_usd + 1e-9)
    part = pairs.withColumn("_range", F.substring(order, 1, 2))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) + F.col("_before")
    return part.join(sizes, "_range").withColumn("affordable", rank <= most).drop("_range", "_before")


def classify(
    pairs: DataFrame, records: DataFrame, done: DataFrame | None = None, stage1: Model = word_overlap, stage2: Model = by_age_and_words,
    cap_usd: float = 1.0, tasks: int | None = None,
) -> DataFrame:
    """(id_a, id_b, pair_hash, stage, relation, confidence, rationale, cost_usd) for each pair that isn't done yet.

    stage: cap_reached, stage1_rejected or stage2_done. A contradiction with a rejected record counts as none.
    Every attempt at a reply counts in the cost.
    """
    ends = records.select("id", "content", "type")
    rows = pairs.withColumn("pair_hash", pair_hash(F.col("id_a"), F.col("id_b"))).dropDuplicates(["pair_hash"])
    if done is not None:
        rows = rows.join(done.select("pair_hash"), "pair_hash", "left_anti")
    rows = within_cost(rows.select("id_a", "id_b", "pair_hash"), cap_usd, STAGE1_COST + PASS_SHARE * STAGE2_COST)
    rows = rows.join(ends.select(F.col("id").alias("id_a"), F.col("content").alias("content_a"), F.col("type").alias("type_a")), "id_a")
    rows = rows.join(ends.select(F.col("id").alias("id_b"), F.col("content").alias("content_b"), F.col("type").alias("type_b")), "id_b")
    rows = materialize(rows, "pairs")
    first = materialize(replies(rows.where("affordable"), stage1, tasks).withColumn("passed", verdict(F.col("reply"))).withColumnRenamed("attempts", "tries").drop("reply"), "stage1")
    second = replies(first.where("passed"), stage2, tasks).withColumn("parsed", relation_reply(F.col("reply"), (*RELATIONS, "none")))
    second = materialize(second, "stage2")
    guarded = F.when((F.col("parsed.relation") == "contradicts") & ((F.col("type_a") == "rejection") | (F.col("type_b") == "rejection")), "none").otherwise(F.col("parsed.relation"))
    shape = lambda df, stage, relation, confidence, rationale, cost: df.select(
        "id_a", "id_b", "pair_hash", F.lit(stage).alias("stage"), relation.cast("string").alias("relation"), confidence.cast("double").alias("confidence"),
        rationale.cast("string").alias("rationale"), cost.cast("double").alias("cost_usd"),
    )
    none = F.lit(None)
    return (
        shape(rows.where("NOT affordable"), "cap_reached", none, none, none, F.lit(0.0))
        .unionByName(shape(first.where("NOT coalesce(passed, false)"), "stage1_rejected", none, none, none, F.col("tries") * STAGE1_COST))
        .unionByName(shape(second, "stage2_done", guarded, F.col("parsed.confidence"), F.col("parsed.rationale"), F.col("tries") * STAGE1_COST + F.col("attempts") * STAGE2_TYPICAL))
    )


def as_edges(outcomes: DataFrame, version: str, now: Column) -> DataFrame:
    """Rows of relations from outcomes: those with a relation and a confidence above zero."""
    rows = outcomes.where((F.col("stage") == "stage2_done") & (F.col("relation") != "none") & (F.col("confidence") > 0))
    return rows.select(
        F.col("pair_hash").alias("id"), F.col("id_a").alias("from_memory_id"), F.col("id_b").alias("to_memory_id"), "relation",
        F.col("confidence").cast("decimal(3,2)").alias("confidence"), "rationale", F.lit(version).alias("classifier_version"),
        now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), now.alias("created_at"), now.alias("updated_at"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counters, from the rows themselves and not from accumulators, which count retried tasks twice."""
    count = lambda c: F.count_if(c)
    stage = F.col("stage")
    return outcomes.agg(
        count(stage != "cap_reached").alias("stage1_total"), count(stage == "stage2_done").alias("stage1_pass"), count(stage == "stage1_rejected").alias("stage1_skip"),
        count((stage == "stage2_done") & (F.col("relation") != "none")).alias("edges"), count(stage == "cap_reached").alias("cap_reached"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
    )


def dry_run_cost(n: int) -> float:
    return STAGE1_COST * n + PASS_SHARE * STAGE2_TYPICAL * n


def capitalised_names(texts: pd.DataFrame) -> list[str]:
    """Rule for extraction: neighbouring capitalised words are a name; one line for each, type and confidence first."""
    import re

    pattern = re.compile(r"\b[A-ZÀ-Ý][\w’-]+ [A-ZÀ-Ý][\w’-]+\b")
    return ["\n".join(f"person|0.6|{m}" for m in dict.fromkeys(pattern.findall(t or ""))) for t in texts["content"]]


def extract(records: DataFrame, known: DataFrame, model: Model = capitalised_names, tasks: int | None = None) -> DataFrame:
    """(memory_id, type, name, confidence, entity_id): entities named in each record, entity_id null for new ones.

    known: (name, entity_id), case folded, as made by entities.dictionary.
    """
    answered = materialize(replies(records.select("id", "content"), model, tasks).drop("content"), "extracted")
    lines = answered.select(F.col("id").alias("memory_id"), F.explode(F.split("reply", "\n")).alias("line"))
    parts = F.split("line", r"\|", 3)
    rows = lines.where(F.size(parts) == 3).select(
        "memory_id", parts[0].alias("type"), parts[2].alias("name"), parts[1].try_cast("double").alias("said")
    )
    rows = rows.where(F.col("said").isNotNull()).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "said"))).drop("said")
    names = known.groupBy(F.lower("name").alias("key")).agg(F.min("entity_id").alias("entity_id"))
    return rows.where(F.trim("name") != "").withColumn("key", F.lower("name")).join(names, "key", "left").drop("key")
