"""Texts for readers and models: what to do next, prompts, and reports of bounded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hints of one answer, findings of one check in a report, and characters of a quoted query at most.
MOST_HINTS, MOST_FINDINGS, SNIPPET = 3, 100, 80


def hint(name: str, usage: Column, why: str) -> list[Column]:
    return [F.lit(name).alias("name"), usage.alias("usage"), F.lit(why).alias("why")]


def after_recall(signals: DataFrame) -> DataFrame:
    """(name, usage, why): a check for each record that an answer's signals call contradicted, in their order (column place)."""
    first = signals.where("kind = 'contradicts'").groupBy("memory_id").agg(F.min("place").alias("place")).orderBy("place", "memory_id").limit(MOST_HINTS)
    return first.select(*hint("lint", F.concat(F.lit("lint --check=contradictions --memory-id="), F.col("memory_id")), "recall flagged a contradiction on this memory; lint diagnoses it"))


def contradicted_topics(findings: DataFrame, most: int = MOST_HINTS) -> DataFrame:
    """(topic, n): topics with the most contradictions, ties in order of the alphabet."""
    rows = findings.where((F.col("check") == "contradictions") & (F.coalesce("topic", F.lit("")) != ""))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(most)


def after_lint(findings: DataFrame) -> DataFrame:
    return contradicted_topics(findings).select(*hint("compile", F.concat(F.lit("compile --topic="), F.col("topic")), "Contradictions on this topic; recompile the wiki view"))


def after_remember(written: DataFrame) -> DataFrame:
    """(id, name, usage, why) for written rows (id, content, tier) that have an id and a text."""
    snippet = F.trim(F.regexp_replace(F.substring("content", 1, SNIPPET), r"\s+", " "))
    quoted = F.regexp_extract(F.to_json(F.struct(snippet.alias("q"))), r'^\{"q":(.*)\}$', 1)
    usage = F.concat(F.lit("recall --query="), quoted, F.coalesce(F.concat(F.lit(" --tier="), F.col("tier")), F.lit("")))
    rows = written.where(F.col("id").isNotNull() & (F.trim("content") != ""))
    return rows.select("id", *hint("recall", usage, "Verify the memory was indexed correctly"))


def surest_entity(found: DataFrame) -> DataFrame:
    """One row: the new entity (canonical_name, confidence) of highest confidence, ties to the smaller name."""
    return found.agg(F.min_by(F.struct("canonical_name", "confidence"), F.struct(-F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), F.col("canonical_name"))).alias("e")).where("e IS NOT NULL").select("e.*")


def after_extraction(found: DataFrame) -> DataFrame:
    return surest_entity(found).select(*hint("recall", F.concat(F.lit("recall --entity="), F.col("canonical_name")), "Confirm the newly extracted entity links to expected memories"))


def known_entities_block(entities: DataFrame, most: int = 10_000) -> str:
    """The lines on known entities of an extraction prompt; refused above `most` entities."""
    line = F.concat(
        F.lit("- "), "type", F.lit(": "), "canonical_name",
        F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" (aliases: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise(""),
    )
    lines = [r[0] for r in entities.orderBy("type", "canonical_name", "id").select(line).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} known entities for one prompt")
    return "\n".join(lines) or "(none yet)"


def source_line(identity: Column, kind: Column, content: Column) -> Column:
    """A record's line in the prompt for a section."""
    return F.concat(F.lit("- (id="), identity, F.lit(", type="), kind, F.lit(") "), content)


def edge_notes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(topic, from_memory_id, to_memory_id, note): relations that frame history, between two members (topic, id) of one cluster."""
    verb = F.when(F.col("relation") == "supersedes", "supersedes").when(F.col("relation") == "contradicts", "contradicts").when(F.col("relation") == "evolved_into", "evolved into")
    told = edges.withColumn("verb", verb).where("verb IS NOT NULL")
    own = members.select("topic", "id").distinct()
    both = told.join(own.select("topic", F.col("id").alias("from_memory_id")), "from_memory_id").join(
        own.select("topic", F.col("id").alias("to_memory_id")), ["topic", "to_memory_id"]
    )
    note = F.concat(F.lit("- "), "from_memory_id", F.lit(" "), "verb", F.lit(" "), "to_memory_id", F.lit(" — "), F.coalesce("rationale", F.lit("")))
    return both.select("topic", "from_memory_id", "to_memory_id", note.alias("note"))


def findings_of_report(findings: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """At most `most` findings of each check, the surest first."""
    order = Window.partitionBy("check").orderBy(F.desc("confidence"), "memory_id", "other_id")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def lint_report(summary: DataFrame, findings: DataFrame) -> str:
    """The findings as text: the counts, then a section for each check that has some."""
    counts = {r["check"]: r["findings"] for r in summary.collect()}  # a row for each check
    lines = ["Lint Report", "===========", f"Total findings: {sum(counts.values())}", *(f"  {c}: {n}" for c, n in sorted(counts.items()))]
    rows = findings_of_report(findings).collect()  # bounded for each check
    for check in sorted({r["check"] for r in rows}):
        lines += ["", f"## {check}"]
        for r in sorted((r for r in rows if r["check"] == check), key=lambda r: r["place"]):
            lines += [f"  - {r['memory_id']}" + (f" ↔ {r['other_id']}" if r["other_id"] else ""), f"      action: {r['action']} (confidence {r['confidence']:.2f})"]
    return "\n".join(lines)
