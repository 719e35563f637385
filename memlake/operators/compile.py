"""Compiling records into documents: clusters, timelines, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import excerpt, topic_slug, topic_title
from memlake.operators.ranges import numbered
from memlake.operators.report import edge_notes
from memlake.session import materialize

UNSORTED = "uncategorized"
#: Entries of one document at most; a larger cluster is written in numbered parts.
PART_ENTRIES = 10_000


def primary_topic(topics: Column) -> Column:
    """The smallest topic; records without one are uncategorised."""
    return F.coalesce(F.array_min(F.filter(topics, lambda t: t.isNotNull() & (t != ""))), F.lit(UNSORTED))


def clusters(records: DataFrame) -> DataFrame:
    """(topic, topic_slug, title, n, first_id, last_id) of the clusters by primary topic."""
    topic = primary_topic(F.col("topics"))
    return records.groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).select(
        "topic", topic_slug(F.col("topic")).alias("topic_slug"), topic_title(F.col("topic")).alias("title"), "n", "first_id", "last_id"
    )


def effective_date(date: Column, created_at: Column) -> Column:
    return F.coalesce(date.cast("string"), F.date_format(created_at, "yyyy-MM-dd"), F.lit("unknown"))


def timeline(records: DataFrame) -> DataFrame:
    """(topic, id, day, line, place): every topic's records in order of their date, one line each."""
    lines = records.select("topics", "id", effective_date(F.col("date"), F.col("created_at")).alias("day"), excerpt(F.col("content")).alias("text"))
    rows = lines.select(F.explode(F.array_distinct("topics")).alias("topic"), "id", "day", "text").where(F.col("topic").isNotNull() & (F.col("topic") != ""))
    line = F.concat(F.lit("- "), F.col("day"), F.lit(" — <m:"), F.col("id"), F.lit("> "), F.col("text"))
    return numbered(rows.select("topic", "id", "day", line.alias("line")), ["topic"], ["day", "id"], "place")


def documents(records: DataFrame, summarise=None, part_entries: int = PART_ENTRIES) -> DataFrame:
    """(topic, path, body): one document for each cluster, or for each part_entries of its entries: topic.md, topic-part-2.md, ...

    `summarise(text) -> text` is a plug-in; the default takes each record's first sentence. Entries are numbered within
    ranges of topic and day, so a topic of any size is spread; only the entries of one part are held as a group.
    """
    make = summarise or (lambda text: text.split(". ")[0].strip())
    rows = records.select(
        primary_topic(F.col("topics")).alias("topic"), "id", effective_date(F.col("date"), F.col("created_at")).alias("day"), "content"
    ).where(F.col("content").isNotNull())

    def section(batches):
        for pdf in batches:
            pdf["entry"] = [f"- {d} — {make(c)} <m:{i}>" for d, c, i in zip(pdf["day"], pdf["content"], pdf["id"])]
            yield pdf[["topic", "day", "id", "entry"]]

    entries = rows.mapInPandas(section, "topic string, day string, id string, entry string")
    parts = numbered(entries, ["topic"], ["day", "id", "entry"], "place").withColumn("part", F.floor((F.col("place") - 1) / part_entries).cast("long") + 1)
    body = parts.groupBy("topic", "part").agg(F.array_sort(F.collect_list(F.struct("day", "id", "entry"))).alias("x"))
    number = F.when(F.col("part") > 1, F.concat(F.lit("-part-"), F.col("part").cast("string"))).otherwise(F.lit(""))
    slug = topic_slug(F.col("topic"))
    return body.select(
        "topic", F.concat(F.lit("topics/"), slug, number, F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), topic_title(F.col("topic")), F.lit("\n\n## Timeline\n\n"), F.array_join(F.transform("x", lambda e: e["entry"]), "\n"), F.lit("\n")).alias("body"),
    )


def loaded(records: DataFrame, edges: DataFrame, scope: str, tier: str | None = None, topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Unarchived records of one scope (and tier, and topic), and the edges that touch them with the record they belong to (memory_id):
    the one that they come from if it was loaded, else the one that they lead to."""
    rows = records.where((F.col("type") != "archived") & (F.col("project_scope") == scope))
    if tier is not None:
        rows = rows.where(F.col("tier") == tier)
    if topic is not None:
        rows = rows.where(F.array_contains("topics", topic))
    ids = rows.select("id")
    there = lambda end: edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    starts = there("from_memory_id").withColumn("memory_id", F.col("from_memory_id"))
    rest = there("to_memory_id").join(ids.withColumnRenamed("id", "from_memory_id"), "from_memory_id", "left_anti").withColumn("memory_id", F.col("to_memory_id"))
    return rows, starts.unionByName(rest)


def tier_documents(records: DataFrame, edges: DataFrame, summarise=None, tiers: tuple[str, ...] = ("preferences", "project-context", "conversations")) -> DataFrame:
    """(tier, section, topic, place, body): a section for each cluster of a tier in the order of a reader's alphabet, with notes on relations within it."""
    make = summarise or (lambda text: text.split(". ")[0].strip())
    members = records.where(F.col("tier").isin(*tiers)).select("tier", primary_topic(F.col("topics")).alias("topic"), "id", "content").where(F.col("content").isNotNull())

    def said(batches):
        for pdf in batches:
            pdf["line"] = [make(c) for c in pdf["content"]]
            yield pdf[["tier", "topic", "id", "line"]]

    lines = members.mapInPandas(said, "tier string, topic string, id string, line string")
    placed = numbered(lines, ["tier", "topic"], ["id"], "n").withColumn("part", F.floor((F.col("n") - 1) / PART_ENTRIES).cast("long") + 1)
    bodies = placed.groupBy("tier", "topic", "part").agg(F.array_sort(F.collect_list(F.struct("n", "id", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat(e["line"], F.lit(" <m:"), e["id"], F.lit(">"))), "\n")
    notes = edge_notes(edges, members.select(F.concat_ws("\u0001", "tier", "topic").alias("topic"), "id")).groupBy("topic").agg(
        F.count(F.lit(1)).alias("notes"), F.array_join(F.slice(F.array_sort(F.collect_set("note")), 1, PART_ENTRIES), "\n").alias("history")
    )
    rows = bodies.withColumn("key", F.concat_ws("\u0001", "tier", "topic")).join(notes.withColumnRenamed("topic", "key"), "key", "left")
    history = F.when((F.col("part") == 1) & F.col("history").isNotNull(), F.concat(F.lit("\n\n"), F.col("history"))).otherwise("")
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.expr("topic COLLATE UNICODE"), "topic", "part"))  # a row for each section
    return rows.select("tier", topic_title(F.col("topic")).alias("section"), "topic", place.alias("place"), F.concat(text, history).alias("body"))


def compile_run(records: DataFrame, edges: DataFrame, previous: DataFrame, tier: str | None = None, topic: str | None = None, everything: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, manifest, stale paths) of one run over exactly one of a tier, a topic and everything.

    previous is the manifest (topic, path) of the last run; entries outside of what the run touches stay, paths within it that no document has any more are stale.
    """
    if (tier is not None) + (topic is not None) + bool(everything) != 1:
        raise ValueError("exactly one of a tier, a topic and everything")
    rows = records.where("type <> 'archived'")
    spark = records.sparkSession
    parts = []
    if everything or tier is not None:
        sections = tier_documents(rows if tier is None else rows.where(F.col("tier") == tier), edges)
        parts.append(sections.select(F.concat(F.lit("tier:"), "tier").alias("topic"), F.concat("tier", F.lit(".md"), F.lit("#"), F.col("place").cast("string")).alias("path"), "body"))
    if everything:
        parts.append(documents(rows))
    if topic is not None:
        parts.append(documents(rows.where(primary_topic(F.col("topics")) == topic)))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    made = materialize(made, "documents")
    current = made.select("topic", "path")
    if everything:
        touched = current.select("topic").union(previous.select("topic")).distinct()
    else:
        touched = spark.createDataFrame([(f"tier:{tier}" if tier is not None else topic,)], "topic string")
    return made, merged_manifest(previous.select("topic", "path"), current, touched), stale_paths(previous, current, touched)


def stale_paths(previous: DataFrame, current: DataFrame, touched: DataFrame) -> DataFrame:
    """(path) of the previous manifest, among the touched topics, that no current document has."""
    return previous.join(touched.select("topic").distinct(), "topic", "left_semi").join(current.select("path"), "path", "left_anti").select("path")


def merged_manifest(previous: DataFrame, current: DataFrame, touched: DataFrame) -> DataFrame:
    """Current entries, and the previous ones of topics that weren't touched."""
    return current.unionByName(previous.join(touched.select("topic").distinct(), "topic", "left_anti"))


__all__ = ["clusters", "compile_run", "loaded", "tier_documents", "documents", "effective_date", "merged_manifest", "primary_topic", "stale_paths", "timeline"]
