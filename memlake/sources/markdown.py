"""Markdown notes as a source: sections with `## `, entries with `- `, indented lines continue an entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import trimmed


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of whole files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))


def entries(notes: DataFrame, default_type: str = "observation") -> DataFrame:
    """(source_file, source_line, section, content, type, topics, people): one row for each entry.

    Lines are numbered and exploded; the current section and entry are carried forward with windows
    over a file, and an entry's lines are joined again. Of several comments with a field the last one counts.
    """
    lines = notes.select("source_file", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    by_file = Window.partitionBy("source_file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading, starts = F.col("line").rlike("^## "), F.col("line").rlike("^- ")
    marked = (
        lines.where(~F.col("line").rlike("^# "))
        .withColumn("section", F.last(F.when(heading, trimmed(F.regexp_replace("line", r"^##\s*", ""))), ignorenulls=True).over(by_file))
        .withColumn("opened", F.last(F.when(heading, F.lit(-1)).when(starts, F.col("n")), ignorenulls=True).over(by_file))
        .where((F.col("opened") >= 0) & (starts | F.col("line").rlike(r"^\s+")))
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("line").startswith("- ") & (F.col("n") == F.col("opened")), F.expr("substring(line, 3)")).otherwise(F.col("line")).alias("line")))), lambda x: x["line"]), "\n")
    rows = marked.groupBy("source_file", "opened").agg(F.first("section", ignorenulls=True).alias("section"), trimmed(text).alias("content")).where("content <> ''")
    comments = F.regexp_extract_all("content", F.lit(r"(?s)<!--\s*(.*?)\s*-->"), 1)
    field = lambda name: F.try_element_at(F.filter(F.transform(comments, lambda c: F.regexp_extract(c, name + r":\s*(\S+)", 1)), lambda x: x != ""), F.lit(-1))
    listed = lambda name: F.filter(F.split(field(name), ","), lambda x: x != "")
    return rows.select(
        "source_file", (F.col("opened") + 1).cast("int").alias("source_line"), "section", "content",
        F.coalesce(field("type"), F.lit(default_type)).alias("type"), listed("topics").alias("topics"), listed("people").alias("people"),
    )
