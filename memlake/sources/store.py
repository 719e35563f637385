"""Snapshot store: immutable versions of a table, a pointer to the current one, and set-based writes.

Parquet tables can't be updated in place, so every write makes a new folder `v=<n>` beside the old one and then
moves a small pointer file over the current one; readers of the old version are not disturbed. There is one writer at a
time. Rules are checked in the same pass that counts the new rows, before the pointer moves. All paths go
through the cluster's file system interface.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import fingerprint
from memlake.session import spread

SCHEMA_VERSION = 1
#: Scores of the nearest record from which a text counts as the same, and as nearly the same (fixed values).
SAME_SCORE, NEAR_SCORE = 0.92, 0.8
TIERS = ("preferences", "project-context", "conversations")
TYPES = ("preference", "decision", "context", "relationship", "observation", "rejection", "archived")


class Conflict(ValueError):
    """A write that would break a rule of the table."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, path: str) -> str | None:
        p, fs = self._file(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        """Written beside and renamed over, so that a reader sees the old or the new text."""
        beside = f"{path}.{uuid.uuid4().hex}"
        p, fs = self._file(beside)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        # Overwriting is part of the move, so that no moment has no file.
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        target, _ = self._file(path)
        over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(p), fs.makeQualified(target), over)

    def version(self, table: str) -> int:
        text = self._read_text(f"{self.root}/{table}/CURRENT")
        if text is None:
            return 0
        state = json.loads(text)
        if state["schema_version"] != SCHEMA_VERSION:
            side = "ahead of" if state["schema_version"] > SCHEMA_VERSION else "behind"
            raise Conflict(f"{table}: its schema version {state['schema_version']} is {side} this library's {SCHEMA_VERSION}")
        return state["version"]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        n = self.version(table) if version is None else version
        if not n:
            raise FileNotFoundError(f"{self.root}/{table} has no version")
        return self.spark.read.parquet(f"{self.root}/{table}/v={n}")

    def write(self, table: str, rows: DataFrame, unique: list[list[str]] | None = None, rules: dict[str, Column] | None = None) -> int:
        """A new version with these rows; nothing changes for readers unless all rules hold."""
        n = self.version(table) + 1
        path = f"{self.root}/{table}/v={n}"
        rows.write.mode("overwrite").parquet(path)
        written = self.spark.read.parquet(path)
        broken = [name for name, c in check(written, unique or [], rules or {}) if c]
        if broken:
            p, fs = self._file(path)
            fs.delete(p, True)
            raise Conflict(f"{table}: {', '.join(broken)}")
        self._write_text(f"{self.root}/{table}/CURRENT", json.dumps({"version": n, "schema_version": SCHEMA_VERSION}))
        return n


def check(rows: DataFrame, unique: list[list[str]], rules: dict[str, Column]) -> list[tuple[str, int]]:
    """(rule, number of rows against it)."""
    found = []
    if rules:
        row = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]).first()
        found += [(name, row[f"r{i}"]) for i, name in enumerate(rules)]
    for key in unique:
        twice = rows.groupBy(*key).count().where("count > 1").limit(1).count()
        found.append((f"unique ({', '.join(key)})", twice))
    return found


def memory_rules() -> dict[str, Column]:
    return {
        "id is not null": F.col("id").isNotNull(),
        "content is not null": F.col("content").isNotNull(),
        "tier is known": F.col("tier").isin(*TIERS),
        "type is known": F.col("type").isin(*TYPES),
        "fingerprint is not null": F.col("fingerprint").isNotNull(),
    }


MEMORY_KEYS = [["id"], ["project_scope", "fingerprint"]]


def remember(records: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Records after a batch of additions. What a scope holds already (archived rows too) is only touched; the rest is added.

    incoming: the columns of records without fingerprint, created_at and updated_at. Repeats within the batch are added once, the
    smallest id of them.
    """
    once = Window.partitionBy("project_scope", "fingerprint").orderBy("id")
    batch = (
        spread(incoming).withColumn("fingerprint", fingerprint(F.col("content"))).withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
        .withColumn("created_at", now).withColumn("updated_at", now)
    )
    key = ["project_scope", "fingerprint"]
    touched = records.join(batch.select(*key, F.lit(True).alias("_hit")), key, "left").withColumn(
        "updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    )
    fresh = batch.join(records.select(*key).distinct(), key, "left_anti")
    return touched.select(*records.columns).unionByName(fresh.select(*records.columns))


def updated(records: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Records with (id, project_scope, and any of content, tier, type, topics, people, section) changed where id and scope agree."""
    columns = [c for c in changes.columns if c not in ("id", "project_scope")]
    renamed = changes.select("id", "project_scope", *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = records.join(renamed, ["id", "project_scope"], "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    if "content" in columns:
        out = out.withColumn("fingerprint", F.when(F.col("_new_content").isNotNull(), fingerprint(F.col("content"))).otherwise(F.col("fingerprint")))
    return out.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).select(*records.columns)


def archived(records: DataFrame, ids: DataFrame, now: Column, replacements: DataFrame | None = None) -> DataFrame:
    """Records with the given ids archived, and replacement rows added."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = records.join(hit, "id", "left").withColumn("type", F.when(F.col("_hit"), "archived").otherwise(F.col("type")))
    out = out.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).select(*records.columns)
    return out if replacements is None else remember(out, replacements, now)


def rejected(records: DataFrame, reasons: DataFrame, now: Column) -> DataFrame:
    """Records with (id, reason) flipped to rejections, and a row with each reason that copies tier, topics and people."""
    hit = records.join(reasons.select("id", "reason").dropDuplicates(["id"]), "id")
    why = (
        hit.withColumn("content", F.col("reason")).withColumn("section", F.concat(F.lit("rejection-of:"), F.col("id")))
        .withColumn("id", F.concat(F.lit("why-"), F.col("id")))
        .withColumn("type", F.lit("rejection")).withColumn("fingerprint", fingerprint(F.col("content"))).withColumn("created_at", now).withColumn("updated_at", now)
        .withColumn("embedding", F.lit(None).cast(records.schema["embedding"].dataType))
    )
    flipped = records.join(reasons.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left").withColumn(
        "type", F.when(F.col("_hit"), "rejection").otherwise(F.col("type"))
    )
    return flipped.select(*records.columns).unionByName(why.select(*records.columns))


def planned_operation(score: Column, kind: Column) -> Column:
    """What to do with a text, by the similarity of its nearest record: leave it, update that record, or add it."""
    return F.when(score >= SAME_SCORE, "NOOP").when(score >= NEAR_SCORE, "UPDATE").when(kind == "rejection", "REJECTION").otherwise("ADD")
