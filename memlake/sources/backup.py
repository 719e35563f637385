"""Export to and import from JSON lines: a header line, then one line for each row of each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.operators.filters import in_scopes

FORMAT, VERSION = "memlake-backup", 1
#: In the order in which rows may refer to rows of earlier tables.
TABLES = ("memories", "entities", "memory_edges", "memory_entities")
KEYS = {
    "memories": [["id"], ["project_scope", "fingerprint"]],
    "entities": [["id"], ["project_scope", "type", "normalized_name"]],
    "memory_edges": [["id"], ["from_memory_id", "to_memory_id", "relation"]],
    "memory_entities": [["memory_id", "entity_id"]],
}


def scoped(tables: dict[str, DataFrame], scope: str | None) -> dict[str, DataFrame]:
    """Rows of the scope; edges and links only with both ends in it."""
    if scope is None:
        return tables
    out = {t: tables[t].where(in_scopes([scope])) for t in ("memories", "entities")}
    ids, names = out["memories"].select("id"), out["entities"].select("id")
    out["memory_edges"] = tables["memory_edges"]
    for end in ("from_memory_id", "to_memory_id"):
        out["memory_edges"] = out["memory_edges"].join(ids.select(F.col("id").alias(end)), end, "left_semi")
    out["memory_entities"] = (
        tables["memory_entities"].join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        .join(names.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    )
    return out


def lines(tables: dict[str, DataFrame], scope: str | None = None) -> DataFrame:
    """(place, value): the lines of a backup, to be sorted by place where order matters."""
    spark = tables["memories"].sparkSession
    header = F.to_json(F.struct(F.lit("header").alias("kind"), F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(scope).alias("scope")))
    out = spark.range(1).select(F.lit("0").alias("place"), header.alias("value"))
    for i, t in enumerate(TABLES):
        rows = scoped(tables, scope)[t]
        own = F.to_json(F.struct(F.lit("row").alias("kind"), F.lit(t).alias("table"), F.struct(*[F.col(c) for c in rows.columns]).alias("data")), {"ignoreNullFields": "false"})
        when = F.col("created_at") if "created_at" in rows.columns else F.col("first_seen_at")
        first = F.col("id") if "id" in rows.columns else F.concat_ws("|", "memory_id", "entity_id")
        out = out.unionByName(rows.select(F.concat_ws("|", F.lit(str(i + 1)), F.coalesce(when.cast("string"), F.lit("")), first).alias("place"), own.alias("value")))
    return out


def export(tables: dict[str, DataFrame], path: str, scope: str | None = None) -> None:
    """Text files in order of place: sorted over all tasks, no single writer."""
    lines(tables, scope).orderBy("place").select("value").write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a backup, and its unreadable lines (value, error). A missing or unknown header is an error."""
    text = spark.read.text(path).where(F.length("value") > 0)
    envelope = "kind string, format string, version int, table string"
    rows = text.select("value", F.from_json("value", envelope).alias("e"))
    header = rows.where("e.kind = 'header'").select("e.*").limit(2).collect()
    if len(header) != 1 or header[0]["format"] != FORMAT or header[0]["version"] != VERSION:
        raise ValueError(f"{path} doesn't begin as a backup of version {VERSION}")
    tables = {}
    for t in TABLES:
        kind = T.StructType([T.StructField("data", schemas[t])])
        tables[t] = rows.where((F.col("e.kind") == "row") & (F.col("e.table") == t)).select(F.from_json("value", kind)["data"].alias("d")).select("d.*")
    known = (F.col("e.kind") == "header") | ((F.col("e.kind") == "row") & F.col("e.table").isin(*TABLES))
    errors = rows.where(~F.coalesce(known, F.lit(False))).select("value", F.lit("neither the header nor a row of a known table").alias("error"))
    return tables, errors


def inserted(existing: DataFrame, incoming: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the import, rows that were new). A row that meets any unique key of an existing row is skipped."""
    fresh = incoming.dropDuplicates(KEYS[table][0])
    for key in KEYS[table]:
        fresh = fresh.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns)), fresh.select(*existing.columns)


def outcomes(existing: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> DataFrame:
    """(table, inserted, skipped) of an import, as a dry run."""
    out = None
    for t in TABLES:
        _, fresh = inserted(existing[t], incoming[t], t)
        row = incoming[t].agg(F.count(F.lit(1)).alias("n")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("inserted"))).select(
            F.lit(t).alias("table"), "inserted", (F.col("n") - F.col("inserted")).alias("skipped")
        )
        out = row if out is None else out.unionByName(row)
    return out


def state_log(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, pair_hash, stage, timestamp, cost_usd, edge_id) of an append-only log; a cut-off last line drops out."""
    schema = "run_id string, pair_hash string, stage string, timestamp string, cost_usd double, edge_id string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col("pair_hash").isNotNull())


def terminal(log: DataFrame, run_id: str, stages: tuple[str, ...]) -> DataFrame:
    """(pair_hash) that a run has done with."""
    return log.where((F.col("run_id") == run_id) & F.col("stage").isin(*stages)).select("pair_hash").distinct()


def append_state(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def age_days(later: Column, earlier: Column) -> Column:
    return F.round((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0))
