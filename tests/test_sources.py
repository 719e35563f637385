import json
import os

import pytest
from pyspark.sql import functions as F

from memlake.sources import backup, markdown, store
from memlake.streaming.ingest import ingest, windowed_counts

KIND = "id string, content string, tier string, type string, section string, topics array<string>, people array<string>, date date, fingerprint string, embedding array<float>, source_file string, source_line int, created_at timestamp, updated_at timestamp, project_scope string"


def memories(spark, rows):
    values = [(i, c, "conversations", t, None, ["x"], None, None, None, None, None, None, None, None, s) for i, c, t, s in rows]
    return spark.createDataFrame(values, KIND).withColumn("fingerprint", store.fingerprint(F.col("content"))).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("updated_at", F.col("created_at"))


def incoming(spark, rows):
    return memories(spark, rows).drop("fingerprint", "created_at", "updated_at")


def now():
    return F.lit("2024-06-01").cast("timestamp")


def test_remember_touches_what_is_there_even_if_archived(spark):
    base = memories(spark, [("a", "one", "archived", "g"), ("b", "two", "context", "g")])
    after = {r.id: r for r in store.remember(base, incoming(spark, [("n1", " one ", "context", "g"), ("n2", "one", "context", "h"), ("n3", "three", "context", "g"), ("n4", "three", "context", "g")]), now()).collect()}
    assert set(after) == {"a", "b", "n2", "n3"}
    assert after["a"].type == "archived" and after["a"].updated_at.month == 6 and after["b"].updated_at.month == 1


def test_update_archive_reject(spark):
    base = memories(spark, [("a", "one", "context", "g"), ("b", "two", "context", "g")])
    change = spark.createDataFrame([("a", "g", "uno"), ("b", "other", "dos")], "id string, project_scope string, content string")
    after = {r.id: r for r in store.updated(base, change, now()).collect()}
    assert after["a"].content == "uno" and after["b"].content == "two" and after["a"].fingerprint != base.where("id = 'a'").first().fingerprint
    gone = {r.id: r.type for r in store.archived(base, spark.createDataFrame([("a",)], "id string"), now(), incoming(spark, [("c", "new", "context", "g")])).collect()}
    assert gone == {"a": "archived", "b": "context", "c": "context"}
    no = {r.id: r for r in store.rejected(base, spark.createDataFrame([("a", "wrong")], "id string, reason string"), now()).collect()}
    assert no["a"].type == "rejection" and no["why-a"].section == "rejection-of:a" and no["why-a"].topics == ["x"] and len(no) == 3


def test_snapshots_and_rules(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    base = memories(spark, [("a", "one", "context", "g")])
    assert s.version("memories") == 0
    assert s.write("memories", base, store.MEMORY_KEYS, store.memory_rules()) == 1
    with pytest.raises(store.Conflict):
        s.write("memories", base.union(base), store.MEMORY_KEYS, store.memory_rules())
    with pytest.raises(store.Conflict):
        s.write("memories", base.withColumn("tier", F.lit("odd")), [], store.memory_rules())
    assert s.version("memories") == 1 and s.read("memories").count() == 1
    more = store.remember(s.read("memories"), incoming(spark, [("b", "two", "context", "g")]), now())
    assert s.write("memories", more, store.MEMORY_KEYS, store.memory_rules()) == 2
    assert s.read("memories").count() == 2 and s.read("memories", 1).count() == 1
    pointer = f"{tmp_path}/db/memories/CURRENT"
    state = json.load(open(pointer))
    for crc in os.listdir(os.path.dirname(pointer)):
        if crc.endswith(".crc"):
            os.remove(os.path.join(os.path.dirname(pointer), crc))
    json.dump(state | {"schema_version": 99}, open(pointer, "w"))
    with pytest.raises(store.Conflict):
        s.read("memories")


def test_plan_of_operation(spark):
    df = spark.createDataFrame([(0.95, "x"), (0.8, "x"), (0.1, "rejection"), (0.1, "x")], "s double, k string")
    assert [r[0] for r in df.select(store.planned_operation(F.col("s"), F.col("k"))).collect()] == ["NOOP", "UPDATE", "REJECTION", "ADD"]


def tables(spark):
    m = memories(spark, [("a", "one", "context", "g"), ("b", "two", "context", "h")])
    e = spark.createDataFrame([("e1", "person", "Ann", "ann", ["A"], "{}", None, None, "g")], "id string, type string, canonical_name string, normalized_name string, aliases array<string>, metadata string, first_seen_at timestamp, last_seen_at timestamp, project_scope string")
    r = spark.createDataFrame([("r1", "a", "b", "supports", None)], "id string, from_memory_id string, to_memory_id string, relation string, created_at timestamp")
    k = spark.createDataFrame([("a", "e1", None), ("b", "e1", None)], "memory_id string, entity_id string, created_at timestamp")
    return {"memories": m, "entities": e, "memory_edges": r, "memory_entities": k}


def test_backup_round_trip(spark, tmp_path):
    own = tables(spark)
    backup.export(own, f"{tmp_path}/out")
    back, errors = backup.load(spark, f"{tmp_path}/out", {t: df.schema for t, df in own.items()})
    assert errors.count() == 0
    for t, df in own.items():
        assert sorted(map(str, back[t].collect())) == sorted(map(str, df.collect()))
    got = {r.table: (r.inserted, r.skipped) for r in backup.outcomes({t: df.limit(0) if t == "memories" else df for t, df in own.items()}, back).collect()}
    assert got == {"memories": (2, 0), "entities": (0, 1), "memory_edges": (0, 1), "memory_entities": (0, 2)}


def test_backup_scope_needs_both_ends(spark):
    kept = {t: df.count() for t, df in backup.scoped(tables(spark), "g").items()}
    assert kept == {"memories": 1, "entities": 1, "memory_edges": 0, "memory_entities": 1}


def test_bad_backups(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"kind": "row"}\n')
    with pytest.raises(ValueError):
        backup.load(spark, str(tmp_path / "x.jsonl"), {})


def test_state_log_survives_a_cut_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"run_id": "r", "pair_hash": "p1", "stage": "stage2_done"}\n{"run_id": "r", "pair_hash": "p2", "stage": "stage1_passed"}\n{"run_id": "r", "pair')
    log = backup.state_log(spark, str(tmp_path / "log.jsonl"))
    assert [r.pair_hash for r in backup.terminal(log, "r", ("stage2_done",)).collect()] == ["p1"]


def test_markdown_entries(spark):
    text = "# t\n- lone\n## One \n- first\n  more\n\n- second <!-- type: decision topics: a,b people: c -->\n## Two\n\nprose\n- third <!-- type:x --> <!-- type:y -->"
    df = spark.createDataFrame([("f", text), ("g", "")], "source_file string, text string")
    rows = markdown.entries(df).orderBy("source_line").collect()
    assert [(r.section, r.content.split(" <")[0], r.type) for r in rows] == [
        (None, "lone", "observation"), ("One", "first\n  more", "observation"), ("One", "second", "decision"), ("Two", "third", "y")
    ]
    assert rows[2].topics == ["a", "b"] and rows[2].people == ["c"] and rows[0].topics is None


def test_ingest_stream_is_idempotent(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    s.write("memories", memories(spark, [("a", "one", "context", "g")]))
    schema = incoming(spark, [("a", "b", "c", "d")]).schema
    source = tmp_path / "in"
    incoming(spark, [("n", "two", "context", "g"), ("o", "one", "context", "g")]).write.json(str(source))
    ingest(spark, str(source), schema, s, str(tmp_path / "cp")).awaitTermination()
    assert {r.id for r in s.read("memories").collect()} == {"a", "n"}
    ingest(spark, str(source), schema, s, str(tmp_path / "cp2")).awaitTermination()
    assert s.read("memories").count() == 2


def test_windowed_counts_on_a_batch(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.n, r.total) for r in windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]
