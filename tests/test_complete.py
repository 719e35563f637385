import pytest
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import compile as compiled
from memlake.operators import guard, measures, ranges, report, retrieve
from memlake.session import shared_dir
from memlake.sources.store import Store


def test_places_in_a_hot_group_are_those_of_one_sorted_pass(spark):
    rows = [("hot", i * 7919 % 1000) for i in range(1000)] + [("cold", i) for i in range(5)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r.g, r.v): r.place for r in ranges.numbered(df, ["g"], ["v"], "place").collect()}
    assert all(got["hot", v] == v + 1 for v in range(1000)) and got["cold", 4] == 5 and got[None, 1] == 1


def test_no_task_gets_a_whole_hot_group(spark):
    # Parts as small as here would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ranges.ranged(spark.range(20_000).select(F.lit("hot").alias("g"), "id"), [F.col("g"), F.col("id")])
        sizes = [r["count"] for r in parts.groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 3 and max(sizes) < 10_000


def test_sum_before_and_auc(spark):
    df = spark.createDataFrame([(i / 100, i) for i in range(100)], "p double, n long")
    got = {r.p: r.below for r in ranges.sum_before(df, "p", "n", "below").collect()}
    assert got[0.0] == 0 and got[0.5] == sum(range(50))
    judged = spark.createDataFrame([(0.9, True), (0.4, True), (0.4, False), (0.1, False)], "probability double, truth boolean")
    assert measures.roc_auc(judged).first()["auc"] == pytest.approx(3.5 / 4)
    assert measures.roc_auc(judged.where("truth")).first()["auc"] is None


def test_egress_is_checked_before_a_model_is_made():
    made = []
    makers = {"near": lambda: made.append("near"), "far": lambda: made.append("far")}
    allowed = guard.allowed_scopes(" a , b,,")
    guard.chosen_model("near", makers, frozenset({"far"}), None, allowed)
    guard.chosen_model("far", makers, frozenset({"far"}), "a", allowed)
    with pytest.raises(guard.EgressRefused):
        guard.chosen_model("far", makers, frozenset({"far"}), "c", allowed)
    with pytest.raises(ValueError):
        guard.chosen_model("other", makers, frozenset(), "a", allowed)
    assert allowed == {"a", "b"} and made == ["near", "far"]


def test_provenance(tmp_path):
    import hashlib

    file, other = tmp_path / "corpus.jsonl", tmp_path / "other.jsonl"
    file.write_bytes(b"x")
    other.write_bytes(b"x")
    pin = hashlib.sha256(b"x").hexdigest()
    assert guard.provenance(str(file), b"x", str(file), pin) == "public-fixture"
    assert guard.provenance(str(other), b"x", str(file), pin) == guard.provenance(str(tmp_path / "none"), b"x", str(file), pin) == "db-sample"
    with pytest.raises(ValueError):
        guard.provenance(str(file), b"y", str(file), pin)


def test_refusals_and_skips(spark):
    rows = [("my password: x", []), ("saw a doctor", ["a"]), ("fine", ["therapist"]), ("fine", []), ("password = doctor", None)]
    df = spark.createDataFrame(rows, "c string, t array<string>")
    assert [r[0] for r in df.select(guard.refusal(F.col("c"), F.coalesce("t", F.array().cast("array<string>")))).collect()] == ["secret", "health", "health", None, "secret"]
    prompts = spark.createDataFrame([("ok, thanks!", 1), ("", 1), ("short", 0), ("x" * 300, 0), ("run it", 1)], "p string, n int")
    assert [r[0] for r in prompts.select(guard.skip_reason(F.col("p"), F.col("n"), F.lit(0), 3)).collect()] == ["acknowledgement", "no-prompt", "too-small", None, None]


def test_relation_replies(spark):
    rows = ['{"relation": "Supports", "confidence": 0.5, "rationale": " x "}', 'Sure: ```json\n{"relation": "supports", "confidence": 1}\n```', '{"relation": "supports", "confidence": 0.8, "rationale": "cut of', "nothing", '{"relation": "likes", "confidence": 1}']
    got = [r.r for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.relation_reply(F.col("t"), ("supports",)).alias("r")).collect()]
    assert (got[0].relation, got[0].confidence, got[0].rationale, got[0].error) == ("supports", 0.5, "x", None)
    assert (got[1].relation, got[1].confidence, got[1].error) == ("supports", 1.0, None)
    assert (got[2].relation, got[2].confidence, got[2].rationale, got[2].error) == ("supports", 0.8, "cut of [truncated]", None)
    assert got[3].error == "unreadable" and got[4].error == "unknown relation: likes"


def test_extraction_replies_drop_and_clamp(spark):
    reply = '{"matched": [{"canonical_name": "A", "confidence": 2}, {"confidence": 1}], "new_entities": [{"type": "tool", "canonical_name": "B", "aliases": ["b", null], "confidence": 0.4}, {"type": "car", "canonical_name": "C", "confidence": 1}]}'
    df = spark.createDataFrame([(reply,), ("{}",), ("no",)], "t string").select(text.extraction_reply(F.col("t"), ("tool",)).alias("r"))
    a, b, c = [r.r for r in df.collect()]
    assert (a.dropped, a.clamped, a.error) == (2, 1, None) and a.matched[0].confidence == 1.0 and a.new_entities[0].aliases == ["b"]
    assert b.error and c.error


def test_report_and_known_entities(spark):
    findings = spark.createDataFrame([("stale", "m1", None, 0.7, "archive"), ("drift", "m2", "m3", 0.55, "reclassify")], "check string, memory_id string, other_id string, confidence double, action string")
    summary = findings.groupBy("check").agg(F.count(F.lit(1)).alias("findings"))
    told = report.lint_report(summary, findings)
    assert "Total findings: 2" in told and "  - m2 ↔ m3" in told and "action: archive (confidence 0.70)" in told
    entities = spark.createDataFrame([("1", "tool", "B", ["b"]), ("2", "person", "A", None)], "id string, type string, canonical_name string, aliases array<string>")
    assert report.known_entities_block(entities) == "- person: A\n- tool: B (aliases: b)"
    with pytest.raises(ValueError):
        report.known_entities_block(entities, most=1)


def test_compile_run_takes_one_of_its_scopes(spark):
    rows = spark.createDataFrame([("m1", "context", "preferences", "One. Two.", ["a"], None, None), ("m2", "context", "preferences", "Three.", ["b"], None, None)], "id string, type string, tier string, content string, topics array<string>, date date, created_at timestamp")
    edges = spark.createDataFrame([("m2", "m1", "supersedes", "newer")], "from_memory_id string, to_memory_id string, relation string, rationale string")
    previous = spark.createDataFrame([("a", "topics/a.md"), ("a", "topics/a-part-2.md"), ("b", "topics/b.md")], "topic string, path string")
    with pytest.raises(ValueError):
        compiled.compile_run(rows, edges, previous, tier="preferences", topic="a")
    made, manifest, stale = compiled.compile_run(rows, edges, previous, topic="a")
    assert [r.path for r in made.collect()] == ["topics/a.md"] and [r.path for r in stale.collect()] == ["topics/a-part-2.md"]
    assert {r.path for r in manifest.collect()} == {"topics/a.md", "topics/b.md"}
    sections = compiled.tier_documents(rows.withColumn("topics", F.array(F.lit("a"))), edges).collect()
    assert sections[0].body == "One <m:m1>\nThree. <m:m2>\n\n- m2 supersedes m1 — newer"


def test_pointer_is_moved_over_and_the_shared_folder_is_demanded(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n in (1, 2, 3):
        assert store.write("t", spark.range(n)) == n == store.version("t") == store.read("t").count()
    assert [p.name for p in (tmp_path / "t").glob("CURRENT*")] == ["CURRENT"]
    assert shared_dir(spark)


def test_search_mode_and_compaction(spark):
    rows = spark.createDataFrame([("a", "s", None), ("b", "t", [1.0])], "id string, project_scope string, embedding array<double>")
    assert retrieve.search_mode(rows, True, ["t"]) == "semantic"
    assert retrieve.search_mode(rows, True, ["s"]) == retrieve.search_mode(rows, False, ["t"]) == "fulltext_only"
    out = retrieve.compacted(spark.createDataFrame([(0.12349999, [], True, 1)], "score double, people array<string>, early_stopped boolean, created_at int")).first()
    assert out.asDict() == {"score": 0.123, "people": None, "early_stopped": True}


def test_every_attempt_of_a_cascade_costs(spark):
    from memlake.operators import cascade

    tried = {}

    def once_broken(batch):
        key = tuple(batch["pair_hash"])
        tried[key] = tried.get(key, 0) + 1
        if tried[key] == 1:
            raise ValueError("no reply")
        return ["YES"] * len(batch)

    records = spark.createDataFrame([("a", "one two three", "context"), ("b", "one two four", "context")], "id string, content string, type string")
    pairs = spark.createDataFrame([("a", "b")], "id_a string, id_b string")
    cost = {n: cascade.classify(pairs, records, stage1=m).first()["cost_usd"] for n, m in (("plain", lambda batch: ["YES"] * len(batch)), ("twice", once_broken))}
    assert cost["twice"] - cost["plain"] == pytest.approx(cascade.STAGE1_COST)
