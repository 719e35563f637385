import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import cascade, compile, edges, entities, filters, lint, measures, retrieve, sensitive, stats

RECORD = "id string, content string, tier string, type string, topics array<string>, people array<string>, embedding array<float>, created_at timestamp, updated_at timestamp, project_scope string, section string, date date"
PROPERTY = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def records(spark, rows):
    base = dict(content="", tier="conversations", type="context", topics=None, people=None, embedding=None, created="2024-01-01 00:00:00", scope="global")
    full = [base | r for r in rows]
    values = [(r["id"], r["content"], r["tier"], r["type"], r["topics"], r["people"], r["embedding"], r["created"], r.get("updated", r["created"]), r["scope"], None) for r in full]
    kind = RECORD.replace("timestamp", "string").replace(", date date", "")
    return spark.createDataFrame(values, kind).withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("updated_at", F.col("updated_at").cast("timestamp")).withColumn("date", F.lit(None).cast("date"))


def edge_rows(spark, rows):
    kind = "id string, from_memory_id string, to_memory_id string, relation string, confidence decimal(3,2), rationale string, classifier_version string, valid_from timestamp, valid_until timestamp, created_at timestamp, updated_at timestamp"
    from datetime import datetime
    from decimal import Decimal

    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(f"e{i}", a, b, rel, Decimal(str(c)), "", "v", t, t if len(rest) and rest[0] else None, t, t) for i, (a, b, rel, c, *rest) in enumerate(rows)], kind)


def batch(spark, rows):
    return spark.createDataFrame(rows, "query_id int, query_text string, query_vector array<double>")


TOPICS = st.lists(st.one_of(st.none(), st.sampled_from("abcd")), max_size=5)


@PROPERTY
@given(st.lists(st.tuples(TOPICS, st.lists(st.sampled_from("xyz"), max_size=2), st.sampled_from(["g", "h"])), min_size=1, max_size=9))
def test_candidate_pairs_equal_brute_force(spark, rows):
    df = records(spark, [dict(id=f"m{i}", topics=t, people=p, scope=s) for i, (t, p, s) in enumerate(rows)])
    got = {(r.id_a, r.id_b) for r in edges.candidate_pairs(df).collect()}
    bags = {(r.id_a, r.id_b) for r in edges.shared_topic_bags(df).collect()}
    want, want_bags = set(), set()
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        ta, tb = set(a[0]) - {None}, set(b[0]) - {None}
        if a[2] == b[2] and (len(ta & tb) >= 2 or set(a[1]) & set(b[1])):
            want.add((f"m{i}", f"m{j}"))
        if a[2] == b[2] and sum(t in tb for t in a[0] if t) >= 2:
            want_bags.add((f"m{i}", f"m{j}"))
    assert got == want and bags == want_bags


def test_pair_queries_have_no_nested_loop(spark):
    df = records(spark, [dict(id="a", topics=["x", "y"]), dict(id="b", topics=["y", "x"])])
    e = edge_rows(spark, [("a", "b", "supports", 0.5)])
    for plan in (edges.candidate_pairs(df), edges.shared_topic_bags(df), lint.orphans(df, e, F.current_timestamp()), lint.drift(df, e)):
        text = plan._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_clean_edges_keeps_latest_and_drops_self(spark):
    e = edge_rows(spark, [("a", "b", " Related-To ", 0.1), ("a", "b", "related_to", 0.9), ("a", "a", "supports", 1), (None, "b", "supports", 1)])
    got = edges.clean_edges(e).collect()
    assert [(r.relation, r.id) for r in got] == [("related_to", "e1")]


def test_signals_swap_to_older_first(spark):
    e = edge_rows(spark, [("n", "o", "supersedes", 1), ("r", "x", "contradicts", 1), ("x", "r", "contradicts", 1)])
    got = {(r.kind, r.memory_id, r.other_id) for r in edges.signals(e, spark.createDataFrame([("o",), ("r",), ("n",)], "id string")).collect()}
    assert got == {("superseded_by", "o", "n"), ("contradicts", "r", "x")}


def test_search_sees_archived_but_retrieval_does_not(spark):
    df = records(spark, [dict(id="a", type="archived"), dict(id="b", type="rejection"), dict(id="c")])
    assert {r.id for r in df.where(filters.not_rejected()).collect()} == {"a", "c"}
    assert {r.id for r in df.where(filters.active()).collect()} == {"c"}
    assert df.where(filters.overlaps("topics", ["x"])).count() == 0


def test_tier_weight_cannot_rescue_a_cut_row(spark):
    rows = [dict(id=f"c{i:02}", embedding=[1.0, 0.0], tier="conversations") for i in range(30)] + [dict(id="p", embedding=[0.99, 0.14], tier="preferences")]
    got = retrieve.hybrid_search(records(spark, rows), batch(spark, [(1, "", [1.0, 0.0])]), k=3)
    assert "p" not in {r.id for r in got.collect()} and got.count() == 30


def test_lexical_needs_all_words_and_empty_query_matches_nothing(spark):
    df = records(spark, [dict(id="a", content="Red fox red"), dict(id="b", content="red hen")])
    got = retrieve.scored(df, batch(spark, [(1, "red FOX", None), (2, "", None)])).collect()
    assert [(r.query_id, r.id, r.match_type, r.lexical) for r in got] == [(1, "a", "fulltext", 0.75)]


def test_progressive_stops_after_a_good_tier(spark):
    rows = [dict(id="p", embedding=[1.0, 0.0], tier="preferences"), dict(id="c", embedding=[1.0, 0.1], tier="conversations")]
    one = retrieve.progressive_search(records(spark, rows), batch(spark, [(1, "", [1.0, 0.0])]), stop_at=0.9)
    assert [r.id for r in one.collect()] == ["p"]
    both = retrieve.progressive_search(records(spark, rows), batch(spark, [(1, "", [1.0, 0.0])]), stop_at=1.1)
    assert both.count() == 2


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, "a b c"), (1, 2, "a b c d e f g h i j"), (1, 3, "a")], "query_id int, rank int, content string")
    assert [r["rank"] for r in retrieve.within_budget(df, 10, 5).collect()] == [1]
    assert retrieve.within_budget(df, 0, 5).count() == 0


def test_diversity_prefers_what_differs(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, [1.0, 0.0], "x"), (1, "b", 0.99, [1.0, 0.0], "x"), (1, "c", 0.8, [0.0, 1.0], "y"), (1, "d", 0.9, None, "x")],
        "query_id int, id string, score double, embedding array<float>, content string",
    )
    assert [r.id for r in retrieve.diversified(df, 3).orderBy("position").collect()] == ["a", "c", "b"]


def test_too_many_queries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "MAX_QUERIES", 1)
    with pytest.raises(ValueError):
        retrieve.collected(batch(spark, [(1, "a", None), (2, "b", None)]))


def test_recall_runs_end_to_end(spark):
    rows = [dict(id=f"m{i}", content=f"note {i} ledger", embedding=[float(i % 3), 1.0]) for i in range(8)]
    got = retrieve.recall(records(spark, rows), batch(spark, [(1, "ledger", [1.0, 1.0])]), k=4, max_tokens=12).collect()
    assert 1 <= len(got) <= 3 and sorted(r.position for r in got)[0] == 1


def judged(spark, pairs):
    return spark.createDataFrame([(float(p), bool(t)) for p, t in pairs], "probability double, truth boolean")


def test_auc(spark):
    assert measures.roc_auc(judged(spark, [(0.9, 1), (0.6, 1), (0.7, 0), (0.1, 0)])).first()["auc"] == 0.75
    assert measures.roc_auc(judged(spark, [(0.9, 1)])).first()["auc"] is None
    rng = random.Random(3)
    rows = [(rng.randrange(6) / 5, rng.random() < 0.4) for _ in range(80)]
    pos, neg = [p for p, t in rows if t], [p for p, t in rows if not t]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(measures.roc_auc(judged(spark, rows)).first()["auc"] - want) < 1e-12


def test_bins_keep_empty_ones_and_put_one_last(spark):
    got = {r.bin: r.n for r in measures.calibration_bins(judged(spark, [(1.0, 1), (0.0, 0), (0.95, 1)])).collect()}
    assert got[9] == 2 and got[0] == 1 and len(got) == 10


def test_temperature_prefers_one_on_ties(spark):
    row = measures.fit_temperature(judged(spark, [(0.5, 1), (0.5, 0)])).first()
    assert row.temperature == 1.0 and row.nll_before == row.nll_after


def test_nearest_rank_and_sweep(spark):
    assert measures.nearest_rank(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int"), "v", [50, 95]).first().asDict() == {"p50": 2.0, "p95": 4.0}
    row = measures.threshold_sweep(judged(spark, []), [0.5]).first()
    assert (row.tp, row.recall, row.precision) == (0, 0.0, 0.0)


def test_round_robin_equals_the_loop(spark):
    rows = [(i, s) for i, s in enumerate("bbabacca")]
    got = [r.i for r in measures.round_robin(spark.createDataFrame(rows, "i int, s string"), "s", "i", 6).collect()]
    assert got == [0, 2, 5, 1, 4, 6]


def test_surplus_is_zero_without_duplicates(spark):
    df = spark.createDataFrame([("g", "f")], "project_scope string, fingerprint string")
    assert stats.surplus(df).first()["surplus"] == 0
    assert stats.surplus(df.union(df).union(df)).first()["surplus"] == 2


def test_stale_rules(spark):
    now = F.lit("2024-12-31 00:00:00").cast("timestamp")
    rows = [dict(id="c", tier="conversations"), dict(id="p", tier="preferences"), dict(id="r", type="rejection"), dict(id="a", type="archived"), dict(id="n", created="2024-12-01 00:00:00")]
    assert {r.id for r in stats.stale(records(spark, rows), now).collect()} == {"c", "r"}


def test_lint_fix_skips_an_existing_edge(spark):
    e = edge_rows(spark, [("a", "b", "contradicts", 0.95), ("a", "b", "supersedes", 0.5), ("c", "d", "contradicts", 0.95)])
    df = records(spark, [dict(id=i, created=c) for i, c in (("a", "2024-03-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("c", "2024-03-01 00:00:00"), ("d", "2024-01-01 00:00:00"))])
    found = lint.contradictions(df, e)
    assert {(r.memory_id, r.action) for r in found.collect()} == {("a", "add_supersedes_edge"), ("c", "add_supersedes_edge")}
    after = {(r.from_memory_id, r.relation) for r in lint.fixed_edges(e, found).collect()}
    assert after == {("a", "contradicts"), ("a", "supersedes"), ("c", "supersedes")}


def test_entities_resolve_and_upsert(spark):
    e = spark.createDataFrame(
        [("1", "person", "Ann", "ann", ["Annie", None], "g"), ("2", "person", "Annie", "annie", [], "g")],
        "id string, type string, canonical_name string, normalized_name string, aliases array<string>, project_scope string",
    ).withColumn("last_seen_at", F.current_timestamp())
    got = {r.name: r.entity_id for r in entities.resolve(spark.createDataFrame([("ANNIE",), ("x",), (None,)], "name string"), e).collect()}
    assert got == {"annie": "2"}
    new = e.where("id = '1'").withColumn("aliases", F.array(F.lit("A."))).withColumn("id", F.lit("9"))
    merged = {r.id: (r.created, [a for a in r.aliases if a]) for r in entities.upserted(e, new).collect()}
    assert merged == {"1": (False, ["A.", "Annie"]), "2": (False, [])}


def test_sensitive_reason_order(spark):
    df = spark.createDataFrame([(["Tax"], "Health", "doctor"), (None, "Health notes", "x"), ([None], None, "my Doctor said"), ([], None, "x")], "topics array<string>, section string, content string")
    got = [r[0] for r in df.select(sensitive.sensitive_reason(F.col("topics"), F.col("section"), F.col("content"))).collect()]
    assert got == ["topic:Tax", "section:Health notes", "text:doctor", None]


def test_cascade_resumes_caps_and_guards(spark):
    df = records(spark, [dict(id="a", content="x y z", topics=["p", "q"]), dict(id="b", content="x y z", topics=["p", "q"]), dict(id="c", content="m n o", topics=["p", "q"], type="rejection")])
    pairs = edges.candidate_pairs(df)
    out = cascade.classify(pairs, df, cap_usd=100.0)
    rows = {(r.id_a, r.id_b): (r.stage, r.relation) for r in out.collect()}
    assert rows == {("a", "b"): ("stage2_done", "supersedes"), ("a", "c"): ("stage1_rejected", None), ("b", "c"): ("stage1_rejected", None)}
    s = cascade.run_summary(out).first()
    assert s.stage1_total == s.stage1_pass + s.stage1_skip == 3 and s.edges == 1
    assert cascade.classify(pairs, df, done=out.select("pair_hash")).count() == 0
    capped = cascade.classify(pairs, df, cap_usd=0.009)
    assert cascade.run_summary(capped).first().cap_reached == 2
    always = lambda rows: ["YES"] * len(rows)
    contra = lambda rows: ['{"relation": "contradicts", "confidence": 0.9, "rationale": ""}'] * len(rows)
    got = {(r.id_a, r.id_b): r.relation for r in cascade.classify(pairs, df, stage1=always, stage2=contra, cap_usd=9.0).collect()}
    assert got == {("a", "b"): "contradicts", ("a", "c"): "none", ("b", "c"): "none"}


def test_extraction_clamps_and_links(spark):
    df = records(spark, [dict(id="m", content="t")])
    model = lambda rows: ["person|7|Ann Lee\nbad line\ntool|x|Hammer\ntool|0.5|New Thing"] * len(rows)
    known = spark.createDataFrame([("ann lee", "e1")], "name string, entity_id string")
    got = {(r.name, r.confidence, r.entity_id) for r in cascade.extract(df, known, model).collect()}
    assert got == {("Ann Lee", 1.0, "e1"), ("New Thing", 0.5, None)}


def test_english_mode_matches_stems_without_stop_words(spark):
    rows = [dict(id="a", content="Migrating schemas, migrating"), dict(id="b", content="a schema of the migration"), dict(id="c", content="schema only")]
    df = records(spark, rows)
    queries = batch(spark, [(1, "schema migration", None), (2, "the schemas of our migrations", None), (3, "of the", None)])
    found = lambda mode: sorted((r.query_id, r.id) for r in retrieve.scored(df, queries, mode=mode).collect())
    assert found("simple") == [(1, "b"), (3, "b")]
    assert found("english") == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    lexical = {r.id: r.lexical for r in retrieve.scored(df, queries.where("query_id = 1"), mode="english").collect()}
    assert lexical == {"a": 0.75, "b": 0.666667}
    assert {r.id for r in retrieve.recall(df, queries.where("query_id = 2"), mode="english").collect()} == {"a", "b"}
    assert {r.id for r in df.where(filters.matches_all(text.lexemes(F.col("content"), "english"), text.lexemes(F.lit("the schemas"), "english"))).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        retrieve.scored(df, queries, mode="French")


def test_large_clusters_are_written_in_parts(spark):
    rows = [dict(id=f"m{i:02}", content=f"Note {i}. More", topics=["big"]) for i in range(7)] + [dict(id="s", content="Small", topics=["small"])]
    whole = {r.path: r.body for r in compile.documents(records(spark, rows)).collect()}
    got = {r.path: r.body for r in compile.documents(records(spark, rows), part_entries=3).collect()}
    assert set(whole) == {"topics/big.md", "topics/small.md"} and got["topics/small.md"] == whole["topics/small.md"]
    lines = lambda body: [x for x in body.split("\n") if x.startswith("- ")]
    parts = [lines(got[f"topics/big{p}.md"]) for p in ("", "-part-2", "-part-3")]
    assert [len(p) for p in parts] == [3, 3, 1] and sum(parts, []) == lines(whole["topics/big.md"])
