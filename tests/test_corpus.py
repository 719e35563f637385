import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.functions import frontmatter
from memlake.operators import corpus

LINE = '{"from": {"id": "a", "content": "x", "type": "context"}, "to": {"id": "b", "content": "y", "type": "context"}, "expected_relation": "%s"}\n'


def test_corpus_reads_and_refuses(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text(LINE % "none" + LINE % "supports")
    assert corpus.read_corpus(spark, str(tmp_path / "good.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text(LINE % "likes")
    with pytest.raises(Exception, match="unknown relation"):
        corpus.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_labels_must_be_known(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "pair_id string, t string")
    assert corpus.matched_labels(rows, spark.createDataFrame([("2", "none")], "pair_id string, human_label string")).count() == 1
    with pytest.raises(ValueError, match="unknown rows: 3"):
        corpus.matched_labels(rows, spark.createDataFrame([("3", "none")], "pair_id string, human_label string"))


def test_rejected_pairs(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "id_a string, id_b string")
    hashes = corpus.with_pair_hash(pairs.where("id_a = 'a'")).select("pair_hash")
    edges = spark.createDataFrame([("c", "a")], "from_memory_id string, to_memory_id string")
    assert [(r.id_a, r.id_b) for r in corpus.rejected_pairs(pairs, hashes, edges).collect()] == [("a", "b")]


def test_probabilities(spark):
    df = spark.createDataFrame([('{"b": 3, "a": 1, "z": 9, "c": -1}',), ('```json\n{"a": 0.5, "b": 0.5}\n```',), ("nothing",), ('{"z": 1}',)], "r string")
    p = corpus.probabilities(F.col("r"), ["a", "b", "c"])
    got = df.select(p.alias("p"), corpus.most_probable(p, ["a", "b", "c"]).alias("m")).collect()
    assert [(r.p, r.m) for r in got] == [({"b": 0.75, "a": 0.25}, "b"), ({"a": 0.5, "b": 0.5}, "a"), (None, None), (None, None)]
    scored = spark.createDataFrame([('{"1": 1, "5": 3}',)], "r string").select(corpus.expected_score(corpus.probabilities(F.col("r"), ["1", "5"])))
    assert scored.first()[0] == 4.0


def test_shadow_summary(spark):
    rows = [(None, 0.9, True, True), (None, 0.4, True, True), (None, 0.1, False, False), ("topic:tax", None, True, False), ("text:gp", 0.9, True, True)]
    df = spark.createDataFrame(rows, "skip_reason string, probability double, passed boolean, edge boolean")
    row = corpus.shadow_summary(df, [0.5]).first()
    assert (row.compared, round(row.agreement, 4), row.missed_edges) == (3, 0.6667, 1)
    assert {(r.kind, r.n) for r in corpus.skip_kinds(df).collect()} == {("topic", 1), ("text", 1)}


def test_embedding_fills_only_what_is_missing(spark):
    df = spark.createDataFrame([("a", "xx", [1.0]), ("b", "yyy", None)], "id string, content string, embedding array<float>")
    got = {r.id: r.embedding for r in corpus.embedded(df, lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got == {"a": [1.0], "b": [3.0]} and corpus.embedded(df).where("embedding IS NULL").count() == 1


@given(st.dictionaries(st.from_regex(r"[a-z_]{1,8}", fullmatch=True), st.one_of(st.text(max_size=12).filter(lambda x: "\r" not in x), st.lists(st.text(min_size=1, max_size=8).filter(lambda x: "\r" not in x), max_size=3)), max_size=4))
def test_frontmatter_round_trip(head):
    back, body = frontmatter.parse(frontmatter.emit(head, "# t\n---\nx"))
    assert body == "# t\n---\nx" and back == head


def test_no_frontmatter():
    assert frontmatter.parse("# t\n") == ({}, "# t\n")
