import pytest
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.functions.vector import cosine


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("words,tokens", [(1, 2), (2, 3), (10, 13), (0, 0)])
def test_token_estimate(spark, words, tokens):
    assert one(spark, text.estimate_tokens(F.lit(" ".join(["w"] * words)))) == tokens


def test_fingerprint_ignores_marks_and_space(spark):
    rows = spark.createDataFrame([("a  b <!-- x\ny --> c",), (" a b c",), ("a b c [See also: z]",), (None,)], "t string")
    got = [r[0] for r in rows.select(text.fingerprint(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] and got[3] is None


def test_unicode_space_is_collapsed(spark):
    assert one(spark, text.normalize_content(F.lit("a　 b﻿"))) == "a b"


def test_pair_hash_is_symmetric(spark):
    assert one(spark, text.pair_hash(F.lit("a"), F.lit("b"))) == one(spark, text.pair_hash(F.lit("b"), F.lit("a")))


def test_slug_title_excerpt_headers(spark):
    assert one(spark, text.topic_slug(F.lit("--Ab c/D_"))) == "ab-c-d"
    assert one(spark, text.topic_title(F.lit("mY_topic-name"))) == "MY Topic Name"
    assert one(spark, text.excerpt(F.lit("x" * 121))) == "x" * 117 + "..."
    assert one(spark, text.excerpt(F.lit("x" * 120))) == "x" * 120
    assert one(spark, text.headers(F.lit("# a\n## b\n### c\n#### d"))) == ["## b", "### c"]


def test_jaccard_and_levenshtein(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, text.jaccard(empty, empty)) == 0
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("b")))) == 0.5
    assert one(spark, text.levenshtein_ratio(F.lit(""), F.lit(""))) == 1
    assert one(spark, text.levenshtein_ratio(F.lit("aé"), F.lit("ae"))) == 0.5


@pytest.mark.parametrize("reply,want", [("YES — related", True), ("**No**: other", False), ("Answer: yes", True), ("maybe", None), ("", None)])
def test_verdict(spark, reply, want):
    assert one(spark, text.verdict(F.lit(reply))) is want


def test_relation_reply(spark):
    read = lambda s: one(spark, text.relation_reply(F.lit(s), ("supports", "none")))
    whole = read('```json\n{"relation": "Supports", "confidence": 0.5, "rationale": " r "}\n```')
    assert (whole.relation, whole.confidence, whole.rationale, whole.error) == ("supports", 0.5, "r", None)
    cut = read('{"relation": "supports", "confidence": 0.7, "rationale": "because it')
    assert (cut.relation, cut.confidence, cut.rationale) == ("supports", 0.7, "because it [truncated]")
    assert read('{"relation": "odd", "confidence": 1}').error == "unknown relation: odd"
    assert read("nothing").error == "unreadable"


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"),
     ("conditional", "condit"), ("electricity", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("happy", "happi"), ("sky", "sky"), ("controlling", "control")],
)
def test_porter(word, stem):
    assert text.porter(word) == stem


def test_english_lexemes(spark):
    assert one(spark, text.english_lexemes(text.tokens(F.lit("The connected connections are connecting")))) == ["connect"]


def test_nfkc_and_entity_name(spark):
    assert one(spark, text.normalize_entity_name(F.lit(" Ｆｕｌｌ  Width "))) == "full width"


def test_cosine_of_zero_and_null(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, cosine(zero, unit)) == 0
    assert one(spark, cosine(unit, unit)) == 1
    assert one(spark, cosine(F.lit(None).cast("array<double>"), unit)) is None
