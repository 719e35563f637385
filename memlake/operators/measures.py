"""Evaluation metrics over labelled predictions, and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.ranges import sum_before


def safe(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def threshold_sweep(judged: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Counts, recall and precision at each threshold, in one pass over (probability, truth)."""
    p, t = F.col("probability"), F.col("truth")
    cells = [
        F.struct(F.lit(float(x)).alias("threshold"), F.count_if((p >= x) & t).alias("tp"), F.count_if((p >= x) & ~t).alias("fp"),
                 F.count_if((p < x) & t).alias("fn"), F.count_if((p < x) & ~t).alias("tn"))
        for x in thresholds
    ]
    rows = judged.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp")))


def label_confusion(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(actual, predicted, n) for each pair of labels, zero cells included, over (actual, predicted)."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    return F.broadcast(grid).join(pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")), ["actual", "predicted"], "left").na.fill(0, ["n"])


def label_scores(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, support, recall, precision) of each label; support counts all its rows, whatever was predicted."""
    cells = label_confusion(pairs, labels)
    actual = pairs.groupBy(F.col("actual").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("actual") == F.col("predicted")).alias("hit"))
    predicted = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("claimed"))
    rows = predicted.join(actual, "label", "left").na.fill(0)
    return rows.select("label", "support", safe(F.col("hit"), F.col("support")).alias("recall"), safe(F.col("hit"), F.col("claimed")).alias("precision"))


def pass_rate(judged: DataFrame, threshold: float) -> DataFrame:
    """One row: the share of judgments that a gate at the threshold lets through."""
    return judged.agg(safe(F.count_if(F.col("probability") >= threshold), F.count(F.lit(1))).alias("pass_rate"))


def cost_per_thousand(judged: DataFrame, cost: str) -> DataFrame:
    """One row: dollars for a thousand judgments; 0 without any."""
    return judged.agg((safe(F.sum(F.col(cost).cast("double")), F.count(F.lit(1))) * 1000).alias("cost_per_1k_usd"))


def stage_judgments(records: DataFrame) -> DataFrame:
    """(pair_id, probability, truth_pass, truth_relation, relation, confidence) to the samples of the three views.

    gate: what stage 1 said of pairs whose verdict is known. fixed: stage 2 on every pair whose relation is known and that it
    has seen. cascade: the same pairs as both stages decide together, `none` where stage 1 or a missing stage 2 stops them.
    """
    passed = F.col("probability") >= 0.5
    gate, known = F.col("truth_pass").isNotNull(), F.col("truth_relation").isNotNull()
    shape = lambda kind, when, actual, predicted, sure: F.when(
        when, F.struct(F.lit(kind).alias("view"), actual.cast("string").alias("actual"), predicted.cast("string").alias("predicted"), sure.cast("double").alias("confidence"))
    )
    views = F.array_compact(F.array(
        shape("gate", gate, F.col("truth_pass"), passed, F.greatest(F.col("probability"), 1 - F.col("probability"))),
        shape("fixed", known & F.col("relation").isNotNull(), F.col("truth_relation"), F.col("relation"), F.col("confidence")),
        shape("cascade", known, F.col("truth_relation"), F.when(passed & F.col("relation").isNotNull(), F.col("relation")).otherwise("none"), F.lit(None)),
    ))
    return records.select("pair_id", F.explode(views).alias("v")).select("pair_id", "v.*")


def needs_second_stage(probability: Column, truth_relation: Column) -> Column:
    """Whether stage 2 has to run: for the cascade if stage 1 passed, for the fixed view if the relation is known."""
    return (probability >= 0.5) | truth_relation.isNotNull()


def confusion(pairs: DataFrame) -> DataFrame:
    """(actual, predicted, n) with the actual label's recall and the predicted label's precision."""
    cells = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    rows, columns = Window.partitionBy("actual"), Window.partitionBy("predicted")
    return cells.withColumn("share_of_actual", F.col("n") / F.sum("n").over(rows)).withColumn("share_of_predicted", F.col("n") / F.sum("n").over(columns))


def calibration_bins(judged: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy), empty bins kept; a probability of 1 falls into the last bin."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("probability") * bins).cast("int")))
    found = judged.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("confidence"), F.avg(F.col("truth").cast("double")).alias("accuracy")
    )
    every = judged.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").na.fill(0).select("bin", "n", "confidence", "accuracy")


def calibration_error(judged: DataFrame, bins: int = 10) -> DataFrame:
    """One row: the mean gap between confidence and accuracy, weighted by the bins' sizes."""
    return calibration_bins(judged, bins).agg(safe(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")).alias("ece"))


def fit_temperature(judged: DataFrame, low: float = 0.25, high: float = 4.0, steps: int = 150) -> DataFrame:
    """(temperature, nll_before, nll_after): grid search over powers 1/T of (probability, 1 - probability).

    Equal judgments are counted first, and each count meets all grid points; T = 1 wins ties, then the smaller T.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate([1.0] + [low + (high - low) * i / steps for i in range(steps + 1)])])
    eps = F.lit(1e-12)
    rows = judged.groupBy("probability", "truth").agg(F.count(F.lit(1)).alias("n")).select("probability", "truth", "n", F.explode(grid).alias("g"))
    a, b = F.pow(F.greatest("probability", eps), 1 / F.col("g.t")), F.pow(F.greatest(1 - F.col("probability"), eps), 1 / F.col("g.t"))
    loss = -F.log(F.greatest(F.when(F.col("truth"), a).otherwise(b) / (a + b), eps))
    points = rows.groupBy("g").agg(F.round(F.sum(loss * F.col("n")) / F.sum("n"), 12).alias("nll"))
    return points.agg(
        F.min_by("g.t", F.struct("nll", "g.i")).alias("temperature"), F.max(F.when(F.col("g.i") == 0, F.col("nll"))).alias("nll_before"), F.min("nll").alias("nll_after")
    )


def roc_auc(judged: DataFrame) -> DataFrame:
    """One row: the chance that a positive outranks a negative, ties counting one half; null without one of the classes.

    Rank sums over the distinct probabilities: counts are pre-aggregated, and the negatives below each probability are
    summed within ranges of it and carried over the ranges' totals.
    """
    by = judged.groupBy("probability").agg(F.count_if(F.col("truth")).alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    won = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    return sum_before(by, "probability", "neg", "below").select(won.alias("won"), "pos", "neg").agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def nearest_rank(frame: DataFrame, column: str, percents: Sequence[int]) -> DataFrame:
    """One row with p<percent> columns: the smallest value that at least so many percent of the rows don't exceed."""
    cells = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").cast("double").alias(f"p{p}") for p in percents]
    return frame.agg(*cells)


def round_robin(frame: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """The first row of each stratum, then the second ones, ...; strata by first appearance, n rows in all."""
    own = Window.partitionBy(stratum).orderBy(order)
    # The cut to n rows comes first, so that it is made before the shuffle; the strata's first rows are an aggregate of their own.
    placed = frame.withColumn("_turn", F.row_number().over(own)).where(F.col("_turn") <= n)
    firsts = frame.groupBy(stratum).agg(F.min(order).alias("_first")).withColumnRenamed(stratum, "_stratum")
    return placed.join(firsts, F.col(stratum).eqNullSafe(F.col("_stratum"))).drop("_stratum").orderBy("_turn", "_first", order).limit(n).drop("_turn", "_first")
