"""Quality: macro F0.5 over S1 entities, its breakdown, ROC-AUC and average precision with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.windows import running_sums


def f_half(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """1.25 TP / (0.25 T + P); an empty truth scores 1 iff the prediction is empty."""
    return F.when(n_true == 0, (n_pred == 0).cast("double")).when(n_pred == 0, 0.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def entity_scores(s1: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, tp, f for every S1, those without any pair included. Pair frames hold s1_id, o_id."""
    marked = truth.select("s1_id", "o_id", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(predicted.select("s1_id", "o_id", F.lit(0).alias("t"), F.lit(1).alias("p")))
    pairs = marked.groupBy("s1_id", "o_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = pairs.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    out = s1.select("s1_id").distinct().join(counts, "s1_id", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return out.withColumn("f", f_half(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f_half(scores: DataFrame) -> DataFrame:
    """macro and, by number of true matches, the means and counts of singletons, ones and manies."""
    kind = {"singleton": F.col("n_true") == 0, "one": F.col("n_true") == 1, "many": F.col("n_true") > 1}
    return scores.agg(F.round(F.avg("f"), 6).alias("macro"), F.count("*").alias("n"), *[x for k, c in kind.items() for x in (F.round(F.avg(F.when(c, F.col("f"))), 6).alias(k), F.sum(c.cast("long")).alias(f"n_{k}"))])


def _by_value(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("v")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """From counts by score value: equal scores count half."""
    each = running_sums(_by_value(df, score, label), "v", {"upto": "neg"}).withColumn("under", F.col("upto") - F.col("neg"))
    return each.agg((F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over score values, from the highest, of the recall gained times the precision there."""
    each = running_sums(_by_value(df, score, label), "v", {"tp": "pos", "taken": "n"}, descending=True)
    return each.agg((F.sum(F.col("pos") * F.col("tp") / F.col("taken")) / F.sum("pos")).alias("ap"))


def ceiling(s1: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """macro F0.5 and its breakdown of a perfect matcher: every true pair among the candidates, and nothing else."""
    found = candidates.select("s1_id", "o_id").distinct().join(truth.select("s1_id", "o_id"), ["s1_id", "o_id"], "left_semi")
    return macro_f_half(entity_scores(s1, found, truth))
