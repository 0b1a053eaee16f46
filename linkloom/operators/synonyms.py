"""Token synonyms mined from matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import dictionaries as D
from linkloom.functions import similarity as S


def mine(pairs: DataFrame, min_count: int = 15, min_ratio: float = 0.5, max_diff: int = 3) -> DataFrame:
    """pairs (ta, tb: token arrays, raw_b) -> b, a, n, seen, script_share: the token a that b most often stands for."""
    bad = [*D.LEGAL_FORMS, *D.NAME_NOISE]
    fine = lambda t: ~t.rlike("[0-9]") & ~t.isin(bad)
    diff = pairs.select(F.filter(F.array_except("ta", "tb"), fine).alias("left"), F.filter(F.array_except("tb", "ta"), lambda t: fine(t) & (F.length(t) >= 2)).alias("right"), F.col("raw_b").rlike(r"[^\u0000-ɏ]").cast("int").alias("script"))
    diff = diff.where((F.size("right") > 0) & (F.size("left") <= max_diff) & (F.size("right") <= max_diff))
    each = diff.select("left", "script", F.explode("right").alias("b"))
    seen = each.groupBy("b").agg(F.count("*").alias("seen"), (F.sum("script") / F.count("*")).alias("script_share"))
    both = each.select("b", F.explode("left").alias("a")).groupBy("b", "a").agg(F.count("*").alias("n"))
    good = both.where(F.col("n") >= min_count).join(seen, "b").where(F.col("n") / F.col("seen") >= min_ratio)
    good = S.similarity(good, "ratio", "b", "a", "__ratio").where("script_share >= 0.5 OR __ratio >= 50").drop("__ratio")
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    return good.withColumn("place", place).where("place = 1").drop("place")


def resolve_chains(synonyms: DataFrame) -> DataFrame:
    """b -> a with one step more where a is itself a synonym; a mapping to itself goes."""
    step = synonyms.select(F.col("b").alias("a"), F.col("a").alias("further"))
    return synonyms.select("b", "a").join(step, "a", "left").select("b", F.coalesce("further", "a").alias("a")).where("a <> b")


def as_dict(synonyms: DataFrame, limit: int = 20_000) -> dict[str, str]:
    """The map for the normalisation; ``limit`` bounds what every expression carries, most frequent first."""
    order = [F.desc("n"), "b"] if "n" in synonyms.columns else ["b"]
    return {r["b"]: r["a"] for r in synonyms.orderBy(*order).limit(limit).collect()}


def token_changes(pairs: DataFrame) -> DataFrame:
    """kind (dropped, added), tok, n over matched pairs (ta, tb)."""
    gone = pairs.select(F.lit("dropped").alias("kind"), F.explode(F.array_except("ta", "tb")).alias("tok"))
    new = pairs.select(F.lit("added").alias("kind"), F.explode(F.array_except("tb", "ta")).alias("tok"))
    return gone.unionByName(new).groupBy("kind", "tok").agg(F.count("*").alias("n"))
