"""Ranking and context columns over candidate pairs. Every tie is broken by ids, so row order never matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_first(group: list[str], by: str, ties: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), *ties))


def rank_min(group: list[str], by: str) -> Column:
    return F.rank().over(Window.partitionBy(*group).orderBy(F.desc(by)))


def gap_to_best(group: list[str], by: str) -> Column:
    return F.max(by).over(Window.partitionBy(*group)) - F.col(by)


def best_other(group: list[str], by: str, ties: list[str], absent: float = -1.0) -> Column:
    """The largest value among the other rows of the group."""
    ordered = Window.partitionBy(*group).orderBy(F.desc(by), *ties)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(ordered)
    return F.when(place == 1, F.coalesce(F.nth_value(by, 2).over(whole), F.lit(absent))).otherwise(F.first(by).over(whole))


def second_best(group: list[str], by: str, ties: list[str]) -> Column:
    whole = Window.partitionBy(*group).orderBy(F.desc(by), *ties).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(by, 2).over(whole)


def top_k(df: DataFrame, group: list[str], by: str, ties: list[str], k: int, rank_col: str = "rank") -> DataFrame:
    """A bare limit on the rank lets Spark cut each group before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank_col, rank_first(group, by, ties)).where(F.col(rank_col) <= k)


def one_to_one(pairs: DataFrame, p: str = "p", s1: str = "s1_id", o: str = "o_id") -> DataFrame:
    """Each record keeps its best S1."""
    return top_k(pairs, [o], p, [s1], 1, "__place").drop("__place")


def relative_one_to_one(pairs: DataFrame, rel: float, p: str = "p", o: str = "o_id") -> DataFrame:
    """Pairs within ``rel`` of their record's best; ties stay."""
    best = F.max(p).over(Window.partitionBy(o))
    return pairs.withColumn("__best", best).where(F.col(p) >= rel * F.col("__best") - 1e-12).drop("__best")


def context_columns(pairs: DataFrame, columns: list[str], s1: str = "s1_id", o: str = "o_id") -> DataFrame:
    """For each column: rank, gap and best other within the S1 (_s1) and within the record (_c), and both counts. All three come
    from one order of the group by the column alone, so rows are sorted once a column and side: where rows tie for the best, each
    has it as its best other, whichever is first."""
    filled = pairs.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-1.0)), F.lit(-1.0)) for c in columns})
    out = {}
    for group, tag in ((s1, "s1"), (o, "c")):
        for c in columns:
            ordered = Window.partitionBy(group).orderBy(F.desc(c))
            whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            place, best = F.rank().over(ordered), F.first(c).over(whole)
            out[f"{c}_rank_{tag}"] = place
            out[f"{c}_gap_{tag}"] = best - F.col(c)
            out[f"{c}_best_other_{tag}"] = F.when(place == 1, F.coalesce(F.nth_value(c, 2).over(whole), F.lit(-1.0))).otherwise(best)
        out[f"n_cands_{tag}"] = F.count("*").over(Window.partitionBy(group))
    return filled.withColumns(out)


def level_two_columns(pairs: DataFrame, p: str = "p", s1: str = "s1_id", o: str = "o_id") -> DataFrame:
    """The thirteen aggregates of a first model's probability."""
    over_o, over_s = Window.partitionBy(o), Window.partitionBy(s1)
    hi = (F.col(p) >= 0.5).cast("double")
    out = pairs.withColumns({
        "l1_p": F.col(p), "l1_rank_o": rank_first([o], p, [s1]), "l1_best_other_o": best_other([o], p, [s1]), "l1_n_hi_o": F.sum(hi).over(over_o), "l1_sum_o": F.sum(p).over(over_o),
        "l1_rank_s1": rank_first([s1], p, [o]), "l1_max_s1": F.max(p).over(over_s), "l1_best_other_s1": best_other([s1], p, [o]), "l1_sum_s1": F.sum(p).over(over_s), "l1_n_hi_s1": F.sum(hi).over(over_s),
    })
    out = out.withColumns({"l1_gap_o": F.col("l1_p") - F.col("l1_best_other_o"), "l1_is_best_o": (F.col("l1_rank_o") == 1).cast("double")})
    return out.withColumn("l1_n_assigned_s1", F.sum(F.col("l1_is_best_o") * hi).over(over_s))


def running_sums(df: DataFrame, key: str, sums: dict[str, str], descending: bool = False, ranges: int = 64) -> DataFrame:
    """df with, for each name -> column, the sum of the column over all rows up to and with this one in the order of ``key``.
    One row a key value.

    The rows are dealt to about ``ranges`` ranges of the key (bounds by approximate percentiles, one row), each range sums
    up its own rows, and the totals of the ranges before (one row of ``ranges`` entries) are added, so that no task sees
    more than its range.
    """
    number = F.col(key).cast("double")
    bounds = df.agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)], 10_000).alias("__bounds"))
    before = (lambda b: b < number) if not descending else (lambda b: b > number)
    dealt = df.join(F.broadcast(bounds)).withColumn("__range", F.size(F.filter(F.array_distinct("__bounds"), before))).drop("__bounds")
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    totals = totals.agg(F.collect_list(F.struct(F.col("__range").alias("at"), *[F.col(f"__t_{n}").alias(n) for n in sums])).alias("__totals"))
    inside = Window.partitionBy("__range").orderBy(F.desc(key) if descending else F.asc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({f"__in_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(totals))
    ahead = F.filter("__totals", lambda t: t["at"] < F.col("__range"))
    kind = dict(totals.select(F.explode("__totals").alias("t")).select("t.*").dtypes)

    def added(name: str) -> Column:
        parts = F.transform(ahead, lambda t: t[name])
        return F.col(f"__in_{name}") + F.aggregate(parts, F.lit(0).cast(kind[name]), lambda s, x: s + x)

    return out.withColumns({n: added(n) for n in sums}).drop("__range", "__totals", *[f"__in_{n}" for n in sums])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of average ranks. Ranks come from counts a value, so ties cost nothing."""
    ranked = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    for c in ("a", "b"):
        sizes = running_sums(ranked.groupBy(c).agg(F.count("*").alias("n")), c, {"upto": "n"})
        ranked = ranked.join(sizes.select(c, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"rank_{c}")), c)
    return ranked.agg(F.corr("rank_a", "rank_b").alias("rho"))


def ranked_in(df: DataFrame, group: str, by: Column, ties: list[str], rank_col: str, rows_per_range: int = 4096) -> DataFrame:
    """df with the place of each row of its group in the order of a number in [0, 1) that is spread evenly, as a hash is.
    Ranges of about ``rows_per_range`` rows are ranked by themselves and placed behind the sizes of those before them."""
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / rows_per_range).alias("__ranges"))
    dealt = df.withColumn("__by", by).join(sizes, group).withColumn("__range", F.floor(F.col("__by") * F.col("__ranges")))
    dealt = dealt.repartition(group, "__range")
    counts = dealt.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "__range", ahead.alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy(group, "__range").orderBy("__by", *ties))
    return dealt.withColumn("__inside", inside).join(counts, [group, "__range"]).withColumn(rank_col, F.col("__ahead") + F.col("__inside")).drop("__by", "__ranges", "__range", "__inside", "__ahead")
