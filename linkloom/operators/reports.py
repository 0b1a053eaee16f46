"""Reports: error attribution, confidence profile, profiles of the raw lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.metrics import entity_scores
from linkloom.operators.windows import ranked_in, spearman

ERRORS = ["fn_blocking", "fn_competition", "fn_threshold", "fp_wrong_s1", "fp_no_entity"]


def attribute_errors(s1: DataFrame, candidates: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """country (and ALL): entities, macro F0.5, and each error type's count and share of the lost points, where an entity's
    loss is shared by its errors. s1 holds s1_id, ckey; each record has one true S1 at most."""
    given = predicted.groupBy("o_id").agg(F.min("s1_id").alias("got"))
    missed = truth.select("s1_id", "o_id").join(candidates.select("s1_id", "o_id", F.lit(1).alias("seen")), ["s1_id", "o_id"], "left").join(given, "o_id", "left")
    fn = missed.where(F.col("got").isNull() | (F.col("got") != F.col("s1_id"))).select("s1_id", F.when(F.col("seen").isNull(), "fn_blocking").when(F.col("got").isNotNull(), "fn_competition").otherwise("fn_threshold").alias("error"))
    owner = truth.select("o_id", F.col("s1_id").alias("right"))
    fp = predicted.select("s1_id", "o_id").join(owner, "o_id", "left").where(F.col("right").isNull() | (F.col("right") != F.col("s1_id"))).select("s1_id", F.when(F.col("right").isNull(), "fp_no_entity").otherwise("fp_wrong_s1").alias("error"))
    counts = fn.unionByName(fp).groupBy("s1_id").agg(F.count("*").alias("errors"), *[F.sum(F.when(F.col("error") == e, 1).otherwise(0)).alias(e) for e in ERRORS])
    each = entity_scores(s1, predicted, truth).join(s1.select("s1_id", "ckey"), "s1_id").join(counts, "s1_id", "left").na.fill(0, ["errors", *ERRORS]).withColumn("loss", 1 - F.col("f"))
    points = [F.round(F.sum(F.when(F.col("errors") > 0, F.col(e) / F.col("errors") * F.col("loss")).otherwise(0.0)), 6).alias(f"{e}_loss") for e in ERRORS]
    out = each.rollup("ckey").agg(F.grouping("ckey").alias("total"), F.count("*").alias("n_s1"), F.round(F.avg("f"), 6).alias("macro"), *[F.sum(e).alias(e) for e in ERRORS], *points)
    return out.select(F.when(F.col("total") == 1, "ALL").otherwise(F.col("ckey")).alias("country"), *[c for c in out.columns if c not in ("ckey", "total")])


def confidence_profile(pairs: DataFrame, s1: DataFrame, t: float = 0.5, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """ckey: mean best p of a record, share of unsure records, share of S1 without a pair above t. pairs carry ckey."""
    place = F.row_number().over(Window.partitionBy("o_id").orderBy(F.desc("p"), "s1_id"))
    best = pairs.withColumn("place", place).where("place = 1")
    told = best.groupBy("ckey").agg(F.count("*").alias("n_records"), F.round(F.avg("p"), 6).alias("mean_best"), F.round(F.avg(((F.col("p") > low) & (F.col("p") < high)).cast("double")), 6).alias("unsure"))
    full = best.where(F.col("p") >= t).select("s1_id").distinct().withColumn("full", F.lit(1))
    empty = s1.join(full, "s1_id", "left").groupBy("ckey").agg(F.round(F.avg(F.col("full").isNull().cast("double")), 6).alias("empty"))
    return empty.join(told, "ckey", "left")


def error_examples(predicted: DataFrame, truth: DataFrame, scored: DataFrame, candidates: DataFrame, per_type: int = 80) -> DataFrame:
    """error, s1_id, o_id, p_this, other_s1, p_other: up to ``per_type`` of each error type, drawn by a hash, with the S1 that
    competes for the record (the predicted one, else the best scored, or the true one) and both probabilities. Each record
    has one true S1 at most."""
    pair = ["s1_id", "o_id"]
    given = predicted.groupBy("o_id").agg(F.min("s1_id").alias("got"))
    best = scored.groupBy("o_id").agg(F.max_by("s1_id", F.struct("p", "s1_id")).alias("first"))
    missed = truth.select(*pair).join(candidates.select(*pair, F.lit(1).alias("seen")), pair, "left").join(given, "o_id", "left").join(best, "o_id", "left")
    missed = missed.where(F.col("got").isNull() | (F.col("got") != F.col("s1_id")))
    kind = F.when(F.col("seen").isNull(), "fn_blocking").when(F.col("got").isNotNull(), "fn_competition").otherwise("fn_threshold")
    fn = missed.select(kind.alias("error"), *pair, F.coalesce("got", "first").alias("other_s1"))
    owner = truth.groupBy("o_id").agg(F.min("s1_id").alias("right"))
    wrong = predicted.select(*pair).join(owner, "o_id", "left").where(F.col("right").isNull() | (F.col("right") != F.col("s1_id")))
    fp = wrong.select(F.when(F.col("right").isNull(), "fp_no_entity").otherwise("fp_wrong_s1").alias("error"), *pair, F.col("right").alias("other_s1"))
    place = F.row_number().over(Window.partitionBy("error").orderBy(F.xxhash64(*pair), *pair))
    few = fn.unionByName(fp).withColumn("place", place).where(F.col("place") <= per_type).drop("place")
    p = scored.select(F.col("s1_id").alias("a"), F.col("o_id").alias("b"), "p")
    mine = few.join(p.withColumnRenamed("p", "p_this"), (F.col("s1_id") == F.col("a")) & (F.col("o_id") == F.col("b")), "left").drop("a", "b")
    told = mine.join(p.withColumnRenamed("p", "p_other"), (F.col("other_s1") == F.col("a")) & (F.col("o_id") == F.col("b")), "left").drop("a", "b")
    return told.select("error", *pair, "p_this", "other_s1", "p_other")


def list_profile(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """n, duplicate ids, and for each column the blank share and mean length."""
    cols = [x for c in columns for x in (F.round(F.avg((F.coalesce(c, F.lit("")) == "").cast("double")), 6).alias(f"{c}_blank"), F.round(F.avg(F.length(c)), 6).alias(f"{c}_length"))]
    return df.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(key)).alias("n_duplicate"), *cols)


#: Words that place an address by a landmark.
LANDMARKS = r"(?i)\b(?:near|nr|opp|opposite|behind|beside)\b"


def character_profile(df: DataFrame, group: str, name: str, addr: str | None = None) -> DataFrame:
    """Shares of names with non-ASCII letters, digits, ampersands, several variants, capitals only; with ``addr`` also of
    addresses with a postcode or a landmark (non-ASCII then counts both)."""
    from linkloom.functions.normalize import name_variants, postal_code

    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    n, a = F.col(name), F.col(addr) if addr else F.lit("")
    both = F.concat_ws(" ", n, a)
    told = [F.count("*").alias("n"), share(both.rlike(r"[^\u0000-\u007F]")).alias("non_ascii"), share(n.rlike("[0-9]")).alias("digits"), share(n.contains("&")).alias("ampersand"), share(F.size(name_variants(n)) > 1).alias("marker"), share((n == F.upper(n)) & (n != F.lower(n))).alias("capitals")]
    if addr:
        told += [share(postal_code(a) != "").alias("postcode"), share(a.rlike(LANDMARKS)).alias("landmark")]
    return df.groupBy(group).agg(*told)


def country_shares(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("__total")))  # one row
    return counts.join(total).withColumn("share", F.round(F.col("n") / F.col("__total"), 6)).drop("__total")


def hard_negatives(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Each S1's closest candidate that isn't a match."""
    from linkloom.operators.windows import top_k

    return top_k(pairs.join(truth, ["s1_id", "o_id"], "left_anti"), ["s1_id"], "score", ["o_id"], 1)


def random_negatives(s1: DataFrame, others: DataFrame, truth: DataFrame, seed: int = 0) -> DataFrame:
    """A record of the same block for each S1, drawn by pairing equal hash ranks inside the block."""
    spread = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    rank = lambda df, key: ranked_in(df.select("ckey", "id"), "ckey", spread, ["id"], "r").select("ckey", "r", F.col("id").alias(key))
    return rank(s1, "s1_id").join(rank(others, "o_id"), ["ckey", "r"]).select("s1_id", "o_id").join(truth, ["s1_id", "o_id"], "left_anti")


def file_positions(df: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """key and the row's place in its files as a share of their rows, from the partitions' order and sizes."""
    marked = df.select(key, F.monotonically_increasing_id().alias("__at"))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("part", "n")).alias("__parts"))  # an entry a partition
    ahead = F.aggregate(F.filter("__parts", lambda x: x["part"] < part), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    total = F.aggregate("__parts", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return marked.join(F.broadcast(sizes)).select(key, ((ahead + place) / total).alias(out))


def row_order_rho(truth: DataFrame, s1_positions: DataFrame, o_positions: DataFrame) -> DataFrame:
    """One row: Spearman's rho of the places of matching rows; far from 0, the files' order gives matches away."""
    both = truth.join(s1_positions.select("s1_id", F.col("pos").alias("a")), "s1_id").join(o_positions.select("o_id", F.col("pos").alias("b")), "o_id")
    return spearman(both, "a", "b")


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report's table as text: at most ``most`` rows, in their order."""
    got = rows.limit(most).collect()
    told = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(told(v) for v in r) + " |" for r in got]) + "\n"


def probe_estimate(country_share: float, score: float, probe_score: float, singleton_share: float) -> float:
    """A country's F from two leaderboard scores, one with its lists blanked."""
    return singleton_share + (score - probe_score) / country_share


def blank_country(lists: DataFrame, s1: DataFrame, country: str, col: str) -> DataFrame:
    return lists.join(s1.select("s1_id", "ckey"), "s1_id").withColumn(col, F.when(F.col("ckey") == country, "").otherwise(F.col(col))).drop("ckey")
