"""Decision rules over scored pairs (s1_id, o_id, p), and their search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.metrics import f_half
from linkloom.operators.windows import one_to_one, relative_one_to_one


def ranked_best(pairs: DataFrame) -> DataFrame:
    """Each record's best pair, with its rank k inside the S1."""
    return one_to_one(pairs).withColumn("k", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "o_id")))


def decide_threshold(best: DataFrame, t: float) -> DataFrame:
    return best.where(F.col("p") >= t)


def decide_two_thresholds(best: DataFrame, t_first: float, t_rest: float) -> DataFrame:
    """An S1's first match needs t_first, any match t_rest."""
    return best.where((F.col("p") >= t_rest) | ((F.col("k") == 1) & (F.col("p") >= t_first)))


def expected_prefixes(best: DataFrame, delta: float = 0.0, beta: float = 1.0, bias: float = 0.0) -> DataFrame:
    """best with prefix_score (expected F0.5 of the first k), k_star (the best prefix) and empty_score (of no match)."""
    if delta:
        clipped = F.log(F.greatest(F.least("p", F.lit(1 - 1e-7)), F.lit(1e-7)) / F.greatest(F.least(1 - F.col("p"), F.lit(1.0)), F.lit(1e-7)))
        best = best.withColumn("p", 1 / (1 + F.exp(-(clipped + delta))))
    group = Window.partitionBy("s1_id")
    upto = Window.partitionBy("s1_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = best.withColumn("prefix_score", 1.25 * F.sum("p").over(upto) / (0.25 * beta * F.sum("p").over(group) + F.col("k")))
    out = out.withColumn("top", F.max("prefix_score").over(group))
    out = out.withColumn("k_star", F.min(F.when(F.col("prefix_score") >= F.col("top") - 1e-12, F.col("k"))).over(group))
    none = F.exp(F.sum(F.log1p(-F.greatest(F.least("p", F.lit(1 - 1e-9)), F.lit(0.0)))).over(group)) + bias
    return out.withColumn("empty_score", none)


def decide_expected(best: DataFrame, delta: float = 0.0, beta: float = 1.0, bias: float = 0.0) -> DataFrame:
    told = expected_prefixes(best, delta, beta, bias)
    return told.where((F.col("top") > F.col("empty_score")) & (F.col("k") <= F.col("k_star"))).select(*best.columns)


def decide_relative(pairs: DataFrame, rel: float, t: float) -> DataFrame:
    """The first generation's rule: pairs near their record's best and above a threshold."""
    return relative_one_to_one(pairs, rel).where(F.col("p") >= t)


def apply_rule(pairs: DataFrame, rule: dict) -> DataFrame:
    best = ranked_best(pairs)
    match rule["rule"]:
        case "threshold":
            return decide_threshold(best, rule["t"])
        case "two_thr":
            return decide_two_thresholds(best, rule["t_first"], rule["t_rest"])
        case "expected_f":
            return decide_expected(best, rule["delta"], rule["beta"], rule["bias"])
        case "sampled_f":
            return decide_sampled(one_to_one(pairs) if rule.get("one_to_one") else pairs, bias=rule.get("bias", 0.0))
        case "relative":
            return decide_relative(pairs, rule["rel"], rule["t"])
        case "by_country":
            levels = F.create_map([x for k, v in rule["thresholds"].items() for x in (F.lit(k), F.lit(float(v)))])
            return best.where(F.col("p") >= F.coalesce(F.try_element_at(levels, F.col("ckey")), F.lit(float(rule["t"]))))
        case other:
            raise ValueError(f"no such rule: {other}")


def score_steps(s1: DataFrame, best: DataFrame, truth: DataFrame, by: str | None = None) -> DataFrame:
    """s1_id (and ``by``), k, p, step: what an S1's F0.5 changes by when its k-th best pair is predicted as well. Row k = 0
    (p null) is the score of predicting nothing. Sums of steps are scores at any threshold, so no threshold is a join."""
    group = [by] if by else []
    sizes = s1.select("s1_id", *group).join(truth.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").na.fill(0, ["n_true"])
    none = sizes.select("s1_id", *group, F.lit(0).alias("k"), F.lit(None).cast("double").alias("p"), f_half(F.lit(0), F.lit(0), F.col("n_true")).alias("step"))
    labelled = best.select("s1_id", "o_id", "k", "p").join(truth.select("s1_id", "o_id", F.lit(1).alias("y")), ["s1_id", "o_id"], "left").join(sizes, "s1_id")
    upto = Window.partitionBy("s1_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp = F.sum(F.coalesce("y", F.lit(0))).over(upto)
    before = tp - F.coalesce("y", F.lit(0))
    step = f_half(tp, F.col("k"), F.col("n_true")) - F.when(F.col("k") == 1, f_half(F.lit(0), F.lit(0), F.col("n_true"))).otherwise(f_half(before, F.col("k") - 1, F.col("n_true")))
    return none.unionByName(labelled.select("s1_id", *group, "k", F.col("p").cast("double").alias("p"), step.alias("step")))


def threshold_scores(s1: DataFrame, pairs: DataFrame, truth: DataFrame, grid: list[float], by: str | None = None) -> DataFrame:
    """t (and ``by``), macro F0.5 at each threshold, n. Every step is added to the highest threshold that its pair reaches;
    the sums, one a threshold and group, are then summed from the top."""
    levels = sorted({float(t) for t in grid})
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in levels]), lambda t: t <= F.col("p")))
    steps = score_steps(s1, ranked_best(pairs), truth, by)
    sums = steps.groupBy(*([by] if by else []), F.when(F.col("k") == 0, len(levels)).otherwise(reached).alias("level")).agg(F.sum("step").alias("step"), F.sum((F.col("k") == 0).cast("long")).alias("n"))
    lists = sums.groupBy(*([by] if by else [])).agg(F.collect_list(F.struct("level", "step")).alias("steps"), F.sum("n").alias("n"))  # an entry a threshold
    each = lists.select(*([by] if by else []), "n", "steps", F.posexplode(F.array(*[F.lit(t) for t in levels])).alias("at", "t"))
    total = F.aggregate(F.filter("steps", lambda x: x["level"] > F.col("at")), F.lit(0.0), lambda s, x: s + x["step"])
    return each.where("n > 0").select(*([by] if by else []), "t", (total / F.col("n")).alias("macro"), "n")


GRID = [round(0.05 + 0.01 * i, 2) for i in range(91)]


def tune_threshold(s1: DataFrame, pairs: DataFrame, truth: DataFrame, grid: list[float] = GRID) -> tuple[float, float]:
    """(score, t) of the best threshold; ties go to the largest."""
    best = threshold_scores(s1, pairs, truth, grid).orderBy(F.desc("macro"), F.desc("t")).first()
    return (best["macro"], best["t"]) if best else (0.0, grid[-1])


def tune_by_country(s1: DataFrame, pairs: DataFrame, truth: DataFrame, t_global: float, min_s1: int = 50_000, min_gain: float = 3e-4, grid: list[float] = GRID) -> dict:
    """Thresholds of countries that are large enough and gain enough over the global one."""
    rows = threshold_scores(s1, pairs, truth, sorted({*grid, t_global}), "ckey")
    over = Window.partitionBy("ckey")
    rows = rows.withColumns({"base": F.max(F.when(F.col("t") == t_global, F.col("macro"))).over(over), "place": F.row_number().over(over.orderBy(F.desc("macro"), F.desc("t")))})
    good = rows.where((F.col("place") == 1) & (F.col("n") >= min_s1) & (F.col("macro") - F.col("base") > min_gain)).select("ckey", "t").collect()  # a row a country
    return {"rule": "by_country", "t": t_global, "thresholds": {r["ckey"]: r["t"] for r in good}}


def rule_grid(t_best: float) -> list[dict]:
    """The rules that the search tries, in order: thresholds, two thresholds around the best, expected F."""
    steps = lambda a, b, d: [round(a + d * i, 2) for i in range(int((b - a) / d + 1e-6) + 1)]
    out = [{"rule": "threshold", "t": t} for t in steps(0.5, 0.84, 0.02)]
    out += [{"rule": "two_thr", "t_first": f, "t_rest": r} for f in steps(0.1, t_best, 0.05) for r in steps(max(0.5, t_best - 0.1), t_best + 0.1, 0.02)]
    return out + [{"rule": "expected_f", "delta": d, "beta": b, "bias": x} for d in (-1.0, -0.5, 0.0, 0.5) for b in (1.0, 1.05) for x in (-0.05, 0.0, 0.05, 0.1, 0.2)]


def rule_scores(s1: DataFrame, pairs: DataFrame, truth: DataFrame, rules: list[dict]) -> list[float]:
    """The macro F0.5 of each rule, in two jobs whatever their number.

    Thresholds are sums of steps over the sorted cuts; a second threshold adds the first steps between the two. The expected-F
    rules of one (delta, beta) share their best prefixes, and a bias only moves the comparison with no match.
    """
    best = ranked_best(pairs)
    steps = score_steps(s1, best, truth)
    cuts = sorted({float(x) for r in rules for k, x in r.items() if k in ("t", "t_first", "t_rest")})
    reached = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("p")))
    told = steps.groupBy(F.when(F.col("k") == 0, -1).otherwise(reached).alias("level"), (F.col("k") == 1).alias("first")).agg(F.sum("step").alias("step"), F.count("*").alias("n")).collect()  # two rows a cut
    n = sum(r["n"] for r in told if r["level"] < 0) or 1
    empty = sum(r["step"] for r in told if r["level"] < 0)
    above = lambda t, first=False: sum(r["step"] for r in told if r["level"] > cuts.index(float(t)) and (r["first"] or not first))
    out: list[float | None] = []
    for r in rules:
        match r["rule"]:
            case "threshold":
                out.append((empty + above(r["t"])) / n)
            case "two_thr":
                more = above(r["t_first"], True) - above(r["t_rest"], True) if r["t_first"] < r["t_rest"] else 0.0
                out.append((empty + above(r["t_rest"]) + more) / n)
            case _:
                out.append(None)
    expected = [r for r in rules if r["rule"] == "expected_f"]
    if expected:
        after = Window.partitionBy("s1_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        each = best.select("s1_id", "o_id", "p", "k").join(steps.where("k > 0").select("s1_id", "k", "step"), ["s1_id", "k"]).withColumn("gained", F.sum("step").over(after))
        kinds = sorted({(r["delta"], r["beta"]) for r in expected})
        gains = []
        for i, (delta, beta) in enumerate(kinds):
            each = expected_prefixes(each.withColumn("__p", F.col("p")), delta, beta, 0.0).withColumn("p", F.col("__p")).drop("__p")
            each = each.withColumnsRenamed({"top": f"top_{i}", "empty_score": f"none_{i}"}).withColumn(f"gain_{i}", F.when(F.col("k") == F.col("k_star"), F.col("gained"))).drop("prefix_score", "k_star")
            gains += [F.max(f"top_{i}").alias(f"top_{i}"), F.max(f"none_{i}").alias(f"none_{i}"), F.max(f"gain_{i}").alias(f"gain_{i}")]
        by_s1 = each.groupBy("s1_id").agg(*gains)
        at = [kinds.index((r["delta"], r["beta"])) for r in expected]
        row = by_s1.agg(*[F.sum(F.when(F.col(f"top_{i}") > F.col(f"none_{i}") + r["bias"], F.col(f"gain_{i}")).otherwise(0.0)).alias(f"r{j}") for j, (i, r) in enumerate(zip(at, expected))]).first()
        scores = iter((empty + (x or 0.0)) / n for x in row)
        out = [next(scores) if r["rule"] == "expected_f" else x for r, x in zip(rules, out)]
    return out


def search_rules(s1: DataFrame, pairs: DataFrame, truth: DataFrame, rules: list[dict] | None = None, min_gain: float = 2e-4) -> dict:
    """The first best rule, adopted over the best plain threshold only for a gain above ``min_gain``."""
    t_best = tune_threshold(s1, pairs, truth, [round(0.5 + 0.02 * i, 2) for i in range(18)])[1]
    rules = rules or rule_grid(t_best)
    scored = list(zip(rule_scores(s1, pairs, truth, rules), rules))
    plain = max((x for x in scored if x[1]["rule"] == "threshold"), key=lambda x: x[0], default=(0.0, {"rule": "threshold", "t": t_best}))
    best = max(scored, key=lambda x: x[0])
    return best[1] if best[0] - plain[0] > min_gain else plain[1]


def confident_labels(pairs: DataFrame, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Pseudo-labels: a record's best pair with p >= high, and the low pairs of the same records."""
    place = F.row_number().over(Window.partitionBy("o_id").orderBy(F.desc("p"), "s1_id"))
    marked = pairs.withColumn("positive", (place == 1) & (F.col("p") >= high))
    some = marked.withColumn("any", F.max("positive").over(Window.partitionBy("o_id")))
    return some.where(F.col("positive") | (F.col("any") & (F.col("p") <= low))).select(*pairs.columns, F.col("positive").cast("int").alias("label"))


def prefilter_keep(pairs: DataFrame, tau: float, k_o: int = 5, k_s1: int = 15, k_min: int = 2) -> DataFrame:
    """Each record's k_min best always, others above tau within the record's or the S1's best."""
    ranks = pairs.withColumns({"rank_o": F.row_number().over(Window.partitionBy("o_id").orderBy(F.desc("p"), "s1_id")), "rank_s1": F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "o_id"))})
    return ranks.where((F.col("rank_o") <= k_min) | ((F.col("p") >= tau) & ((F.col("rank_o") <= k_o) | (F.col("rank_s1") <= k_s1))))


def decide_sampled(pairs: DataFrame, samples: int = 400, most: int = 25, min_p: float = 0.01, bias: float = 0.0, seed: int = 0) -> DataFrame:
    """The first generation's expected-F rule by simulation: for each S1, truths are drawn from its ``most`` best pairs, and
    the prefix of the best mean F0.5 is kept if it beats no match by ``bias``. Draws are hashes of (seed, draw, pair)."""
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "o_id"))
    few = pairs.where(F.col("p") >= min_p).withColumn("k", place).where(F.col("k") <= most)  # most rows an S1
    drawn = few.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    hit = (F.pmod(F.xxhash64(F.lit(seed), "draw", "s1_id", "o_id"), F.lit(1 << 30)) / float(1 << 30) < F.col("p")).cast("int")
    over = Window.partitionBy("s1_id", "draw")
    upto = over.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = drawn.withColumn("hit", hit).withColumns({"tp": F.sum("hit").over(upto), "n_true": F.sum("hit").over(over)})
    means = each.groupBy("s1_id", "k").agg(F.avg(1.25 * F.col("tp") / (0.25 * F.col("n_true") + F.col("k"))).alias("mean"))
    top = means.groupBy("s1_id").agg(F.max(F.struct("mean", (-F.col("k")).alias("k"))).alias("top"))
    none = few.groupBy("s1_id").agg(F.exp(F.sum(F.log1p(-F.least("p", F.lit(1 - 1e-12))))).alias("none"))
    kept = top.join(none, "s1_id").where(F.col("top.mean") > F.col("none") + bias).select("s1_id", (-F.col("top.k")).alias("k_star"))
    return few.join(kept, "s1_id").where("k <= k_star").select(*pairs.columns)


def tune_first(s1: DataFrame, pairs: DataFrame, truth: DataFrame, samples: int = 400) -> dict:
    """The first generation's tuner: thresholds and simulated rules, on all pairs or on each record's best; the best
    threshold is then refined by hundredths. Ties go to the first tried."""
    from linkloom.operators.metrics import entity_scores

    def score(rule: dict) -> float:
        kept = one_to_one(pairs) if rule["one_to_one"] else pairs
        chosen = kept.where(F.col("p") >= rule["t"]) if rule["rule"] == "threshold" else decide_sampled(kept, samples, bias=rule["bias"])
        return entity_scores(s1, chosen, truth).agg(F.avg("f")).first()[0] or 0.0

    def thresholds(levels: list[float], one: bool) -> list[tuple[float, dict]]:
        best = one_to_one(pairs) if one else pairs
        ranked = best.withColumn("k", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "o_id")))
        steps, cuts = score_steps(s1, ranked, truth), F.array(*[F.lit(t) for t in levels])
        rows = steps.select(F.col("k").alias("k"), "step", F.size(F.filter(cuts, lambda t: t <= F.col("p"))).alias("level")).groupBy((F.col("k") == 0).alias("none"), "level").agg(F.sum("step").alias("step"), F.count("*").alias("n")).collect()
        n, empty = sum(r["n"] for r in rows if r["none"]) or 1, sum(r["step"] for r in rows if r["none"])
        return [((empty + sum(r["step"] for r in rows if not r["none"] and r["level"] > i)) / n, {"rule": "threshold", "t": t, "one_to_one": one}) for i, t in enumerate(levels)]

    tried = []
    for one in (False, True):
        tried += thresholds([round(0.2 + 0.05 * i, 2) for i in range(16)], one)
        tried += [(score(r), r) for r in ({"rule": "sampled_f", "bias": b, "one_to_one": one} for b in (0.0, 0.02, 0.05, 0.1))]
    best = max(tried, key=lambda x: x[0])
    if best[1]["rule"] == "threshold":
        near = thresholds([round(best[1]["t"] - 0.05 + 0.01 * i, 2) for i in range(11)], best[1]["one_to_one"])
        finer = max(near, key=lambda x: x[0])
        best = finer if finer[0] > best[0] else best
    return best[1] | {"score": best[0]}
