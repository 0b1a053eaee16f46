import pytest
from pyspark.sql import functions as F

from linkloom.operators import blocking as B
from linkloom.operators import decide as R
from linkloom.operators import metrics as M
from linkloom.operators import synonyms as Y
from linkloom.operators import vectors as V
from linkloom.operators import windows as W


def test_best_other_with_ties_and_singletons(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.2), (2, 1, 0.5)], "g int, i int, v double")
    got = {(r["g"], r["i"]): r["o"] for r in df.withColumn("o", W.best_other(["g"], "v", ["i"])).collect()}
    assert got == {(1, 1): 0.9, (1, 2): 0.9, (1, 3): 0.9, (2, 1): -1.0}


@pytest.mark.parametrize(("t", "p", "tp", "f"), [(0, 0, 0, 1.0), (0, 2, 0, 0.0), (2, 0, 0, 0.0), (2, 1, 1, 0.833333), (1, 2, 1, 0.555556), (4, 4, 3, 0.75)])
def test_f_half(spark, t, p, tp, f):
    row = spark.createDataFrame([(t, p, tp)], "t int, p int, tp int").select(M.f_half(F.col("tp"), F.col("p"), F.col("t")).alias("f")).first()
    assert row["f"] == pytest.approx(f, abs=1e-6)


def test_row_order_does_not_matter(spark):
    rows = [(i % 5, i, (i * 7 % 3) / 2) for i in range(40)]
    a, b = (spark.createDataFrame(x, "s1_id int, o_id int, p double").repartition(n) for x, n in ((rows, 1), (rows[::-1], 4)))
    assert sorted(R.ranked_best(a).collect()) == sorted(R.ranked_best(b).collect())


def test_cosine_pairs_and_top_k(spark):
    recs = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "x", ["a", "b"]), (3, "x", ["b", "c"]), (4, "y", ["a", "b"])], "id int, ckey string, toks array<string>")
    pairs = B.cosine_pairs(recs.where("id = 1"), recs.where("id > 1"), digits=6)
    got = {(r["s1_id"], r["o_id"]): r["score"] for r in pairs.collect()}
    assert got[1, 2] == pytest.approx(1.0) and (1, 4) not in got
    both = B.top_both_ways(pairs, 1, 1).collect()
    assert any(r["r_fwd"] == 1 and r["o_id"] == 2 for r in both)


def test_exact_key_skips_blank_and_large(spark):
    a = spark.createDataFrame([(1, "k"), (2, ""), (3, "big")], "id int, k string")
    b = spark.createDataFrame([(10, "k"), (11, ""), *[(20 + i, "big") for i in range(3)]], "id int, k string")
    assert [(r[0], r[1]) for r in B.exact_key_pairs(a, b, ["k"], 2).collect()] == [(1, 10)]


def test_nearest_matches_native(spark):
    rows = [(i, str(i % 2), V.encode_text(f"name {i * 37 % 11} word").tolist()) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, ckey string, vector array<double>")
    a, b = v.where("id % 4 = 0"), v.where("id % 4 <> 0")
    key = lambda df: sorted((r["s1_id"], r["o_id"], round(r["emb_score"], 4), r["r_emb"]) for r in df.collect())
    assert key(V.nearest(a, b, 3, 4, rows_per_tile=5)) == key(V.nearest_native(a, b, 3, 4))


def test_rules(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.55), ("b", "x", 0.3), ("b", "z", 0.4)], "s1_id string, o_id string, p double")
    ids = lambda df: sorted((r["s1_id"], r["o_id"]) for r in df.collect())
    assert ids(R.apply_rule(pairs, {"rule": "threshold", "t": 0.5})) == [("a", "x"), ("a", "y")]
    assert ids(R.apply_rule(pairs, {"rule": "two_thr", "t_first": 0.35, "t_rest": 0.6})) == [("a", "x"), ("b", "z")]
    assert ("a", "x") in ids(R.apply_rule(pairs, {"rule": "expected_f", "delta": 0.0, "beta": 1.0, "bias": 0.0}))
    s1 = spark.createDataFrame([("a", "c"), ("b", "c")], "s1_id string, ckey string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y")], "s1_id string, o_id string")
    assert R.tune_threshold(s1, pairs, truth)[1] == 0.55
    assert R.tune_by_country(s1, pairs, truth, 0.9, min_s1=1)["thresholds"] == {"c": 0.55}
    assert R.search_rules(s1, pairs, truth, [{"rule": "threshold", "t": 0.5}, {"rule": "threshold", "t": 0.95}])["t"] == 0.5


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.5, 0), (2.0, 1)], "s double, y int")
    assert M.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(3.5 / 4)
    assert M.average_precision(df, "s", "y").first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_synonyms(spark):
    rows = [(["bombay"], ["mumbai"], "x")] * 20 + [(["richmond"], ["county"], "x")] * 20
    got = Y.mine(spark.createDataFrame(rows, "tb array<string>, ta array<string>, raw_b string"), min_count=15)
    assert Y.as_dict(got).get("richmond") is None
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "b string, a string")
    assert {(r["b"], r["a"]) for r in Y.resolve_chains(chain).collect()} == {("a", "c"), ("b", "c")}


def frames(spark, seed=1):
    import random

    r = random.Random(seed)
    s1 = spark.createDataFrame([(f"a{i}", "c%d" % (i % 2)) for i in range(30)], "s1_id string, ckey string")
    pairs = {(f"a{r.randrange(30)}", f"o{i % 60}"): round(r.random(), 2) for i in range(150)}
    truth = [(f"a{r.randrange(30)}", f"o{i}") for i in range(40)]
    return s1, spark.createDataFrame([(*k, p) for k, p in pairs.items()], "s1_id string, o_id string, p double"), spark.createDataFrame(truth, "s1_id string, o_id string")


def test_rule_scores_equal_each_rule_applied(spark):
    s1, pairs, truth = frames(spark)
    rules = R.rule_grid(0.6)[::19] + [{"rule": "two_thr", "t_first": 0.8, "t_rest": 0.5}]
    for got, rule in zip(R.rule_scores(s1, pairs, truth, rules), rules):
        assert got == pytest.approx(M.entity_scores(s1, R.apply_rule(pairs, rule), truth).agg(F.avg("f")).first()[0], abs=1e-9), rule
    for x in R.threshold_scores(s1, pairs, truth, [0.2, 0.9], "ckey").collect():
        mine = s1.where(F.col("ckey") == x["ckey"])
        kept = R.apply_rule(pairs, {"rule": "threshold", "t": x["t"]}).join(mine, "s1_id", "left_semi")
        assert x["macro"] == pytest.approx(M.entity_scores(mine, kept, truth.join(mine, "s1_id", "left_semi")).agg(F.avg("f")).first()[0], abs=1e-9)


def test_sampled_rule_comes_near_the_closed_form(spark):
    _, pairs, _ = frames(spark, 3)
    best = R.ranked_best(pairs)
    closed = {(x["s1_id"], x["o_id"]) for x in R.decide_expected(best).collect()}
    drawn = {(x["s1_id"], x["o_id"]) for x in R.decide_sampled(best.drop("k"), 400).collect()}
    assert len(closed & drawn) >= 0.8 * len(closed | drawn)
    assert R.tune_first(*frames(spark, 3), samples=5)["score"] > 0


def test_running_sums_and_ranks_in_ranges(spark):
    rows = [(i * 7 % 101, i % 5 + 1) for i in range(101)]
    df = spark.createDataFrame(rows, "v int, n int")
    for down in (False, True):
        got = {x["v"]: x["s"] for x in W.running_sums(df, "v", {"s": "n"}, descending=down, ranges=8).collect()}
        assert got == {v: sum(n for w, n in rows if (w >= v if down else w <= v)) for v, _ in rows}
    ranked = W.ranked_in(spark.range(300).select("id", (F.col("id") % 3).alias("g")), "g", F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20), ["id"], "r", 16)
    assert sorted((x["g"], x["r"]) for x in ranked.collect()) == [(g, i) for g in range(3) for i in range(1, 101)]


def test_chunks_change_nothing(spark):
    recs = spark.createDataFrame([(i, "x", [f"t{i % 7}", f"u{i % 3}", "v"]) for i in range(60)], "id int, ckey string, toks array<string>")
    key = lambda df: sorted(map(str, df.collect()))
    a, b = recs.where("id % 4 = 0"), recs.where("id % 4 <> 0")
    assert key(B.cosine_pairs(a, b, 6, chunk=3)) == key(B.cosine_pairs(a, b, 6))


def test_index_finds_most_neighbours(spark):
    rows = [(i, str(i % 2), V.encode_text(f"{'red blue green amber'.split()[i % 4]} name {i * 37 % 101} word{i % 13}").tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "id long, ckey string, vector array<double>")
    a, b = v.where("id % 4 = 0"), v.where("id % 4 <> 0")
    found = V.neighbour_recall(V.nearest_indexed(a, b, 5, cells=16, probes=6), V.nearest(a, b, 5)).first()
    assert found["n"] == 100 * 5 and found["recall"] >= 0.9


def test_first_candidates_by_steps(spark):
    from linkloom.functions.similarity import char_ngrams

    rows = [(i, "x", t) for i, t in enumerate(["red widget co", "red widgets", "blue ring", "a ring", "a", "green lamp co", "lamp green", "ring blue x"])]
    recs = spark.createDataFrame(rows, "id int, ckey string, t string")
    import math

    grams = {i: char_ngrams(t) for i, _, t in rows}
    df = {g: sum(g in c for c in grams.values()) for c in grams.values() for g in c}
    raw = {i: {g: (1 + math.log(n)) * (1 + math.log(9 / (1 + df[g]))) for g, n in c.items() if df[g] >= 2} for i, c in grams.items()}
    unit = {i: {g: w / math.sqrt(sum(x * x for x in c.values())) for g, w in c.items()} for i, c in raw.items()}
    got = {(x["s1_id"], x["o_id"]): x["score"] for x in B.tfidf_top(recs.where("id < 4"), recs.where("id >= 4"), "t", 10, 0.05, rows_per_tile=2).collect()}
    want = {(a, b): s for a in range(4) for b in range(4, 8) if (s := sum(w * unit[b].get(g, 0) for g, w in unit[a].items())) >= 0.05}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_folds_refits_and_simulations(spark):
    from linkloom.operators import learn as L

    rows = [(f"s{i // 6}", f"o{i}", float(i % 6 == 0) + (i * 7 % 11) / 20, float(i % 5), int(i % 6 == 0), "c%d" % (i // 6 % 2)) for i in range(360)]
    df = spark.createDataFrame(rows, "s1_id string, o_id string, x double, z double, label int, country string")
    folds = L.balanced_folds(df, "s1_id", 4).groupBy("fold").count().collect()
    assert {x["count"] for x in folds} == {15}
    scored, models = L.grouped_oof(df, ["x", "z"], k=2, rounds=2)
    assert scored.count() == 360 and M.roc_auc(scored, "p", "label").first()["auc"] > 0.9
    assert len(L.refitted(df, ["x", "z"], models, (0, 1))) == 2 and L.importances(models[0], ["x", "z"])[0][0] == "x"
    s1 = df.select("s1_id", F.col("country").alias("ckey")).distinct()
    truth = df.where("label = 1").select("s1_id", "o_id")
    pairs = df.drop("country")
    apart = L.leave_one_out(df, ["x", "z"], "country", rounds=2)
    assert apart.count() == 360
    seen = L.unseen_groups(pairs, ["x", "z"], s1, truth, rounds=2, min_s1=5)
    assert len(seen) == 4 and all(0.5 < x["macro_best"] <= 1 for x in seen)
    gains = L.self_training_gain(pairs, ["x", "z"], s1, truth, rounds=2, min_s1=5, high=0.6, low=0.4)
    assert len(gains) == 2 and all(x["positive_precision"] > 0.8 for x in gains)


def test_text_scorer_is_trained_out_of_fold(spark):
    rows = [(f"s{i}", f"o{i}{j}", f"{n} bakery | {i} main st", f"{n if j == 0 else 'other'} bakery | {i if j == 0 else i + 7} main st", int(j == 0)) for i, n in enumerate(["amber", "cedar", "lunar", "royal"] * 12) for j in (0, 1)]
    pairs = spark.createDataFrame(rows, "s1_id string, o_id string, text_a string, text_b string, label int")
    scored, scorers = V.cross_scores(pairs)
    assert len(scorers) == 2 and M.roc_auc(scored, "ce_p", "label").first()["auc"] > 0.95
    more, again = V.cross_scores(pairs, start=scorers)
    assert more.count() == len(rows) and all(len(s.weights) == 6 for s in again)


def test_reports(spark):
    from linkloom.operators import reports as E
    from linkloom.operators import stats as T

    df = spark.createDataFrame([("x", "A&B Ltd", "near 12 Main 400001"), ("x", "ACME", ""), ("y", "Foo dba Bär", None)], "c string, n string, a string")
    got = {r["c"]: r for r in E.character_profile(df, "c", "n", "a").collect()}
    assert (got["x"]["ampersand"], got["x"]["capitals"], got["x"]["postcode"], got["x"]["landmark"], got["y"]["marker"], got["y"]["non_ascii"]) == (0.5, 0.5, 0.5, 0.5, 1.0, 1.0)
    assert E.probe_estimate(0.5, 0.9, 0.5, 0.1) == pytest.approx(0.9)
    lists = spark.createDataFrame([("1", "a,b"), ("2", "c")], "s1_id string, m string")
    blank = E.blank_country(lists, spark.createDataFrame([("1", "x"), ("2", "y")], "s1_id string, ckey string"), "x", "m")
    assert {r["s1_id"]: r["m"] for r in blank.collect()} == {"1": "", "2": "c"}
    assert E.markdown(T.value_counts(df, "c").orderBy("bucket"), "Title").splitlines()[0] == "## Title"
    s1, pairs, truth = frames(spark)
    neg = E.random_negatives(s1.withColumnRenamed("s1_id", "id"), spark.createDataFrame([(f"o{i}", "c%d" % (i % 2)) for i in range(60)], "id string, ckey string"), truth)
    assert 0 < neg.count() <= 30 and neg.join(truth, ["s1_id", "o_id"]).count() == 0


@pytest.mark.parametrize("reverse", [True, False])
def test_tfidf_top_multiplies_equal_texts_once(spark, monkeypatch, reverse):
    """Forty copies of three texts are three vectors, and the ties between copies fall to the smallest ids."""
    recs = spark.createDataFrame([(i, "x", ["red widget", "red widgets", "green lamp"][i % 3]) for i in range(120)], "id int, ckey string, t string")
    a, b = recs.where("id % 4 = 0"), recs.where("id % 4 <> 0")
    sizes, products = [], B.products
    monkeypatch.setattr(B, "products", lambda held, asked, *x, **y: (sizes.append((held.count(), asked.count())), products(held, asked, *x, **y))[1])
    got = sorted((x["s1_id"], x["o_id"], x["rank"]) for x in B.tfidf_top(a, b, "t", 4, 0.05, reverse=reverse, digits=6).collect())
    asks, bases = ([i for i in range(120) if (i % 4 == 0) == own] for own in (not reverse, reverse))
    want = [(q, r, k) for q in asks for k, r in enumerate([r for r in bases if r % 3 == q % 3][:4], 1)]
    assert got == sorted((r, q, k) if reverse else (q, r, k) for q, r, k in want) and sizes == [(3, 3)]


@pytest.mark.parametrize("digits", [None, 6])
def test_cosine_top_equals_the_best_of_all_pairs(spark, monkeypatch, digits):
    """With copies, ties, small tiles and early cuts; no pairs are made beside the best."""
    from linkloom.operators import sparse

    rows = [(i, "xy"[i % 7 == 0], [f"t{i % 5}", f"u{i * i % 11}", f"v{i // 30}", "w"]) for i in range(240)]
    recs = spark.createDataFrame(rows, "id long, ckey string, toks array<string>")
    a, b = recs.where("id % 4 = 0"), recs.where("id % 4 <> 0")
    told = lambda df: sorted((x["s1_id"], x["o_id"], round(x["score"], 6), x["r_rev"] or 0, x["r_fwd"] or 0) for x in df.collect())
    pairs = B.cosine_pairs(a, b, 6)
    want = told(B.top_both_ways(pairs, 3, 5))
    assert told(B.cosine_top(a, b, 3, 5, 6)) == want
    assert told(B.cosine_top(a, b, 3, 5, 6, chunk=7)) == want
    if digits is None:
        assert len(B.cosine_top(a, b, 3, 5).collect()) > 0
    best = sparse._Best(3, 2, 0.0, digits)
    monkeypatch.setattr(sparse, "WAITING", 1)
    scores = [[0.5, 0, 0.25], [0.5, 0.125, 0.75], [0.5, 0, 0.75], [0.75, 0, 0.25]]
    for r, s in enumerate(scores):
        best.add(sparse.np.array(s), r)
    assert [x.tolist() for x in best.cut()] == [[0, 0, 1, 2, 2], [0.75, 0.5, 0.125, 0.75, 0.75], [3, 0, 1, 1, 2]]


def test_numbered_postings_in_chunks_and_tiles_in_rounds(spark, monkeypatch):
    """Chunks of tokens and rounds of tiles give what one chunk and one round give, with repeated ids, nulls and empty records;
    of the tables written on the way only the numbered records stay."""
    import random

    from linkloom.operators import sparse
    from linkloom.operators import terms as X

    r = random.Random(3)
    rows = [(i, r.choice("xy") if i % 17 else None, [f"w{int(r.random() ** 2 * 40)}" for _ in range(r.randrange(9))] if i % 13 else None) for i in range(200)]
    d = spark.createDataFrame([*rows, (7, rows[7][1], ["w1", "w2"]), (9, rows[9][1], [None, "w1", "w30"])], "id long, ckey string, toks array<string>").repartition(3)
    a, b = d.where("id % 4 = 0"), d.where("id % 4 <> 0")
    expected = {(x["s1_id"], x["o_id"]): x["score"] for x in naive_cosine(d, 60).collect()}
    assert {(x["s1_id"], x["o_id"]): x["score"] for x in B.cosine_pairs(a, b, 6, cap=60).collect()} == pytest.approx(expected, abs=2e-6)
    one = [sorted(map(tuple, way.collect())) for way in B.cosine_ways(a, b, 3, 4, digits=6, cap=60)]
    kept = set()
    monkeypatch.setattr(B, "saved", lambda df, f=B.saved: (out := f(df), kept.update(out.inputFiles()))[0])
    monkeypatch.setattr(X, "saved", lambda df, f=X.saved: (out := f(df), kept.update(out.inputFiles()))[0])
    rounds = []
    monkeypatch.setattr(sparse, "_tiles", lambda *x, f=sparse._tiles: (rounds.append(1), f(*x))[1])
    monkeypatch.setattr(B, "products", lambda *x, **y: sparse.products(*x, **y, copies=0.7))
    monkeypatch.setattr(B, "numbered_postings", lambda d, f=B.numbered_postings, **y: f(d, chunk=50, **y))
    some = [sorted(map(tuple, way.collect())) for way in B.cosine_ways(a, b, 3, 4, digits=6, chunk=9, cap=60)]
    assert some == one and len(rounds) > 1
    import os

    stays = {f.rsplit("/", 1)[0] for f in kept if os.path.exists(f.removeprefix("file:"))}
    assert len(stays) < len({f.rsplit("/", 1)[0] for f in kept}) - 3


def naive_cosine(d, cap):
    post = d.select("id", "ckey", F.explode(F.array_compact(F.array_distinct("toks"))).alias("tok"))
    freq = post.groupBy("ckey", "tok").agg(F.count("*").alias("df")).where(f"df BETWEEN 2 AND {cap}").join(d.groupBy("ckey").agg(F.count("*").alias("n")), "ckey")
    idf = post.join(freq, ["ckey", "tok"]).select("id", "ckey", "tok", F.log(F.col("n") / F.col("df")).alias("v"))
    w = idf.join(idf.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")), "id").select("id", "ckey", "tok", (F.col("v") / F.col("norm")).alias("w"))
    a, b = w.where("id % 4 = 0").select(F.col("id").alias("s1_id"), "ckey", "tok", F.col("w").alias("wa")), w.where("id % 4 <> 0").select(F.col("id").alias("o_id"), "ckey", "tok", F.col("w").alias("wb"))
    return a.join(b, ["ckey", "tok"]).groupBy("s1_id", "o_id").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("score"))


@pytest.mark.parametrize("chars", [True, False])
def test_text_cosine_is_term_cosine_of_tfidf(spark, chars):
    """Repeated terms, empty and null texts, pairs across blocks, several chunks; and no row a term of a pair in the plan."""
    words = ["alpha beta", "beta beta gamma", "alpha", "", None, "gamma delta alpha alpha", "delta"]
    d = spark.createDataFrame([(f"r{i}", "xy"[i // 3 % 2], words[i * 5 % 7]) for i in range(24)], "id string, ckey string, t string")
    pairs = spark.createDataFrame([(f"r{i}", f"r{j}") for i in range(8) for j in range(8, 24) if (i + j) % 3], "s1_id string, o_id string")
    least = 2 if chars else 1
    key = lambda df: {(x["s1_id"], x["o_id"]): x["c"] for x in df.collect()}
    a, b = d.where(F.substring("id", 2, 9).cast("int") < 8), d.where(F.substring("id", 2, 9).cast("int") >= 8)
    got = B.text_cosine(pairs, a, b, "t", chars, least, "c", chunk=20)
    assert key(got) == pytest.approx(key(B.term_cosine(pairs, B.tfidf(d, "t", chars, least), "c")), abs=1e-12)
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_context_sorts_once_a_column_and_side(spark):
    import random

    r = random.Random(7)
    rows = [(i, j, r.choice([0.0, 0.5, 1.0, None, float("nan")]), r.random()) for i in range(6) for j in range(8) if r.random() < 0.6]
    out = W.context_columns(spark.createDataFrame(rows, "s1_id long, o_id long, x double, y double"), ["x", "y"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 4 + 2  # one for each column and side, and the counts' two
    clean = {(i, j): (-1.0 if x is None or x != x else x, y) for i, j, x, y in rows}
    for got in out.collect():
        for tag, at in (("s1", 0), ("c", 1)):
            me = (got["s1_id"], got["o_id"])
            mine = [v for k, v in clean.items() if k[at] == me[at]]
            assert got[f"n_cands_{tag}"] == len(mine)
            for c, col in (("x", 0), ("y", 1)):
                v, others = clean[me][col], sorted((w[col] for k, w in clean.items() if k[at] == me[at] and k != me), reverse=True)
                assert (got[f"{c}_rank_{tag}"], got[f"{c}_gap_{tag}"], got[f"{c}_best_other_{tag}"]) == (1 + sum(w > v for w in others), max([v, *others]) - v, others[0] if others else -1.0)


def test_candidates_leave_one_table(spark, tmp_path, monkeypatch):
    import os

    from linkloom.plans import catalogue as C
    from linkloom.sources import tables as I

    made, saved = [], I.saved
    for module in (B, I, sparse_module()):
        monkeypatch.setattr(module, "saved", lambda df: (made.append(saved(df)), made[-1])[1])
    spark.createDataFrame([(i, "en", f"w{i % 5} v{i % 3} u{i}") for i in range(60)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    there = lambda: [at for df in made for at in {f.rsplit("/", 1)[0].removeprefix("file:") for f in df.inputFiles()} if os.path.isdir(at)]
    found = C.candidates(spark, str(tmp_path))
    own = {f.rsplit("/", 1)[0].removeprefix("file:") for f in found.inputFiles()}
    assert set(there()) == own and len(own) == 1 and found.count() > 0


def test_all_pairs_are_never_saved_on_the_way(spark, monkeypatch):
    """However many tiles a block has: the pairs grow with its square, and the caller writes them once already."""
    sparse = sparse_module()
    recs = spark.createDataFrame([(i, "xy"[i % 7 == 0], [f"t{i % 5}", f"u{i * i % 11}", "w"]) for i in range(90)], "id long, ckey string, toks array<string>")
    a, b = recs.where("id % 4 = 0"), recs.where("id % 4 <> 0")
    want = {(x["s1_id"], x["o_id"]): x["score"] for x in naive_cosine(recs, 3000).collect()}
    made, saved = [], sparse.saved
    for module in (B, sparse):
        monkeypatch.setattr(module, "saved", lambda df: (made.append(df.columns), saved(df))[1])
    found = B.cosine_pairs(a, b, 6, chunk=9)
    rows = found.collect()
    assert {(x["s1_id"], x["o_id"]): x["score"] for x in rows} == pytest.approx(want, abs=2e-6) and len(rows) == len(want) > 0
    assert made and not any("score" in columns for columns in made)
    assert found.columns == ["s1_id", "o_id", "score"]


def sparse_module():
    from linkloom.operators import sparse

    return sparse


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_tfidf_top_sends_no_terms_of_texts_to_every_task(spark, monkeypatch, bound):
    """Spark takes the exploded terms for as small as the file of the texts; they must not go through the driver, and a table
    above the bound must not either."""
    import re

    recs = spark.createDataFrame([(i, "xy"[i % 2], f"part {i % 40} of {i % 17}") for i in range(200)], "id int, ckey string, t string")
    a, b = recs.where("id % 4 = 0"), recs.where("id % 4 <> 0")
    plans, saved = [], B.saved
    plan = lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df)[1]
    monkeypatch.setattr(B, "saved", lambda df: saved(plan(df)))
    monkeypatch.setattr(B, "SENT", bound, raising=False)
    got = plan(B.tfidf_top(a, b, "t", 4, 0.05, digits=6)).collect()
    for lines in (p.splitlines() for p in plans):
        depth = [re.search(r"[A-Za-z]", x).start() if re.search(r"[A-Za-z]", x) else 0 for x in lines]
        for i, x in enumerate(lines):
            if "BroadcastExchange" in x:
                below = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
                assert not any("Generate" in y for y in below)
                assert bound or not any(re.search(r"\b(text|tok|ids)#", y) and "HashedRelation" in x for y in below)
    weights = {(r["id"], r["tok"]): r["w"] for r in B.tfidf(recs, "t").collect()}
    terms = {i: {t: w for (j, t), w in weights.items() if j == i} for i in range(200)}
    score = lambda i, j: round(sum(w * terms[j].get(t, 0.0) for t, w in terms[i].items()), 6)
    for i in range(0, 200, 4):
        want = sorted((-score(i, j), j) for j in range(200) if j % 4 and j % 2 == i % 2 and score(i, j) >= 0.05)[:4]
        mine = sorted((r["rank"], r["o_id"], r["score"]) for r in got if r["s1_id"] == i)
        assert [(j, s) for _, j, s in mine] == [(j, pytest.approx(-s, abs=2e-6)) for s, j in want]
