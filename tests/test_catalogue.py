import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
FAST = ["block_token_df", "block_pairs_cosine", "block_union_merge", "embed_topk", "norm_basic_clean", "norm_numbers", "norm_postal", "sim_jaro_winkler", "win_best_other", "win_prefix_expected_f", "metric_macro_f05", "threshold_grid", "stat_spearman", "output_lists", "join_anti", "sim_weighted", "sim_partial", "first_tfidf_reverse", "norm_transliterate", "errors_examples", "stat_row_order", "folds", "truth_sizes", "tokens_block", "prepared_records"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    import __spark_entry__ as entry

    told = lambda v: "-" if v is None else repr(round(float(v), 5)) if isinstance(v, float) else str(v)
    got = entry.queries()[name](spark, DATA)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(told(v) for v in r) for r in got.select(*cols).collect()) == sorted(tuple(told(v) for v in r) for r in rel.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def candidates_by_steps(rows, k_rev=10, k_fwd=20, cap=3000, share=0.004):
    """(s1_id, o_id) -> score: all pairs of a block that share a token of the production window, then the best both ways."""
    toks = {i: set(re.sub("[^a-z0-9]+", " ", text.lower()).split()) for i, text, _ in rows}
    sizes, df = Counter(lang for _, _, lang in rows), Counter((lang, t) for i, _, lang in rows for t in toks[i])
    weights = {}
    for i, _, lang in rows:
        w = {t: math.log(sizes[lang] / df[lang, t]) for t in toks[i] if 2 <= df[lang, t] <= max(cap, share * sizes[lang])}
        norm = math.sqrt(sum(x * x for x in w.values()))
        weights[i] = {t: x / norm for t, x in w.items()} if norm else {}
    scores = {(a, b): round(sum(w * weights[b][t] for t, w in weights[a].items() if t in weights[b]), 6) for a, _, la in rows for b, _, lb in rows if a % 4 == 0 and b % 4 and la == lb and weights[a].keys() & weights[b].keys()}
    by_o, by_s1 = defaultdict(list), defaultdict(list)
    for (a, b), score in scores.items():
        by_o[b].append((-score, a, b))
        by_s1[a].append((-score, b, a))
    kept = {(a, b) for x in by_o.values() for _, a, b in sorted(x)[:k_rev]} | {(a, b) for x in by_s1.values() for _, b, a in sorted(x)[:k_fwd]}
    return {pair: scores[pair] for pair in kept}


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Sixty copies of one text, each with a word of its own or none, among other texts."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "Alpha beta, gamma!" + (f" own{i // 5}" if i % 3 else ""), "en") for i in range(60)]
    rows += [(i, " ".join(r.choices(words, k=r.randrange(1, 9))), r.choice(["en", "en", "de"])) for i in range(60, 240)]
    path = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_flagship_has_the_production_window(spark, copies):
    from linkloom.plans import catalogue

    path, rows = copies
    want = candidates_by_steps(rows)
    got = {(x["s1_id"], x["o_id"]): x["score"] for x in catalogue.candidates(spark, path).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)
    best = {}
    for (a, b), p in sorted(want.items()):
        best[b] = max(best.get(b, (-1, 0)), (p, -a))
    assert {(x["s1_id"], x["o_id"]) for x in catalogue.flagship(spark, path).collect()} == {(-a, b) for b, (p, a) in best.items() if p >= 0.3}
    assert {x["o_id"] for x in catalogue.flagship(spark, path).collect()} >= {i for i in range(60) if i % 4}


def test_lists_and_candidates_of_the_feature_queries(spark):
    from linkloom.plans import catalogue

    a, b, pairs = catalogue.lists(spark, DATA)
    again = catalogue.lists(spark, DATA)
    assert sorted(map(str, b.collect())) == sorted(map(str, again[1].collect()))
    assert a.count() == 10 and b.count() == 150 and 0 < pairs.count() < 150
    cand = catalogue.merged(a, b)
    assert cand.join(pairs, ["s1_id", "o_id"]).count() >= 0.95 * pairs.count()


@pytest.mark.parametrize("name", ["errors_attribution", "errors_examples"])
def test_candidates_are_made_once(spark, monkeypatch, name):
    from linkloom.plans import catalogue

    calls, made = [], catalogue.candidates
    monkeypatch.setattr(catalogue, "candidates", lambda *a: (calls.append(a), made(*a))[1])
    catalogue.QUERIES[name](spark, DATA).collect()
    assert len(calls) == 1
