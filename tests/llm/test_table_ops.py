import datetime as dt
import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing, queries, sharding, url_filters

DATA = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- mixing
def targets_by_steps(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, fixed, total = {}, {}, sum(sizes.values())
    while True:
        left = [s for s in names if s not in fixed]
        rest, whole = total - sum(fixed.values()), sum(w[s] for s in left)
        out = {s: rest * w[s] / whole for s in left} if left else {}
        over = [s for s in left if out[s] > 3 * sizes[s]]
        if not over:
            return fixed | out
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("ranges", [20_000, 7])
def test_mix_targets_and_budgets(spark, ranges):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(50), r.choice(["a", "a", "a", "b", "c", "d", None, "ä"]), 0) for i in range(400)]
    rows += [(1000, None, "a", 0), (1001, "", "zz", 0), (1, "w w w", "b", 0), (1, "w w w", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    got = mixing.mix_sources(docs, rows_per_range=ranges).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets_by_steps(sizes), defaultdict(int)
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix_sources(docs.repartition(5), rows_per_range=ranges).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs.drop("taken"))
    words = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words - sum(taken.values())) <= 3  # rows that share id and size share their part
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_mixed_documents_without_ids(spark):
    r = random.Random(5)
    rows = [(i if i % 3 else None, " ".join(f"t{i}" for _ in range(r.choice([0, 1, 4, 4, 9]))), r.choice(["a", "a", "a", "b", None])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = defaultdict(int)
    for x in mixing.mix_sources(docs).collect():
        want[x["source"], x["doc_id"]] += x["taken"]
    got = defaultdict(int)
    for x in mixing.mixed_documents(docs).collect():
        got[x["source"], x["doc_id"]] += len(x["text"].split())
        assert any(i == x["doc_id"] and s == x["source"] and t.startswith(x["text"]) for i, t, s in rows)
    assert any(n for (_, i), n in want.items() if i is None)
    assert got == {key: n for key, n in want.items() if n}


@pytest.mark.parametrize("seed", range(3))
def test_mixed_documents_take_what_the_plan_takes(spark, seed):
    """Word for word, with repeated rows at the cut, names that the operator uses inside, and a hot source."""
    r = random.Random(seed)
    rows = [(r.choice([i, 7, None]), "ab " * r.choice([0, 3, 3, 5]) + r.choice(["x", "y"]), r.choice(["a", "a", "a", "b", None]), 1, "n") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size long, named string")
    want, got = defaultdict(int), defaultdict(int)
    for x in mixing.mix_sources(docs).collect():
        want[x["source"], x["doc_id"], x["size"]] += x["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    whole = {(i, s): defaultdict(int) for i, _, s, _, _ in rows}
    for i, t, s, _, _ in rows:
        whole[i, s][len(t.split())] += 1
    for x in mixed.collect():
        assert (x["__size"], x["named"]) == (1, "n")
        size = next(len(t.split()) for i, t, s, _, _ in rows if (i, s) == (x["doc_id"], x["source"]) and t.startswith(x["text"]) and (t == x["text"] or want[s, i, len(t.split())] % len(t.split())))
        got[x["source"], x["doc_id"], size] += len(x["text"].split())
    assert sum(got.values()) == sum(want.values())
    by_source = lambda d: {s: sum(n for (k, *_), n in d.items() if k == s) for s in ("a", "b", None)}
    assert by_source(got) == by_source(want)
    assert mixing.mixed_documents(docs.where("false")).count() == 0


# ---------------------------------------------------------------- URL filters
def test_url_filters_by_brute_force(spark):
    r = random.Random(2)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    hosts = ["a.com", "x.a.com", "b.org", "y.x.a.com"]
    events = [(r.choice("LM"), r.choice([*hosts, "a.com/p"]), day(r.randrange(300)), r.choice(["add", "remove"])) for _ in range(60)]
    events += [(None, "a.com", day(1), "add"), ("L", "a.com", None, "add")]
    urls = ["http://X.a.com/p/q", "https://u@a.com:80/p", "http://b.org", "nonsense", "", None, "http://y.x.a.com./p?x", "ftp://c.net/"]
    caps = [(i, r.choice(urls), day(r.randrange(320)) if i % 9 else None) for i in range(150)]
    got = url_filters.filter_captures(spark.createDataFrame(caps, "page_id long, url string, fetched date"), spark.createDataFrame(events, "list string, pattern string, at date, action string"), period_days=30)
    keys = {"http://X.a.com/p/q": ["x.a.com", "a.com", "com", "x.a.com/p"], "https://u@a.com:80/p": ["a.com", "com", "a.com/p"], "http://b.org": ["b.org", "org"], "http://y.x.a.com./p?x": ["y.x.a.com", "x.a.com", "a.com", "com", "y.x.a.com/p"], "ftp://c.net/": ["c.net", "net"]}

    def active(entry, when):
        state = None
        for at, action in sorted(((e[2], e[3]) for e in events if e[:2] == entry and e[2] and e[2] <= when), key=lambda x: (x[0], x[1] == "remove")):
            state = action
        return state == "add"

    for x in got.collect():
        entries = {(e[0], e[1]) for e in events if e[0] and x["fetched"] and e[1] in keys.get(x["url"], []) and active(e[:2], x["fetched"])}
        assert (x["n_entries"], x["lists"], x["verdict"]) == (len(entries), ",".join(sorted({e[0] for e in entries})), "block" if entries else "allow"), x
    assert got.count() == len(set(caps))
    # every key hot, then none: the same rows
    again = [url_filters.filter_captures(spark.createDataFrame(caps, "page_id long, url string, fetched date"), spark.createDataFrame(events, "list string, pattern string, at date, action string"), hot_share=n, hot_rows=1) for n in (3, 100)]
    assert all(sorted(map(str, a.collect())) == sorted(map(str, got.collect())) for a in again)
    none = spark.createDataFrame([], "list string, pattern string, at date, action string")
    assert url_filters.filter_captures(spark.createDataFrame(caps, "page_id long, url string, fetched date"), none).where("verdict = 'block'").count() == 0


# ---------------------------------------------------------------- sharding
def test_store_compacts_and_keeps_rows(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=4000, fanout=3, small_bytes=2000)
    rows = []
    for k in range(10):
        batch = [(k * 100 + i, "t" * (i * 7 % 50) if i % 6 else None, "shard") for i in range(30)]
        rows += batch
        store.append(spark.createDataFrame(batch, "doc_id long, text string, name string").repartition(3))
        before = store.version()
        store.compact()
    m = store.manifest()
    tiers = [x["tier"] for x in m["runs"]]
    assert all(tiers.count(t) < 3 for t in tiers) and max(tiers) >= 2
    got = store.read()
    assert sorted(map(str, ((x["doc_id"], x["text"], x["name"]) for x in got.collect()))) == sorted(map(str, rows))
    assert store.read(before).count() <= len(rows)
    assert store.vacuum() > 0 and store.read().count() == len(rows)


def test_store_empty_and_conflicts(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.read().count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    store.append(empty)
    assert store.read().count() == 0 and "text" in store.read().columns
    calls = []

    def change(m):
        if not calls:  # another writer takes the number first
            calls.append(1)
            sharding.ShardStore(spark, f"file://{tmp_path}/s").append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        m["runs"] = m["runs"] + []
        return m

    assert store._commit(change)["version"] == store.version() == 3 and store.read().count() == 1


def test_shard_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i if i else None, "x" * i) for i in range(50)], "doc_id long, text string")
    store = sharding.shard_documents(docs, f"file://{tmp_path}/s")
    assert sorted(str(x["doc_id"]) for x in store.read().collect()) == sorted(str(x["doc_id"]) for x in docs.collect())


def test_shard_documents_with_unmerged_arrivals(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000 if i == 7 else 10))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one task: the same base name in each arrival
    store = sharding.shard_documents(docs, f"file://{tmp_path}/data/s", small_bytes=2000)
    runs = store.manifest()["runs"]
    files = {f"r{x['run']:04d}-{i:05d}": (x["tier"], p) for x in runs for i, (p, _) in enumerate(x["files"])}
    assert len({p.rpartition("/")[2] for _, p in files.values()}) < len(files)
    got = store.read().collect()
    assert sorted((x["doc_id"], x["text"]) for x in got) == rows
    for shard, (tier, p) in files.items():
        held = {x["doc_id"] for x in spark.read.parquet(f"{store.root}/{p}").select("doc_id").collect()}
        assert {x["doc_id"] for x in got if x["shard"] == shard} == held and {x["tier"] for x in got if x["shard"] == shard} == {tier}


def tier_of(size, small, fanout):
    tier = 0
    while size >= small * fanout ** (tier + 1):
        tier += 1
    return tier


@pytest.mark.parametrize("arrivals", range(1, 11))
def test_each_version_follows_from_the_last(spark, tmp_path, arrivals):
    """Sizes on both sides of a tier's limit; every version against a plain simulation, and whole rows at each."""
    r = random.Random(arrivals)
    rows = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=r.choice([5, 300])))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", small_bytes=1500, fanout=2, target_bytes=6000)
    store.append(docs, F.col("doc_id") % (arrivals * 2) / 2, arrivals)  # halves: rounded down to a number
    store.compact(jobs=2)
    for v in range(1, store.version() + 1):
        m = store.manifest(v)
        assert all(x["bytes"] == sum(n for _, n in x["files"]) and x["tier"] >= tier_of(x["bytes"], 1500, 2) for x in m["runs"])
        assert sorted((x["doc_id"], x["text"]) for x in store.read(v).collect()) == rows
        left = {x["run"]: x for x in m["runs"]}
        want, made = dict(left), []
        for tier in sorted({x["tier"] for x in m["runs"]}):
            mine = sorted(k for k, x in left.items() if x["tier"] == tier)
            while len(mine) >= 2:
                made.append((tier, mine[:2]))
                for k in mine[:2]:
                    del want[k]
                mine = mine[2:]
        if v == store.version():
            assert not made
            continue
        after = {x["run"]: x for x in store.manifest(v + 1)["runs"]}
        assert {k: x for k, x in after.items() if k in left} == want
        fresh = [after[k] for k in sorted(after) if k not in left]
        assert len(fresh) == len(made)
        for x, (tier, parts) in zip(fresh, made):
            ids = lambda runs: sorted(y["doc_id"] for z in runs for p, _ in z["files"] for y in spark.read.parquet(f"{store.root}/{p}").collect())
            assert x["tier"] == max(tier + 1, tier_of(x["bytes"], 1500, 2)) and ids([x]) == ids([left[k] for k in parts])
            assert len(x["files"]) <= max(1, round(sum(left[k]["bytes"] for k in parts) / 6000))


def test_arrivals_out_of_range_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t", "own", 5, "mine", "a") for i in range(10)], "doc_id long, text string, shard string, Tier int, version string, __arrival string")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(docs, F.when(F.col("doc_id") < 9, F.col("doc_id") - 2), 4)
    assert len(store.manifest()["runs"]) == 9
    got = store.read()
    assert {"shard", "shard_", "Tier", "tier_", "version", "version_"} <= set(got.columns)
    assert {(x["doc_id"], x["shard"], x["Tier"], x["version"], x["version_"], x["__arrival"]) for x in got.collect()} == {(i, "own", 5, "mine", 1, "a") for i in range(10)}
    store.append(spark.createDataFrame([(99, 1.5)], "doc_id long, more double"))
    assert store.read().where("doc_id = 99").select("text", "more").first() == (None, 1.5) and store.read().count() == 11
    for bad in ("doc_id string", "DOC_ID long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], bad))


def test_vacuum_takes_orphans(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fanout=2)
    docs = spark.createDataFrame([(i, "t") for i in range(10)], "doc_id long, text string").coalesce(1)
    store.append(docs)
    docs.write.parquet(f"{store.root}/data/lost")  # an append that was never committed
    (tmp_path / "s" / "_manifest" / ".aside-x").write_text("{}")
    assert store.vacuum() == 0 and store.vacuum(orphan_seconds=-1) == 1
    assert not (tmp_path / "s" / "_manifest" / ".aside-x").exists() and store.read().count() == 10


def test_manifests_elsewhere(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", manifest_root=f"file://{tmp_path}/m")
    store.append(spark.createDataFrame([(1, "t")], "doc_id long, text string"))
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.suffix == ".json") == ["v00000001.json"] and store.read().count() == 1


# ---------------------------------------------------------------- queries against SQL
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, (tuple(x) for x in got.select(*cols).collect()))) == sorted(map(str, rel.fetchall()))


def test_pipeline_on_the_smallest_tables(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and {"doc_id", "text", "shard", "version"} <= set(out.columns)
    assert out.where("text IS NULL").count() == 0
