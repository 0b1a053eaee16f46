import random
import re
from collections import Counter, defaultdict

import pytest
import corpus_pipeline
from linkloom.llm import decontam, langid
from tests.llm.test_table_ops import targets_by_steps
from tests.llm.test_text_ops import components_by_brute_force, edit_distance_in, prose

WORDS = {"aa": "the then this that with other river stone", "bb": "der die das und nicht schnell haus weg", "cc": "les dans avec pour nous tres maison ville"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, node long, size long, taken long, shard string, row string, label string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, benchmark passages, nulls, blanks, repeated rows and a long text; columns named as the stages'
    own ones."""
    r = random.Random(21)
    passages = [" ".join(f"{r.choice(WORDS['aa'].split())}{r.randrange(10**4)}" for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(70):
        lang = r.choice(list(WORDS))
        words = [r.choice(WORDS[lang].split()) + (str(r.randrange(300)) if r.random() < 0.5 else "") for _ in range(r.randrange(6, 60))]
        text = " ".join(words)
        if i % 9 == 0:
            text += " " + r.choice(passages).upper()
        if i % 5 == 1 and rows:
            text = (r.choice(rows)[1] or "") + (" end" if i % 2 else "")
        rows.append((i, text, lang if i % 7 else None, r.choice(["web", "web", "web", "books", None])))
    rows += [(100, None, "aa", "web"), (101, "", "bb", "web"), (102, "12 34 !!", "aa", "books"), (103, " ".join(r.choice(WORDS["cc"].split()) + str(r.randrange(10**5)) for _ in range(20_000)), "cc", "books")]
    rows += [rows[3], rows[3], (None, "der die das und nicht", "bb", "web"), (None, "der die das und nicht", "bb", "web"), (4, "les dans avec pour nous tres", "cc", None)]
    full = [(i, t, k, s, len(t or ""), 1, 2, 3, "own", "r", "l") for i, t, k, s in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    bench = [(k, p) for k, p in enumerate(passages)] + [(9, None), (10, "12"), (None, passages[0])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [p for _, p in bench if p and len(p) > 9]


def rows_of(df):
    return Counter(map(str, df.select(sorted(df.columns)).collect()))


def test_stages_by_brute_force(spark, corpus, tmp_path):
    folder, passages = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, make in corpus_pipeline.STAGES:
        before = docs.collect()
        out = make(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs_after = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs_after.collect()
        kept[name] = len(got)
        if name != "shards":
            assert docs_after.columns == docs.columns
        if name == "language":
            model = langid.fit_language_model(docs)
            want = [x for x in before if x["text"] and any(c.isalpha() for c in x["text"]) and model.predict(x["text"])[1] >= 0.3]
            assert Counter(map(str, got)) == Counter(map(str, want)) and not {100, 101, 102} & {x["doc_id"] for x in got}
        elif name == "near_duplicates":
            numbered = list(enumerate(before))
            label = components_by_brute_force([(k, x["text"]) for k, x in numbered])
            groups = defaultdict(list)
            for k, x in numbered:
                groups[label[k][1]].append(x)
            assert len(got) == len(groups)
            for group in groups.values():
                ids = [x["doc_id"] for x in group if x["doc_id"] is not None]
                least = min(ids) if ids else None
                mine = [x for x in group if x["doc_id"] == least]
                assert sum(str(y) in {str(x) for x in mine} for y in got) == 1
        elif name == "decontamination":
            plain = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
            index = decontam.ItemIndex([(0, p) for p in passages], 10, 0.08)
            leaks = lambda t: any(edit_distance_in(plain(p), plain(t)) <= e for p, e in zip(passages, index.budget))
            want = [x for x in before if len(x["text"]) > 20_000 or not leaks(x["text"])]
            assert Counter(map(str, got)) == Counter(map(str, want)) and len(want) < len(before)
        elif name == "mixture":
            sizes, taken = defaultdict(int), defaultdict(int)
            for x in before:
                sizes[x["source"]] += len(x["text"].split())
            for x in got:
                taken[x["source"]] += len(x["text"].split())
                assert x["n_chars"] == len(x["text"])
            assert all(abs(taken[s] - t) <= 0.5 for s, t in targets_by_steps(sizes).items())
            starts = defaultdict(set)
            for x in before:
                starts[x["doc_id"], x["source"]].add(x["text"])
            assert all(any(t.startswith(x["text"]) for t in starts[x["doc_id"], x["source"]]) for x in got)
        else:
            assert {"shard_", "tier", "version"} <= set(docs_after.columns)
            assert rows_of(docs_after.drop("shard_", "tier", "version")) == rows_of(docs)
            assert len({x["version"] for x in got}) == 1
        docs = docs_after
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == kept["shards"] and rows_of(whole.drop("shard_", "tier", "version")) == rows_of(docs.drop("shard_", "tier", "version"))


def test_stages_on_an_empty_table(spark, corpus):
    folder, _ = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, make in corpus_pipeline.STAGES:
        assert make(spark, none, folder).count() == 0, name
