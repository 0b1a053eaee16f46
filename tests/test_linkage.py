import pytest
from pyspark.sql import functions as F

from linkloom.plans.linkage import Linkage, first_generation, fingerprint
from linkloom.plans.synthetic import business_lists
from linkloom.sources import tables as I

RECORD = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    work = str(tmp_path_factory.mktemp("work"))
    records, truth = business_lists(spark, 60, ["US", "India"])
    run = Linkage(spark, work, k_rev=3, k_fwd=3, k_emb=2, folds=2, rounds=2, synonym_count=3, cross_scorer=True)
    macro = run.train(records, truth).first()["macro"]
    return work, run, macro


def test_end_to_end(spark, trained):
    work, run, macro = trained
    assert macro > 0.8 and run.bundle["level"] in (1, 2) and run.report()["recall by source"].first()["both"] > 0.95
    new, truth = business_lists(spark, 30, ["US", "France"], seed=7)
    matches, cands = run.predict(new)
    s1 = new.where(F.col("entity_id").startswith("S1")).select(F.col("entity_id").alias("s1_id"))
    others = new.where(~F.col("entity_id").startswith("S1")).select(F.col("entity_id").alias("o_id"))
    pairs = cands.select("s1_id", F.explode(F.split("candidate_entity_ids", ",")).alias("o_id"))
    assert matches.count() == 30
    assert I.check_lists(matches, s1, others, "matched_entity_ids", pairs).count() == 0
    # another session's view of the folder gives the same, and other lists give their own rows
    again = Linkage.load(spark, work)
    assert sorted(again.predict(new)[0].collect()) == sorted(matches.collect())
    third, _ = business_lists(spark, 20, ["US"], seed=8)
    assert {x["s1_id"] for x in again.predict(third)[0].collect()} == {x[0] for x in third.where("entity_id LIKE 'S1%'").select("entity_id").collect()}


def test_steps_follow_their_input(spark, tmp_path):
    run = Linkage(spark, str(tmp_path))
    a = spark.createDataFrame([("S1-1", "Foo Ltd", "1 Main St", "US")], RECORD)
    b = spark.createDataFrame([("S1-1", "Bar Ltd", "1 Main St", "US")], RECORD)
    names = [run.prepare(x, "train")[0].table.first()["c_name"] for x in (a, b, a)]
    assert names == ["foo", "bar", "foo"] and fingerprint(a) != fingerprint(b)
    assert fingerprint(a.unionByName(b)) == fingerprint(b.unionByName(a).repartition(3))
    step = lambda **o: run.step("x", ["k"], o, lambda: a).key
    assert step(k=1) != step(k=2) and step(k=1) == step(k=1)


def test_first_generation(spark):
    records, truth = business_lists(spark, 30, ["US", "India"], seed=3)
    got = first_generation(records, truth, folds=2, rounds=2)
    assert got["rule"]["score"] > 0.7 and got["ceiling"].first()["macro"] > 0.9 and len(got["models"]) == 3


def test_lists_are_the_same_on_every_run(spark):
    a, b = (business_lists(spark, 50, ["US", "India", "France"], seed=4) for _ in range(2))
    assert all(sorted(map(str, x.collect())) == sorted(map(str, y.repartition(3).collect())) for x, y in zip(a, b))
    assert a[0].select("entity_id").distinct().count() == a[0].count()


@pytest.mark.parametrize("files", [1, 3, None])
def test_tsv_round_trip(spark, tmp_path, files):
    rows = [("S1-1", 'a "b"', "NA", ""), ("S1-2", "x", "", "US"), ("#3", " lead", "trail ", '"'), ("S1-4", "日本 \\n", "a,b", "'"), *[(f"S{i}", "", "", "") for i in range(5, 15)]]
    df = spark.createDataFrame(rows, RECORD).repartition(4)
    I.write_tsv(df, str(tmp_path / "t"), files)
    assert sorted(I.read_tsv(spark, str(tmp_path / "t")).collect()) == sorted(df.collect())


@pytest.mark.parametrize("bad", ["a\tb", "a\nb", "a\rb"])
def test_tsv_refuses_what_it_cannot_hold(spark, tmp_path, bad):
    with pytest.raises(Exception, match="a field holds"):
        I.write_tsv(spark.createDataFrame([("S1", bad, "", "")], RECORD), str(tmp_path / "t"))


def test_splits_and_command(spark, tmp_path, capsys):
    from linkloom.__main__ import main

    records, truth = business_lists(spark, 20, ["US"], seed=5)
    for split in ("train", "test"):
        for k in (1, 2, 3):
            rows = records.where(F.col("entity_id").startswith(f"S{k}"))
            text = "\n".join(["entity_id\tbusiness_name\tbusiness_address\tcountry", *["\t".join(x) for x in rows.collect()]])
            (tmp_path / split).mkdir(exist_ok=True)
            (tmp_path / split / f"{split}_source{k}.tsv").write_text(text + "\n")
    assert main(["check", "--data", str(tmp_path)], spark) == 1
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("\n".join(["source1_entity_id\tmatched_entity_ids", *["\t".join(x) for x in truth.collect()]]) + "\n")
    assert main(["check", "--data", str(tmp_path)], spark) == 0
    got, lists = I.read_split(spark, str(tmp_path), "train")
    assert got.count() == records.count() and lists.count() == 20 and set(got.columns) >= {"src", "split"}
    assert main(["profile", "--data", str(tmp_path), "--split", "train"], spark) == 0
    assert "Countries" in capsys.readouterr().out


def test_validator_names_every_problem(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    lists = frame([("a", "x,x"), ("a", "y"), ("z", "q"), ("c", "y")], "s1_id string, m string")
    s1, others = frame([("a",), ("b",), ("c",)], "s1_id string"), frame([("x",), ("y",)], "o_id string")
    got = {x["problem"]: x["n"] for x in I.check_lists(lists, s1, others, "m", frame([("a", "x"), ("a", "y"), ("z", "q")], "s1_id string, o_id string")).collect()}
    assert got == {"duplicate S1": 1, "missing S1": 1, "unknown S1": 1, "unknown record": 1, "record twice": 1, "match outside candidates": 1}
