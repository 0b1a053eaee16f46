"""python -m linkloom COMMAND: check, profile, train, predict, full, recall over the TSV files of a data folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="linkloom")
    out.add_argument("command", choices=["check", "profile", "train", "predict", "full", "recall"])
    out.add_argument("--data", required=True, help="folder with train/ and test/")
    out.add_argument("--work", help="folder for steps, models and the bundle")
    out.add_argument("--out", help="folder for the lists of train, predict and full")
    out.add_argument("--split", default="test")
    for name, kind, default in (("k-rev", int, 10), ("k-fwd", int, 20), ("k-emb", int, 5), ("df-cap", int, 3000), ("df-share", float, 0.004), ("folds", int, 3), ("rounds", int, 20), ("drop-s1", float, 0.0)):
        out.add_argument(f"--{name}", type=kind, default=default)
    out.add_argument("--cross-scorer", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from linkloom.operators import reports, stats
    from linkloom.plans.linkage import Linkage
    from linkloom.sources import tables

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linkloom").getOrCreate()
    if args.command == "check":
        told = tables.check_data(spark, args.data)
        for name, there, rows in told:
            print(f"{'ok' if there else 'MISSING':8} {name} {rows if there else ''}")
        return 0 if all(there for _, there, _ in told) else 1
    if args.command == "profile":
        records, _ = tables.read_split(spark, args.data, args.split)
        print(reports.markdown(reports.list_profile(records, "entity_id", ["business_name", "business_address", "country"]), "Lists"))
        print(reports.markdown(reports.country_shares(records, "country").orderBy("country"), "Countries"))
        print(reports.markdown(reports.character_profile(records, "src", "business_name", "business_address").orderBy("src"), "Characters"))
        print(reports.markdown(stats.crosstab(records, "country", "src", ["S1", "S2", "S3"]).orderBy("country"), "Files by country"))
        return 0
    options = {n: getattr(args, n) for n in ("k_rev", "k_fwd", "k_emb", "df_cap", "df_share", "folds", "rounds", "cross_scorer")}
    run = Linkage(spark, args.work, **options) if args.command != "predict" else Linkage.load(spark, args.work)
    if args.command in ("train", "full", "recall"):
        records, truth = tables.read_split(spark, args.data, "train")
        raw = records.select("entity_id", "business_name", "business_address", "country")
        if args.drop_s1:
            gone = tables.without_ids(raw.where(F.col("entity_id").startswith("S1")), tables.keep_fraction(raw, "entity_id", args.drop_s1))
            raw = tables.without_ids(raw, gone)
        print(reports.markdown(run.train(raw, truth), "Macro F0.5 out of fold"))
        for title, table in run.report().items():
            print(reports.markdown(table, title))
    if args.command in ("predict", "full"):
        records, _ = tables.read_split(spark, args.data, args.split)
        matches, candidates = run.predict(records.select("entity_id", "business_name", "business_address", "country"), args.split)
        for name, lists, col in (("matches", matches, "matched_entity_ids"), ("candidates", candidates, "candidate_entity_ids")):
            tables.write_tsv(lists.select(F.col("s1_id").alias("source1_entity_id"), col).orderBy("source1_entity_id"), f"{args.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
