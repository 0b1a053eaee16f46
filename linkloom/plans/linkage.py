"""End-to-end linkage: prepare, block, pre-filter, features, stacking, decision, output lists.

Every step is a table under ``work`` whose name ends in a key of the step's options and of the keys of all it is made from;
at the root of the keys stands a fingerprint of the input's rows. A step whose key is there is read again, and anything
that changes upstream changes the keys below it. Fitted models lie beside the tables under keys made the same way, and
what prediction needs is one JSON file, so that another session can load it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.normalize import prepare_records, tokens
from linkloom.operators import blocking, decide, features, learn, synonyms, vectors
from linkloom.operators.metrics import ceiling, entity_scores, macro_f_half
from linkloom.sources.tables import id_lists, materialised, truth_pairs

TAUS = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05]


def digest(*parts) -> str:
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]


def fingerprint(df: DataFrame) -> str:
    """Of the rows, in any order: their number and the sums of two hashes of each, and the schema."""
    cols = sorted(df.columns)
    hashes = [F.sum(F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in cols]).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)]
    return digest(df.select(cols).schema.simpleString(), *df.agg(F.count("*").alias("n"), *hashes).first())


@dataclass
class Step:
    key: str
    table: DataFrame


@dataclass
class Linkage:
    spark: SparkSession
    work: str
    k_rev: int = 10
    k_fwd: int = 20
    k_emb: int = 5
    df_cap: int = 3000
    df_share: float = 0.004
    budget: float = 4.0
    folds: int = 3
    rounds: int = 20
    embeddings: bool = True
    cross_scorer: bool = False
    mine_synonyms: bool = True
    synonym_count: int = 15
    indexed_above: int = 1_000_000
    country_s1: int = 50_000
    encoder: Callable[[list[str]], np.ndarray] = vectors.encode_batch
    encoder_name: str = "hashed trigrams"
    bundle: dict = field(default_factory=dict)

    # ------------------------------------------------------------------ files
    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.work}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def _write(self, name: str, text: str) -> None:
        fs, path = self._at(name)
        stream = fs.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def step(self, name: str, from_: list, options: dict, make: Callable[[], DataFrame]) -> Step:
        key = digest(name, from_, options)
        if not self._there(f"{name}-{key}/_SUCCESS"):
            make().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.work}/{name}-{key}")
        return Step(key, self.spark.read.parquet(f"{self.work}/{name}-{key}"))

    def model(self, name: str, key: str, make: Callable[[], Model]) -> Model:
        path = f"models/{name}-{key}"
        if not self._there(f"{path}/_SUCCESS"):
            make().write().overwrite().save(f"{self.work}/{path}")
            self._write(f"{path}/_SUCCESS", "")
        return PipelineModel.load(f"{self.work}/{path}")

    def save(self) -> None:
        self._write("bundle.json", json.dumps(self.bundle, sort_keys=True))

    @classmethod
    def load(cls, spark: SparkSession, work: str, **options) -> "Linkage":
        """A linkage trained by an earlier session, with its options."""
        out = cls(spark, work)
        out.bundle = json.loads(out._read("bundle.json"))
        for name, value in (out.bundle["options"] | options).items():
            setattr(out, name, value)
        return out

    def options(self) -> dict:
        names = ("k_rev", "k_fwd", "k_emb", "df_cap", "df_share", "budget", "folds", "rounds", "embeddings", "cross_scorer", "mine_synonyms", "synonym_count", "indexed_above", "country_s1", "encoder_name")
        return {n: getattr(self, n) for n in names}

    # ------------------------------------------------------------------ steps
    def prepare(self, records: DataFrame, split: str, input_key: str | None = None, known: tuple[dict, dict] = ({}, {})) -> tuple[Step, DataFrame, DataFrame]:
        """The prepared records, S1 and the others."""
        out = self.step(f"{split}_prep", [input_key or fingerprint(records)], {"synonyms": known}, lambda: prepare_records(records, *known))
        first = F.col("entity_id").startswith("S1")
        return out, out.table.where(first), out.table.where(~first)

    def mined(self, records: DataFrame, truth: DataFrame, key: str) -> tuple[dict, dict]:
        """Token synonyms of names and addresses from the true pairs."""
        name = f"synonyms-{digest(key, self.synonym_count)}.json"
        if not self._there(name):
            _, s1, others = self.prepare(records, "train", key)
            side = lambda d, k, t: d.select(F.col("entity_id").alias(k), F.col("name").alias(f"name_{t}"), F.col("addr").alias(f"addr_{t}"), tokens(F.col("n_name")).alias(f"n{t}"), tokens(F.col("n_addr")).alias(f"a{t}"))
            both = truth.join(side(s1, "s1_id", "a"), "s1_id").join(side(others, "o_id", "b"), "o_id")
            found = []
            for raw, lead in (("name", "n"), ("addr", "a")):
                mined = synonyms.mine(both.select(F.col(f"{lead}a").alias("ta"), F.col(f"{lead}b").alias("tb"), F.col(f"{raw}_b").alias("raw_b")), self.synonym_count)
                found.append(synonyms.as_dict(synonyms.resolve_chains(mined)))
            self._write(name, json.dumps(found))
        return tuple(json.loads(self._read(name)))

    def candidates(self, prep: Step, s1: DataFrame, others: DataFrame, split: str) -> Step:
        side = lambda d: d.select(F.col("entity_id").alias("id"), "ckey", F.col("btok").alias("toks"))
        named = lambda d: vectors.encode_distinct(d.select(F.col("entity_id").alias("id"), "ckey", F.col("c_name").alias("t")), "t", encoder=self.encoder).drop("t")

        def make() -> DataFrame:
            pairs = blocking.cosine_top(side(s1), side(others), self.k_rev, self.k_fwd, cap=self.df_cap, share=self.df_share)
            find = vectors.nearest_indexed if s1.count() > self.indexed_above else vectors.nearest
            return blocking.merge_candidates(pairs, find(named(s1), named(others), self.k_emb))

        return self.step(f"{split}_cands", [prep.key], {"k": [self.k_rev, self.k_fwd, self.k_emb], "window": [self.df_cap, self.df_share], "encoder": self.encoder_name, "indexed": self.indexed_above}, make)

    def _labelled(self, table: DataFrame, truth: DataFrame) -> DataFrame:
        return table.join(truth.select("s1_id", "o_id", F.lit(1).alias("label")), ["s1_id", "o_id"], "left").na.fill(0, ["label"])

    def _features(self, pruned: Step, s1: DataFrame, others: DataFrame, split: str) -> Step:
        return self.step(f"{split}_feat", [pruned.key], {"embeddings": self.embeddings, "encoder": self.encoder_name}, lambda: features.pair_features(pruned.table, s1, others, self.embeddings, self.encoder))

    def _texts(self, pruned: Step, s1: DataFrame, others: DataFrame) -> DataFrame:
        text = lambda d, key, out: d.select(F.col("entity_id").alias(key), vectors.pair_text(F.col("name"), F.col("addr")).alias(out))
        chosen = vectors.select_for_scorer(pruned.table.select("s1_id", "o_id", "p1"), 2, 0.02)
        return chosen.join(text(s1, "s1_id", "text_a"), "s1_id").join(text(others, "o_id", "text_b"), "o_id")

    def _with_scorer(self, table: DataFrame, scored: DataFrame) -> DataFrame:
        """The features with the five columns of the text scorer; null where a pair was not worth its time."""
        told = vectors.cosine_context(scored.select("s1_id", "o_id", "ce_p"), "ce_p")
        return table.join(told, ["s1_id", "o_id"], "left")

    SCORER = ["ce_p", "ce_p_rank_c", "ce_p_best_other_c", "ce_p_gap_c", "ce_p_best_other_s1"]

    # ------------------------------------------------------------------ training
    def train(self, records: DataFrame, truth_lists: DataFrame) -> DataFrame:
        """Fits everything on the train split; returns the macro F0.5 of the out-of-fold decision."""
        key = fingerprint(records)
        truth = truth_pairs(truth_lists, records.where(F.col("entity_id").startswith("S1")))
        truth_key = fingerprint(truth)
        truth = self.step("truth", [truth_key], {}, lambda: truth).table
        known = self.mined(records, truth, digest(key, truth_key)) if self.mine_synonyms else ({}, {})
        prep, s1, others = self.prepare(records, "train", key, known)
        ids = s1.select(F.col("entity_id").alias("s1_id"), "ckey")
        cands = self.candidates(prep, s1, others, "train")
        fit = {"folds": self.folds, "rounds": self.rounds}

        cheap = self.step("train_cheap", [cands.key], {}, lambda: features.cheap_features(cands.table, s1, others))
        filter_key = digest("prefilter", cheap.key, truth_key, fit)
        names: dict[str, str] = {}

        def kept(lead: str, under: str):
            def find(name: str, make: Callable[[], Model]) -> Model:
                names[f"{lead}{name}"] = f"{lead}{name}-{under}"
                return self.model(f"{lead}{name}", under, make)

            return find

        scored, _ = learn.out_of_fold(self._labelled(cheap.table, truth), features.CHEAP, "p", self.folds, rounds=self.rounds, kept=kept("prefilter-", filter_key))
        scored = self.step("train_cheap_p", [filter_key], {}, lambda: scored).table
        tau = learn.tau_for_budget(scored, self.budget, TAUS)
        pruned = self._pruned(scored, tau, [filter_key, cands.key], "train")

        feat = self._features(pruned, s1, others, "train")
        table, extra, scorers = feat.table, [], []
        if self.cross_scorer:
            read, scorers = vectors.cross_scores(self._labelled(self._texts(pruned, s1, others), truth))
            read = self.step("train_ce", [pruned.key, truth_key], {}, lambda: read.select("s1_id", "o_id", "ce_p"))
            table, extra = self._with_scorer(table, read.table), self.SCORER
        stack_key = digest("stack", feat.key, truth_key, fit, extra)
        columns = features.feature_names(self.embeddings)
        two, fitted = learn.stacked(self._labelled(table, truth), columns, self.folds, self.rounds, saved=lambda n, df: self.step(f"train_{n}", [stack_key], {}, lambda: df).table, kept=kept("", stack_key), extra=extra)
        scored = self.step("train_scored", [stack_key], {"level": 2}, lambda: two.select("s1_id", "o_id", "p", "l1_p")).table

        # level 2 is used only if it is no worse
        one, two = (scored.select("s1_id", "o_id", F.col(c).alias("p")) for c in ("l1_p", "p"))
        best = [decide.tune_threshold(ids, x, truth) for x in (one, two)]
        level = 2 if best[1][0] >= best[0][0] else 1
        chosen = two if level == 2 else one
        rule = decide.search_rules(ids, chosen, truth)
        if rule["rule"] == "threshold":
            by_country = decide.tune_by_country(ids, chosen, truth, rule["t"], self.country_s1)
            rule = by_country if by_country["thresholds"] else rule
        self.bundle = {
            "options": self.options(), "synonyms": list(known), "tau": tau, "level": level, "rule": rule, "models": names, "features1": fitted["features1"], "features2": fitted["features2"], "extra": extra,
            "scorers": [list(s.weights) for s in scorers], "macro": {"level1": best[0][0], "level2": best[1][0]}, "trained_on": digest(key, truth_key),
        }
        self.save()
        self._train = {"ids": ids, "truth": truth, "cands": cands.table, "pruned": pruned.table, "scored": chosen}
        return macro_f_half(entity_scores(ids, self.decide(chosen, ids), truth))

    def _pruned(self, scored: DataFrame, tau: float, from_: list, split: str) -> Step:
        kept = lambda: decide.prefilter_keep(scored, tau).select("s1_id", "o_id", "score", "r_rev", "r_fwd", "r_emb", "emb_score", F.col("p").alias("p1"))
        return self.step(f"{split}_pruned", from_, {"tau": tau}, kept)

    def decide(self, scored: DataFrame, ids: DataFrame) -> DataFrame:
        rule = self.bundle["rule"]
        return decide.apply_rule(scored.join(ids.select("s1_id", "ckey"), "s1_id") if rule["rule"] == "by_country" else scored, rule)

    def report(self) -> dict[str, DataFrame]:
        """Tables of the last training in this session: recall by source, recall grid, ceilings, importances."""
        t = self._train
        pad = t["cands"]
        first = self._models("level1")[0]
        weights = learn.importances(first, self.bundle["features1"])
        return {
            "recall by source": blocking.recall_by_source(t["truth"], pad), "recall grid": blocking.recall_grid(t["truth"], pad, [1, 2, 5, self.k_rev], [0, 1, 5, self.k_fwd]),
            "ceiling of all candidates": ceiling(t["ids"], pad, t["truth"]), "ceiling after the pre-filter": ceiling(t["ids"], t["pruned"], t["truth"]),
            "importance": self.spark.createDataFrame(weights[:25], "feature string, gain double"),
        }

    # ------------------------------------------------------------------ prediction
    def _models(self, lead: str) -> list[Model]:
        names = sorted(v for k, v in self.bundle["models"].items() if k.startswith(f"{lead}-"))
        return [PipelineModel.load(f"{self.work}/models/{n}") for n in names]

    def _ready(self, table: DataFrame, columns: list[str]) -> DataFrame:
        """Indicators and filled values as training had them."""
        gone = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        marks = [c for c in columns if c.endswith("_isnull")]
        plain = [c for c in columns if c not in marks and c in table.columns]
        table = table.withColumns({m: gone(m.removesuffix("_isnull")).cast("double") for m in marks if m not in table.columns})
        return table.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-1.0)), F.lit(-1.0)) for c in plain})

    def predict(self, records: DataFrame, split: str = "test") -> tuple[DataFrame, DataFrame]:
        """(matches, candidates) as id lists for every S1 of the split."""
        from linkloom.operators.windows import level_two_columns

        told, models = self.bundle, digest(self.bundle["models"], self.bundle["level"])
        prep, s1, others = self.prepare(records, split, known=tuple(told["synonyms"]))
        cands = self.candidates(prep, s1, others, split)
        cheap = self.step(f"{split}_cheap", [cands.key], {}, lambda: features.cheap_features(cands.table, s1, others))
        scored = self.step(f"{split}_cheap_p", [cheap.key, models], {}, lambda: learn.average_models(self._models("prefilter"), cheap.table))
        pruned = self._pruned(scored.table, told["tau"], [scored.key], split)
        feat = self._features(pruned, s1, others, split)
        table = feat.table
        if told["extra"]:
            scorers = [vectors.PairScorer(np.array(w)) for w in told["scorers"]]
            mean = lambda a, b: np.mean([s(a, b) for s in scorers], axis=0) if a else []
            read = self.step(f"{split}_ce", [pruned.key, models], {}, lambda: vectors.score_text_pairs(self._texts(pruned, s1, others), mean).select("s1_id", "o_id", "ce_p"))
            table = self._with_scorer(table, read.table)

        def make() -> DataFrame:
            one = learn.average_models(self._models("level1"), self._ready(table, told["features2"]), "p")
            if told["level"] == 1:
                return one.select("s1_id", "o_id", "p")
            one = self.step(f"{split}_level1", [feat.key, models], {}, lambda: level_two_columns(one).drop("p")).table
            return learn.average_models(self._models("level2"), one, "p").select("s1_id", "o_id", "p")

        final = self.step(f"{split}_scored", [feat.key, models], {"level": told["level"]}, make).table
        ids = s1.select(F.col("entity_id").alias("s1_id"), "ckey")
        return id_lists(ids, self.decide(final, ids), "matched_entity_ids"), id_lists(ids, final, "candidate_entity_ids")


def first_generation(records: DataFrame, truth_lists: DataFrame, folds: int = 5, rounds: int = 20) -> dict:
    """The older path: TF-IDF and exact-key candidates, its own features, balanced folds, its own tuner, leave one country out,
    and models of three seeds on all rows. What several steps read is written to the checkpoint folder in between."""
    prep = materialised(prepare_records(records))
    first = F.col("entity_id").startswith("S1")
    s1, others = prep.where(first), prep.where(~first)
    truth = materialised(truth_pairs(truth_lists, records.where(first)))
    side = lambda d: d.withColumnRenamed("entity_id", "id")
    pairs = materialised(blocking.first_candidates(side(s1), side(others)).select("s1_id", "o_id").distinct())
    base = features.row_similarity(pairs, s1, others).drop("country_equal", "pc_equal")
    own = features.first_features(pairs, s1, others)
    table = features.first_context(base.join(own, ["s1_id", "o_id"]), ["name_tset", "addr_tset", "cos_name", "cos_full", "cos_addr"])
    table = table.join(truth.select("s1_id", "o_id", F.lit(1).alias("label")), ["s1_id", "o_id"], "left").na.fill(0, ["label"])
    table = materialised(table)
    table, names = learn.filled(table, [c for c in table.columns if c not in ("s1_id", "o_id", "label")])
    scored, models = learn.grouped_oof(table, names, k=folds, rounds=rounds)
    ids = s1.select(F.col("entity_id").alias("s1_id"), "ckey")
    p = materialised(scored.select("s1_id", "o_id", "p"))
    rule = decide.tune_first(ids, p, truth)
    apart = learn.leave_one_out(table.join(ids, "s1_id"), names, "ckey", rounds=rounds)
    alone = macro_f_half(entity_scores(ids, decide.apply_rule(apart.select("s1_id", "o_id", "p"), rule), truth)) if apart is not None else None
    return {"rule": rule, "scored": p, "ceiling": ceiling(ids, pairs, truth), "leave_one_out": alone, "models": learn.refitted(table, names, models), "features": names}
