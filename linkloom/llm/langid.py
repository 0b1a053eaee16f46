"""Language mixture inference.

Character trigrams around letters are hashed into ``buckets``; a language is a distribution over buckets. For each
document, expectation-maximisation estimates the proportions of the languages from the trigram likelihoods; languages of
little mass are dropped and the rest is fitted again, and of the sets tried the one with the best penalised likelihood
is kept (BIC, with the number of trigrams divided by three as neighbours overlap).

The model is fitted on a bounded, hash-drawn sample of labelled rows (``per_language`` expected documents a language);
prediction is map-only over whole texts. Labels are rows whose crc32(id as text) mod 4 is not 2.

Edge cases: null text, empty text and text without a letter give ``und`` with score 0; without labelled rows everything
is ``und``; rows with a null id are predicted but not learned from; repeated rows give equal results; very long texts are counted in full in one pass; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import give_back

UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigram_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the trigrams whose middle is a letter; other characters count as one blank."""
    out = np.zeros(0, np.int64)
    total = None
    lowered = text.lower()
    for at in range(0, len(lowered), 1 << 20):  # bounded memory on very long texts; pieces overlap by two characters
        piece = lowered[max(0, at - 1) : at + (1 << 20) + 1]
        points = np.frombuffer((" " * (at == 0) + piece + " " * (at + (1 << 20) >= len(lowered))).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        points = np.where(letter, points, 32).astype(np.uint64)
        mid = letter[1:-1]
        key = (points[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (points[2:] * np.uint64(0x165667B19E3779F9))
        key = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)
        found = np.bincount((key[mid] % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        total = found if total is None else total + found
    if total is None:
        return out, out
    where = np.flatnonzero(total)
    return where, total[where]


def _em(p: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood. p: trigrams x languages."""
    pi, n = np.full(p.shape[1], 1 / p.shape[1]), c.sum()
    for _ in range(rounds):
        mix = p * pi
        new = (c / mix.sum(1)) @ mix / n
        moved = np.abs(new - pi).max()
        pi = new
        if moved < 2e-3:
            break
    return pi, float(c @ np.log(p @ pi))


def infer_mixture(logp: np.ndarray, where: np.ndarray, counts: np.ndarray, rounds: int = 25, floor: float = 0.005, shift: float = 1.0) -> tuple[np.ndarray, float]:
    """Proportions by language (0 outside the chosen set) and a score of the largest: its smoothed share.

    The sets tried are the single best language, all languages, and what is left as languages below ``floor`` or else the
    smallest one are dropped in turn.
    """
    k = logp.shape[1]
    rows = logp[where].astype(np.float64)
    c = counts.astype(np.float64)
    p = np.exp(rows - rows.max(1, keepdims=True))
    single = c @ np.log(p)
    best = int(np.argmax(single))
    eff = max(2.0, c.sum() / 3)
    chosen, value, shares = [best], single[best] / 3, np.ones(1)
    alive = list(range(k))
    while len(alive) > 1:
        pi, ll = _em(p[:, alive], c, rounds)
        if (penalised := ll / 3 - 0.5 * (len(alive) - 1) * np.log(eff) * 2) > value:
            chosen, value, shares = list(alive), penalised, pi
        keep = [a for a, x in zip(alive, pi) if x >= floor]
        if not keep or len(keep) == len(alive):
            smallest = int(np.argmin(pi))
            keep = [a for i, a in enumerate(alive) if i != smallest]
        alive = keep
    out = np.zeros(k)
    out[chosen] = shares
    top = int(np.argmax(out))
    rivals = np.exp(np.clip(single - single[top], -60, 0) / 3)
    rivals[top] = 1
    n = c.sum() / 3
    return out, float((out[top] * n + shift * rivals[top] / rivals.sum()) / (n + shift))


class LanguageModel:
    def __init__(self, languages: list[str], logp: np.ndarray):
        self.languages, self.logp, self.buckets = languages, logp, len(logp)

    def predict(self, text: str | None) -> tuple[str, float, str]:
        if not text or not self.languages:
            return UNKNOWN, 0.0, ""
        where, counts = trigram_counts(text, self.buckets)
        if not len(where):
            return UNKNOWN, 0.0, ""
        shares, score = infer_mixture(self.logp, where, counts)
        order = np.argsort(-shares, kind="stable")
        return self.languages[order[0]], min(1.0, max(0.0, score)), ",".join(f"{self.languages[i]}:{shares[i]:.3f}" for i in order if shares[i] > 0)


def held_out(id_col, modulus: int, rest: int):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)) == rest


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, buckets: int = 1 << 15, smoothing: float = 0.05) -> LanguageModel:
    """Collects languages x buckets counts at most; the sample bounds the work, and its draw is a hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"), 4, 2))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((buckets, 0), np.float32))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1_000_003)) / 1_000_003.0
    share = F.create_map([x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                where, counts = trigram_counts(text.as_py(), buckets)
                got = sums.setdefault(lang, np.zeros(buckets, np.float64))
                got[where] += counts / max(1, counts.sum())  # a document weighs the same whatever its length
        for lang, got in sums.items():
            where = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where)), pa.array(where.astype(np.int32)), pa.array(got[where])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counts})
    table = np.zeros((buckets, len(languages)))
    for r in counts:
        table[r["bucket"], languages.index(r["lang"])] = r["n"]
    table = table / np.maximum(table.sum(0), 1e-12)
    base = table.mean(1, keepdims=True)
    table = (1 - smoothing) * table + smoothing * (0.5 * base + 0.5 / buckets)
    return LanguageModel(languages, np.log(table).astype(np.float32))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.string())])


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, mixture (``en:0.930,fr:0.070``). The model broadcast is languages x buckets floats."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:])]], schema=_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known: those without a letter and those below ``min_score`` go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        out = pd.Series([(p := shared.value.predict(t))[0] != UNKNOWN and p[1] >= min_score for t in texts], dtype=bool)
        give_back()
        return out

    return docs.where(known(F.col(text_col)))
