"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, violent verb, modal, target, negation, verb of saying, other). Five sequential transducers
read them one after another: insult marks insults (a repetition weighs less), threat finds violent verbs with a modal or a
target on either side, negation and reported speech turn what they cover into weaker forms, and aimed strengthens what
stands near a target. Arcs carry weights; the machines are composed into one, whose arcs weigh the product, and a clause's
weight is the sum over its matches of arc weight times the word's weight. Clauses are classed by what they hold, and the
document's score is a logistic function of the weights of its clauses by class. The insult lexicon, its weights and the
logistic weights are learned from labels.

Learning reads a bounded, hash-drawn sample of labelled rows (``sample_rows`` expected); the lexicon has ``max_words`` words
at most, the most telling of 20 times as many that are counted exactly. Documents with the same minimum word hash count as
one, so that the other words of copied toxic documents aren't taken for insults.

Edge cases: null or empty text matches nothing and gets the base score; a clause ends at a full stop, question or
exclamation mark, colon, semicolon or line end, and is read whole however long it is, token by token in constant memory;
without labels the seed lists decide; repeated rows give equal results; a document with several labels counts as toxic if
one says so; labels without an id are ignored, and documents without one are scored as any other; other columns of both
tables are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.langid import held_out

#: Seed lists of the grammar.
TARGETS = "you your yours yourself u he she they him her them tu te toi vous votre du dich dir ihr euch sie usted ustedes ti".split()
NEGATIONS = "not never no n't isn't aren't wasn't don't won't ne pas jamais aucun nicht kein keine nie nunca tampoco".split()
REPORTED = "said says quoted quote told called calls claimed reported wrote dit disait appelle sagte sagt nannte dijo dice llama".split()
THREATS = "kill hurt destroy murder shoot stab tuer frapper töten umbringen matar golpear killed hurting killing".split()
MODALS = "will gonna going shall must should i'll we'll vais va vamos voy werde wird soll".split()
INSULTS = "idiot moron stupid scum".split()

WORD, INSULT, VERB, MODAL, TARGET, NEGATION, REPORT = "WIVMYNR"
SYMBOLS = (WORD, INSULT, VERB, MODAL, TARGET, NEGATION, REPORT)
#: What the grammar writes for a match: insult or threat, in lower case where negated; AIM says that the last match is aimed.
THREAT, AIM = "T", "A"
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")
_END = re.compile(r"[.!?;:\n]")


class Transducer:
    """A sequential transducer with weighted arcs: (state, symbol) -> (state, output, weight). Missing arcs copy the symbol,
    stay and weigh 1."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], start: int = 0):
        self.arcs, self.start = arcs, start

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def machine(start, move, alphabet) -> Transducer:
    """The transducer of move(state, symbol) -> (state, output, weight), over the states reached from ``start``."""
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            to, out, weight = move(state, symbol)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            arcs[number[state], symbol] = (number[to], out, weight)
    return Transducer(arcs)


def compose(a: Transducer, b: Transducer, alphabet) -> Transducer:
    """The machine that feeds a's output to b; its arcs weigh the product."""

    def move(state, symbol):
        sa, mid, wa = a.step(state[0], symbol)
        sb, out, wb = b.step(state[1], mid)
        return (sa, sb), out, wa * wb

    return machine((a.start, b.start), move, alphabet)


def insult(again: float = 0.5) -> Transducer:
    """The first insult of a clause weighs 1, later ones ``again``."""
    return machine(False, lambda seen, x: (seen or x == INSULT, x, again if seen and x == INSULT else 1.0), SYMBOLS)


def threat(reach: int = 4, intended: float = 2.0, bare: float = 1.0, passive: float = 1.5) -> Transducer:
    """Violent verbs become threats: at the target after them (more so after a modal), or at the verb itself where a target
    and a modal stand before it. A verb without a target is a word."""

    def move(state, x):
        modal, target, verb, weight = state  # how many tokens the modal, the target and the open verb still reach
        after = (max(0, modal - 1), max(0, target - 1), max(0, verb - 1), weight)
        if x == MODAL:
            return (reach, *after[1:]), x, 1.0
        if x == TARGET:
            if verb:
                return (after[0], reach, 0, 0.0), THREAT, weight
            return (after[0], reach, *after[2:]), x, 1.0
        if x == VERB:
            if modal and target:
                return (0, 0, 0, 0.0), THREAT, passive
            return (*after[:2], reach, intended if modal else bare), WORD, 1.0
        return (*after[:2], after[2], weight if after[2] else 0.0), x, 1.0

    return machine((0, 0, 0, 0.0), move, SYMBOLS)


def negation(reach: int = 4, kept: float = 0.2) -> Transducer:
    """Insults and threats up to ``reach`` tokens after a negation become negated (lower case)."""

    def move(left, x):
        if x == NEGATION:
            return reach, x, 1.0
        if left and x in (INSULT, THREAT):
            return left - 1, x.lower(), kept
        return max(0, left - 1), x, 1.0

    return machine(0, move, (*SYMBOLS, THREAT))


def reported(kept: float = 0.5) -> Transducer:
    """What follows a verb of saying in its clause is reported (a trailing r)."""

    def move(said, x):
        if said and x.upper() in (INSULT, THREAT):
            return said, x + "r", kept
        return said or x == REPORT, x, 1.0

    return machine(False, move, (*SYMBOLS, THREAT, "i", "t"))


MATCHES = tuple(x + r for x in (INSULT, THREAT, "i", "t") for r in ("", "r"))


def aimed(reach: int = 6, gain: float = 1.5) -> Transducer:
    """Matches up to ``reach`` tokens after a target are aimed (a trailing y); a target that soon after a match becomes AIM.
    A threat is aimed in itself."""

    def move(state, x):
        before, after = state
        if x in MATCHES:
            if before or x[0] in "Tt":
                return (max(0, before - 1), 0), x + "y", gain
            return (0, reach), x, 1.0
        if x == TARGET:
            return (reach, 0), AIM if after else x, gain if after else 1.0
        return (max(0, before - 1), max(0, after - 1)), x, 1.0

    return machine((0, 0), move, (*SYMBOLS, *MATCHES))


GRAMMAR = insult()
for _next in (threat(), negation(), reported(), aimed()):
    GRAMMAR = compose(GRAMMAR, _next, SYMBOLS)
#: By class of clause: the weights of those with a threat, a plain insult, only reported ones, only negated ones; of those
#: that are aimed; the number of clauses; the heaviest.
FEATURES = ("plain", "negated", "reported", "aimed", "threat", "clauses", "strongest")
DEFAULT = np.array([-2.0, 3.0, 0.3, 0.5, 0.8, 3.0, 0.0, 0.5])


class ToxicityModel:
    def __init__(self, insults: dict[str, float], weights: np.ndarray):
        self.insults, self.weights = insults, weights
        self._find = self._tags = None

    def __getstate__(self):
        return {"insults": self.insults, "weights": self.weights, "_find": None, "_tags": None}

    def _ready(self) -> None:
        tags = ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTED, REPORT), (MODALS, MODAL), (THREATS, VERB), (self.insults, INSULT))
        self._tags = {w: tag for words, tag in tags for w in words}
        self._find = ahocorasick.Automaton()
        for w in [*self.insults, *THREATS]:
            self._find.add_word(w, w)
        self._find.make_automaton()

    def _stretches(self, low: str) -> Iterator[tuple[int, int]]:
        """Where the clauses lie that hold an insult or a violent verb as a whole word."""
        ends, done = None, 0
        for last, w in self._find.iter(low):
            start, end = last - len(w) + 1, last + 1
            if end <= done or (start and low[start - 1].isalnum()) or (end < len(low) and low[end].isalnum()):
                continue
            if ends is None:
                ends = [m.start() for m in _END.finditer(low)]
            at = bisect.bisect_left(ends, start)
            done = ends[at] if at < len(ends) else len(low)
            yield (ends[at - 1] + 1 if at else 0), done

    def clauses(self, text: str) -> list[list[tuple[str, str, float]]]:
        """(output, word, weight) of the matches, by clause."""
        if self._find is None:
            self._ready()
        low = text.lower()
        out = []
        for begin, stop in self._stretches(low):
            state, got = GRAMMAR.start, []
            for m in _TOKEN.finditer(low, begin, stop):
                word = m[0]
                if not word[0].isalnum():
                    continue
                tag = self._tags.get(word, WORD)
                state, output, weight = GRAMMAR.step(state, tag)
                if output == AIM:
                    last = got[-1]
                    got[-1] = (last[0] + "y", last[1], last[2] * weight)
                elif output[0] in "IiTt":
                    got.append((output, word, weight * (self.insults.get(word, 1.0) if tag == INSULT else 1.0)))
            if got:
                out.append(got)
        return out

    def features(self, clauses: list[list[tuple[str, str, float]]]) -> list[float]:
        f = dict.fromkeys(FEATURES, 0.0)
        for clause in clauses:
            weight, outputs = sum(w for *_, w in clause), [x for x, *_ in clause]
            plain = [x for x in outputs if x[0].isupper() and "r" not in x]
            kind = "threat" if any(x[0] == THREAT for x in plain) else "plain" if plain else "reported" if any(x[0].isupper() for x in outputs) else "negated"
            f[kind] += weight
            f["aimed"] += weight * any(x.endswith("y") for x in outputs)
            f["clauses"] += 1
            f["strongest"] = max(f["strongest"], weight)
        return [float(np.log1p(f[k])) for k in FEATURES]

    def judge(self, text: str | None) -> tuple[float, list[list[tuple[str, str, float]]]]:
        clauses = self.clauses(text) if text else []
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(clauses)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), clauses

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method; the intercept isn't penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _vocabulary(text: str) -> set[str]:
    return {w for w in _TOKEN.findall(text.lower()) if len(w) >= 3 and w[0].isalpha()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 8000, max_words: int = 200) -> ToxicityModel:
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id"), 5, 0)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if not total:
        return ToxicityModel(dict.fromkeys(INSULTS, 1.0), DEFAULT)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1_000_003)) / 1_000_003.0
    few = known.where(draw < min(1.0, sample_rows / total))  # about sample_rows rows of 12 bytes
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(few), "id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic > 0].update(_vocabulary(text.as_py()))
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][w] for w in every], pa.int64()), pa.array([seen[0][w] for w in every], pa.int64())], ["word", "n1", "n0"])

    counts = rows.select("text", "toxic").mapInArrow(words, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("n1")).first()
    n1, n0 = int(sizes["n1"] or 0), int(sizes["n"] - (sizes["n1"] or 0))
    if not n1 or not n0:
        return ToxicityModel(dict.fromkeys(INSULTS, 1.0), DEFAULT)
    rate = (F.col("n1") + 0.1) / (n1 + 1) / ((F.col("n0") + 0.5) / (n0 + 1))
    candidates = [r["word"] for r in counts.where((F.col("n1") >= 2) & (rate >= 4)).orderBy(F.desc(F.col("n1") * F.log(rate)), "word").limit(20 * max_words).collect()]
    wanted = spark.sparkContext.broadcast(frozenset(candidates))

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vocabularies = [_vocabulary(t.as_py()) for t in batch.column(0)]
            found = [sorted(v & wanted.value) for v in vocabularies]
            least = [min(map(xxhash.xxh3_64_intdigest, v - wanted.value), default=0) >> 1 for v in vocabularies]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1), pa.array(least, pa.int64())], ["words", "toxic", "least"])

    table = rows.select("text", "toxic").mapInArrow(incidence, "words array<string>, toxic int, least long").select(F.explode_outer("words").alias("word"), (F.col("toxic") > 0).alias("toxic"), "least")
    distinct = table.groupBy("word", "toxic").agg(F.countDistinct("least").alias("n")).where("word IS NOT NULL").collect()
    kinds = {r["toxic"]: r["n"] for r in rows.select("text", "toxic").mapInArrow(incidence, "words array<string>, toxic int, least long").groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.countDistinct("least").alias("n")).collect()}
    insults = _choose({(r["word"], r["toxic"]): r["n"] for r in distinct}, kinds.get(True, 0), kinds.get(False, 0), max_words)
    model = ToxicityModel(insults or dict.fromkeys(INSULTS, 1.0), DEFAULT)
    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.features(shared.value.judge(t.as_py())[1]) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], ["f", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(measured, "f array<double>, toxic int").groupBy("f", "toxic").agg(F.count("*").alias("n")).orderBy("f", "toxic").collect()
    x = np.repeat(np.array([r["f"] for r in got]), [r["n"] for r in got], axis=0)
    y = np.repeat(np.array([float(r["toxic"] > 0) for r in got]), [r["n"] for r in got])
    return ToxicityModel(model.insults, fit_logistic(x, y))


def _choose(counts: dict[tuple[str, bool], int], n1: int, n0: int, max_words: int, least_share: float = 0.02) -> dict[str, float]:
    """Words in at least ``least_share`` of the toxic documents, eight times as often as in clean ones; weights are log ratios."""
    ratios = {}
    for word in {w for w, _ in counts}:
        k1, k0 = counts.get((word, True), 0), counts.get((word, False), 0)
        if k1 >= max(4, least_share * n1) and (ratio := (k1 + 0.1) / (n1 + 1) / ((k0 + 0.5) / (n0 + 1))) >= 8:
            ratios[word] = (k1 * np.log(ratio), float(np.clip(np.log(ratio) / 4, 0.25, 3)))
    return {w: r[1] for w, r in sorted(ratios.items(), key=lambda x: (-x[1][0], x[0]))[:max_words]}


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("matches", pa.string())])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, matches (``tag:word`` of the matched clauses, clauses parted by |). Map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, told = [], []
            for cell in batch.column(1):
                score, clauses = shared.value.judge(cell.as_py())
                scores.append(score)
                told.append("|".join(" ".join(f"{tag}:{w}" for tag, w, _ in c) for c in clauses))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(told, pa.string())], schema=_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, matches string")
