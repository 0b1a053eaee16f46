"""N-gram Jaccard join by filters under several global token orders.

A document's set holds its distinct ``k``-word shingles. Two sets of Jaccard similarity t or more share a token within
their prefixes of n - ceil(t n) + 1 tokens under every order of all tokens, and the prefixes share at least
ceil(t/(1+t) (n+m)) - max(n - p, m - q) tokens. The orders put frequent tokens last, by classes of frequency, and differ in
a hash. Every candidate, wherever it comes from, must pass under all of them before it is verified on the whole sets.

Groups of near copies never become all pairs: equal sets are one node; then, in a few rounds, every node is a candidate
with the centre of its token groups with which it shares most, and connected nodes take one label. Only pairs across
labels are then enumerated from the first order's prefixes, shortened by the places where a first shared token can stand.
The orders' whole prefixes are intersected pair by pair, and what passes all is verified, so no link is lost.

Which tokens are frequent is counted in two steps: in the hash-ordered prefixes of all documents, then in the whole sets
whose prefixes are frequent tokens to the share ``crowded`` or more, since only those have frequent tokens left in front
once the known ones are last. Each step lists the ``hot_bound`` most frequent at most, which bounds the broadcast, and any
list is right, as it only moves tokens in the order.

What a token's group shares (its size, least and greatest node, centre) is a window over the token, but for tokens that
were counted more than ``heavy`` times: those are pre-aggregated where their rows lie, and the one row a token is sent back.

Edge cases: null, empty or blank text has an empty set and is linked with nothing; fewer than k words are one shingle; a
null id takes part by its text, and a component's id is its smallest non-null id; rows sharing an id are judged by their
own texts and sets; ties and repeated rows are equal sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Prefix, Scratch, hash_words, mix64, narrow_batches, release_shuffles, tidy, to_signed


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(Prefix(hash_words(words)).grams(min(k, len(words))))


def set_key(tokens: np.ndarray) -> int | None:
    """A signed 64-bit name of the set; null for the empty one."""
    if not len(tokens):
        return None
    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >> 63 else h


NO_HOT = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def prefix_of(tokens: np.ndarray, order: int, hot: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The tokens before the prefix's end, in order number ``order``: by the class of their frequency, then by a hash.

    ``hot``: sorted frequent tokens and their classes, 1 to 63; other tokens are class 0.
    """
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    rank = mix64(tokens ^ np.uint64(0xA0761D6478BD642F * (order + 1) % (1 << 64))) >> np.uint64(6)
    known, classes = hot
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        rank |= np.where(known[at] == tokens, classes[at], np.uint64(0)) << np.uint64(58)
    return tokens[np.argsort(rank, kind="stable")[:size]]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _describe(k: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), k) for t in batch.column(1)]
            prefixes = [to_signed(prefix_of(s, 0, NO_HOT, percent)) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], schema=schema)

    return run


def _prefix_arrays(k: int, percent: int, hot):
    """The first order's prefix of every set."""
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), k)
                if len(s):
                    rows.append((doc, set_key(s), len(s), to_signed(prefix_of(s, 0, hot.value, percent))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _crowded(known: np.ndarray, share: float):
    """(doc_id, node) of the sets whose prefix is frequent tokens to ``share`` or more; ``known``: sorted, broadcast."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            tokens, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            sizes = np.diff(ends, prepend=0)
            at = np.minimum(np.searchsorted(known.value, tokens), len(known.value) - 1)
            hits = np.concatenate([[0], np.cumsum(known.value[at] == tokens)])
            frequent = hits[ends] - hits[ends - sizes]
            mask = pa.array((sizes > 0) & (frequent >= share * sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    return run


def _tokens(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(to_signed(shingles(text.as_py(), k)))], ["token"])

    return run


def _verify(k: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def tokens(node: int, text) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[node] = shingles(text.as_py(), k)
            return kept[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hits = [i for i, (x, y) in enumerate(zip(a, b)) if similar(tokens(x, batch.column(2)[i]), tokens(y, batch.column(3)[i]), percent)]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hits], pa.int64()), pa.array([b[i] for i in hits], pa.int64())], schema=schema)

    return run


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label): label is the smallest node of the component. Each round maps every node to its smallest neighbour and
    contracts the graph; only minima are taken over a node's links, so a hub is no unbounded group."""
    spark = links.sparkSession
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges-0")
    labels, turn = None, 0
    while edges.limit(1).count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to"))
        least = scratch.save(least, f"{name}-least-{turn}")
        if labels is None:
            labels = least.withColumnRenamed("to", "label")
        else:
            step = labels.join(least.withColumnRenamed("node", "label"), "label", "left")
            labels = step.select("node", F.coalesce("to", "label").alias("label"))
        labels = scratch.save(labels, f"{name}-labels-{turn}")
        edges = (
            edges.join(least.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b"))
            .where("a <> b")
            .distinct()
        )
        turn += 1
        edges = scratch.save(edges, f"{name}-edges-{turn}")
        scratch.drop(f"{name}-edges-{turn - 1}", f"{name}-labels-{turn - 2}", f"{name}-least-{turn - 2}")
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, orders: int = 3, rounds: int = 3, frequent: int = 24, crowded: float = 0.25, heavy: int = 10_000, hot_bound: int = 1_000_000, broadcast_bound: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_class (documents with the same set), node, label
    (names the component, also where it has no id; null for the empty set)."""
    with narrow_batches(docs.sparkSession):  # all jobs with Python run inside; the result is a plan over saved tables
        return _components_of(docs, id_col, text_col, k, percent, orders, rounds, frequent, crowded, heavy, hot_bound, broadcast_bound)


def _components_of(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, orders: int, rounds: int, frequent: int, crowded: float, heavy: int, hot_bound: int, broadcast_bound: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = scratch.save(source.mapInArrow(_describe(k, percent), "doc_id long, n long, node long, prefix array<long>"), "described")
    base = scratch.save(described.select("doc_id", "n", "node"), "base")

    def most_frequent(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
        top = counts.where(F.col("n") > frequent).orderBy(F.desc("n"), "token").limit(hot_bound).toArrow()
        return np.array(top.column(0).to_numpy(), np.int64).view(np.uint64), np.array(top.column(1).to_numpy(), np.int64)

    known, times = most_frequent(described.select(F.explode("prefix").alias("token")))
    if len(known):
        listed = spark.sparkContext.broadcast(np.sort(known))
        chosen = described.where("doc_id IS NOT NULL").select("doc_id", "node", "prefix").mapInArrow(_crowded(listed, crowded), "doc_id long, node long")
        chosen = scratch.save(chosen.groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "crowded")
        send = F.broadcast if chosen.count() <= broadcast_bound else (lambda df: df)
        whole = source.join(send(chosen), "doc_id", "left_semi").select("text").mapInArrow(_tokens(k), "token long")
        more, often = most_frequent(whole)
        both = np.concatenate([known, more])
        known, where = np.unique(both, return_inverse=True)
        counted, times = np.concatenate([times, often]), np.zeros(len(known), np.int64)
        np.maximum.at(times, where, counted)
    hot = spark.sparkContext.broadcast((known, np.clip(np.log2(np.maximum(times, 1)), 1, 63).astype(np.uint64)))
    heaviest = to_signed(known[times > heavy])  # hot_bound tokens of each step at most
    heaviest = spark.createDataFrame(pd.DataFrame({"token": heaviest}), "token long") if len(heaviest) else None
    scratch.drop("described")
    release_shuffles(spark)

    # one row a distinct set; its first order's prefix
    ddl = "id long, node long, n long, prefix array<long>"
    with_prefix = source.where("text IS NOT NULL").mapInArrow(_prefix_arrays(k, percent, hot), ddl)
    nodes = with_prefix.groupBy("node").agg(F.min_by("prefix", F.coalesce("id", F.lit((1 << 63) - 1))).alias("prefix"), F.min("id").alias("rep"), F.first("n").alias("n"))
    nodes = scratch.save(nodes, "nodes")
    release_shuffles(spark)

    some_heavy = heaviest is not None
    seen = nodes.select("node", "n", F.size("prefix").alias("p"), F.posexplode("prefix").alias("at", "token"))
    if some_heavy:
        light, crowd = (seen.join(F.broadcast(heaviest), "token", kind) for kind in ("left_anti", "left_semi"))
        seen = light.withColumn("heavy", F.lit(False)).unionByName(crowd.withColumn("heavy", F.lit(True)))
    else:
        seen = seen.withColumn("heavy", F.lit(False))
    seen = _beside(seen, {"low": F.min("node"), "high": F.max("node"), "df": F.count("*")}, some_heavy)
    postings = scratch.save(seen.where("low < high").drop("low", "high"), "shared")
    # nodes whose tokens are most shared lie in the middle of their group
    central = postings.groupBy("node").agg((F.sum("df") / F.first("p")).alias("central"))
    postings = scratch.save(postings.join(central, "node").select("token", "node", "n", "p", "at", "central", "heavy"), "postings")
    scratch.drop("shared")
    release_shuffles(spark)

    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    rest = F.greatest(*[F.ceil(F.lit(percent) * F.col(c) / 100) - 1 for c in ("n_a", "n_b")])
    least_shared = F.greatest(F.lit(1), need - rest)
    sizes_fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def texts_of(chosen: DataFrame, name: str) -> DataFrame:
        """(node, n, text, prefixes) of the chosen nodes, a prefix for each order; a short list of ids goes
        to the documents, else both meet in a shuffle."""
        live = scratch.save(chosen.distinct().join(nodes.select("node", "rep"), "node"), f"{name}-nodes")
        short = live.count() <= broadcast_bound
        send = F.broadcast if short else (lambda df: df)
        named = source.withColumnRenamed("doc_id", "rep").join(send(live.where("rep IS NOT NULL")), "rep").select("node", "text")
        unnamed = source.where("doc_id IS NULL AND text IS NOT NULL").mapInArrow(_with_node(k), "node long, text string").join(send(live.where("rep IS NULL").select("node")), "node").select("node", "text")
        return scratch.save(named.unionByName(unnamed).mapInArrow(_own_text(k, percent, orders, hot), "node long, n long, text string, prefixes array<array<long>>"), name)

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the filters of all orders and then the comparison of the whole sets."""
        side = lambda s: texts.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("text").alias(f"t{s}"), F.col("prefixes").alias(f"p{s}"))
        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        for i in range(orders):
            both = both.where(F.size(F.array_intersect(F.col("pa")[i], F.col("pb")[i])) >= least_shared)
        return both.select("a", "b", "ta", "tb").mapInArrow(_verify(k, percent), "a long, b long")

    labels = None
    for turn in range(rounds):
        marked = postings if labels is None else postings.join(labels, "node", "left")
        marked = marked.withColumn("label", F.col("node") if labels is None else F.coalesce("label", "node"))
        draw = F.xxhash64(F.lit(turn), "node").cast("double") if turn else -F.col("central")
        centre = F.min(F.struct(draw.alias("draw"), "node", "label", "n"))
        stars = _beside(marked, {"centre": centre}, some_heavy).where("centre.label <> label").groupBy(F.col("node").alias("b"), F.col("centre.node").alias("a"), F.col("n").alias("n_b"), F.col("centre.n").alias("n_a")).agg(F.count("*").alias("shared"))
        # a centre that shares little is left to the last step
        stars = stars.where(sizes_fit & (F.col("shared") >= F.greatest(least_shared / 2, F.lit(0.02) * F.col("n_b"))))
        stars = scratch.save(stars.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")), f"stars-{turn}")
        texts = texts_of(stars.select(F.explode(F.array("a", "b")).alias("node")), f"texts-{turn}")
        links = scratch.save(verify(stars, texts), f"links-{turn}")
        labels = _merge(scratch, labels, links, f"labels-{turn}")
        scratch.drop(f"texts-{turn}", f"stars-{turn}")
        release_shuffles(spark)

    pairs = scratch.save(_cross_pairs(postings, labels, percent, some_heavy), "cross")
    release_shuffles(spark)
    first = nodes.select("node", "n", "prefix")
    both = pairs.join(first.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("prefix").alias("pa")), "a").join(first.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("prefix").alias("pb")), "b")
    pairs = scratch.save(both.where(F.size(F.array_intersect("pa", "pb")) >= least_shared).select("a", "b", "n_a", "n_b"), "pairs-0")
    release_shuffles(spark)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), "texts-last")
    links = scratch.save(verify(pairs, texts), "links-last")
    labels = _merge(scratch, labels, links, "labels-last")
    scratch.drop("texts-last", "postings")
    release_shuffles(spark)

    # from sets back to documents
    told = nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = told.groupBy("label").agg(F.min("rep").alias("component_id"))
    told = told.join(smallest, "label").select("node", "label", "component_id")
    sizes = base.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n_class"))
    told = told.join(sizes, "node")
    out = base.join(told, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"), "node", "label")


BUCKET = 1 / 0.95


def _beside(rows: DataFrame, told: dict[str, Column], some_heavy: bool) -> DataFrame:
    """The rows with aggregates over their tokens beside them; rows marked ``heavy`` stay where they are."""
    over = Window.partitionBy("token")
    light = rows.where("NOT heavy").withColumns({name: column.over(over) for name, column in told.items()})
    if not some_heavy:
        return light
    crowd = rows.where("heavy")
    each = crowd.groupBy("token").agg(*[column.alias(name) for name, column in told.items()])
    return light.unionByName(crowd.join(F.broadcast(each), "token"))


def _cross_pairs(postings: DataFrame, labels: DataFrame, percent: int, some_heavy: bool) -> DataFrame:
    """(a, b): nodes of different labels that can have their first shared token in both prefixes.

    A pair of sizes n >= m shares c = need - rest tokens of its prefixes at least, so the first of them stands c - 1 places
    before either prefix's end. Sizes fall into buckets of ratio 0.95; c is taken at the bucket's edge, which only lowers
    it; pairs that meet are held to their own sizes. Near copies of one size meet on their rarest tokens alone, so those that differ in rare tokens never meet.
    """
    own = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = _beside(own, {"low": F.min("label"), "high": F.max("label"), "least": F.min("n"), "most": F.max("n")}, some_heavy).where("low < high")
    bucket = lambda n: F.floor(F.log(n) / float(np.log(BUCKET))).cast("int")
    edge = lambda b: F.exp(b * float(np.log(BUCKET)))

    def shared(n, m):
        """Of sizes n >= m."""
        return F.greatest(F.lit(1), F.ceil(F.lit(percent) * (n + m) / (100 + percent)) - (F.ceil(F.lit(percent) * n / 100) - 1))

    small = lambda b: F.greatest(F.ceil(F.lit(percent) * F.col("n") / 100), F.floor(edge(b)) - 1, F.lit(1))
    rows = mixed.select("token", "node", "label", "n", "p", "at", bucket(F.col("n")).alias("bucket"), bucket(F.col("least")).alias("lowest"), bucket(F.col("most")).alias("highest"))
    same = F.least(shared(F.col("n"), small(F.col("bucket"))), shared(F.ceil(edge(F.col("bucket") + 1)) + 1, F.col("n")))
    near = rows.where(F.col("at") <= F.col("p") - same).select("token", "bucket", "node", "label", "n", "p", "at")
    reach = int(np.log(100 / percent) / np.log(BUCKET)) + 1
    larger = rows.where("bucket > lowest").withColumn("to", F.explode(F.sequence(F.greatest(F.col("lowest"), F.col("bucket") - reach), F.col("bucket") - 1)))
    larger = larger.where(F.col("at") <= F.col("p") - shared(F.col("n"), small(F.col("to")))).select("token", F.col("to").alias("bucket"), "node", "label", "n", "p", "at")
    smaller = rows.where("bucket < highest").select("token", "bucket", "node", "label", "n", "p", "at")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        a, b = (df.select("token", "bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "n", "p", "at")]) for df, s in ((x, "a"), (y, "b")))
        fits = (F.col("label_a") != F.col("label_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        c = shared(F.greatest("n_a", "n_b"), F.least("n_a", "n_b"))
        fits &= (F.col("at_a") <= F.col("p_a") - c) & (F.col("at_b") <= F.col("p_b") - c)
        return a.join(b, ["token", "bucket"]).where(fits & (F.col("node_a") < F.col("node_b") if x is y else F.lit(True))).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    return met(near, near).unionByName(met(larger, smaller)).distinct()


def _with_node(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(shingles(t.as_py(), k)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(1)], ["node", "text"])

    return run


def _own_text(k: int, percent: int, orders: int, hot):
    """Of the texts under a representative's id, those that have the node's set (rows may share an id), with the set's size
    and its prefix under each order."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("text", pa.string()), ("prefixes", pa.list_(pa.list_(pa.int64())))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, sizes, prefixes = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = shingles(text.as_py(), k)
                mask.append(set_key(tokens) == node)
                if mask[-1]:
                    sizes.append(len(tokens))
                    prefixes.append([to_signed(prefix_of(tokens, order, hot.value, percent)) for order in range(orders)])
            own = batch.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sizes, pa.int64()), own.column(1).cast(pa.string()), pa.array(prefixes, pa.list_(pa.list_(pa.int64())))], schema=schema)

    return run


def _merge(scratch: Scratch, labels: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """The labels with the components that the links join."""
    if labels is None:
        return components(scratch, links, name)
    own = labels.select("node", "label")
    a, b = own.select(F.col("node").alias("a"), F.col("label").alias("la")), own.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(scratch, lifted, name)
    # nodes without a label yet are labelled by themselves
    every = own.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(own, "node", "left_anti").withColumn("label", F.col("node")))
    out = every.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.save(out, f"{name}-all")


def _keys(k: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(shingles(t, k)) for t in texts], dtype="Int64")

    return run


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component, of its smallest id; rows with an empty set stay.

    A row whose id is its own is judged by the id. Rows with a repeated or null id are judged by their own sets, and of
    those that have a component's smallest id (or of all, if it has none) the one with the smallest text stays.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.save(ngram_components(docs, id_col, text_col, **options).select("doc_id", "node", "label", "component_id"), "found")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__id"))
    gone = found.where("component_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("__id"))
    own = F.col(id_col).cast("long")
    single = docs.where(own.isNotNull()).join(gone.unionByName(repeated).distinct(), own == F.col("__id"), "left_anti")
    odd = docs.where(own.isNull()).unionByName(docs.join(repeated, own == F.col("__id"), "left_semi"))
    odd = odd.withColumn("__node", _keys(options.get("k", 5))(F.col(text_col)))
    told = found.where("node IS NOT NULL").groupBy(F.col("node").alias("__node")).agg(F.first("label").alias("__label"), F.first("component_id").alias("__component"))
    first = odd.where("__node IS NOT NULL").join(told, "__node").where(own.eqNullSafe(F.col("__component")))
    first = first.groupBy("__label").agg(F.min_by(F.struct(*docs.columns), text_col).alias("__row")).select("__row.*")
    return single.unionByName(odd.where("__node IS NULL").select(*docs.columns)).unionByName(first)
