"""Products of sparse vectors inside blocks, tile by tile: all of them, or each record's best.

Both sides are dealt to tiles, and every tile of the held side meets every tile of the asked side once. A task keeps one
held tile as an inverted index, reads the asked rows in order of their ids, and adds up one row's products at a time, so
partial products of pairs are never shuffled and a pair's product is whole where it is made.

Rows are id, ckey, t (term numbers, array<int> or array<long>) and w: array<double>, the weights; or array<int>, the terms'
document frequencies, with n, the records of the block, from which IDF weights of length one are made in the task.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.windows import top_k
from linkloom.sources.tables import discard, saved

#: Pairs of a tile that wait for the next cut to the best, and that go out in one batch.
WAITING, OUT_ROWS = 500_000, 65_536
#: Term numbers below this are looked up in a table.
PLACES = 1 << 23
#: Copies of a row, on average, that a round of tiles sends at most.
COPIES = 2.0


class _Rows:
    """Rows of a batch: ids, where each row's terms start, terms and weights; rows without weight have no terms."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("id")
        lists = batch.column("t")
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.t = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        w = batch.column("w").flatten().to_numpy(zero_copy_only=False)
        if w.dtype.kind == "i":
            row = np.repeat(np.arange(len(size)), size)
            w = np.log(batch.column("n").to_numpy(zero_copy_only=False)[row] / w)
            norm = np.sqrt(np.bincount(row, w * w, minlength=len(size)))
            has = norm[row] > 0
            w, self.t, size = w[has] / norm[row[has]], self.t[has], np.where(norm > 0, size, 0)
        self.w = np.maximum(w, 1e-150)  # a shared term of weight 0 makes a pair, too
        self.start = np.concatenate([[0], np.cumsum(size)])


class _Held:
    """One tile as an inverted index, in order of its ids."""

    def __init__(self, parts: list[_Rows]):
        self.ids = pa.concat_arrays([p.ids for p in parts])
        sizes = np.concatenate([np.diff(p.start) for p in parts])
        t, w = np.concatenate([p.t for p in parts]), np.concatenate([p.w for p in parts])
        order = np.argsort(t, kind="stable")
        self.n, self.at, self.w = len(sizes), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], w[order]
        self.terms, first = np.unique(t[order], return_index=True)
        self.first = np.append(first, len(t))
        self.place = None  # of small term numbers, the place of each
        if len(self.terms) and self.terms[0] >= 0 and self.terms[-1] < PLACES:
            self.place = np.full(int(self.terms[-1]) + 1, -1, np.int32)
            self.place[self.terms] = np.arange(len(self.terms))

    def places(self, t: np.ndarray) -> np.ndarray:
        """The place of each term, -1 where the tile has none."""
        if self.place is not None:
            out = self.place[np.minimum(t, len(self.place) - 1)]
            out[t >= len(self.place)] = -1
            return out
        out = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
        return np.where(self.terms[out] == t, out, -1) if len(self.terms) else np.full(len(t), -1)

    def products(self, where: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One row's products with every held one; ``where``: the places of its terms."""
        known = where >= 0
        where, w = where[known], w[known]
        size = self.first[where + 1] - self.first[where]
        total = int(size.sum())
        if not total:
            return np.zeros(self.n)
        index = np.repeat(self.first[where] - (np.cumsum(size) - size), size) + np.arange(total)
        return np.bincount(self.at[index], np.repeat(w, size) * self.w[index], minlength=self.n)


class _Best:
    """The k best asked rows of every held one; asked rows come in order, so of equal products the earlier stays."""

    def __init__(self, n: int, k: int, least: float, digits: int | None):
        self.k, self.least, self.digits, self.slack = k, least, digits, 0.4 * 10.0**-digits if digits is not None else 0.0
        self.bar, self.rows, self.waiting = np.zeros(n), [], 0

    def add(self, scores: np.ndarray, row: int) -> None:
        at = np.flatnonzero(scores > self.bar)
        if len(at):
            self.rows.append((at, _rounded(scores[at], self.digits), np.full(len(at), row)))
            self.waiting += len(at)
            if self.waiting > WAITING:
                self.cut()
                self.waiting = 0

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        at, score, row = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((row, -score, at))
        order = order[score[order] >= self.least]
        at, score, row = at[order], score[order], row[order]
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        kept = place < self.k
        at, score, row, place = at[kept], score[kept], row[kept], place[kept]
        last = place == self.k - 1
        self.bar[at[last]] = score[last] + self.slack
        self.rows = [(at, score, row)]
        return at, score, row


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    return np.round(x, digits) if digits is not None else x


def _best_of(scores: np.ndarray, k: int, least: float, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best, of equal ones the first; the k-th largest of the maxima of 64 bounds them below."""
    floor = 0.0
    if len(scores) > 64 * k:
        top = scores[: len(scores) // 64 * 64].reshape(-1, 64).max(1)
        floor = np.partition(top, -k)[-k] - (10.0**-digits if digits is not None else 0.0)
    at = np.flatnonzero(scores >= floor if floor > 0 else scores > 0)
    score = _rounded(scores[at], digits)
    order = np.argsort(-score, kind="stable")[:k]
    order = order[score[order] >= least]
    return at[order], score[order]


def _tiles(k_held: int | None, k_asked: int | None, least: float, digits: int | None, schema: pa.Schema):
    """k_held, k_asked: best of a row of that side; both None: all products. The way goes out if the schema has it."""

    def out(held: pa.Array, asked: pa.Array, score: np.ndarray, way: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(score), OUT_ROWS):
            part = slice(i, i + OUT_ROWS)
            n = len(score[part])
            columns = [held[part].cast(schema.field(0).type), asked[part].cast(schema.field(1).type), pa.array(score[part]), pa.array(np.full(n, way, np.int32))]
            yield pa.RecordBatch.from_arrays(columns[: len(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, held, best, told = None, [], None, None, []

        def end() -> Iterator[pa.RecordBatch]:
            if best is not None and told:
                at, score, row = best.cut()
                yield from out(held.ids.take(pa.array(at)), pa.concat_arrays(told).take(pa.array(row)), score, 0)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("ckey", "i", "j", "side"))))
            begin = 0
            while begin < len(keys):
                stop = begin + 1
                while stop < len(keys) and keys[stop] == keys[begin]:
                    stop += 1
                rows, key, side = _Rows(batch.slice(begin, stop - begin)), keys[begin][:3], keys[begin][3]
                begin = stop
                if key != tile:
                    yield from end()
                    tile, parts, held, best, told = key, [], None, None, []
                if side == 0:
                    parts.append(rows)
                    continue
                if held is None and parts:
                    held, parts = _Held(parts), []
                    best = _Best(held.n, k_held, least, digits) if k_held else None
                if held is None:
                    continue
                past, where = sum(map(len, told)), held.places(rows.t)
                told += [rows.ids] if best is not None else []
                at_all, score_all, row_all, waiting = [], [], [], 0
                for r in range(len(rows.ids)):
                    own = slice(rows.start[r], rows.start[r + 1])
                    scores = held.products(where[own], rows.w[own])
                    if best is not None:
                        best.add(scores, past + r)
                    if k_asked:
                        at, score = _best_of(scores, k_asked, least, digits)
                    elif not k_held:
                        at = np.flatnonzero(scores)
                        score = _rounded(scores[at], digits)
                    else:
                        continue
                    at_all.append(at)
                    score_all.append(score)
                    row_all.append(np.full(len(at), r))
                    waiting += len(at)
                    if waiting >= OUT_ROWS:
                        yield from out(held.ids.take(pa.array(np.concatenate(at_all))), rows.ids.take(pa.array(np.concatenate(row_all))), np.concatenate(score_all), 1)
                        at_all, score_all, row_all, waiting = [], [], [], 0
                if waiting:
                    yield from out(held.ids.take(pa.array(np.concatenate(at_all))), rows.ids.take(pa.array(np.concatenate(row_all))), np.concatenate(score_all), 1)
        yield from end()

    return run


def small(df: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """A table to join with, saved; sent to every task if it has ``bound`` rows at most, so that a large block is no large task."""
    df = saved(df)
    return F.broadcast(df) if df.count() <= bound else df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffles of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def products(held: DataFrame, asked: DataFrame, held_id: str, asked_id: str, k_held: int | None = None, k_asked: int | None = None, least: float = 0.0, digits: int | None = None, rows_per_tile: int = 32_768, copies: float = COPIES, save: bool = False) -> DataFrame:
    """held_id, asked_id, score, way: the ``k_held`` best asked rows of each held row inside a tile (way 0) and the
    ``k_asked`` best held rows of each asked one (way 1), for a top-k over all tiles; without both, all products, each once (way 1).

    A row is sent once for every tile of the other side. Where that makes more than ``copies`` of a row on average, tiles meet
    in rounds: each sends about so many copies at most, and the best so far are cut and saved before the next. All products
    take one round: saved between rounds they would lie on disk a second time beside the caller's own output, which is far
    larger than the copies of rows. ``save``: the result is written once, however many rounds there are, so that the caller
    can discard what it was made from."""
    spark = held.sparkSession
    count = lambda d, name: d.groupBy("ckey").agg(F.ceil(F.count("*") / rows_per_tile).cast("int").alias(f"t{name}"), F.count("*").alias(f"n{name}"))
    sizes = small(count(held, "i").join(count(asked, "j"), "ckey"))
    release(spark)
    rounds, best_only = 1, bool(k_held or k_asked)
    if best_only:
        sent = sizes.agg(F.sum(F.col("ni") * F.col("tj") + F.col("nj") * F.col("ti")).alias("all"), F.sum(F.col("ni") + F.col("nj")).alias("rows"), F.max(F.greatest("ti", "tj")).alias("most")).first()
        rounds = max(1, min(sent["most"] or 1, math.ceil((sent["all"] or 0) / (copies * (sent["rows"] or 1)))))
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n, own, r: F.explode(F.filter(F.sequence(F.lit(0), F.col(n) - 1), lambda x: (x + F.col(own)) % rounds == r))
    columns = ["ckey", "i", "j", "side", *[c for c in held.columns if c != "ckey"]]
    kinds = dict(held.dtypes)["id"], dict(asked.dtypes)["id"]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(held_id, arrow[kinds[0]]), (asked_id, arrow[kinds[1]]), ("score", pa.float64()), *[("way", pa.int32())] * best_only])

    def met(r: int) -> DataFrame:
        a = held.join(sizes, "ckey").withColumn("side", F.lit(0)).withColumn("i", deal(F.col("ti"))).withColumn("j", every("tj", "i", r)).select(columns)
        b = asked.join(sizes, "ckey").withColumn("side", F.lit(1)).withColumn("j", deal(F.col("tj"))).withColumn("i", every("ti", "j", r)).select(columns)
        rows = a.unionByName(b).repartition("ckey", "i", "j").sortWithinPartitions("ckey", "i", "j", "side", "id")
        out = rows.mapInArrow(_tiles(k_held, k_asked, least, digits, schema), f"{held_id} {kinds[0]}, {asked_id} {kinds[1]}, score double" + ", way int" * best_only)
        return out if best_only else out.withColumn("way", F.lit(1))

    def best(found: DataFrame) -> DataFrame:
        ways = [(0, held_id, asked_id, k_held), (1, asked_id, held_id, k_asked)]
        parts = [top_k(found.where(F.col("way") == w), [own], "score", [other], k).drop("rank") for w, own, other, k in ways if k]
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]

    if rounds == 1 and not save:
        return met(0)
    found = None
    for r in range(rounds):
        new = saved(met(r))
        release(spark)
        if found is None:
            found = new
        else:
            both = saved(best(found.unionByName(new)))
            discard(found)
            discard(new)
            release(spark)
            found = both
    discard(sizes)
    return found


def pair_products(pairs: DataFrame, vectors: DataFrame, blocks: DataFrame, out: str, rows_per_tile: int = 32_768) -> DataFrame:
    """s1_id, o_id, ``out``: the products of given pairs, saved. vectors: id, t (term numbers), w; blocks: s1_id, ckey. A task
    holds one tile of a block's S1; a record is sent to the tiles where it has a pair, once each, with its S1 there."""
    sizes = small(blocks.groupBy("ckey").agg(F.ceil(F.count("*") / rows_per_tile).cast("int").alias("n")))
    place = blocks.join(sizes, "ckey").select("s1_id", F.xxhash64("ckey", F.pmod(F.xxhash64("s1_id"), "n")).alias("tile"))
    wanted = pairs.select("s1_id", "o_id").join(place, "s1_id").groupBy("tile", "o_id").agg(F.collect_list("s1_id").alias("with"))  # a record's S1
    none = F.array().cast(pairs.select(F.array("s1_id").alias("x")).schema["x"].dataType)
    held = vectors.withColumnRenamed("id", "s1_id").join(place, "s1_id").select("tile", F.lit(0).alias("side"), F.col("s1_id").alias("id"), "t", "w", none.alias("with"))
    asked = vectors.withColumnRenamed("id", "o_id").join(wanted, "o_id").select("tile", F.lit(1).alias("side"), F.col("o_id").alias("id"), "t", "w", "with")
    rows = held.unionByName(asked).repartition("tile").sortWithinPartitions("tile", "side")
    kind = dict(pairs.dtypes)["s1_id"], dict(pairs.dtypes)["o_id"]
    arrow = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[k] for k in kind]
    schema = pa.schema([("s1_id", arrow[0]), ("o_id", arrow[1]), (out, pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, held, weight = None, [], {}, np.zeros(1)
        for batch in batches:
            tiles, sides = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(tiles) != 0) | (np.diff(sides) != 0)) + 1), len(tiles)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if tiles[begin] != tile:
                    tile, parts, held = tiles[begin], [], None
                part = batch.slice(begin, end - begin)
                rows = _Rows(part)
                if sides[begin] == 0:
                    parts.append(rows)
                    continue
                if held is None:
                    names = [x for p in parts for x in p.ids.to_pylist()]
                    held = dict(zip(names, range(len(names))))
                    t, w = (np.concatenate([getattr(p, c) for p in parts] or [np.empty(0, np.int64)]) for c in ("t", "w"))
                    start = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.start) for p in parts] or [np.empty(0, np.int64)]))])
                    parts = []
                most = max(rows.t.max(initial=0), t.max(initial=0)) + 1
                weight = weight if len(weight) >= most else np.zeros(int(most))
                a, b, score = [], [], []
                for r, (name, asked) in enumerate(zip(rows.ids.to_pylist(), part.column("with").to_pylist())):
                    known = [(x, held[x]) for x in asked if x in held]
                    if not known:
                        continue
                    own = slice(rows.start[r], rows.start[r + 1])
                    weight[rows.t[own]] = rows.w[own]
                    for x, at in known:
                        it = slice(start[at], start[at + 1])
                        a.append(x)
                        b.append(name)
                        score.append(float(weight[t[it]] @ w[it]))
                    weight[rows.t[own]] = 0.0
                yield pa.RecordBatch.from_arrays([pa.array(a, arrow[0]), pa.array(b, arrow[1]), pa.array(score, pa.float64())], schema=schema)

    return saved(rows.mapInArrow(run, f"s1_id {kind[0]}, o_id {kind[1]}, {out} double"))
