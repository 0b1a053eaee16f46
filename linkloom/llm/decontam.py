"""Benchmark decontamination by the q-gram lemma.

Texts are normalised (letters and digits in lower case, other runs one blank). A region within e edits of an item of n
characters shares at least T = n - q + 1 - q e of the item's q-grams inside a diagonal band; bands of width 2(e+1) that
overlap by half hold every spread of e. Bands that reach T are verified by banded alignment, and regions within the edit
budget e = floor(error n) (less where T would fall under 1) are matches, with positions in the original text.

An item of fewer than q characters has no q-gram; its own length takes the place of q and no edit is left to it, so it
matches where it stands as whole words.

The items are held by every task, so they come in blocks of about ``block_chars`` characters (a longer item is a block of
its own). One block is one scan without a shuffle. Of several, a bitmap of all their q-grams, of bounded size, first sifts
the documents in one scan, and only those with enough q-grams meet the blocks, one after another.

Edge cases: null or empty text has no match; null items and items without a letter or digit aren't searched; equal items
all match, also those without an id; repeated rows give repeated matches; very long texts are handled in overlapping
pieces; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, mix64

PIECE = 1 << 20


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(0x110000, bool)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            word[c] = True
            if len(t := s.lower()) == 1:
                low[c] = ord(t)
    return word, low


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place of each in the original."""
    word, low = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = word[points]
    keep = is_word.copy()
    keep[1:] |= ~is_word[1:] & is_word[:-1]  # the first of a run of others stands for it
    at = np.flatnonzero(keep)
    return np.where(is_word[at], low[points[at]], 32).astype(np.uint32), at


def qgram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = points.astype(np.uint64)
    out, done, spans, power = None, 0, {1: c}, {1: 0x9E3779B97F4A7C15}
    size = 1
    while size * 2 <= q:
        h = spans[size]
        spans[2 * size] = h[:-size] * np.uint64(power[size]) + h[size:]
        power[2 * size] = power[size] * power[size] % (1 << 64)
        size *= 2
    for size in sorted(spans, reverse=True):
        while done + size <= q:
            part = spans[size][done : done + n]
            out = part.copy() if out is None else out * np.uint64(power[size]) + part
            done += size
    return mix64(out)


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits of the whole pattern against a stretch of text, diagonals low..high (text place less pattern place), and
    the place where it ends. Text before and after is free; ``anchored``: text before counts."""
    far = 1 << 20
    offsets = np.arange(low, high + 1)
    row = np.where((offsets >= 0) & (offsets <= len(text)), offsets if anchored else 0, far)
    steps = np.arange(len(offsets))
    for i in range(1, len(pattern) + 1):
        place = offsets + i  # text characters used
        ok = (place >= 1) & (place <= len(text))
        same = np.ones(len(offsets), np.int64)
        same[ok] = text[place[ok] - 1] != pattern[i - 1]
        new = np.where(ok, row + same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((place >= 0) & (place <= len(text)), new, far)
        row = np.minimum.accumulate(new - steps) + steps
        row = np.where((place >= 0) & (place <= len(text)), row, far)
    best = int(np.argmin(row))
    return int(row[best]), int(offsets[best] + len(pattern))


def item_points(text: str) -> np.ndarray:
    points, _ = normalise(text)
    return points[:-1] if len(points) and points[-1] == 32 else points


class ItemIndex:
    def __init__(self, items: list[tuple[int | None, str]], q: int, error: float):
        self.q, self.ids, self.points, self.budget, self.need = q, [], [], [], []
        self.short: dict[int, dict[int, list[int | None]]] = {}  # length -> hash of the whole item -> ids
        hashes, owner, place = [], [], []
        for item, text in items:
            points = item_points(text)
            if len(points) < q:
                if len(points):
                    own = int(qgram_hashes(points, len(points))[0])
                    self.short.setdefault(len(points), {}).setdefault(own, []).append(item)
                continue
            grams = qgram_hashes(points, q)
            e = min(int(error * len(points)), (len(grams) - 1) // q)
            self.ids.append(item)
            self.points.append(points)
            self.budget.append(e)
            self.need.append(len(grams) - q * e)
            hashes.append(grams)
            owner.append(np.full(len(grams), len(self.ids) - 1))
            place.append(np.arange(len(grams)))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, np.int64)
        self.step = np.array(self.budget, np.int64) + 1
        bits = max(16, min(24, int(np.log2(max(1, len(self.hashes)))) + 6))
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.hashes & self.mask).astype(np.int64)] = True
        self.reach = max((len(p) + 2 * e + 2 for p, e in zip(self.points, self.budget)), default=0)

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, end, edits): for each item the matches that don't overlap a better one of the same item.

        ``first_only``: one match of an item of q characters or more, or none; items shorter than that prove nothing.
        """
        if not text:
            return []
        points, at = normalise(text)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for begin in range(0, max(1, len(points)), PIECE) if len(self.hashes) else ():
            piece = points[begin : begin + PIECE + 2 * self.reach]
            for k, s, e, d in self._piece(piece, first_only):
                if first_only:
                    return [(self.ids[k], 0, 0, d)]
                found.setdefault(k, []).append((d, begin + s, begin + e))
        out = [] if first_only else [(item, int(at[s]), int(at[e - 1]) + 1, 0) for s, e, item in self._short(points)]
        for k, spans in found.items():
            kept: list[tuple[int, int, int]] = []
            for d, s, e in sorted(set(spans)):
                if all(e <= s2 or s >= e2 for _, s2, e2 in kept):
                    kept.append((d, s, e))
            out += [(self.ids[k], int(at[s]), int(at[e - 1]) + 1, d) for d, s, e in kept]
        return sorted(out, key=lambda m: (m[1], m[2], m[0] is None, m[0] or 0, m[3]))

    def _short(self, points: np.ndarray) -> Iterator[tuple[int, int, int | None]]:
        """(start, end, item) of the short items that stand as whole words."""
        blank = np.concatenate(([True], points == 32, [True]))
        for n, owners in self.short.items():
            grams = qgram_hashes(points, n)
            known = np.fromiter(owners, np.uint64, len(owners))
            for s in np.flatnonzero(np.isin(grams, known) & blank[: len(grams)] & blank[n + 1 : n + 1 + len(grams)]).tolist():
                for item in owners[int(grams[s])]:
                    yield s, s + n, item

    def _piece(self, points: np.ndarray, first_only: bool) -> Iterator[tuple[int, int, int, int]]:
        grams = qgram_hashes(points, self.q)
        spots = np.flatnonzero(self.seen[(grams & self.mask).astype(np.int64)])
        if not len(spots):
            return
        left = np.searchsorted(self.hashes, grams[spots], "left")
        n = np.searchsorted(self.hashes, grams[spots], "right") - left
        if not n.any():
            return
        spot = np.repeat(spots, n)
        entry = np.repeat(left - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        owner, place = self.owner[entry], self.place[entry]
        enough = np.bincount(owner, minlength=len(self.ids)) >= np.array(self.need)
        some = enough[owner]
        if not some.any():
            return
        owner, place, diagonal = owner[some], place[some], spot[some] - place[some]
        band = diagonal // self.step[owner]
        owner, place, band = np.concatenate([owner, owner]), np.concatenate([place, place]), np.concatenate([band, band - 1])
        order = np.lexsort((place, band, owner))
        owner, place, band = owner[order], place[order], band[order]
        new_band = np.concatenate(([True], (owner[1:] != owner[:-1]) | (band[1:] != band[:-1])))
        new_gram = new_band | np.concatenate(([True], place[1:] != place[:-1]))
        starts = np.flatnonzero(new_band)
        distinct = np.add.reduceat(new_gram.astype(np.int64), starts)
        for s in starts[distinct >= np.array(self.need)[owner[starts]]]:
            k = int(owner[s])
            e, pattern, low = self.budget[k], self.points[k], int(band[s]) * int(self.step[k])
            from_, to = max(0, low - e), min(len(points), low + 2 * (e + 1) + len(pattern) + e)
            stretch = points[from_:to]
            d, end = banded_distance(pattern, stretch, low - e - from_, low + 2 * (e + 1) + e - from_)
            if d <= e:
                cut = stretch[max(0, end - len(pattern) - e) : end][::-1]
                _, length = banded_distance(pattern[::-1], cut, -e, e, anchored=True)
                yield k, from_ + end - length, from_ + end, d
                if first_only:
                    return


class ItemBlocks:
    """The benchmark in blocks of about ``block_chars`` characters; one block at a time passes through the driver."""

    def __init__(self, benchmark: DataFrame, q: int, error: float, block_chars: int, id_col: str = "item_id", text_col: str = "text"):
        self.q, self.error = q, error
        self.rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        chars = self.rows.agg(F.sum(F.length("text"))).first()[0] or 0
        self.count = -(-chars // block_chars)

    def block(self, b: int) -> ItemIndex:
        mine = self.rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(self.count)) == b).orderBy("id", "text")
        return ItemIndex([(r["id"], r["text"]) for r in mine.collect()], self.q, self.error)

    def sieve(self) -> "Sieve":
        out = Sieve(self.q)
        for b in range(self.count):
            out.add(self.block(b))
        return out


class Sieve:
    """A bitmap of the q-grams of all items, 16 MB at any size, and the least number that a match shares."""

    BITS = 27

    def __init__(self, q: int):
        self.q, self.need, self.lengths = q, None, set()
        self.bits = np.zeros(1 << self.BITS - 3, np.uint8)

    def _at(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = grams & np.uint64((1 << self.BITS) - 1)
        return (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8)

    def add(self, index: ItemIndex) -> None:
        byte, bit = self._at(index.hashes)
        np.bitwise_or.at(self.bits, byte, bit)
        self.need = min([x for x in (self.need, *index.need) if x is not None], default=None)
        self.lengths |= set(index.short)

    def keeps(self, text: str | None, short: bool = True) -> bool:
        """No text with a match is dropped: it holds ``need`` q-grams of the item. Short items (unless not ``short``) keep all."""
        if not text:
            return False
        if self.lengths and short:
            return True
        points, _ = normalise(text)
        hits = 0
        for begin in range(0, max(1, len(points)), PIECE) if self.need else ():
            byte, bit = self._at(qgram_hashes(points[begin : begin + PIECE + self.q - 1], self.q))
            hits += int(np.count_nonzero(self.bits[byte] & bit))
            if hits >= self.need:
                return True
        return False


def _judged(judge, text: str):
    """The column judge(text)."""

    @F.pandas_udf("boolean")
    def run(texts):
        import pandas as pd

        return pd.Series([bool(judge(t)) for t in texts], dtype=bool)

    return run(F.col(text))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = 10, error: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, start, end (code points, end exclusive), edits: one row a match."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    ddl = "doc_id long, item_id long, start long, end long, edits int"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, *m) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in shared.value.matches(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return run

    blocks = ItemBlocks(benchmark, q, error, block_chars)
    if not blocks.count:
        return spark.createDataFrame([], ddl)
    if blocks.count == 1:
        return source.mapInArrow(search(spark.sparkContext.broadcast(blocks.block(0))), ddl)
    scratch = Scratch(spark, "leaks")
    sieve = spark.sparkContext.broadcast(blocks.sieve())
    sifted = scratch.save(source.where(_judged(lambda t: sieve.value.keeps(t), "text")), "sifted")
    out = spark.createDataFrame([], ddl)
    for b in range(blocks.count):
        shared = spark.sparkContext.broadcast(blocks.block(b))
        out = out.unionByName(scratch.save(sifted.mapInArrow(search(shared), ddl), f"found-{b}"))
        shared.destroy()
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = 10, error: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` without a match of an item of q characters or more (a shorter one, as a single word, doesn't
    tell a benchmark passage from other text); rows with null text stay."""
    spark = docs.sparkSession
    blocks = ItemBlocks(benchmark, q, error, block_chars)
    if not blocks.count:
        return docs
    if blocks.count == 1:
        index = spark.sparkContext.broadcast(blocks.block(0))
        return docs.where(~_judged(lambda t: index.value.matches(t, first_only=True), text_col))
    # rows that the sieve rules out stay as they are; the others go past one block after another
    scratch = Scratch(spark, "leaks")
    sieve = spark.sparkContext.broadcast(blocks.sieve())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = scratch.save(docs.select(row.alias("row"), _judged(lambda t: sieve.value.keeps(t, False), text_col).alias("suspect")), "marked")
    left = marked.where("suspect")
    for b in range(blocks.count):
        shared = spark.sparkContext.broadcast(blocks.block(b))
        left = scratch.save(left.where(~_judged(lambda t, shared=shared: shared.value.matches(t, first_only=True), f"row.{text_col}")), f"left-{b}")
        shared.destroy()
    return marked.where("NOT suspect").unionByName(left).select("row.*")
