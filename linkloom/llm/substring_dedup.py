"""Substring deduplication with suffix automata of reference shards.

A window is ``window`` consecutive words. A word is removed when a window over it also starts in a document with a
smaller id, judged on the input. Streaming every document past every shard grows with the square of the corpus, so the
documents are routed: each window has one anchor, the least hash of its ``anchor``-word grams, and equal windows have
equal anchors. Per run of windows with one anchor occurrence a document has a passage. The distinct passages of the
anchors that several documents share are dealt to shards of bounded size, each keeps its first holder, and a shard's
suffix automaton over whole words, states carrying the smallest id, gives matching statistics for each passage; maximal
spans of the window length that a smaller id holds come back as masks. Other holders of a passage repeat it whole.

An anchor with more than ``hot`` distinct passages would be one long shard. Its windows are routed by their own
hash instead: a shard of one window, where the matching statistic is equality.

Edge cases: null or empty text has no words and stays as it is; rows with a null id are kept whole and are never a
reference; rows that share an id don't remove from each other; documents shorter than a window stay; very long texts are
handled whole, in memory proportional to the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Prefix, Scratch, hash_words, release_shuffles, to_signed, words_of


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each window of ``width`` values."""
    value, at, span = values, np.arange(len(values)), 1
    while span < width:
        d = min(span, width - span)
        take = value[d:] < value[:-d]
        value, at = np.where(take, value[d:], value[:-d]), np.where(take, at[d:], at[:-d])
        span += d
    return at


class Passages:
    """The passages of a text: for each, anchor hash, passage hash, and its windows [first, last]."""

    def __init__(self, words: list[bytes], window: int, anchor: int):
        self.words = words
        n = len(words) - window + 1
        if n <= 0:
            self.anchor = self.passage = np.empty(0, np.uint64)
            self.first = self.last = np.empty(0, np.int64)
            return
        self.prefix = Prefix(hash_words(words))
        grams = self.prefix.grams(anchor)
        at = sliding_argmin(grams, window - anchor + 1)
        cuts = np.flatnonzero(np.diff(at)) + 1
        self.first = np.concatenate(([0], cuts))
        self.last = np.concatenate((cuts - 1, [n - 1]))
        self.anchor = grams[at[self.first]]
        self.passage = self.prefix.ranges(self.first, self.last + window)


class Automaton:
    """A generalised suffix automaton over words. Strings come in order of their ids, so a state's first id is its smallest."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]

    def add(self, words: list[bytes], holder: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            if (q := nxt[last].get(w)) is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, q, w)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(holder)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = new

    def _split(self, p: int, q: int, w: bytes) -> int:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        first.append(first[q])
        link.append(link[q])
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def repeats(self, words: list[bytes], window: int, holder: int) -> list[bool]:
        """For each window of the words: whether it stands in a string of a smaller id (matching statistics cut at the window)."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, state, matched = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if (q := nxt[state].get(w)) is not None:
                state, matched = q, matched + 1
            while length[link[state]] >= window if state else False:
                state = link[state]
                matched = length[state]
            matched = min(matched, window)
            if i >= window - 1:
                out.append(matched == window and first[state] < holder)
        return out


#: A window that many documents hold is dealt to so many keys.
SALTS = 32

_FOUND = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("passage", pa.int64())])


def _emit_passages(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, anchors, passages = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = Passages(words_of(text.as_py()), window, anchor)
                if len(got.anchor):
                    pairs = np.unique(np.stack([got.anchor, got.passage]), axis=1) if len(got.anchor) > 1 else np.stack([got.anchor, got.passage])
                    ids.append(np.full(pairs.shape[1], doc, np.int64))
                    anchors.append(to_signed(pairs[0]))
                    passages.append(to_signed(pairs[1]))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, anchors, passages)], schema=_FOUND)

    return run


def _emit_windows(window: int, anchor: int, hot=None):
    """Rows (doc_id, text, anchors) -> (doc_id, window hash) of the windows under hot anchors: those of ``hot``, else the row's own."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                got = Passages(words_of(text.as_py()), window, anchor)
                known = hot.value if hot is not None else batch.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                under = np.isin(got.anchor, known)
                if under.any():
                    grams = got.prefix.grams(window)
                    mine = np.unique(np.concatenate([grams[a : b + 1] for a, b in zip(got.first[under], got.last[under])]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), doc, np.int64)), pa.array(to_signed(mine))], schema=schema)

    return run


def _cut_passages(window: int, anchor: int):
    """Rows (doc_id, text, wanted) -> (anchor, passage, holder, words) for the wanted passages of the text."""
    schema = pa.schema([("anchor", pa.int64()), ("passage", pa.int64()), ("holder", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                want = set(wanted.values.to_numpy(zero_copy_only=False).view(np.uint64).tolist())
                got = Passages(words_of(text.as_py()), window, anchor)
                for a, p, f, last in zip(to_signed(got.anchor).tolist(), got.passage.tolist(), got.first.tolist(), got.last.tolist()):
                    if p in want:
                        want.discard(p)
                        rows.append((a, p - (1 << 64) if p >> 63 else p, doc, b" ".join(got.words[f : last + window])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _match_shards(window: int, shard_words: int):
    """Rows in order of (anchor, holder): shards of whole anchors, closed at ``shard_words`` words."""
    schema = pa.schema([("anchor", pa.int64()), ("passage", pa.int64()), ("holder", pa.int64()), ("mask", pa.binary())])

    def judged(shard: list[tuple]) -> pa.RecordBatch:
        machine, rows, seen = Automaton(), [], set()
        for a, p, holder, words in sorted(shard, key=lambda r: r[2]):
            if (a, p) in seen:
                continue
            seen.add((a, p))
            words = words.split(b" ")
            hits = machine.repeats(words, window, holder)
            machine.add(words, holder)
            rows.append((a, p, holder, np.packbits(hits).tobytes() if any(hits) else None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != last and size >= shard_words:
                    yield judged(shard)
                    shard, size = [], 0
                last = row[0]
                shard.append(row)
                size += row[3].count(b" ") + 1
        if shard:
            yield judged(shard)

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _remove(window: int, anchor: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, hits, hashes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                words = words_of(text.as_py())
                gone = None
                if hits.is_valid or hashes.is_valid:
                    got = Passages(words, window, anchor)
                    marked = np.zeros(len(words) + 1, np.int64)  # +1 where removed windows begin, -1 after they end
                    masks = {r["passage"]: r["mask"] for r in hits.as_py()} if hits.is_valid else {}
                    for p, f, last in zip(to_signed(got.passage).tolist(), got.first.tolist(), got.last.tolist()):
                        if p in masks:
                            m = masks[p]
                            starts = np.arange(f, last + 1) if m is None else f + np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), count=last + 1 - f))
                            np.add.at(marked, starts, 1)
                            np.add.at(marked, starts + window, -1)
                    if hashes.is_valid and len(got.anchor):
                        starts = np.flatnonzero(np.isin(to_signed(got.prefix.grams(window)), hashes.values.to_numpy(zero_copy_only=False)))
                        np.add.at(marked, starts, 1)
                        np.add.at(marked, starts + window, -1)
                    gone = np.cumsum(marked[:-1]) > 0
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if with_text else None))
            columns = list(zip(*rows)) if rows else [[] for _ in _KEPT]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEPT)], schema=_KEPT)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, anchor: int = 20, hot: int = 1000, shard_words: int = 40_000, hot_bound: int = 500_000, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by blanks; null unless ``with_text``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = source.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = scratch.save(named.mapInArrow(_emit_passages(window, anchor), "doc_id long, anchor long, passage long"), "found")

    # anchors that several documents have; the distinct passages of each with their first holders
    passages = found.groupBy("anchor", "passage").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last_holder"))
    anchors = passages.groupBy("anchor").agg(F.min("holder").alias("first"), F.max("last_holder").alias("last"), F.count("*").alias("contexts")).where("first < last")
    anchors = scratch.save(anchors.select("anchor", "contexts"), "anchors")
    shared = scratch.save(found.join(anchors, "anchor").select("doc_id", "anchor", "passage", (F.col("contexts") > hot).alias("hot")), "shared")
    scratch.drop("found")
    release_shuffles(spark)
    firsts = shared.where("NOT hot").groupBy("anchor", "passage").agg(F.min("doc_id").alias("holder"))

    # each first holder hands its passages to the shards
    wanted = firsts.groupBy("holder").agg(F.collect_list("passage").alias("wanted")).withColumnRenamed("holder", "doc_id")
    cut = named.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_cut_passages(window, anchor), "anchor long, passage long, holder long, words binary")
    dealt = cut.repartition("anchor").sortWithinPartitions("anchor", "holder")
    masks = scratch.save(dealt.mapInArrow(_match_shards(window, shard_words), "anchor long, passage long, holder long, mask binary"), "masks")
    release_shuffles(spark)
    told = shared.where("NOT hot").join(masks, ["anchor", "passage"]).where("doc_id > holder OR mask IS NOT NULL")
    told = told.groupBy("doc_id").agg(F.collect_list(F.struct("passage", F.when(F.col("doc_id") == F.col("holder"), F.col("mask")).alias("mask"))).alias("hits"))

    # windows of hot anchors, none on most corpora; the anchors reach the texts by broadcast up to the bound, by documents beyond
    crowded = anchors.where(F.col("contexts") > hot).select("anchor")
    n_hot = crowded.count()
    if n_hot:
        if n_hot <= hot_bound:
            values = np.array([r[0] for r in crowded.collect()], np.int64).view(np.uint64)
            windows = named.mapInArrow(_emit_windows(window, anchor, spark.sparkContext.broadcast(values)), "doc_id long, hash long")
        else:
            holders = shared.where("hot").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
            windows = named.join(holders, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_emit_windows(window, anchor), "doc_id long, hash long")
        windows = scratch.save(windows, "windows")
        windows = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        parts = windows.groupBy("hash", "salt").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))
        first = parts.groupBy("hash").agg(F.min("holder").alias("holder"), F.max("last").alias("last"), F.collect_list("salt").alias("salts")).where("holder < last")
        first = first.select("hash", "holder", F.explode("salts").alias("salt"))
        repeated = windows.join(first, ["hash", "salt"]).where("doc_id > holder").groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))
        told = told.join(repeated, "doc_id", "full")
    else:
        told = told.withColumn("hashes", F.lit(None).cast("array<long>"))
    joined = source.join(told, "doc_id", "left").select("doc_id", "text", "hits", "hashes")
    return joined.mapInArrow(_remove(window, anchor, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
