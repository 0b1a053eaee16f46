"""Records' tokens as numbers, without shuffling a row for every token of a record.

A chunk is some records that one task reads: their tokens become numbers of the chunk, and the chunk's distinct tokens, with
how many of its records have them, are what is counted, cut to a window and joined with. The numbered records, packed, then
meet the final numbers of their chunk once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from linkloom.operators.sparse import release
from linkloom.sources.tables import discard, saved

#: Tokens of a chunk, about, and of one packed row or batch that goes out.
CHUNK, OUT = 2_000_000, 500_000


def _ranges(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Rows in order, cut where their sizes sum up to ``most``; a row is never cut."""
    part = (np.cumsum(sizes) - sizes) // most
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)), len(sizes)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:]))


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _packed(ids: pa.Array, ckey: pa.Array, sizes: np.ndarray, codes: np.ndarray) -> bytes:
    """Rows with their codes in order, as differences, compressed."""
    steps = np.diff(codes, prepend=0)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[begin] = codes[begin]
    batch = pa.RecordBatch.from_arrays([ids, ckey, pa.ListArray.from_arrays(_offsets(sizes), pa.array(steps.astype(np.int32)))], ["id", "ckey", "codes"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    batch = pa.ipc.open_stream(rows).read_next_batch()
    sizes = _sizes(batch.column("codes"))
    total = np.concatenate([[0], np.cumsum(batch.column("codes").flatten().to_numpy(), dtype=np.int64)])
    return batch.column("id"), batch.column("ckey"), sizes, total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


def coded(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Saved rows of two kinds, from id, ckey, toks (without nulls): chunk, ckey, tok, times, code, df of each chunk's distinct
    tokens by how often a record has them; and chunk, packed: some of its records with their codes, where tok is null."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ckey", kinds["ckey"]), T.StructField("tok", T.StringType()), T.StructField("times", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("df", T.IntegerType()), T.StructField("packed", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def told(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ckey, lists = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("id", "ckey", "toks"))
        sizes, name = _sizes(lists), uuid.uuid4().int >> 65
        words, blocks = lists.flatten().dictionary_encode(), ckey.dictionary_encode()
        n, row = max(1, len(words.dictionary)), np.repeat(np.arange(len(sizes)), sizes)
        row_word, times = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, word, most = row_word // n, row_word % n, int(times.max(initial=0)) + 1
        sizes = np.bincount(row, minlength=len(sizes))
        codes, known = pd.factorize((blocks.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * n + word) * most + times)
        df = np.bincount(codes, minlength=len(known))
        order = np.argsort(-df, kind="stable")  # frequent tokens get small codes, which pack well
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(len(known))
        known, df = known[order], df[order]
        codes = np.sort(row * max(1, len(known)) + place[codes]) - row * max(1, len(known))
        for i in range(0, len(known), OUT):
            at, often = known[i : i + OUT] // most, known[i : i + OUT] % most
            yield batch_of(len(at), chunk=pa.array(np.full(len(at), name)), ckey=blocks.dictionary.take(pa.array(at // n)), tok=words.dictionary.take(pa.array(at % n)), times=pa.array(often), code=pa.array(np.arange(i, i + len(at))), df=pa.array(df[i : i + OUT]))
        start = np.concatenate([[0], np.cumsum(sizes)])
        for s in _ranges(sizes, OUT):
            yield batch_of(1, chunk=pa.array([name]), packed=pa.array([_packed(ids[s], ckey[s], sizes[s], codes[start[s.start] : start[s.stop]])], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            sizes = _sizes(batch.column("toks"))
            for s in _ranges(sizes, chunk):
                parts.append(batch.slice(s.start, s.stop - s.start))
                waiting += int(sizes[s].sum())
                if waiting >= chunk:
                    yield from told(parts)
                    parts, waiting = [], 0
        if parts:
            yield from told(parts)

    return saved(records.select("id", "ckey", "toks").mapInArrow(run, schema))


def renumbered(rows: DataFrame, numbers: DataFrame, id_type: T.DataType, w_type: T.DataType = T.IntegerType()) -> DataFrame:
    """id, ckey, t, w, saved: the records of ``coded`` with the numbers t and w of (chunk, code, t, w) in place of their codes; codes
    without a number are left out, and so are records without any."""
    schema = T.StructType([T.StructField("id", id_type), rows.schema["ckey"], T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(w_type))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, told, place, t, w = None, [], None, None, None
        for batch in batches:
            for i, now in enumerate(batch.column("chunk").to_pylist()):
                if now != name:
                    name, told, place = now, [], None
                packed = batch.column("packed")[i]
                if not packed.is_valid:
                    told.append([batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("code", "t", "w")])
                    continue
                if place is None and told:
                    code, t, w = (np.concatenate(c) for c in zip(*told))
                    place = np.full(int(code.max()) + 2, -1)  # the last one stands for all codes beyond
                    place[code] = np.arange(len(code))
                if place is None:
                    continue
                ids, ckey, sizes, codes = _unpacked(packed.as_py())
                found = place[np.minimum(codes, len(place) - 1)]
                kept = found >= 0
                own = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
                columns = [ids, ckey, *(pa.ListArray.from_arrays(_offsets(own), pa.array(x[found[kept]])) for x in (t, w))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).filter(pa.array(own > 0))

    some = numbers.groupBy("chunk", F.shiftright("code", 15).alias("part")).agg(F.collect_list(F.struct("code", "t", "w")).alias("x"))  # 32,768 at most
    some = saved(some.select("chunk", F.col("x.code").alias("code"), F.col("x.t").alias("t"), F.col("x.w").alias("w")))
    release(rows.sparkSession)
    some = some.select("chunk", F.lit(0).alias("side"), F.lit(None).cast("binary").alias("packed"), "code", "t", "w")
    none = lambda kind: F.array().cast(T.ArrayType(kind))
    whole = rows.where("packed IS NOT NULL").select("chunk", F.lit(1).alias("side"), "packed", none(T.IntegerType()).alias("code"), none(T.IntegerType()).alias("t"), none(w_type).alias("w"))
    out = saved(some.unionByName(whole).repartition("chunk").sortWithinPartitions("chunk", "side").mapInArrow(run, schema))
    discard(some)
    return out
