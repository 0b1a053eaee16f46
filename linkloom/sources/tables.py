"""Raw lists, truth files and output lists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Tab-separated with a header; quotes and words such as NA are text; blank fields are empty strings."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path)
    return df.select([F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def read_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame | None]:
    """(records with source and split columns, truth or None where the split has none)."""
    parts = [read_tsv(spark, f"{folder}/{split}/{split}_source{k}.tsv").withColumn("src", F.lit(f"S{k}")) for k in (1, 2, 3)]
    records = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("split", F.lit(split))
    truth = read_tsv(spark, f"{folder}/{split}/{split}_ground_truth.tsv", TRUTH) if split == "train" else None
    return records, truth


def filtered_by_ids(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def truth_pairs(truth: DataFrame, s1: DataFrame) -> DataFrame:
    """(s1_id, o_id) of the truth lists for the S1 that are present."""
    pairs = truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("o_id"))
    return pairs.withColumn("o_id", F.trim("o_id")).where("o_id <> ''").distinct().join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")


def truth_sizes(truth: DataFrame, s1: DataFrame) -> DataFrame:
    return s1.select(F.col("entity_id").alias("s1_id")).join(truth_pairs(truth, s1).groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").na.fill(0, ["n_true"])


def write_parquet(df: DataFrame, path: str) -> None:
    """zstd; the committer makes the files visible when the job ends."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def id_lists(s1: DataFrame, pairs: DataFrame, out: str) -> DataFrame:
    """One row for every S1: its record ids in order, comma-joined, empty where it has none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("o_id")), ",").alias(out))
    return s1.select("s1_id").distinct().join(lists, "s1_id", "left").na.fill("", [out])


def write_tsv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Tab-separated, a header in every file, no quoting or escaping. A field that holds a tab or a line end can't be told
    from two fields or rows, so it stops the job. ``files``: into that many files."""
    fields = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns}
    bad = lambda v: F.raise_error(F.concat(F.lit("a field holds a tab, a line end or a null character: "), F.substring(v, 1, 80)))
    rows = df.select([F.when(v.rlike("[\\t\\r\\n\\x00]"), bad(v).cast("string")).otherwise(v).alias(c) for c, v in fields.items()])
    rows = rows.coalesce(files) if files else rows
    quiet = {"sep": "\t", "header": True, "quote": "\0", "escape": "\0", "emptyValue": "", "nullValue": "", "escapeQuotes": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(**quiet).csv(path)


def check_lists(lists: DataFrame, s1: DataFrame, others: DataFrame, col: str, candidates: DataFrame | None = None) -> DataFrame:
    """problem, n: duplicate or missing S1, unknown ids, ids twice in a list, matches outside the candidates. Empty if fine."""
    ids = lists.select("s1_id", F.explode(F.filter(F.split(col, ","), lambda x: x != "")).alias("o_id"))
    found = [
        lists.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate S1").alias("problem")),
        s1.join(lists, "s1_id", "left_anti").select(F.lit("missing S1").alias("problem")),
        lists.join(s1, "s1_id", "left_anti").select(F.lit("unknown S1").alias("problem")),
        ids.join(others.select(F.col("o_id")), "o_id", "left_anti").select(F.lit("unknown record").alias("problem")),
        ids.groupBy("s1_id", "o_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("record twice").alias("problem")),
    ]
    if candidates is not None:
        found.append(ids.join(candidates.select("s1_id", "o_id"), ["s1_id", "o_id"], "left_anti").select(F.lit("match outside candidates").alias("problem")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("problem").agg(F.count("*").alias("n"))


def drawn(seed: str, key: str) -> Column:
    """A number below 2^32 that seed and key fix, the same in any engine: the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def keep_fraction(df: DataFrame, key: str, drop: float, seed: str = "drop:") -> DataFrame:
    """Drops about the share ``drop`` of the ids, by a hash, the same on every run."""
    return df.where(drawn(seed, key) % 100_000 >= drop * 100_000)


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder (spark.checkpoint.dir) and read from there. A local session without one
    gets a temporary folder; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()):
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """As ``materialised``, but compressed Parquet, for tables as large as the input; the folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
        folder = context.getCheckpointDir()
    at = f"{folder.rstrip('/')}/saved-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    write_parquet(df, at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``saved`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if at.rsplit("/", 1)[-1].startswith("saved-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def structural_sample(s1: DataFrame, others: DataFrame, pairs: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """A share of the S1 with all their matches, and the same share of the records without one. Ids: s1_id, o_id."""
    some = keep_fraction(s1, "s1_id", 1 - share, "sample:")
    mine = others.join(pairs.join(some, "s1_id", "left_semi"), "o_id", "left_semi")
    free = keep_fraction(others.join(pairs, "o_id", "left_anti"), "o_id", 1 - share, "sample:")
    return some, mine.unionByName(free)


def without_ids(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """The rows whose id isn't among ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first in ``order``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


#: The files of each split.
EXPECTED = {split: [f"{split}_source{k}.tsv" for k in (1, 2, 3)] + (["train_ground_truth.tsv"] if split == "train" else []) for split in ("train", "test")}


def check_data(spark: SparkSession, folder: str) -> list[tuple[str, bool, int]]:
    """(file, present, rows) of the files that the splits need."""
    out = []
    for split, names in EXPECTED.items():
        for name in names:
            path = f"{folder}/{split}/{name}"
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
            out.append((f"{split}/{name}", there, count_lines(spark, path) if there else 0))
    return out


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines without the header."""
    return max(0, spark.read.text(path).count() - 1)
