"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key; inside its source the documents are dealt into key ranges, ordered inside a
range, and get the distributed prefix sum of their word counts (sums of whole ranges plus the sum inside the range).
Each source is cut at its exact word budget; budgets over the source's size repeat it in whole epochs first.

Edge cases: null or empty text has size 0 and is never taken; a null source is a source of its own, last in order;
an empty table gives an empty result; repeated rows are separate rows; rows with the same id are ordered by size (equal
ones are interchangeable, so the result is the same set of rows either way); rows without an id share one key and are
ordered by size; other columns are ignored, also those named like the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]++"
KEY_BITS = 60
RANGES_IN_STRETCH = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: int, id_col: Column) -> Column:
    """60 bits of md5, so that any engine can recompute them."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """source, source_size, n_docs -> + target, budget. One row a source.

    A target is weight x level, at most max_epochs x source size. What the limit cuts off is reshared by weight; the fixed
    point is one common level, which follows from prefix sums over the sources in the order of limit / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    out = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(table, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("before", F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("before")) / (F.col("all_weights") - F.col("weights_before")))
        .withColumn("target", F.least("limit", F.col("weight") * F.max("level").over(everything)))
    )
    return out.withColumn("budget", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_epochs).cast("long")).select("source", "source_size", "n_docs", "target", "budget")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, max_epochs: int, seed: int, rows_per_range: int) -> DataFrame:
    """A row a document: named, unnamed (its source), doc_id, key, size, source_size, target, epochs (whole passes), rest
    (words of one pass more) and before (words of the source's documents in front of it)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(seed, F.col(id_col)).alias("key"))
    rows = scratch.save(rows, "rows")  # ids and numbers only: the texts are read once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sizes, weights, share, max_epochs)
    targets = targets.withColumns({"named": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull(), "ranges": F.ceil(F.col("n_docs") / rows_per_range)}).drop("source", "n_docs")
    rows = rows.withColumns({"named": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()})
    source, part = ["named", "unnamed"], ["named", "unnamed", "range"]
    dealt = rows.join(targets, source).withColumn("range", F.floor(F.col("key") / float(1 << KEY_BITS) * F.col("ranges")).cast("long"))
    dealt = dealt.repartition(*part)  # the join's partitioning by source would also serve the steps below, with a hot source in one task
    # sums of ranges, in two steps, so that a hot source's ranges are no single group either
    offsets = dealt.groupBy(part).agg(F.sum("size").alias("range_size")).withColumn("stretch", F.floor(F.col("range") / RANGES_IN_STRETCH))
    upto = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stretches = offsets.groupBy(*source, "stretch").agg(F.sum("range_size").alias("stretch_size"))
    stretches = stretches.select(*source, "stretch", F.coalesce(F.sum("stretch_size").over(upto(source, "stretch")), F.lit(0)).alias("ahead"))
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("range_size").over(upto([*source, "stretch"], "range")), F.lit(0))).join(stretches, [*source, "stretch"])
    offsets = offsets.select(*part, (F.col("offset") + F.col("ahead")).alias("offset"))
    inside = Window.partitionBy(part).orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("upto", F.sum("size").over(inside)).join(offsets, part)
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    return summed.withColumns({"before": F.col("offset") + F.col("upto") - F.col("size"), "epochs": epochs, "rest": F.col("budget") - epochs * F.col("source_size")})


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.0, max_epochs: int = 3, seed: int = 0, rows_per_range: int = 2_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mix takes from each document."""
    plan = _planned(docs, id_col, text_col, source_col, weights, share, max_epochs, seed, rows_per_range)
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return plan.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.0, max_epochs: int = 3, seed: int = 0, rows_per_range: int = 2_000) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: repeated once an epoch, the document at the cut with its first words only.

    A source's order is (key, id, size), so one row a source tells every document its part: those in front of the cut come
    once more than the whole epochs, the one at the cut in part. Texts are read where they lie and never shuffled. Rows
    equal to the cut in key, id and size take turns by their texts. Documents that the mix leaves out are dropped; ``n_chars``
    follows the text, other columns stay.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    plan = scratch.save(_planned(docs, id_col, text_col, source_col, weights, share, max_epochs, seed, rows_per_range).select("named", "unnamed", "doc_id", "key", "size", "before", "epochs", "rest"), "plan")
    place = lambda key, i, size: F.struct(key.alias("key"), i.isNull().alias("gone"), i.alias("id"), size.alias("size"))
    row = place(F.col("key"), F.col("doc_id"), F.col("size"))
    cuts = plan.where("size > 0 AND before < rest AND rest <= before + size").select("named", "unnamed", row.alias("__cut"))
    sources = plan.groupBy("named", "unnamed").agg(F.first("epochs").alias("__epochs"), F.first("rest").alias("__rest"))
    sources = sources.join(cuts, ["named", "unnamed"], "left")
    tied = plan.withColumn("__row", row).join(sources, ["named", "unnamed"]).where(F.col("__row") == F.col("__cut"))
    tied = tied.groupBy("named", "unnamed").agg(F.min("before").alias("__first"), F.count("*").alias("__ties"))
    sources = sources.join(tied, ["named", "unnamed"], "left").withColumn("__left", F.col("__rest") - F.col("__first")).withColumnsRenamed({"named": "__named", "unnamed": "__unnamed"})
    sources = scratch.save(sources.select("__named", "__unnamed", "__epochs", "__cut", "__ties", "__left"), "sources")
    told = sources.agg(F.count("*").alias("n"), F.max("__ties").alias("ties")).first()

    # the row goes along as one struct, so that no name of its columns can clash
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.coalesce(source_col, F.lit("")).alias("__named"), F.col(source_col).isNull().alias("__unnamed"), word_count(F.col(text_col)).alias("__size"), random_key(seed, F.col(id_col)).alias("__key"))
    each = each.join(F.broadcast(sources) if told["n"] <= 1_000_000 else sources, ["__named", "__unnamed"])
    its_id, its_text = F.col("__row")[id_col], F.col("__row")[text_col]
    mine = place(F.col("__key"), its_id, F.col("__size"))
    front, at_cut = F.coalesce(mine < F.col("__cut"), F.lit(False)), F.coalesce(mine == F.col("__cut"), F.lit(False))
    part = lambda turn: F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__left") - turn * F.col("__size")))
    extra = F.when(front, F.col("__size")).when(at_cut, part(F.lit(0))).otherwise(F.lit(0))
    if (told["ties"] or 0) > 1:
        # some source has equal rows at its cut; only those are put in order
        whole = each.where(~(at_cut & (F.col("__ties") > 1))).withColumn("__extra", extra)
        turns = F.row_number().over(Window.partitionBy("__named", "__unnamed").orderBy(F.xxhash64(its_text), its_text)) - 1
        equal = each.where(at_cut & (F.col("__ties") > 1)).withColumn("__turn", turns).withColumn("__extra", part(F.col("__turn"))).drop("__turn")
        each = whole.unionByName(equal)
    else:
        each = each.withColumn("__extra", extra)
    copies = F.when(F.col("__size") > 0, F.col("__epochs") + (F.col("__extra") > 0).cast("long")).otherwise(0)
    out = each.withColumn("__copies", copies.cast("int")).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    cut_off = (F.col("__copy") > F.col("__epochs")) & (F.col("__extra") < F.col("__size"))
    words = F.regexp_extract_all(its_text, F.lit(WORD), F.lit(0))
    text = F.when(cut_off, F.array_join(F.slice(words, 1, F.col("__extra").cast("int")), " ")).otherwise(its_text)
    fixed = {text_col: text}
    if "n_chars" in docs.columns:
        fixed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[fixed.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])
