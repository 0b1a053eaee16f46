"""URL filters with dated lists: a temporal as-of join in DataFrame functions.

Entries come as dated events (add, remove) of a list and a pattern (a host, which covers its subdomains, or a host with
a first path segment). They become validity intervals [valid_from, valid_to). A capture asks for every suffix of its
host and for host + first path segment; it meets the intervals of a key that hold at its fetch time, found by an
equi-join on key and period, where an interval stands in each period it touches.

Some keys are asked for by a large share of all captures ("com"). Keys asked for by more than one in ``hot_share`` (and by
``hot_rows`` at least) are listed; there are fewer than ``hot_share`` of them, which bounds their broadcast. Those that no
list holds leave the join at once, the others are salted so that no part of a key has more than that share.

Edge cases: a null, empty or unparsable URL matches nothing and is allowed; a null fetch time matches nothing; an add
while active and a remove while inactive change nothing; of events at one instant the remove comes last; equal captures
(same id, URL and time) give one row; entries with a null list, pattern or time are dropped; empty lists allow
everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 90


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null where there is none."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.lower(F.regexp_replace(raw, r"\.$", ""))
    return F.when(host != "", host)


def url_keys(url: Column) -> Column:
    """Every suffix of the host, and host/segment."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    return F.when(host.isNotNull(), F.when(segment != "", F.concat(suffixes, F.array(F.concat(host, F.lit("/"), segment)))).otherwise(suffixes))


def validity_intervals(events: DataFrame) -> DataFrame:
    """list, pattern, at (date), action ('add' or 'remove') -> list, pattern, valid_from, valid_to (null: open)."""
    known = events.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL").select("list", F.lower("pattern").alias("pattern"), "at", (F.col("action") == "add").alias("adds"))
    # one event an instant: a remove beats an add
    known = known.groupBy("list", "pattern", "at").agg(F.min("adds").alias("adds"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    turns = known.withColumn("was", F.coalesce(F.lag("adds").over(order), F.lit(False))).where("adds <> was")
    return turns.withColumn("valid_to", F.lead("at").over(order)).where("adds").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", period_days: int = PERIOD_DAYS, hot_share: int = 1_000, hot_rows: int = 10_000) -> DataFrame:
    """capture_id, url, fetched, verdict (block or allow), n_entries, lists (comma-joined), listed_since: entries active at fetch time."""
    period = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / period_days)
    seen = captures.select(F.col(id_col).alias("capture_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    last = F.lit("2100-01-01").cast("date")  # open intervals are looked up under their own mark, not period by period
    valid = validity_intervals(events)
    closed = valid.where("valid_to IS NOT NULL").withColumn("period", F.explode(F.sequence(period("valid_from"), period("valid_to"))))
    open_ = valid.where("valid_to IS NULL").withColumns({"valid_to": last, "period": F.lit(-1).cast("long")})
    entries = closed.unionByName(open_).withColumnRenamed("pattern", "key")

    keyed = seen.where("fetched IS NOT NULL").withColumn("key", F.explode(url_keys(F.col("url"))))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    least = F.greatest(F.col("total") / hot_share, F.lit(float(hot_rows)))
    hot = counts.join(total).where(F.col("n") > least).select("key", F.ceil(F.col("n") / least).cast("int").alias("salts"))
    hot = hot.join(valid.select(F.col("pattern").alias("key")).distinct().withColumn("listed", F.lit(True)), "key", "left")
    asked = keyed.join(F.broadcast(hot), "key", "left").where("salts IS NULL OR listed")
    asked = asked.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("capture_id", "url", "fetched"), "salts")).cast("int"))
    asked = asked.withColumn("period", F.explode(F.array(period("fetched"), F.lit(-1).cast("long"))))
    entries = entries.join(F.broadcast(hot.select("key", "salts")), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))

    hit = asked.select("capture_id", "url", "fetched", "key", "period", "salt").join(entries.drop("salts"), ["key", "period", "salt"]).where("valid_from <= fetched AND fetched < valid_to")
    found = hit.groupBy("capture_id", "url", "fetched").agg(F.countDistinct("list", "key").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("listed_since"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("capture_id", "url", "fetched")]
    out = seen.distinct().alias("s").join(found.alias("f"), same[0] & same[1] & same[2], "left")
    return out.select("s.capture_id", "s.url", "s.fetched", F.when(F.col("n_entries") > 0, "block").otherwise("allow").alias("verdict"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), "listed_since")
