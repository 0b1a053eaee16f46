"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.substring_dedup import substring_dedup

    return substring_dedup(read_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.matroska import media_columns

    return media_columns(read_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the compacted store gives them back, each with whether its shard is one of the newest manifest's.
    Shard names, tiers and versions depend on compressed sizes, so tests hold them against a simulation instead."""
    from linkloom.llm.common import Scratch
    from linkloom.llm.sharding import shard_documents

    store = shard_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "shards").root)
    m = store.manifest()
    runs = {f"r{r['run']:04d}": r["tier"] for r in m["runs"] if r["files"]}  # a few a tier
    tier = F.try_element_at(F.create_map([x for k, t in runs.items() for x in (F.lit(k), F.lit(t))]), F.substring_index("shard", "-", 1)) if runs else F.lit(None)
    return store.read().select("doc_id", "source", "lang", "n_chars", F.sha2(F.col("text"), 256).alias("text_sha256"), F.coalesce((tier == F.col("tier")) & (F.col("version") == m["version"]), F.lit(False)).alias("listed"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.decontam import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.ngram_join import ngram_components

    return ngram_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.langid import held_out
    from linkloom.llm.toxicity import fit_toxicity, score_toxicity

    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: the fetch day is drawn from the page's id, as the table has none."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(1000)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2022-01-01").cast("date"), day).alias("fetched"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List events drawn from hashes of the hosts: three lists, adds, removes and second adds."""
    from linkloom.llm.url_filters import url_host

    hosts = pages.select(url_host(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()
    lists = hosts.withColumn("list", F.explode(F.array(*[F.lit(x) for x in ("adult", "malware", "spam")])))
    number = lambda at: F.conv(F.substring("h", at, 4), 16, 10).cast("int")
    drawn = lists.withColumn("h", F.md5(F.concat_ws("|", "list", "pattern").cast("binary"))).where(F.col("h") < "8")
    start = F.date_add(F.lit("2022-01-01").cast("date"), number(2) % 700)
    first = drawn.select("list", "pattern", start.alias("at"), F.lit("add").alias("action"), "h")
    gone = first.where(F.substring("h", 6, 1) < "c").select("list", "pattern", F.date_add("at", 30 + number(7) % 200).alias("at"), F.lit("remove").alias("action"), "h")
    again = gone.where(F.substring("h", 11, 1) < "8").select("list", "pattern", F.date_add("at", 10 + number(12) % 100).alias("at"), F.lit("add").alias("action"), "h")
    return first.unionByName(gone).unionByName(again).select("list", "pattern", "at", "action")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.url_filters import filter_captures

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    found = filter_captures(dated_captures(pages), dated_entries(pages))
    return found.select(F.col("capture_id").alias("page_id"), "url", F.col("fetched").cast("string").alias("fetched"), "verdict", "n_entries", "lists", F.col("listed_since").cast("string").alias("listed_since"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.langid import fit_language_model, held_out, identify_languages

    docs = read_table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_language_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "mixture")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.pii import detect_pii

    return detect_pii(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_mixing": op2_mixing,
        "op3_media_columns": op3_media_columns,
        "op4_sharding": op4_sharding,
        "op5_decontamination": op5_decontamination,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_toxicity": op7_toxicity,
        "op8_url_filters": op8_url_filters,
        "op9_language_id": op9_language_id,
        "op10_pii": op10_pii,
    }


OP1_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
windows AS (
  SELECT r, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE len(words) >= 50)),
firsts AS (SELECT h, min(doc_id) AS holder FROM windows GROUP BY h),
hits AS (SELECT DISTINCT w.r, w.i + unnest(range(0, 50)) AS pos FROM windows w JOIN firsts f ON w.h = f.h WHERE w.doc_id > f.holder),
each AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs),
kept AS (SELECT r, list(word ORDER BY pos) AS k FROM each e ANTI JOIN hits h USING (r, pos) GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(len(k), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (r)
"""

OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sizes),
weighted AS (
  SELECT *, CAST([5.0, 2.0, 1.0][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS lim,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(lim) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted WINDOW w AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(lim, weight * max(level) OVER ()) AS target FROM levels),
budgets AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS budget FROM targets),
summed AS (
  SELECT r.doc_id, r.size, r.source, b.source_size, b.target, b.budget,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id ASC NULLS LAST, r.size ROWS UNBOUNDED PRECEDING) - r.size AS before
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, source,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM summed
"""


OP4_SQL = "SELECT doc_id, source, lang, n_chars, sha256(text) AS text_sha256, true AS listed FROM documents"


OP6_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, label) AS (
  SELECT a, a FROM edges
  UNION
  SELECT e.b, r.label FROM reach r JOIN edges e ON r.doc_id = e.a WHERE r.label < e.b),
lowest AS (SELECT doc_id, min(label) AS label FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(label, d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""


OP8_SQL = r"""
WITH captures AS (
  SELECT DISTINCT page_id, url, DATE '2022-01-01' + CAST((page_id * 7919) % 1000 AS INTEGER) AS fetched,
         nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '[.]$', '')), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment
  FROM pages),
drawn AS (
  SELECT * FROM (SELECT list, host AS pattern, md5(list || '|' || host) AS h FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL), (VALUES ('adult'), ('malware'), ('spam')) l(list))
  WHERE h < '8'),
first AS (SELECT list, pattern, h, DATE '2022-01-01' + CAST(CAST('0x' || substr(h, 2, 4) AS INTEGER) % 700 AS INTEGER) AS day FROM drawn),
gone AS (SELECT list, pattern, h, day + CAST(30 + CAST('0x' || substr(h, 7, 4) AS INTEGER) % 200 AS INTEGER) AS day FROM first WHERE substr(h, 6, 1) < 'c'),
again AS (SELECT list, pattern, h, day + CAST(10 + CAST('0x' || substr(h, 12, 4) AS INTEGER) % 100 AS INTEGER) AS day FROM gone WHERE substr(h, 11, 1) < '8'),
valid AS (
  SELECT f.list, f.pattern, f.day AS valid_from, g.day AS valid_to FROM first f LEFT JOIN gone g USING (list, pattern)
  UNION ALL SELECT list, pattern, day, NULL FROM again),
keys AS (
  SELECT page_id, url, fetched, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) || CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END) AS key
  FROM captures WHERE host IS NOT NULL),
found AS (
  SELECT page_id, url, fetched, count(DISTINCT (list, pattern)) AS n_entries, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, min(valid_from) AS since
  FROM keys JOIN valid ON key = pattern AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) GROUP BY 1, 2, 3)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, CASE WHEN n_entries > 0 THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(n_entries, 0) AS n_entries, coalesce(lists, '') AS lists, CAST(since AS VARCHAR) AS listed_since
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id AND c.url IS NOT DISTINCT FROM f.url AND c.fetched = f.fetched
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op4_sharding": OP4_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op8_url_filters": OP8_SQL}
