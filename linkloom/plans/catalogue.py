"""The query catalogue: every operator on the test tables, with the same query in SQL where SQL can express it.

The tables hold no business lists, so records are stand-ins. For candidates and decisions, documents are records, their
language is the block, ids divisible by four play S1 and all others the noisy lists; a record's truth is the smallest S1 of
an equal normalised text. For features and models, suppliers are S1 and customers mention them, with names and addresses
drawn from their keys. All rows, whole texts, and the operators' production parameters take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import dictionaries as D
from linkloom.functions import normalize as N
from linkloom.functions import similarity as S
from linkloom.operators import blocking as B
from linkloom.operators import decide as R
from linkloom.operators import features as P
from linkloom.operators import metrics as M
from linkloom.operators import reports as E
from linkloom.operators import stats as T
from linkloom.operators import synonyms as Y
from linkloom.operators import vectors as V
from linkloom.operators import windows as W
from linkloom.plans import synthetic as G
from linkloom.sources import tables as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- records and candidate pairs
REC = r"""
clean AS (SELECT doc_id AS id, lang AS ckey, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS name FROM documents),
rec AS (SELECT id, ckey, name, list_distinct(list_filter(string_split(name, ' '), lambda t: t <> '')) AS toks, id % 4 = 0 AS is_s1 FROM clean),
post AS (SELECT id, ckey, is_s1, unnest(toks) AS tok FROM rec),
sizes AS (SELECT ckey, count(*) AS n FROM rec GROUP BY ckey),
freq AS (SELECT ckey, tok, df, n FROM (SELECT ckey, tok, count(*) AS df FROM post GROUP BY ckey, tok) JOIN sizes USING (ckey) WHERE df >= 2 AND df <= greatest(3000, 0.004 * n))"""
PAIRS = (
    REC
    + """,
idf AS (SELECT p.id, p.ckey, p.is_s1, p.tok, ln(f.n / f.df) AS idf FROM post p JOIN freq f USING (ckey, tok)),
norm AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM idf GROUP BY id),
weighted AS (SELECT i.id, ckey, is_s1, tok, idf / norm AS w FROM idf i JOIN norm m ON i.id = m.id WHERE norm > 0),
pairs AS (SELECT a.id AS s1_id, b.id AS o_id, round(sum(a.w * b.w), 6) AS score FROM weighted a JOIN weighted b ON a.ckey = b.ckey AND a.tok = b.tok AND a.is_s1 AND NOT b.is_s1 GROUP BY 1, 2)"""
)
BOTH = (
    PAIRS
    + """,
rev AS (SELECT *, row_number() OVER (PARTITION BY o_id ORDER BY score DESC, s1_id) AS r FROM pairs),
fwd AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, o_id) AS r FROM pairs),
cand AS (
  SELECT s1_id, o_id, max(score) AS score, min(r_rev) AS r_rev, min(r_fwd) AS r_fwd FROM (
    SELECT s1_id, o_id, score, r AS r_rev, NULL AS r_fwd FROM rev WHERE r <= 10
    UNION ALL SELECT s1_id, o_id, score, NULL, r FROM fwd WHERE r <= 20) GROUP BY 1, 2)"""
)
TRUTH = """,
truth AS (SELECT a.s1_id, b.id AS o_id FROM (SELECT ckey, name, min(id) AS s1_id FROM rec WHERE is_s1 GROUP BY ckey, name) a JOIN rec b ON a.ckey = b.ckey AND a.name = b.name WHERE NOT b.is_s1)"""
BEST = (
    BOTH
    + TRUTH
    + """,
best AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, o_id) AS k FROM (
  SELECT s1_id, o_id, score AS p, row_number() OVER (PARTITION BY o_id ORDER BY score DESC, s1_id) AS place FROM cand) WHERE place = 1),
own AS (SELECT id AS s1_id, ckey FROM rec WHERE is_s1)"""
)
SCORED = """,
marked AS (SELECT s1_id, o_id, max(t) AS t, max(p) AS p FROM (SELECT s1_id, o_id, 1 AS t, 0 AS p FROM truth UNION ALL SELECT s1_id, o_id, 0, 1 FROM predicted) GROUP BY 1, 2),
counts AS (SELECT s1_id, sum(t) AS n_true, sum(p) AS n_pred, sum(t * p) AS tp FROM marked GROUP BY 1),
scores AS (SELECT *, CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN n_pred = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END AS f FROM (
  SELECT o.s1_id, o.ckey, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM own o LEFT JOIN counts c ON o.s1_id = c.s1_id))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clean = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("ckey"), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("name"), "text")
    return clean.withColumns({"toks": F.array_distinct(N.tokens(F.col("name"))), "is_s1": F.col("id") % 4 == 0})


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rec = records(spark, sf_dir).select("id", "ckey", "toks", "is_s1")
    return rec.where("is_s1"), rec.where("NOT is_s1")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cosine_pairs(*both_sides(spark, sf_dir), digits=6)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.cosine_top(*both_sides(spark, sf_dir), digits=6)
    kept = I.saved(found)
    I.discard(found)
    return kept


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir).select("id", "ckey", F.md5(F.col("name").cast("binary")).alias("h"), "is_s1")
    a = rec.where("is_s1").groupBy("ckey", "h").agg(F.min("id").alias("s1_id"))
    return a.join(rec.where("NOT is_s1").select("ckey", "h", F.col("id").alias("o_id")), ["ckey", "h"]).select("s1_id", "o_id")


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("doc_id") % 4 == 0).select(F.col("doc_id").alias("s1_id"), F.col("lang").alias("ckey"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumnRenamed("score", "p")


def decided(spark: SparkSession, sf_dir: str, t: float = 0.5, found: DataFrame | None = None) -> DataFrame:
    """``found``: the candidates, where the caller has them."""
    scored = scored_pairs(spark, sf_dir) if found is None else found.withColumnRenamed("score", "p")
    return R.decide_threshold(R.ranked_best(scored), t)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, tokens, inverted-index join, top-k both ways, one-to-one, threshold."""
    return decided(spark, sf_dir, 0.3).select("s1_id", "o_id", "p")


@query(f"WITH {REC} SELECT ckey, tok, df FROM freq")
def block_token_df(spark, sf):
    return B.token_frequencies(records(spark, sf)).select("ckey", "tok", "df")


@query(f"WITH {PAIRS} SELECT id, ckey, tok, round(w, 6) AS w FROM weighted")
def block_idf(spark, sf):
    rec = records(spark, sf)
    return B.weighted_postings(rec, B.token_frequencies(rec)).select("id", "ckey", "tok", F.round("w", 6).alias("w"))


@query(f"WITH {PAIRS} SELECT s1_id, o_id, score FROM pairs")
def block_pairs_cosine(spark, sf):
    return pairs(spark, sf)


@query(f"WITH {BOTH} SELECT s1_id, o_id, score, r AS r_rev FROM rev WHERE r <= 10")
def block_topk_reverse(spark, sf):
    return B.cosine_ways(*both_sides(spark, sf), 10, None, digits=6)[0]


@query(f"WITH {BOTH} SELECT s1_id, o_id, score, r AS r_fwd FROM fwd WHERE r <= 20")
def block_topk_forward(spark, sf):
    return B.cosine_ways(*both_sides(spark, sf), None, 20, digits=6)[1]


@query(f"WITH {BOTH} SELECT s1_id, o_id, score, coalesce(r_rev, 255) AS r_rev, coalesce(r_fwd, 255) AS r_fwd FROM cand")
def block_union_merge(spark, sf):
    return candidates(spark, sf).na.fill(255, ["r_rev", "r_fwd"])


@query(f"WITH {BOTH} SELECT s1_id, o_id, score FROM cand WHERE r_rev <= 2 OR r_fwd <= 3")
def block_rank_filter(spark, sf):
    return B.rank_filter(candidates(spark, sf), 2, 3).select("s1_id", "o_id", "score")


@query(
    f"""WITH {BOTH}{TRUTH}, grid AS (SELECT r, f FROM (VALUES (1), (2), (5), (10)) a(r), (VALUES (0), (1), (5), (20)) b(f))
SELECT r, f, (SELECT count(*) FROM cand WHERE r_rev <= r OR r_fwd <= f) AS n_pairs,
  (SELECT count(*) FROM truth JOIN cand USING (s1_id, o_id) WHERE r_rev <= r OR r_fwd <= f) AS n_found,
  round((SELECT count(*) FROM truth JOIN cand USING (s1_id, o_id) WHERE r_rev <= r OR r_fwd <= f) / (SELECT nullif(count(*), 0) FROM truth), 6) AS recall FROM grid"""
)
def block_recall_grid(spark, sf):
    return B.recall_grid(truth(spark, sf), candidates(spark, sf), [1, 2, 5, 10], [0, 1, 5, 20])


@query(
    f"""WITH {BOTH}{TRUTH}, hit AS (SELECT t.s1_id, count(*) AS n, count(c.s1_id) AS found FROM truth t LEFT JOIN cand c ON t.s1_id = c.s1_id AND t.o_id = c.o_id GROUP BY 1)
SELECT round(sum(found) / sum(n), 6) AS pair_recall, round(avg(CASE WHEN n = found THEN 1.0 ELSE 0.0 END), 6) AS covered,
  round(1 - (SELECT count(*) FROM cand) / ((SELECT count(*) FROM rec WHERE is_s1)::DOUBLE * (SELECT count(*) FROM rec WHERE NOT is_s1)), 6) AS reduction,
  round((SELECT count(*) FROM cand) / (SELECT count(*) FROM rec WHERE is_s1), 6) AS mean_candidates FROM hit"""
)
def block_report(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count("*").alias("n"), F.sum((F.col("doc_id") % 4 == 0).cast("long")).alias("s1")).first()
    return B.blocking_report(truth(spark, sf), candidates(spark, sf), n["s1"], n["n"] - n["s1"])


EXACT = """, keyed AS (SELECT id, ckey, is_s1, string_split(name, ' ')[1] AS k FROM rec WHERE name <> ''),
few AS (SELECT ckey, k FROM keyed GROUP BY 1, 2 HAVING sum(CASE WHEN is_s1 THEN 1 ELSE 0 END) BETWEEN 1 AND 30 AND sum(CASE WHEN is_s1 THEN 0 ELSE 1 END) BETWEEN 1 AND 30),
exact AS (SELECT a.id AS s1_id, b.id AS o_id FROM keyed a JOIN keyed b USING (ckey, k) JOIN few USING (ckey, k) WHERE a.is_s1 AND NOT b.is_s1)"""


def exact_pairs(spark, sf):
    rec = records(spark, sf).select("id", "ckey", "is_s1", F.try_element_at("toks", F.lit(1)).alias("k"))
    return B.exact_key_pairs(rec.where("is_s1"), rec.where("NOT is_s1"), ["ckey", "k"])


@query(f"WITH {REC}{EXACT} SELECT s1_id, o_id FROM exact")
def block_exact_key(spark, sf):
    return exact_pairs(spark, sf)


@query(f"WITH {BOTH}{EXACT}, found AS (SELECT 'token' AS blocker, s1_id, o_id FROM cand UNION ALL SELECT 'key', s1_id, o_id FROM exact), n AS (SELECT s1_id, o_id, count(*) AS c FROM found GROUP BY 1, 2) SELECT blocker, count(*) AS n_pairs, CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_unique FROM found JOIN n USING (s1_id, o_id) GROUP BY blocker")
def block_unique_contribution(spark, sf):
    both = candidates(spark, sf).select(F.lit("token").alias("blocker"), "s1_id", "o_id").unionByName(exact_pairs(spark, sf).select(F.lit("key").alias("blocker"), "s1_id", "o_id"))
    return B.unique_contribution(both)


# ---------------------------------------------------------------- vectors
VEC = """vec AS (SELECT vec_id AS id, label AS ckey, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9)) AS v FROM embeddings),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_id ORDER BY emb_score DESC, s1_id) AS r_emb FROM (
  SELECT a.id AS s1_id, b.id AS o_id, round(list_sum(list_transform(list_zip(b.v, a.v), lambda z: z[1] * z[2])), 6) AS emb_score FROM vec a JOIN vec b USING (ckey) WHERE a.id % 4 = 0 AND b.id % 4 <> 0)) WHERE r_emb <= 5)"""


def neighbours(spark, sf):
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("ckey"), V.normalised(F.col("embedding")).alias("vector"))
    return V.nearest(vec.where("id % 4 = 0"), vec.where("id % 4 <> 0"), 5, digits=6)


@query(f"WITH {VEC} SELECT s1_id, o_id, emb_score, r_emb FROM near")
def embed_topk(spark, sf):
    return neighbours(spark, sf)


@query(
    f"""WITH {VEC}, o AS (SELECT *, row_number() OVER wo AS rc, row_number() OVER ws AS rs FROM near WINDOW wo AS (PARTITION BY o_id ORDER BY emb_score DESC, s1_id), ws AS (PARTITION BY s1_id ORDER BY emb_score DESC, o_id)),
b AS (SELECT s1_id, o_id, emb_score, rc, CASE WHEN rc = 1 THEN coalesce(max(CASE WHEN rc = 2 THEN emb_score END) OVER (PARTITION BY o_id), -1) ELSE max(emb_score) OVER (PARTITION BY o_id) END AS bc,
 CASE WHEN rs = 1 THEN coalesce(max(CASE WHEN rs = 2 THEN emb_score END) OVER (PARTITION BY s1_id), -1) ELSE max(emb_score) OVER (PARTITION BY s1_id) END AS bs FROM o)
SELECT s1_id, o_id, emb_score AS emb_cos, rc AS emb_cos_rank_c, bc AS emb_cos_best_other_c, bs AS emb_cos_best_other_s1, round(emb_score - bc, 6) AS emb_cos_gap_c FROM b"""
)
def embed_cos_context(spark, sf):
    out = V.cosine_context(neighbours(spark, sf).select("s1_id", "o_id", F.col("emb_score").alias("emb_cos")))
    return out.withColumn("emb_cos_gap_c", F.round("emb_cos_gap_c", 6))


@query(f"WITH {BOTH}{EXACT}, o AS (SELECT s1_id, o_id, 0.5 AS e, row_number() OVER (PARTITION BY o_id ORDER BY s1_id) AS r FROM exact) SELECT coalesce(c.s1_id, o.s1_id) AS s1_id, coalesce(c.o_id, o.o_id) AS o_id, coalesce(score, 0) AS score, coalesce(r_rev, 255) AS r_rev, coalesce(r_fwd, 255) AS r_fwd, CAST(coalesce(e, -1) AS DOUBLE) AS emb_score, coalesce(r, 255) AS r_emb FROM cand c FULL JOIN o ON c.s1_id = o.s1_id AND c.o_id = o.o_id")
def cand_merge_outer(spark, sf):
    other = exact_pairs(spark, sf).select("s1_id", "o_id", F.lit(0.5).alias("emb_score"), F.row_number().over(Window.partitionBy("o_id").orderBy("s1_id")).alias("r_emb"))
    return B.merge_candidates(candidates(spark, sf), other)


@query(f"WITH {BOTH}{TRUTH}{EXACT} SELECT count(*) AS n, round(avg(CASE WHEN c.s1_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS token, round(avg(CASE WHEN e.s1_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS embedding, round(avg(CASE WHEN c.s1_id IS NULL AND e.s1_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS both FROM truth t LEFT JOIN cand c ON c.s1_id = t.s1_id AND c.o_id = t.o_id LEFT JOIN exact e ON e.s1_id = t.s1_id AND e.o_id = t.o_id")
def block_recall_by_source(spark, sf):
    other = exact_pairs(spark, sf).select("s1_id", "o_id", F.lit(0.5).alias("emb_score"), F.lit(1).alias("r_emb"))
    return B.recall_by_source(truth(spark, sf), B.merge_candidates(candidates(spark, sf), other))


@query()
def embed_encode(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", "p_name")
    return V.encode_distinct(names, "p_name").select("p_partkey", "p_name", F.round(V.dot(F.col("vector"), F.col("vector")), 4).alias("norm"))


@query()
def embed_topk_indexed(spark, sf):
    """The same neighbours through the inverted file."""
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("ckey"), V.normalised(F.col("embedding")).alias("vector"))
    return V.nearest_indexed(vec.where("id % 4 = 0"), vec.where("id % 4 <> 0"), 5, digits=6)


@query()
def scorer_pairs(spark, sf):
    rec = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), V.pair_text(F.col("text"), F.col("source")).alias("text"))
    chosen = V.select_for_scorer(candidates(spark, sf).withColumnRenamed("score", "p1"), 2, 0.02).select("s1_id", "o_id")
    texts = chosen.join(rec.select(F.col("id").alias("s1_id"), F.col("text").alias("text_a")), "s1_id").join(rec.select(F.col("id").alias("o_id"), F.col("text").alias("text_b")), "o_id")
    return V.score_text_pairs(texts, V.PairScorer()).select("s1_id", "o_id", F.round("ce_p", 6).alias("ce_p"))


@query("SELECT doc_id, left(text, 120) || ' | ' || left(source, 160) AS pair_text FROM documents")
def scorer_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.pair_text(F.col("text"), F.col("source")).alias("pair_text"))


# ---------------------------------------------------------------- normalisation
CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\s*&\s*|\s+\+\s+', ' and ', 'g'), '[''`]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\b([0-9]+)(?:st|nd|rd|th|er|e|eme)\b', '\1', 'g'), '\s+', ' ', 'g'))"
#: The tables' other letters are accented ones and ß, which SQL can transliterate too.
ASCII_SQL = "strip_accents(replace({0}, 'ß', 'ss'))"
PLAIN = ASCII_SQL.format("text")


DOMAIN_SQL = r"regexp_replace({0}, '(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:com|net|org|in|co\.in|fr|biz|us|info)\b', ' \1 ', 'gi')"


@query(f"SELECT doc_id, {CLEAN_SQL.format(PLAIN)} AS cleaned FROM documents")
def norm_basic_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.basic_clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {PLAIN} AS plain FROM documents")
def norm_transliterate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.transliterate(F.col("text")).alias("plain"))


@query(f"SELECT p_partkey, p_type, {CLEAN_SQL.format("p_name || ' & ' || p_brand")} AS cleaned FROM part")
def norm_distinct(spark, sf):
    """Distinct strings are cleaned once and joined back."""
    raw = table(spark, sf, "part").select("p_partkey", "p_type", F.concat("p_name", F.lit(" & "), "p_brand").alias("raw"))
    return N.over_distinct(raw, "raw", lambda c: {"cleaned": N.basic_clean(c)}).drop("raw")


LEET_SQL = "CASE WHEN length({0}) >= 4 AND length(regexp_replace({0}, '[^0-9]', '', 'g')) = 1 AND length(regexp_replace({0}, '[^a-z]', '', 'g')) >= 3 THEN translate({0}, '013458', 'oleasb') ELSE {0} END"


def sql_map(table_: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table_.items()) + "}"


@query(f"WITH canon(k, v) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in D.LEGAL_CANON.items())}), toks AS (SELECT doc_id, i, {LEET_SQL.format('t')} AS t FROM (SELECT doc_id, unnest(list_filter(string_split(c, ' '), lambda x: x <> '')) AS t, unnest(range(1, 1 + len(list_filter(string_split(c, ' '), lambda x: x <> '')))) AS i FROM (SELECT doc_id, {CLEAN_SQL.format(ASCII_SQL.format(DOMAIN_SQL.format("text")))} AS c FROM documents))) SELECT doc_id, string_agg(coalesce(v, t), ' ' ORDER BY i) AS tokens FROM toks LEFT JOIN canon ON t = k GROUP BY doc_id")
def norm_tokens(spark, sf):
    out = table(spark, sf, "documents").select("doc_id", N.name_tokens(F.col("text")).alias("t"))
    return out.where(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("tokens"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+'), lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END))), ',') AS numbers FROM documents")
def norm_numbers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(N.numbers(F.col("text")), ",").alias("numbers"))


@query(r"SELECT doc_id, coalesce(list_transform(list_filter(regexp_extract_all(regexp_replace(text, '<\s*null\s*>|\bnull\b|\bnone\b|\bn/?a\b|\bnil\b', ' ', 'gi'), '[0-9]+'), lambda d: len(ltrim(d, '0')) <= 5), lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END)[1], '') AS house_number FROM documents")
def norm_house_number(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.house_number(F.col("text")).alias("house_number"))


@query(
    r"""SELECT doc_id, CASE WHEN regexp_extract(t, '\b([0-9]{6})\b', 1) <> '' THEN regexp_extract(t, '\b([0-9]{6})\b', 1)
WHEN regexp_extract(t, '\b([0-9]{3})\s([0-9]{3})\b', 1) <> '' THEN regexp_extract(t, '\b([0-9]{3})\s([0-9]{3})\b', 1) || regexp_extract(t, '\b([0-9]{3})\s([0-9]{3})\b', 2)
WHEN len(regexp_extract_all(t, '[0-9]+')) > 1 THEN coalesce(regexp_extract_all(t, '\b([0-9]{5})(?:-[0-9]{4})?\b', 1)[-1], '') ELSE '' END AS postal FROM (SELECT doc_id, text AS t FROM documents)"""
)
def norm_postal(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.postal_code(F.col("text")).alias("postal"))


@query("SELECT s_suppkey, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: NOT regexp_full_match(t, '[0-9]+')), lambda t: t[1]), '') AS acronym FROM supplier")
def norm_acronym(spark, sf):
    core = N.core_tokens(N.name_tokens(F.col("s_name"), None, True))
    return table(spark, sf, "supplier").select("s_suppkey", N.acronym(core).alias("acronym"))


@query(f"SELECT DISTINCT tok, {LEET_SQL.format('tok')} AS fixed FROM (SELECT unnest(string_split({CLEAN_SQL.format(PLAIN)}, ' ')) AS tok FROM documents) WHERE tok <> ''")
def norm_leet(spark, sf):
    toks = table(spark, sf, "documents").select(F.explode(N.tokens(N.basic_clean(F.col("text")))).alias("tok")).distinct()
    return toks.select("tok", N.fix_leet(F.col("tok")).alias("fixed"))


@query(r"SELECT o_orderkey, regexp_replace(t, '\b([0-9]+)(?:st|nd|rd|th|er|e|eme)\b', '\1', 'g') AS cleaned FROM (SELECT o_orderkey, 'order ' || o_orderkey || CASE o_orderkey % 4 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END || ' of ' || o_custkey || 'eme' AS t FROM orders)")
def norm_ordinal(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("th", "st", "nd", "rd")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), suffix, F.lit(" of "), F.col("o_custkey").cast("string"), F.lit("eme"))
    return table(spark, sf, "orders").select("o_orderkey", N.basic_clean(text, True).alias("cleaned"))


def _skeleton_sql(t: str) -> str:
    s = t
    for a, b in D.SKELETON_STEPS:
        s = f"replace({s}, '{a}', '{b}')"
    rest = f"regexp_replace(substr({s}, 2), '[aeiouh]', '', 'g')"
    for c in "bcdfgjklmnpqrstvwxyz0123456789":
        rest = f"regexp_replace({rest}, '{c}+', '{c}', 'g')"
    return f"CASE WHEN regexp_full_match({t}, '[0-9]+') THEN {t} ELSE substr({s}, 1, 1) || {rest} END"


@query(f"SELECT DISTINCT tok, {_skeleton_sql('tok')} AS skeleton FROM (SELECT unnest(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')), ' ')) AS tok FROM part) WHERE tok <> ''")
def norm_skeleton(spark, sf):
    text = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), "[^a-z0-9]+", " "))
    return table(spark, sf, "part").select(F.explode(N.tokens(text)).alias("tok")).distinct().select("tok", N.skeleton(F.col("tok")).alias("skeleton"))


@query(r"SELECT page_id, regexp_replace(url, '(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:com|net|org|in|co\.in|fr|biz|us|info)\b', ' \1 ', 'gi') AS unwrapped FROM pages")
def norm_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.unwrap_domain(F.col("url")).alias("unwrapped"))


@query("SELECT s_suppkey, unnest([name, left_part, right_part]) AS variant, unnest([0, 1, 2]) AS place FROM (SELECT s_suppkey, s_name || ' dba: ' || 'Shop ' || s_suppkey AS name, s_name AS left_part, 'Shop ' || s_suppkey AS right_part FROM supplier)")
def norm_dba_split(spark, sf):
    name = F.concat(F.col("s_name"), F.lit(" dba: Shop "), F.col("s_suppkey").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", F.posexplode(N.name_variants(name)).alias("place", "variant"))


@query(f"SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda t: coalesce({sql_map({'standard': 'std', 'small': 'sm', 'large': 'lg', 'medium': 'md', 'economy': 'eco', 'promo': 'pro'})}[t], t)), ' ') AS canon FROM part")
def map_canon(spark, sf):
    short = {"standard": "std", "small": "sm", "large": "lg", "medium": "md", "economy": "eco", "promo": "pro"}
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(F.split(F.lower("p_type"), " "), lambda t: N.canonical(t, short)), " ").alias("canon"))


@query("SELECT DISTINCT p_name, array_to_string(list_transform(range(1, len(t)), lambda i: 'nb:' || t[i] || '_' || t[i + 1]), ',') AS bigrams FROM (SELECT p_name, string_split(lower(p_name), ' ') AS t FROM part)")
def tokens_bigrams(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", F.array_join(N.bigrams(F.split(F.lower("p_name"), " "), "nb:"), ",").alias("bigrams"))


def _among(t: str, words) -> str:
    return f"{t} IN ({', '.join(f"'{w}'" for w in words)})"


def _step_sql(source: str) -> str:
    """CTEs from ``source`` (k, name, addr) to ``prepared``: name tokens nt, core tokens core, address tokens places_raw, block tokens btok."""
    legal = f"({_among('t', D.LEGAL_FORMS)} OR (len(t) >= 5 AND {_among(_skeleton_sql('t'), N.LEGAL_SKELETONS)}))"
    left_out = f"{legal} OR {_among('t', [*D.NAME_NOISE, *D.COUNTRY_WORDS])} OR regexp_full_match(t, '[0-9]+')"
    bare = "CASE WHEN ltrim({0}, '0') = '' THEN '0' ELSE ltrim({0}, '0') END"
    two = "list_transform(range(1, len({0})), lambda i: '{1}' || {0}[i] || '_' || {0}[i + 1])"
    return f"""src AS ({source}),
toks AS (SELECT k, name, addr, list_transform(list_transform(list_filter(string_split({CLEAN_SQL.format(DOMAIN_SQL.format('name'))}, ' '), lambda t: t <> ''), lambda t: {LEET_SQL.format('t')}), lambda t: coalesce({sql_map(D.LEGAL_CANON)}[t], t)) AS nt,
  list_transform(list_filter(string_split(array_to_string(list_transform(list_transform(string_split(addr, ','), lambda c: {CLEAN_SQL.format('c')}), lambda c: coalesce({sql_map(D.STATES)}[c], c)), ' '), ' '), lambda t: t <> ''), lambda t: coalesce({sql_map(D.ADDR_CANON)}[t], t)) AS places_raw FROM src),
cores AS (SELECT *, CASE WHEN len(list_filter(nt, lambda t: NOT ({left_out}))) > 0 THEN list_filter(nt, lambda t: NOT ({left_out})) ELSE nt END AS core FROM toks),
marks AS (SELECT *, list_transform(list_filter(core, lambda t: len(t) > 1), lambda t: {_skeleton_sql('t')}) AS names, array_to_string(core, '') AS solid,
  list_transform(list_filter(places_raw, lambda t: len(t) > 1 OR regexp_full_match(t, '[0-9]+')), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '#' || {bare.format('t')} ELSE {_skeleton_sql('t')} END) AS places FROM cores),
prepared AS (SELECT *, list_sort(list_distinct(list_transform(names, lambda t: 'n:' || t) || {two.format('names', 'nb:')} || CASE WHEN len(solid) >= 4 THEN ['ns:' || solid] ELSE [] END
  || list_transform(places, lambda t: CASE WHEN t[1] = '#' THEN '#:' || substr(t, 2) ELSE 'a:' || t END) || {two.format('places', 'ab:')})) AS btok FROM marks)"""


@query(f"WITH {_step_sql("SELECT p_partkey AS k, p_name AS name, p_size || ' ' || p_type || ', Michigan' AS addr FROM part")} SELECT k AS p_partkey, array_to_string(btok, ',') AS tokens FROM prepared")
def tokens_block(spark, sf):
    core = N.core_tokens(N.name_tokens(F.col("p_name"), None, True))
    addr = N.address_tokens(F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"), F.lit(", Michigan")), None, True)
    return table(spark, sf, "part").select("p_partkey", F.array_join(N.block_tokens(core, addr), ",").alias("tokens"))


@query(
    f"""WITH {_step_sql("SELECT 'S1-' || s_suppkey AS k, s_name || ' Private Limited' AS name, s_suppkey || ' Main Street, New York, 10001' AS addr FROM supplier")},
runs AS (SELECT *, list_transform(regexp_extract_all(addr, '[0-9]+'), lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END) AS runs FROM prepared)
SELECT k AS entity_id, 'us' AS ckey, array_to_string(nt, ' ') AS n_name, array_to_string(core, ' ') AS c_name, array_to_string(places_raw, ' ') AS n_addr,
  array_to_string(list_transform(core, lambda t: {_skeleton_sql('t')}), ' ') AS p_name, coalesce(list_filter(runs, lambda d: len(d) <= 5)[1], '') AS hn,
  CASE WHEN regexp_extract(addr, '\\b([0-9]{{6}})\\b', 1) <> '' THEN regexp_extract(addr, '\\b([0-9]{{6}})\\b', 1) ELSE '10001' END AS pc,
  array_to_string(list_sort(list_distinct(runs)), ',') AS nums, array_to_string(btok, ',') AS btok FROM runs"""
)
def prepared_records(spark, sf):
    raw = table(spark, sf, "supplier").select(F.concat(F.lit("S1-"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.concat(F.col("s_name"), F.lit(" Private Limited")).alias("business_name"), F.concat(F.col("s_suppkey").cast("string"), F.lit(" Main Street, New York, 10001")).alias("business_address"), F.lit("US ").alias("country"))
    out = N.prepare_records(raw)
    return out.select("entity_id", "ckey", "n_name", "c_name", "n_addr", "p_name", "hn", "pc", F.array_join("nums", ",").alias("nums"), F.array_join("btok", ",").alias("btok"))


# ---------------------------------------------------------------- similarities
#: Pairs of part names on neighbouring lines of an order: as many at most as there are lines.
NAMES = """line AS (SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
np AS (SELECT DISTINCT least(x.p_name, y.p_name) AS a, greatest(x.p_name, y.p_name) AS b FROM line x JOIN line y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber WHERE x.p_name <> y.p_name),
names AS (SELECT a AS n FROM np UNION SELECT b FROM np)"""
#: x, y, r: the ratio of the string pairs in ``need``, by the bit-parallel longest common subsequence; for 60 characters at most.
RATIO = """, sp AS (SELECT DISTINCT x, y FROM need),
step(x, y, i, s) AS (
  SELECT x, y, 0, (1::BIGINT << len(x)) - 1 FROM sp
  UNION ALL SELECT x, y, i + 1, ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << len(x)) - 1)
  FROM (SELECT x, y, i, s, coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda p: CASE WHEN x[p] = y[i + 1] THEN 1::BIGINT << (p - 1) ELSE 0::BIGINT END)), 0)::BIGINT AS m FROM step WHERE i < len(y))),
ratio AS (SELECT x, y, CASE WHEN x = y THEN 100.0 ELSE 200.0 * (len(x) - bit_count(s)) / (len(x) + len(y)) END AS r FROM step WHERE i = len(y))"""
SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
#: lo, hi: the shorter string first, with its windows over the longer one, ends included.
PARTIAL = """lo_hi AS (SELECT x AS x0, y AS y0, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS lo, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS hi FROM wanted),
windows AS (SELECT DISTINCT lo, hi, substr(hi, greatest(w, 1), len(lo) + least(w, 1) - 1) AS part FROM (SELECT DISTINCT lo, hi, unnest(range(2 - len(lo), len(hi) + 1)) AS w FROM lo_hi))"""


def name_pairs(spark, sf):
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p_name").alias("next"))
    both = line.join(after, ["l_orderkey", "l_linenumber"]).where("p_name <> next")
    return both.select(F.least("p_name", "next").alias("a"), F.greatest("p_name", "next").alias("b")).distinct()


@query(f"WITH {NAMES} SELECT a, b, levenshtein(a, b) AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM np")
def sim_levenshtein(spark, sf):
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(S.levenshtein_similarity(a, b), 6).alias("similarity"))


def kernel(spark, sf, kind: str) -> DataFrame:
    return S.similarity(name_pairs(spark, sf), kind).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {NAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM np")
def sim_jaro_winkler(spark, sf):
    return kernel(spark, sf, "jw")


@query(f"WITH RECURSIVE {NAMES}, need AS (SELECT a AS x, b AS y FROM np){RATIO} SELECT x AS a, y AS b, round(r, 6) AS similarity FROM ratio")
def sim_ratio_indel(spark, sf):
    return kernel(spark, sf, "ratio")


@query(f"WITH RECURSIVE {NAMES}, sorted AS (SELECT a, b, {SORTED.format('a')} AS x, {SORTED.format('b')} AS y FROM np), need AS (SELECT x, y FROM sorted){RATIO} SELECT a, b, round(r, 6) AS similarity FROM sorted JOIN ratio USING (x, y)")
def sim_token_sort(spark, sf):
    return kernel(spark, sf, "tsort")


TSET = """sets AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM np),
parts AS (SELECT a, b, list_sort(list_intersect(ta, tb)) AS t, list_sort(list_filter(ta, lambda w: NOT list_contains(tb, w))) AS l, list_sort(list_filter(tb, lambda w: NOT list_contains(ta, w))) AS r FROM sets),
three AS (SELECT a, b, len(t) > 0 AS shared, len(t) > 0 AND (len(l) = 0 OR len(r) = 0) AS within, array_to_string(t, ' ') AS core, array_to_string(t || l, ' ') AS one, array_to_string(t || r, ' ') AS two FROM parts)"""
TSET_NEED = "SELECT one AS x, two AS y FROM three UNION ALL SELECT core, one FROM three WHERE shared UNION ALL SELECT core, two FROM three WHERE shared"
TSET_VALUE = """SELECT a, b, CASE WHEN within THEN 100.0 ELSE greatest(p.r, coalesce(q.r, 0), coalesce(w.r, 0)) END AS tset FROM three
  JOIN ratio p ON p.x = one AND p.y = two LEFT JOIN ratio q ON shared AND q.x = core AND q.y = one LEFT JOIN ratio w ON shared AND w.x = core AND w.y = two"""


@query(f"WITH RECURSIVE {NAMES}, {TSET}, need AS ({TSET_NEED}){RATIO} SELECT a, b, round(tset, 6) AS similarity FROM ({TSET_VALUE})")
def sim_token_set(spark, sf):
    return kernel(spark, sf, "tset")


PARTIAL_VALUE = "partial AS (SELECT x0, y0, max(CASE WHEN contains(hi, lo) THEN 100.0 ELSE r END) AS r FROM lo_hi JOIN windows USING (lo, hi) JOIN ratio ON x = lo AND y = part GROUP BY x0, y0)"


@query(f"WITH RECURSIVE {NAMES}, wanted AS (SELECT a AS x, b AS y FROM np), {PARTIAL}, need AS (SELECT lo AS x, part AS y FROM windows){RATIO}, {PARTIAL_VALUE} SELECT x0 AS a, y0 AS b, round(r, 6) AS similarity FROM partial")
def sim_partial(spark, sf):
    return kernel(spark, sf, "partial")


@query(
    f"""WITH RECURSIVE {NAMES}, {TSET}, own AS (SELECT a, b, {SORTED.format('a')} AS sa, {SORTED.format('b')} AS sb, shared, array_to_string(l, ' ') AS la, array_to_string(r, ' ') AS lb FROM three JOIN parts USING (a, b)),
wanted AS (SELECT a AS x, b AS y FROM own UNION SELECT sa, sb FROM own UNION SELECT la, lb FROM own WHERE NOT shared), {PARTIAL},
need AS ({TSET_NEED} UNION ALL SELECT a, b FROM own UNION ALL SELECT sa, sb FROM own UNION ALL SELECT lo, part FROM windows){RATIO}, {PARTIAL_VALUE}, tset AS ({TSET_VALUE})
SELECT a, b, round(CASE WHEN long < 1.5 THEN greatest(w.r, 0.95 * greatest(s.r, tset)) ELSE greatest(w.r, scale * p.r, 0.95 * scale * greatest(CASE WHEN shared THEN 100.0 ELSE q.r END, ps.r)) END, 6) AS similarity
FROM (SELECT *, greatest(len(a), len(b)) / least(len(a), len(b)) AS long, CASE WHEN greatest(len(a), len(b)) / least(len(a), len(b)) <= 8 THEN 0.9 ELSE 0.6 END AS scale FROM own) o
JOIN ratio w ON w.x = a AND w.y = b JOIN ratio s ON s.x = sa AND s.y = sb JOIN tset USING (a, b) JOIN partial p ON p.x0 = a AND p.y0 = b JOIN partial ps ON ps.x0 = sa AND ps.y0 = sb LEFT JOIN partial q ON q.x0 = la AND q.y0 = lb"""
)
def sim_weighted(spark, sf):
    return kernel(spark, sf, "wratio")


LETTERS = "list_transform(string_split({0}, ' '), lambda t: array_to_string(list_sort(string_split(t, '')), ''))"


@query(f"WITH RECURSIVE {NAMES}, words AS (SELECT a, b, i, x, unnest({LETTERS.format('b')}) AS y FROM (SELECT a, b, unnest(range(len(string_split(a, ' ')))) AS i, unnest({LETTERS.format('a')}) AS x FROM np)), need AS (SELECT x, y FROM words){RATIO} SELECT a, b, round(avg(best), 6) AS similarity FROM (SELECT a, b, i, max(r) AS best FROM words JOIN ratio USING (x, y) GROUP BY a, b, i) GROUP BY a, b")
def sim_sorted_tokens(spark, sf):
    return kernel(spark, sf, "sorted_ratio")


@query(f"WITH {NAMES} SELECT a, b, round(CAST(list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(len(x) - len(replace(x, c, '')), len(y) - len(replace(y, c, ''))))) AS DOUBLE) / greatest(len(x), len(y)), 6) AS similarity FROM (SELECT a, b, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM np)")
def sim_char_bag(spark, sf):
    return name_pairs(spark, sf).select("a", "b", F.round(S.letters_in_common(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"WITH {NAMES} SELECT a, b, round(len(list_filter(x, lambda t: list_contains(y, t))) / len(x), 6) AS similarity FROM (SELECT a, b, {LETTERS.format('a')} AS x, {LETTERS.format('b')} AS y FROM np)")
def sim_anagram(spark, sf):
    return name_pairs(spark, sf).select("a", "b", F.round(S.anagram_share(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"WITH {NAMES} SELECT a, b, CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: left(a, i) = left(b, i))) AS DOUBLE) AS similarity FROM np")
def sim_common_prefix(spark, sf):
    return name_pairs(spark, sf).select("a", "b", S.common_prefix(F.col("a"), F.col("b")).alias("similarity"))


@query(
    f"""WITH {NAMES}, w AS (SELECT n, ' ' || unnest(string_split(n, ' ')) || ' ' AS w FROM names),
g AS (SELECT n, substr(w, i, k) AS g, count(*) AS c FROM (SELECT n, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM w, (VALUES (2), (3), (4)) v(k)) GROUP BY 1, 2),
norm AS (SELECT n, sqrt(sum(c * c)) AS norm FROM g GROUP BY n)
SELECT a, b, round(coalesce((SELECT sum(x.c * y.c) FROM g x JOIN g y ON x.g = y.g WHERE x.n = np.a AND y.n = np.b), 0) / (x0.norm * y0.norm), 6) AS similarity
FROM np JOIN norm x0 ON x0.n = np.a JOIN norm y0 ON y0.n = np.b"""
)
def sim_char_ngram_cosine(spark, sf):
    return kernel(spark, sf, "char_cos")


@query(
    f"""WITH {BOTH}, df AS (SELECT tok, ln((SELECT count(*) FROM rec) / count(*)) AS idf FROM post GROUP BY tok),
few AS (SELECT s1_id, o_id FROM cand),
side AS (SELECT f.s1_id, f.o_id, tok, 'a' AS s FROM few f JOIN post p ON p.id = f.s1_id UNION ALL SELECT f.s1_id, f.o_id, tok, 'b' FROM few f JOIN post p ON p.id = f.o_id),
each AS (SELECT s1_id, o_id, tok, string_agg(s, '' ORDER BY s) AS s FROM side GROUP BY 1, 2, 3)
SELECT s1_id, o_id, round(sum(CASE WHEN s = 'ab' THEN 1 ELSE 0 END) / count(*), 6) AS tok_jac,
  round(CASE WHEN sum(idf) > 0 THEN sum(CASE WHEN s = 'ab' THEN idf ELSE 0 END) / sum(idf) ELSE 0 END, 6) AS tok_wjac,
  round(coalesce(max(CASE WHEN s = 'ab' THEN idf END), 0), 6) AS tok_max_shared, round(sum(CASE WHEN s = 'a' THEN idf ELSE 0 END), 5) AS tok_only_s1, round(sum(CASE WHEN s = 'b' THEN idf ELSE 0 END), 5) AS tok_only_c,
  round(coalesce(max(CASE WHEN s <> 'ab' THEN idf END), 0), 6) AS tok_max_only, CAST(sum(CASE WHEN s = 'a' THEN 1 ELSE 0 END) AS BIGINT) AS tok_n_only_s1, CAST(sum(CASE WHEN s = 'b' THEN 1 ELSE 0 END) AS BIGINT) AS tok_n_only_c
FROM each JOIN df USING (tok) GROUP BY 1, 2"""
)
def sim_token_idf(spark, sf):
    rec = records(spark, sf).select("id", "name")
    few = candidates(spark, sf).select("s1_id", "o_id")
    both = few.join(rec.select(F.col("id").alias("s1_id"), F.col("name").alias("na")), "s1_id").join(rec.select(F.col("id").alias("o_id"), F.col("name").alias("nb")), "o_id")
    out = P.token_features(both, "na", "nb", P.token_idf(rec, "name"), None, "tok")
    digits = {"tok_only_s1": 5, "tok_only_c": 5}
    return out.withColumns({c: F.round(c, digits.get(c, 6)) for c in out.columns if c.startswith("tok_") and "_n_" not in c})


NUMS = r"""nums AS (SELECT doc_id AS id, list_distinct(list_transform(regexp_extract_all(text, '[0-9]+'), lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END)) AS n FROM documents)"""


@query(
    f"""WITH {BOTH}, {NUMS} SELECT s1_id, o_id, CASE WHEN len(a.n) > 0 AND len(b.n) > 0 THEN 1.0 ELSE 0.0 END AS nums_both,
round(CASE WHEN len(a.n) > 0 AND len(b.n) > 0 THEN len(list_intersect(a.n, b.n)) / len(list_distinct(a.n || b.n)) END, 4) AS nums_jac,
CASE WHEN len(a.n) > 0 AND len(b.n) > 0 AND len(list_intersect(a.n, b.n)) = 0 THEN 1.0 ELSE 0.0 END AS nums_conflict FROM cand JOIN nums a ON a.id = s1_id JOIN nums b ON b.id = o_id"""
)
def sim_number_sets(spark, sf):
    nums = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), N.numbers(F.col("text")).alias("n"))
    both = candidates(spark, sf).join(nums.select(F.col("id").alias("s1_id"), F.col("n").alias("a")), "s1_id").join(nums.select(F.col("id").alias("o_id"), F.col("n").alias("b")), "o_id")
    return both.select("s1_id", "o_id", *[F.round(c.cast("double"), 4).alias(k) for k, c in P.number_set_features(F.col("a"), F.col("b"), "nums").items()])


@query(
    """WITH k AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders)
SELECT o_orderkey, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS hn_equal, CASE WHEN a <> b AND (starts_with(a, b) OR starts_with(b, a) OR ends_with(a, b) OR ends_with(b, a)) THEN 1.0 ELSE 0.0 END AS hn_affix,
CAST(levenshtein(a, b) AS DOUBLE) AS hn_lev, round(ln(1 + abs(CAST(substr(a, 1, 9) AS BIGINT) - CAST(substr(b, 1, 9) AS BIGINT))), 3) AS hn_log_gap FROM k"""
)
def sim_house_number(spark, sf):
    f = P.house_number_features(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", *[F.round(f[c].cast("double"), 3).alias(c) for c in ("hn_equal", "hn_affix", "hn_lev", "hn_log_gap")])


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 1.0 ELSE 0.0 END AS name_nonascii_b, 0.0 AS script_a, CASE WHEN regexp_matches(text, '[^\x{0000}-\x{024F}]') THEN 1.0 ELSE 0.0 END AS script_b, CASE WHEN regexp_matches(text, '[^\x{0000}-\x{024F}]') THEN 1.0 ELSE 0.0 END AS script_mismatch FROM documents")
def sim_script_flags(spark, sf):
    flags = P.script_features(F.col("source"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[c.cast("double").alias(k) for k, c in flags.items()])


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS core_equal, CASE WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 1.0 ELSE 0.0 END AS ns_equal,
CASE WHEN len(replace(a, ' ', '')) >= 4 AND len(replace(b, ' ', '')) >= 4 AND (contains(replace(a, ' ', ''), replace(b, ' ', '')) OR contains(replace(b, ' ', ''), replace(a, ' ', ''))) THEN 1.0 ELSE 0.0 END AS ns_contain,
CASE WHEN string_split(a, ' ')[1] = string_split(b, ' ')[1] THEN 1.0 ELSE 0.0 END AS first_tok_eq, CAST(len(a) AS DOUBLE) AS core_len_a, CAST(len(b) AS DOUBLE) AS core_len_b, CAST(len(string_split(a, ' ')) - len(string_split(b, ' ')) AS DOUBLE) AS core_ntok_diff,
round(least(len(replace(a, ' ', '')), len(replace(b, ' ', ''))) / greatest(len(replace(a, ' ', '')), len(replace(b, ' ', ''))), 4) AS ns_len_ratio, CASE WHEN left(a, 1) || left(string_split(a, ' ')[2], 1) = left(b, 1) || left(string_split(b, ' ')[2], 1) THEN 1.0 ELSE 0.0 END AS initials_eq,
CASE WHEN left(a, 1) || left(string_split(a, ' ')[2], 1) = replace(b, ' ', '') OR left(b, 1) || left(string_split(b, ' ')[2], 1) = replace(a, ' ', '') THEN 1.0 ELSE 0.0 END AS acronym_match,
CASE WHEN x = y THEN 1.0 ELSE 0.0 END AS pc_equal, round(len(y) / greatest(len(x), len(y)), 4) AS addr_len_ratio
FROM (SELECT l_orderkey, l_linenumber, p_name AS a, lower(p_type) || ' ' || lower(p_brand) AS b, CAST(l_suppkey AS VARCHAR) AS x, CAST(l_linenumber AS VARCHAR) AS y FROM lineitem JOIN part ON p_partkey = l_partkey)"""
)
def sim_plain(spark, sf):
    """Equalities, lengths, initials, postcodes: the features that built-in functions express, on part names against types."""
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    a = {"c_name": F.col("p_name"), "pc": F.col("l_suppkey").cast("string"), "n_addr": F.col("l_suppkey").cast("string")}
    b = {"c_name": F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")), "pc": F.col("l_linenumber").cast("string"), "n_addr": F.col("l_linenumber").cast("string")}
    none = {"name": F.lit(""), "p_name": F.lit(""), "hn": F.lit(""), "nums": F.array().cast("array<string>")}
    f = P.plain_features(lambda c: (a | none)[c], lambda c: (b | none)[c])
    names = ["core_equal", "ns_equal", "ns_contain", "first_tok_eq", "core_len_a", "core_len_b", "core_ntok_diff", "ns_len_ratio", "initials_eq", "acronym_match", "pc_equal", "addr_len_ratio"]
    return line.select("l_orderkey", "l_linenumber", *[F.round(f[c].cast("double"), 4).alias(c) for c in names])


def lists(spark, sf):
    """(S1, others, truth), prepared and written as Linkage does before it goes on: suppliers, and customers that mention the supplier whose number their key falls on; a fifth of the
    customers mention nobody."""
    s1 = G.clean(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("string").alias("country")))
    n = F.broadcast(s1.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")))  # one row
    seen = table(spark, sf, "customer").join(n).select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.when(G.chance("lost", F.col("c_custkey")) < 0.2, F.col("c_custkey") + 1_000_000_000).otherwise(F.col("c_custkey") % F.col("n")).alias("entity"))
    known = seen.join(s1, "entity").select("entity", "country", "c_custkey", "name", "address")
    lost = G.clean(seen.where("entity >= 1000000000").select("entity", F.col("nation").alias("country"), "c_custkey")).select(*known.columns)
    noisy = G.noisy(known.unionByName(lost).withColumnRenamed("c_custkey", "copy"))
    raw = lambda d, key: I.materialised(N.prepare_records(d.select(key.alias("entity_id"), F.col("name").alias("business_name"), F.col("address").alias("business_address"), "country")))
    s1_id, o_id = F.concat(F.lit("S1-"), F.col("entity").cast("string")), F.concat(F.when(F.col("copy") % 3 == 0, "S3-").otherwise("S2-"), F.col("copy").cast("string"))
    pairs_ = noisy.where("entity < 1000000000").select(s1_id.alias("s1_id"), o_id.alias("o_id"))
    return raw(s1, s1_id), raw(noisy, o_id), I.materialised(pairs_)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Token and vector candidates of both lists."""
    side = lambda d: d.select(F.col("entity_id").alias("id"), "ckey", F.col("btok").alias("toks"))
    named = lambda d: V.encode_distinct(d.select(F.col("entity_id").alias("id"), "ckey", F.col("c_name").alias("t")), "t").drop("t")
    return I.materialised(B.merge_candidates(B.cosine_top(side(a), side(b)), V.nearest(named(a), named(b))))


@query()
def pair_features(spark, sf):
    """The 136 columns of all candidates of suppliers and the customers that mention them."""
    a, b, _ = lists(spark, sf)
    return P.pair_features(merged(a, b).withColumn("p1", F.col("score")), a, b, embeddings=True)


@query()
def prefilter_columns(spark, sf):
    a, b, _ = lists(spark, sf)
    return P.cheap_features(merged(a, b), a, b)


@query()
def first_features(spark, sf):
    """The first generation's own columns for its candidates."""
    a, b, _ = lists(spark, sf)
    side = lambda d: d.withColumnRenamed("entity_id", "id")
    found = I.materialised(B.first_candidates(side(a), side(b)).select("s1_id", "o_id").distinct())
    return P.first_features(found, a, b)


TERMS = """rec AS (SELECT p_partkey AS id, p_size % 5 AS ckey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS t FROM part),
w AS (SELECT id, ckey, ' ' || unnest(string_split(t, ' ')) || ' ' AS w FROM rec),
tf AS (SELECT id, ckey, g AS tok, count(*) AS tf FROM (SELECT id, ckey, substr(w, i, k) AS g FROM (SELECT id, ckey, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM w, (VALUES (2), (3), (4)) v(k))) GROUP BY 1, 2, 3),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok HAVING count(*) >= 2),
raw AS (SELECT id, ckey, tok, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(*) FROM rec)) / (1 + df))) AS raw FROM tf JOIN df USING (tok)),
weight AS (SELECT id, ckey, tok, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM raw)"""


def part_texts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("ckey"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("t"))


@query(f"WITH {TERMS} SELECT id, ckey, tok, round(w, 6) AS w FROM weight")
def first_tfidf(spark, sf):
    return B.tfidf(part_texts(spark, sf), "t").select("id", "ckey", "tok", F.round("w", 6).alias("w"))


TOP_TERMS = TERMS + """, sim AS (SELECT a.id AS s1_id, b.id AS o_id, round(sum(a.w * b.w), 6) AS score FROM weight a JOIN weight b ON a.ckey = b.ckey AND a.tok = b.tok WHERE a.id % 4 = 0 AND b.id % 4 <> 0 GROUP BY 1, 2)"""


@query(f"WITH {TOP_TERMS} SELECT * FROM (SELECT s1_id, o_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, o_id) AS rank FROM sim WHERE score >= 0.05) WHERE rank <= 10")
def first_tfidf_topk(spark, sf):
    rec = part_texts(spark, sf)
    return B.tfidf_top(rec.where("id % 4 = 0"), rec.where("id % 4 <> 0"), "t", 10, digits=6)


@query(f"WITH {TOP_TERMS} SELECT * FROM (SELECT s1_id, o_id, score, row_number() OVER (PARTITION BY o_id ORDER BY score DESC, s1_id) AS rank FROM sim WHERE score >= 0.2) WHERE rank <= 5")
def first_tfidf_reverse(spark, sf):
    rec = part_texts(spark, sf)
    return B.tfidf_top(rec.where("id % 4 = 0"), rec.where("id % 4 <> 0"), "t", 5, 0.2, reverse=True, digits=6)


# ---------------------------------------------------------------- windows
LINE = "l AS (SELECT l_orderkey AS g, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, l_extendedprice AS v FROM lineitem)"
TIES = ["p", "s", "i"]


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("v"))


@query(f"WITH {LINE} SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v DESC, p, s, i) AS r FROM l")
def win_rank_first(spark, sf):
    return lines(spark, sf).select("g", "v", W.rank_first(["g"], "v", TIES).cast("long").alias("r"))


@query(f"WITH {LINE} SELECT g, v, rank() OVER (PARTITION BY g ORDER BY v DESC) AS r FROM l")
def win_rank_min(spark, sf):
    return lines(spark, sf).select("g", "v", W.rank_min(["g"], "v").cast("long").alias("r"))


@query(f"WITH {LINE} SELECT g, v, round(max(v) OVER (PARTITION BY g) - v, 6) AS gap FROM l")
def win_gap(spark, sf):
    return lines(spark, sf).select("g", "v", F.round(W.gap_to_best(["g"], "v"), 6).alias("gap"))


@query(f"WITH {LINE}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, p, s, i) AS r FROM l) SELECT g, v, CASE WHEN r = 1 THEN coalesce(max(CASE WHEN r = 2 THEN v END) OVER (PARTITION BY g), -1) ELSE max(v) OVER (PARTITION BY g) END AS other FROM r")
def win_best_other(spark, sf):
    return lines(spark, sf).select("g", "v", W.best_other(["g"], "v", TIES).alias("other"))


@query(f"WITH {LINE}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, p, s, i) AS r FROM l) SELECT g, v, max(CASE WHEN r = 2 THEN v END) OVER (PARTITION BY g) AS second FROM r")
def win_second(spark, sf):
    return lines(spark, sf).select("g", "v", W.second_best(["g"], "v", TIES).alias("second"))


@query(f"WITH {BEST} SELECT s1_id, o_id, p FROM best")
def win_one_to_one(spark, sf):
    return W.one_to_one(scored_pairs(spark, sf)).select("s1_id", "o_id", "p")


@query(f"WITH {BOTH} SELECT s1_id, o_id, score AS p FROM (SELECT *, max(score) OVER (PARTITION BY o_id) AS b FROM cand) WHERE score >= 0.9 * b - 1e-12")
def win_relative_best(spark, sf):
    return W.relative_one_to_one(scored_pairs(spark, sf), 0.9).select("s1_id", "o_id", "p")


@query(
    f"""WITH {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, o_id) AS rs, row_number() OVER (PARTITION BY o_id ORDER BY score DESC, s1_id) AS rc FROM cand)
SELECT s1_id, o_id, score, rank() OVER (PARTITION BY s1_id ORDER BY score DESC) AS score_rank_s1, round(max(score) OVER s - score, 6) AS score_gap_s1, CASE WHEN rs = 1 THEN coalesce(max(CASE WHEN rs = 2 THEN score END) OVER s, -1) ELSE max(score) OVER s END AS score_best_other_s1,
rank() OVER (PARTITION BY o_id ORDER BY score DESC) AS score_rank_c, round(max(score) OVER c - score, 6) AS score_gap_c, CASE WHEN rc = 1 THEN coalesce(max(CASE WHEN rc = 2 THEN score END) OVER c, -1) ELSE max(score) OVER c END AS score_best_other_c,
count(*) OVER s AS n_cands_s1, count(*) OVER c AS n_cands_c FROM r WINDOW s AS (PARTITION BY s1_id), c AS (PARTITION BY o_id)"""
)
def win_context(spark, sf):
    out = W.context_columns(candidates(spark, sf).select("s1_id", "o_id", "score"), ["score"])
    return out.withColumns({c: F.round(c, 6) for c in ("score_gap_s1", "score_gap_c")})


@query(
    f"""WITH {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, o_id) AS rs, row_number() OVER (PARTITION BY o_id ORDER BY score DESC, s1_id) AS rc, CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END AS hi FROM cand)
SELECT s1_id, o_id, rc AS l1_rank_o, rs AS l1_rank_s1, sum(hi) OVER c AS l1_n_hi_o, round(sum(score) OVER c, 6) AS l1_sum_o, sum(hi) OVER s AS l1_n_hi_s1, round(sum(score) OVER s, 6) AS l1_sum_s1, max(score) OVER s AS l1_max_s1,
CASE WHEN rc = 1 THEN 1.0 ELSE 0.0 END AS l1_is_best_o, sum(CASE WHEN rc = 1 THEN hi ELSE 0 END) OVER s AS l1_n_assigned_s1 FROM r WINDOW s AS (PARTITION BY s1_id), c AS (PARTITION BY o_id)"""
)
def win_level_two(spark, sf):
    out = W.level_two_columns(scored_pairs(spark, sf))
    return out.select("s1_id", "o_id", "l1_rank_o", "l1_rank_s1", "l1_n_hi_o", F.round("l1_sum_o", 6).alias("l1_sum_o"), "l1_n_hi_s1", F.round("l1_sum_s1", 6).alias("l1_sum_s1"), "l1_max_s1", "l1_is_best_o", "l1_n_assigned_s1")


EXPECTED = """e AS (SELECT user_id AS s1_id, event_id AS o_id, value / (1 + value) AS p, row_number() OVER (PARTITION BY user_id ORDER BY value / (1 + value) DESC, event_id) AS k FROM (SELECT user_id, event_id, abs(value) AS value FROM events WHERE value IS NOT NULL)),
x AS (SELECT *, 1.25 * sum(p) OVER (PARTITION BY s1_id ORDER BY k) / (0.25 * sum(p) OVER (PARTITION BY s1_id) + k) AS prefix_score FROM e),
t AS (SELECT *, max(prefix_score) OVER (PARTITION BY s1_id) AS top FROM x)"""


@query(f"WITH {EXPECTED} SELECT s1_id, o_id, round(prefix_score, 6) AS prefix_score, min(CASE WHEN prefix_score >= top - 1e-12 THEN k END) OVER (PARTITION BY s1_id) AS k_star, round(exp(sum(ln(1 - greatest(least(p, 1 - 1e-9), 0))) OVER (PARTITION BY s1_id)), 6) AS empty_score FROM t")
def win_prefix_expected_f(spark, sf):
    v = F.abs("value")
    e = table(spark, sf, "events").where("value IS NOT NULL").select(F.col("user_id").alias("s1_id"), F.col("event_id").alias("o_id"), (v / (1 + v)).alias("p"))
    out = R.expected_prefixes(e.withColumn("k", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "o_id"))))
    return out.select("s1_id", "o_id", F.round("prefix_score", 6).alias("prefix_score"), "k_star", F.round("empty_score", 6).alias("empty_score"))


# ---------------------------------------------------------------- decisions and metrics
def _predicted(where: str) -> str:
    return f", predicted AS (SELECT s1_id, o_id, p FROM best WHERE {where})"


@query(f"WITH {BEST}{_predicted('p >= 0.5')}{SCORED} SELECT round(avg(f), 6) AS macro, count(*) AS n FROM scores")
def metric_macro_f05(spark, sf):
    return M.macro_f_half(M.entity_scores(own(spark, sf), decided(spark, sf), truth(spark, sf))).select("macro", "n")


@query(
    f"""WITH {BEST}{_predicted('p >= 0.5')}{SCORED} SELECT round(avg(CASE WHEN n_true = 0 THEN f END), 6) AS singleton, CAST(sum(CASE WHEN n_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_singleton,
round(avg(CASE WHEN n_true = 1 THEN f END), 6) AS one, CAST(sum(CASE WHEN n_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_one, round(avg(CASE WHEN n_true > 1 THEN f END), 6) AS many, CAST(sum(CASE WHEN n_true > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_many FROM scores"""
)
def metric_breakdown(spark, sf):
    return M.macro_f_half(M.entity_scores(own(spark, sf), decided(spark, sf), truth(spark, sf))).drop("macro", "n")


@query(f"WITH {BEST}, predicted AS (SELECT s1_id, o_id FROM cand JOIN truth USING (s1_id, o_id)){SCORED} SELECT round(avg(f), 6) AS macro, count(*) AS n FROM scores")
def metric_ceiling(spark, sf):
    return M.ceiling(own(spark, sf), candidates(spark, sf), truth(spark, sf)).select("macro", "n")


@query(f"WITH {BOTH}{TRUTH} SELECT k, CAST(sum(CASE WHEN r_fwd <= k THEN 1 ELSE 0 END) AS BIGINT) AS n_found, round(sum(CASE WHEN r_fwd <= k THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM truth t LEFT JOIN cand c ON t.s1_id = c.s1_id AND t.o_id = c.o_id, (VALUES (1), (5), (10), (20)) g(k) GROUP BY k")
def block_recall_at(spark, sf):
    return B.recall_at(truth(spark, sf), candidates(spark, sf), [1, 5, 10, 20], "r_fwd")


GRID_SQL = f"""WITH {BEST}, grid AS (SELECT round(0.1 * unnest(range(1, 10)), 1) AS t),
n AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1), lab AS (SELECT b.s1_id, p, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS y FROM best b LEFT JOIN truth t ON b.s1_id = t.s1_id AND b.o_id = t.o_id),
c AS (SELECT s1_id, t, count(*) AS n_pred, sum(y) AS tp FROM lab JOIN grid ON p >= t GROUP BY 1, 2),
e AS (SELECT o.s1_id, o.ckey, g.t, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM own o CROSS JOIN grid g LEFT JOIN n USING (s1_id) LEFT JOIN c ON c.s1_id = o.s1_id AND c.t = g.t),
f AS (SELECT *, CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN n_pred = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END AS f FROM e)"""
TENTHS = [round(0.1 * i, 1) for i in range(1, 10)]


@query(GRID_SQL + " SELECT t, round(avg(f), 6) AS macro, count(*) AS n FROM f GROUP BY t")
def threshold_grid(spark, sf):
    return R.threshold_scores(own(spark, sf), scored_pairs(spark, sf), truth(spark, sf), TENTHS).withColumn("macro", F.round("macro", 6))


@query(GRID_SQL + " SELECT ckey, t, round(avg(f), 6) AS macro, count(*) AS n FROM f GROUP BY ckey, t")
def threshold_grid_country(spark, sf):
    return R.threshold_scores(own(spark, sf), scored_pairs(spark, sf), truth(spark, sf), TENTHS, "ckey").withColumn("macro", F.round("macro", 6))


@query(f"WITH {BEST} SELECT s1_id, o_id, p FROM best WHERE p >= 0.6 OR (k = 1 AND p >= 0.3)")
def decide_two_threshold(spark, sf):
    return R.decide_two_thresholds(R.ranked_best(scored_pairs(spark, sf)), 0.3, 0.6).select("s1_id", "o_id", "p")


@query(
    f"""WITH {BEST}, x AS (SELECT *, 1.25 * sum(p) OVER (PARTITION BY s1_id ORDER BY k) / (0.25 * sum(p) OVER (PARTITION BY s1_id) + k) AS sc FROM best),
t AS (SELECT *, max(sc) OVER g AS top, exp(sum(ln(1 - greatest(least(p, 1 - 1e-9), 0))) OVER g) AS none FROM x WINDOW g AS (PARTITION BY s1_id)),
u AS (SELECT *, min(CASE WHEN sc >= top - 1e-12 THEN k END) OVER (PARTITION BY s1_id) AS ks FROM t) SELECT s1_id, o_id, p FROM u WHERE top > none AND k <= ks"""
)
def decide_expected_f(spark, sf):
    return R.decide_expected(R.ranked_best(scored_pairs(spark, sf))).select("s1_id", "o_id", "p")


@query(f"WITH {BOTH} SELECT s1_id, o_id, p, CASE WHEN place = 1 AND p >= 0.9 THEN 1 ELSE 0 END AS label FROM (SELECT *, max(CASE WHEN place = 1 AND p >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY o_id) AS good FROM (SELECT s1_id, o_id, score AS p, row_number() OVER (PARTITION BY o_id ORDER BY score DESC, s1_id) AS place FROM cand)) WHERE (place = 1 AND p >= 0.9) OR (good = 1 AND p <= 0.05)")
def decide_pseudo_labels(spark, sf):
    return R.confident_labels(scored_pairs(spark, sf), 0.9, 0.05).select("s1_id", "o_id", "p", "label")


@query(f"WITH {BOTH} SELECT s1_id, o_id, p FROM (SELECT s1_id, o_id, score AS p, row_number() OVER (PARTITION BY o_id ORDER BY score DESC, s1_id) AS ro, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, o_id) AS rs FROM cand) WHERE ro <= 2 OR (p >= 0.2 AND (ro <= 5 OR rs <= 15))")
def prefilter_keep(spark, sf):
    return R.prefilter_keep(scored_pairs(spark, sf), 0.2).select("s1_id", "o_id", "p")


AUC = "x AS (SELECT d.n_chars AS v, l.quality AS y FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT v, CAST(sum(y) AS DOUBLE) AS pos, count(*) - sum(y) AS neg, count(*) AS n FROM x GROUP BY v)"


def quality_scores(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")


@query(f"WITH {AUC} SELECT round(sum(pos * (u + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM g)")
def metric_auc(spark, sf):
    return M.roc_auc(quality_scores(spark, sf), "n_chars", "quality").select(F.round("auc", 6).alias("auc"))


@query(f"WITH {AUC} SELECT round(sum(pos * tp / taken) / sum(pos), 6) AS ap FROM (SELECT *, sum(pos) OVER (ORDER BY v DESC) AS tp, sum(n) OVER (ORDER BY v DESC) AS taken FROM g)")
def metric_average_precision(spark, sf):
    return M.average_precision(quality_scores(spark, sf), "n_chars", "quality").select(F.round("ap", 6).alias("ap"))


# ---------------------------------------------------------------- statistics and reports
@query("WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS b FROM orders) SELECT round(corr(a, b), 6) AS rho FROM r")
def stat_spearman(spark, sf):
    return W.spearman(table(spark, sf, "orders"), "o_totalprice", "o_custkey").select(F.round("rho", 6).alias("rho"))


@query("SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS F, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS O FROM lineitem GROUP BY 1")
def stat_crosstab(spark, sf):
    return T.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 3) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 3) AS O FROM lineitem GROUP BY 1")
def stat_pivot_mean(spark, sf):
    return T.pivot_mean(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"])


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3, quantile_cont(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS top FROM lineitem GROUP BY 1")
def stat_describe(spark, sf):
    return T.describe(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT least(n, 10) AS bucket, count(*) AS n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def stat_hist(spark, sf):
    return T.group_sizes(table(spark, sf, "lineitem"), "l_orderkey", 10)


@query("SELECT p_size AS bucket, count(*) AS n FROM part GROUP BY 1")
def stat_value_counts(spark, sf):
    return T.value_counts(table(spark, sf, "part"), "p_size")


@query(f"WITH {REC} SELECT ckey, tok, n FROM (SELECT ckey, tok, count(*) AS n, row_number() OVER (PARTITION BY ckey ORDER BY count(*) DESC, tok) AS r FROM post GROUP BY 1, 2) WHERE r <= 30")
def stat_top_tokens(spark, sf):
    counts = B.postings(records(spark, sf)).groupBy("ckey", "tok").agg(F.count("*").alias("n"))
    return W.top_k(counts, ["ckey"], "n", ["tok"], 30).select("ckey", "tok", "n")


@query("SELECT lang, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def stat_shares(spark, sf):
    return E.country_shares(table(spark, sf, "documents"), "lang")


@query("SELECT count(*) AS n, count(*) - count(DISTINCT doc_id) AS n_duplicate, round(avg(CASE WHEN coalesce(text, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS text_blank, round(avg(length(text)), 6) AS text_length, round(avg(CASE WHEN coalesce(source, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS source_blank, round(avg(length(source)), 6) AS source_length FROM documents")
def stat_list_profile(spark, sf):
    return E.list_profile(table(spark, sf, "documents"), "doc_id", ["text", "source"])


@query(
    r"""SELECT lang, count(*) AS n, round(avg(CASE WHEN regexp_matches(text || ' ' || source, '[^\x00-\x7F]') THEN 1.0 ELSE 0.0 END), 6) AS non_ascii, round(avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS digits,
round(avg(CASE WHEN contains(text, '&') THEN 1.0 ELSE 0.0 END), 6) AS ampersand, round(avg(CASE WHEN text = upper(text) AND text <> lower(text) THEN 1.0 ELSE 0.0 END), 6) AS capitals,
0.0 AS postcode, round(avg(CASE WHEN regexp_matches(source, '(?i)\b(?:near|nr|opp|opposite|behind|beside)\b') THEN 1.0 ELSE 0.0 END), 6) AS landmark FROM documents GROUP BY 1"""
)
def stat_character_profile(spark, sf):
    return E.character_profile(table(spark, sf, "documents"), "lang", "text", "source").drop("marker")


@query("WITH p AS (SELECT *, (row_number() OVER () - 1) / (SELECT count(*) FROM orders) AS pos FROM orders), t AS (SELECT a.pos AS x, b.pos AS y FROM p a JOIN p b ON a.o_custkey = b.o_orderkey), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM t) SELECT round(corr(a, b), 6) AS rho FROM r")
def stat_row_order(spark, sf):
    """Orders whose customer key is another order's key stand for matching rows."""
    orders = table(spark, sf, "orders")
    places = E.file_positions(orders, "o_orderkey")
    matches = orders.select(F.col("o_orderkey").alias("s1_id"), F.col("o_custkey").alias("o_id"))
    return E.row_order_rho(matches, places.withColumnRenamed("o_orderkey", "s1_id"), places.withColumnRenamed("o_orderkey", "o_id")).select(F.round("rho", 6).alias("rho"))


ERR = """, given AS (SELECT o_id, s1_id AS got FROM predicted),
fn AS (SELECT t.s1_id, CASE WHEN c.s1_id IS NULL THEN 'fn_blocking' WHEN got IS NOT NULL THEN 'fn_competition' ELSE 'fn_threshold' END AS e FROM truth t LEFT JOIN cand c ON c.s1_id = t.s1_id AND c.o_id = t.o_id LEFT JOIN given g ON g.o_id = t.o_id WHERE got IS NULL OR got <> t.s1_id),
owner AS (SELECT o_id, min(s1_id) AS s1_id FROM truth GROUP BY 1),
fp AS (SELECT p.s1_id, CASE WHEN w.s1_id IS NULL THEN 'fp_no_entity' ELSE 'fp_wrong_s1' END AS e FROM predicted p LEFT JOIN owner w ON w.o_id = p.o_id WHERE w.s1_id IS NULL OR w.s1_id <> p.s1_id)"""
_COUNT = ", ".join(f"CAST(sum(CASE WHEN e = '{e}' THEN 1 ELSE 0 END) AS BIGINT) AS {e}" for e in E.ERRORS)
_SUM = ", ".join(f"CAST(sum(coalesce({e}, 0)) AS BIGINT) AS {e}, round(sum(CASE WHEN errors > 0 THEN {e} / errors * (1 - f) ELSE 0 END), 6) AS {e}_loss" for e in E.ERRORS)


@query(f"WITH {BEST}{_predicted('p >= 0.5')}{SCORED}{ERR}, k AS (SELECT s1_id, count(*) AS errors, {_COUNT} FROM (SELECT * FROM fn UNION ALL SELECT * FROM fp) GROUP BY 1) SELECT CASE WHEN grouping(ckey) = 1 THEN 'ALL' ELSE ckey END AS country, count(*) AS n_s1, round(avg(f), 6) AS macro, {_SUM} FROM scores s LEFT JOIN k ON s.s1_id = k.s1_id GROUP BY ROLLUP (ckey)")
def errors_attribution(spark, sf):
    found = candidates(spark, sf)
    return E.attribute_errors(own(spark, sf), found, decided(spark, sf, found=found), truth(spark, sf))


@query(
    f"""WITH {BEST}{_predicted('p >= 0.5')}, given AS (SELECT o_id, min(s1_id) AS got FROM predicted GROUP BY 1), first AS (SELECT o_id, arg_max(s1_id, (score, s1_id)) AS first FROM cand GROUP BY 1),
fn AS (SELECT CASE WHEN c.s1_id IS NULL THEN 'fn_blocking' WHEN got IS NOT NULL THEN 'fn_competition' ELSE 'fn_threshold' END AS error, t.s1_id, t.o_id, coalesce(got, first) AS other_s1 FROM truth t LEFT JOIN cand c ON c.s1_id = t.s1_id AND c.o_id = t.o_id LEFT JOIN given g ON g.o_id = t.o_id LEFT JOIN first f ON f.o_id = t.o_id WHERE got IS NULL OR got <> t.s1_id),
fp AS (SELECT CASE WHEN w.s1_id IS NULL THEN 'fp_no_entity' ELSE 'fp_wrong_s1' END AS error, p.s1_id, p.o_id, w.s1_id AS other_s1 FROM predicted p LEFT JOIN truth w ON w.o_id = p.o_id WHERE w.s1_id IS NULL OR w.s1_id <> p.s1_id)
SELECT error, e.s1_id, e.o_id, a.score AS p_this, other_s1, b.score AS p_other FROM (SELECT * FROM fn UNION ALL SELECT * FROM fp) e LEFT JOIN cand a ON a.s1_id = e.s1_id AND a.o_id = e.o_id LEFT JOIN cand b ON b.s1_id = e.other_s1 AND b.o_id = e.o_id"""
)
def errors_examples(spark, sf):
    """All of them: the report's limit is larger than the table."""
    found = candidates(spark, sf)
    return E.error_examples(decided(spark, sf, found=found), truth(spark, sf), found.withColumnRenamed("score", "p"), found, 1 << 30)


@query(
    f"""WITH {BOTH}, own AS (SELECT id AS s1_id, ckey FROM rec WHERE is_s1), b AS (SELECT c.s1_id, c.score AS p, o.ckey, row_number() OVER (PARTITION BY c.o_id ORDER BY c.score DESC, c.s1_id) AS place FROM cand c JOIN own o ON o.s1_id = c.s1_id),
t AS (SELECT ckey, count(*) AS n_records, round(avg(p), 6) AS mean_best, round(avg(CASE WHEN p > 0.1 AND p < 0.9 THEN 1.0 ELSE 0.0 END), 6) AS unsure FROM b WHERE place = 1 GROUP BY 1),
e AS (SELECT ckey, round(avg(CASE WHEN s1_id IN (SELECT s1_id FROM b WHERE place = 1 AND p >= 0.5) THEN 0.0 ELSE 1.0 END), 6) AS empty FROM own GROUP BY 1) SELECT e.ckey, empty, n_records, mean_best, unsure FROM e LEFT JOIN t USING (ckey)"""
)
def profile_confidence(spark, sf):
    s1 = own(spark, sf)
    return E.confidence_profile(scored_pairs(spark, sf).join(s1, "s1_id"), s1)


@query(f"WITH {BOTH}{TRUTH} SELECT s1_id, o_id, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, o_id) AS r FROM cand WHERE (s1_id, o_id) NOT IN (SELECT (s1_id, o_id) FROM truth)) WHERE r = 1")
def hard_negatives(spark, sf):
    return E.hard_negatives(candidates(spark, sf), truth(spark, sf)).select("s1_id", "o_id", "score")


@query()
def random_negatives(spark, sf):
    rec = records(spark, sf).select("id", "ckey", "is_s1")
    return E.random_negatives(rec.where("is_s1"), rec.where("NOT is_s1"), truth(spark, sf))


DRAWN = "CAST('0x' || substr(md5('{0}' || CAST({1} AS VARCHAR)), 1, 8) AS BIGINT)"


@query(f"SELECT c_custkey FROM customer WHERE {DRAWN.format('drop:', 'c_custkey')} % 100000 >= 19000")
def sample_hash(spark, sf):
    return I.keep_fraction(table(spark, sf, "customer"), "c_custkey", 0.19).select("c_custkey")


@query(f"SELECT c_custkey, CAST({DRAWN.format('fold:', 'c_custkey')} % 3 AS INTEGER) AS fold FROM customer")
def folds(spark, sf):
    from linkloom.operators.learn import fold_of

    return table(spark, sf, "customer").select("c_custkey", fold_of("c_custkey", 3).alias("fold"))


@query(f"WITH k AS (SELECT s_suppkey FROM supplier WHERE {DRAWN.format('sample:', 's_suppkey')} % 100000 >= 75000), p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT 'S1' AS kind, s_suppkey AS id FROM k UNION ALL SELECT 'other', p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM p JOIN k ON l_suppkey = s_suppkey) OR (p_partkey NOT IN (SELECT l_partkey FROM p) AND {DRAWN.format('sample:', 'p_partkey')} % 100000 >= 75000)")
def sample_structural(spark, sf):
    """A quarter of the suppliers with all their parts, and of the parts without a supplier."""
    s1 = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s1_id"))
    others = table(spark, sf, "part").select(F.col("p_partkey").alias("o_id"))
    sold = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s1_id"), F.col("l_partkey").alias("o_id")).distinct()
    some, rest = I.structural_sample(s1, others, sold, 0.25)
    return some.select(F.lit("S1").alias("kind"), F.col("s1_id").alias("id")).unionByName(rest.select(F.lit("other").alias("kind"), F.col("o_id").alias("id")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def keep_first(spark, sf):
    return I.keep_first(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


UNFIT = f"(regexp_matches(t, '[0-9]') OR {_among('t', [*D.LEGAL_FORMS, *D.NAME_NOISE])})"


@query(
    f"""WITH {BEST}, m AS (SELECT s1_id, o_id FROM best WHERE p >= 0.5),
d AS (SELECT list_filter(a.toks, lambda t: NOT list_contains(b.toks, t)) AS l, list_filter(b.toks, lambda t: NOT list_contains(a.toks, t)) AS r FROM m JOIN rec a ON a.id = s1_id JOIN rec b ON b.id = o_id)
SELECT kind, tok, count(*) AS n FROM (SELECT 'dropped' AS kind, unnest(l) AS tok FROM d UNION ALL SELECT 'added', unnest(r) FROM d) GROUP BY 1, 2"""
)
def synonym_changes(spark, sf):
    rec = records(spark, sf).select("id", "toks")
    m = decided(spark, sf).join(rec.select(F.col("id").alias("s1_id"), F.col("toks").alias("ta")), "s1_id").join(rec.select(F.col("id").alias("o_id"), F.col("toks").alias("tb")), "o_id")
    return Y.token_changes(m)


@query(
    f"""WITH RECURSIVE {BEST}, raw AS (SELECT doc_id AS id, text FROM documents),
m AS (SELECT a.toks AS ta, b.toks AS tb, CASE WHEN regexp_matches(text, '[^\\x{{0}}-\\x{{24F}}]') THEN 1 ELSE 0 END AS script FROM best JOIN rec a ON a.id = s1_id JOIN rec b ON b.id = o_id JOIN raw ON raw.id = o_id WHERE p >= 0.5),
d AS (SELECT script, list_filter(ta, lambda t: NOT list_contains(tb, t) AND NOT {UNFIT}) AS l, list_filter(tb, lambda t: NOT list_contains(ta, t) AND NOT {UNFIT} AND len(t) >= 2) AS r FROM m),
each AS (SELECT l, script, unnest(r) AS b FROM d WHERE len(r) > 0 AND len(l) <= 3 AND len(r) <= 3),
seen AS (SELECT b, count(*) AS seen, sum(script) / count(*) AS script_share FROM each GROUP BY b),
both_ AS (SELECT b, a, count(*) AS n FROM (SELECT b, unnest(l) AS a FROM each) GROUP BY b, a),
good AS (SELECT b, a, n, seen, script_share FROM both_ JOIN seen USING (b) WHERE n / seen >= 0.3),
need AS (SELECT b AS x, a AS y FROM good){RATIO}
SELECT b, a, n, seen, script_share FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS place FROM good JOIN ratio ON x = b AND y = a WHERE script_share >= 0.5 OR r >= 50) WHERE place = 1"""
)
def synonym_mine(spark, sf):
    rec = records(spark, sf).select("id", "toks", "text")
    m = decided(spark, sf).join(rec.select(F.col("id").alias("s1_id"), F.col("toks").alias("ta")), "s1_id").join(rec.select(F.col("id").alias("o_id"), F.col("toks").alias("tb"), F.col("text").alias("raw_b")), "o_id")
    return Y.mine(m, min_count=1, min_ratio=0.3)


def ordered(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def join_semi(spark, sf):
    return I.filtered_by_ids(table(spark, sf, "orders"), ordered(spark, sf), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_anti(spark, sf):
    return I.without_ids(table(spark, sf, "orders"), ordered(spark, sf), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, round(CAST(CAST(ln(1 + coalesce(n, 0)) AS FLOAT) AS DOUBLE), 4) AS freq FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def join_frequency(spark, sf):
    out = P.name_frequency(table(spark, sf, "part"), table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey"], "freq")
    return out.select("p_partkey", F.round(F.col("freq").cast("double"), 4).alias("freq"))


@query("SELECT p_partkey, round(CAST(CAST(ln(1 + n) AS FLOAT) AS DOUBLE), 4) AS freq FROM part JOIN (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) USING (p_brand, p_name)")
def join_frequency_block(spark, sf):
    parts = table(spark, sf, "part")
    return P.name_frequency(parts, parts, ["p_brand", "p_name"], "freq").select("p_partkey", F.round(F.col("freq").cast("double"), 4).alias("freq"))


@query("SELECT c_custkey AS source1_entity_id, CAST(o_orderkey AS VARCHAR) AS o_id FROM customer JOIN orders ON o_custkey = c_custkey")
def truth_explode(spark, sf):
    written = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source1_entity_id")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ", ").alias("matched_entity_ids"))
    present = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    return I.truth_pairs(written, present).select(F.col("s1_id").alias("source1_entity_id"), "o_id")


@query("SELECT c_custkey AS s1_id, count(o_orderkey) AS n_true FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def truth_sizes(spark, sf):
    written = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source1_entity_id")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ",").alias("matched_entity_ids"))
    return I.truth_sizes(written, table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id")))


@query(f"WITH {BEST} SELECT o.s1_id, coalesce(string_agg(CAST(b.o_id AS VARCHAR), ',' ORDER BY b.o_id), '') AS matched FROM own o LEFT JOIN best b ON b.s1_id = o.s1_id AND b.p >= 0.5 GROUP BY 1")
def output_lists(spark, sf):
    from linkloom.sources.tables import id_lists

    return id_lists(own(spark, sf), decided(spark, sf), "matched")


def _labelled(df: DataFrame, pairs_: DataFrame) -> DataFrame:
    return df.join(pairs_.withColumn("label", F.lit(1)), ["s1_id", "o_id"], "left").na.fill(0, ["label"])


@query()
def prefilter_gbt(spark, sf):
    from linkloom.operators.learn import out_of_fold

    a, b, pairs_ = lists(spark, sf)
    data = I.materialised(_labelled(P.cheap_features(merged(a, b), a, b), pairs_))
    return out_of_fold(data, P.CHEAP, "p1")[0].select("s1_id", "o_id", "label", F.round("p1", 6).alias("p1"))


@query()
def stack_oof(spark, sf):
    from linkloom.operators.learn import stacked

    a, b, pairs_ = lists(spark, sf)
    cand = merged(a, b).withColumn("p1", F.col("score"))
    data = I.materialised(_labelled(P.pair_features(cand, a, b, embeddings=True), pairs_))
    out, _ = stacked(data, P.feature_names(True), saved=lambda name, df: I.materialised(df))
    return out.select("s1_id", "o_id", "label", F.round("p", 6).alias("p"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
