"""The registered queries of the training-data operators: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, blockmax, mixing, packing, pii, quality, simhash, suffixes, tokens, toxicity
from tidemark.llm.common import stash, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.measured(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    narrow = mixing.numbered(rows.select(F.col("row.doc_id").alias("doc_id"), "source", "size", "imp", "u", "rh"))
    taken = mixing.copies(narrow, mixing.plan(narrow)[0])
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, by_word=True)
    return tokens.read(files).drop("ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, budget=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "text", "n_entities")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for poor, 1 for good but toxic, 2 for good and clean text. Kept is what is more likely good than not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")))
    return quality.scores(docs, model, grade=1, keep=0.5).select("row.doc_id", "expected_grade", "tail_probability", "keep")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_tokens": op2_tokens,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_ann": op5_ann,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_blockmax": op8_blockmax,
    "op9_quality": op9_quality,
    "op10_suffixes": op10_suffixes,
}

def _fill_sql(k: int, where: str) -> str:
    """A fill: of the documents beyond the prefix the one whose size comes nearest to what is left of the target, if that comes closer."""
    return f"""
f{k} AS (SELECT sid, arg_min(rid, (abs(gap - size), key, rid)) AS f{k}, arg_min(size, (abs(gap - size), key, rid)) AS s FROM line JOIN g{k - 1} USING (sid)
         WHERE NOT inside AND abs(gap - size) < abs(gap) {where} GROUP BY sid),
g{k} AS (SELECT g.* REPLACE (gap - coalesce(s, 0) AS gap), f{k} FROM g{k - 1} g LEFT JOIN f{k} USING (sid))"""


ORACLE_SQL: dict[str, str] = {
    "op8_blockmax": """
WITH v AS (SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op1_mixing": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '~') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
m AS (SELECT *, ceil(32 * (size + 8.0::DOUBLE) / (size + 16)) / 32.0::DOUBLE AS imp FROM d),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((sid - 1) % 3) + 1] AS w, source_size * 2.0::DOUBLE AS most FROM per),
level AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY most / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
target AS (SELECT source, sid, source_size, least(most, max(level) OVER () * w) AS target FROM level),
placed0 AS (SELECT m.*, t.sid, t.target FROM m JOIN target t ON m.source IS NOT DISTINCT FROM t.source),
bands AS (SELECT sid, imp, any_value(target) AS target, sum(size)::BIGINT AS words FROM placed0 GROUP BY sid, imp HAVING sum(size) > 0),
lams AS (SELECT *, (target - coalesce(sum(words) OVER (PARTITION BY sid ORDER BY imp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
             / sum(imp * words) OVER (PARTITION BY sid ORDER BY imp DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM bands),
scale AS (SELECT sid, max_by(lam, imp) AS lam FROM lams WHERE lam * imp <= 2 GROUP BY sid),
expected AS (SELECT p.*, least(2.0::DOUBLE, CASE WHEN t.source_size > 0 THEN coalesce(lam, 'inf'::DOUBLE) ELSE 0 END * imp) AS e
             FROM placed0 p JOIN target t USING (sid) LEFT JOIN scale USING (sid)),
odds AS (SELECT *, floor(e) AS whole, (u / (1 - u)) * ((1 - (e - floor(e))) / nullif(e - floor(e), 0)) AS o FROM expected),
placed AS (SELECT rid, doc_id, source, sid, size, whole, CASE WHEN size > 0 THEN floor(o / (1 + o) * 281474976710656.0::DOUBLE)::BIGINT END AS key FROM odds),
t0 AS (SELECT t.*, target - coalesce((SELECT sum(whole * size) FROM placed p WHERE p.sid = t.sid), 0) AS gap FROM target t),
sums AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY key, rid ROWS UNBOUNDED PRECEDING) AS cum FROM placed WHERE key IS NOT NULL),
line AS (SELECT s.* , cum <= t.gap AS inside FROM sums s JOIN t0 t USING (sid)),
g0 AS (SELECT t.sid, gap - coalesce((SELECT max(cum) FROM line l WHERE l.sid = t.sid AND inside), 0) AS gap FROM t0 t),{_fill_sql(1, "")},{_fill_sql(2, "AND f1 IS DISTINCT FROM rid")},
took AS (SELECT p.*, t.target, t.source_size, (p.whole + (coalesce(l.inside, false) OR coalesce(p.rid = f1, false) OR coalesce(p.rid = f2, false))::INT)::BIGINT AS copies
         FROM placed p JOIN t0 t USING (sid) LEFT JOIN line l USING (rid) LEFT JOIN g2 ON g2.sid = p.sid)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies * size AS taken, source, copies FROM took""",
}
