"""The driver's queries for these operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words
from .decontaminate import leaks
from .jaccard_join import jaccard_join
from .line_dedup import line_dedup
from .mixing import mix_sources
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .suffix_dedup import suffix_dedup
from .token_binary import token_binary
from .toxicity import toxicity
from .url_filter import url_filter


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), shingle=5, threshold=0.8)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(_remainder(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity(_table(spark, sf_dir, "documents"), labels, threshold=0.3)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))
    out = quality_scores(_table(spark, sf_dir, "documents"), labels, threshold=0.3)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "finish", "mix_end")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    out = quality_rules(_table(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_toxicity, op3_quality, op4_suffix_dedup, op5_url_filter, op6_mixing, op7_decontaminate, op8_quality_rules, op9_line_dedup, op10_token_binary)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * m >= 8 * (x.n + y.n - m)),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.doc_id WHERE c.root < l.b),
k AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT c.doc_id, min(root) AS class_id, coalesce(any_value(k), 0) AS n_links FROM c LEFT JOIN k ON a = c.doc_id GROUP BY 1""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS k FROM d),
h AS (SELECT *, substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || k), 1, 16) AS h FROM r),
e AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST, size, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM h),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT min_by(level, (cap / weight, place)) AS level FROM l WHERE level * weight < cap),
t AS (SELECT source, source_size, CAST(floor(budget) AS BIGINT) AS budget, CASE WHEN l.level * weight >= cap THEN cap ELSE o.level * weight END AS target FROM l LEFT JOIN o ON true),
q AS (SELECT doc_id, e.source, size, k, source_size, target, budget, round, upto + round * source_size AS stop, CAST(floor(target) AS BIGINT) AS goal
      FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) v(round) WHERE round = 0 OR size > 0),
p AS (SELECT *, 0 AS tail, goal - stop + size AS words, CAST(1 AS DOUBLE) AS finish FROM q WHERE stop - size < goal AND goal < stop UNION ALL
      SELECT *, 1, stop - goal, stop / target FROM q WHERE stop - size < goal AND goal < stop UNION ALL
      SELECT *, 0, size, CASE WHEN target > 0 THEN stop / target ELSE 32768 END FROM q WHERE NOT (stop - size < goal AND goal < stop)),
m AS (SELECT *, CAST(sum(words) OVER (ORDER BY finish, source NULLS LAST, doc_id NULLS LAST, size, k, round, tail ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mix_end FROM p),
x AS (SELECT *, greatest(0, words - greatest(0, mix_end - budget)) AS taken FROM m)
SELECT doc_id, size, source_size, target, CAST(sum(taken) AS BIGINT) AS taken, min(finish) AS finish,
       nullif(min_by(CASE WHEN taken > 0 THEN mix_end ELSE -1 END, (finish, round, tail)), -1) AS mix_end
FROM x GROUP BY doc_id, source, size, k, source_size, target""",
    "op9_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
