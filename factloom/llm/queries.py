"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.decontaminate import contamination
from factloom.llm.html import extract_text
from factloom.llm.jaccard import jaccard_components
from factloom.llm.language_model import score_documents
from factloom.llm.licenses import COPYRIGHT_LINE, NOTICES, SPELLINGS, scan_licenses
from factloom.llm.mixing import mix_sizes
from factloom.llm.quality import quality
from factloom.llm.secrets import scan_secrets
from factloom.llm.suffixes import remove_repeats
from factloom.llm.tokenstore import token_store

#: The vocabulary of op8, a file of the public tokenizers outside the repository.
VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(_table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).drop("text_hash", "label")


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix": op2_mix,
    "op3_jaccard": op3_jaccard,
    "op4_extract_html": op4_extract_html,
    "op5_language_model": op5_language_model,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_store": op8_token_store,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
}

def _canonical_sql(text: str) -> str:
    """The canonical form of a licence text, in DuckDB."""
    t = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = f"regexp_replace({t}, '{COPYRIGHT_LINE}', ' ', 'g')"
    t = "' ' || trim(regexp_replace(" + t + r", '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g'), ' ') || ' '"
    for old, new in SPELLINGS:
        t = f"replace({t}, ' {old} ', ' {new} ')"
    return f"trim({t}, ' ')"


def _notice_rows() -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in NOTICES)


FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 12] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
part AS (SELECT r, n, i, w[i:i + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item_id FROM part JOIN win USING (win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op3_jaccard": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
t AS (SELECT r AS a, r AS b FROM n UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(z.doc_id) FROM t JOIN d z ON z.r = t.b WHERE t.a = d.r), d.doc_id) AS component_id FROM d LEFT JOIN n USING (r)""",
    "op10_licenses": f"""
WITH known AS (SELECT sha256({_canonical_sql("t.text")}) AS digest, min(t.name) AS licence FROM (VALUES {_notice_rows()}) AS t(name, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS unit FROM d),
hit AS (SELECT r, licence FROM line JOIN known ON digest = sha256({_canonical_sql("unit")})),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM hit GROUP BY r)
SELECT doc_id, (SELECT licence FROM known WHERE digest = sha256({_canonical_sql("d.text")})) AS license, coalesce(n, 0) AS n_license_lines, coalesce(names, '') AS licenses FROM d LEFT JOIN n USING (r)""",
    "op2_mix": r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level AS found FROM l WHERE level * weight <= cap ORDER BY cap / weight, k LIMIT 1),
t AS (SELECT k, source_size, least(cap, found * weight) AS target, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END AS ramp FROM l, f),
c AS (SELECT d.*, source_size, target, CAST(ramp AS DOUBLE) AS ramp, CAST(round(target) AS BIGINT) AS whole, coalesce(sum(size) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM d JOIN t USING (k)),
u AS (SELECT *, CASE WHEN least(size, greatest(whole - begun, 0)) > 0 THEN least(1.0, (begun + least(size, greatest(whole - begun, 0)) / 2) / whole) END AS share FROM c)
SELECT doc_id, size, source_size, target, CAST(least(size, greatest(whole - begun, 0)) + least(size, greatest(whole - begun - source_size, 0)) + least(size, greatest(whole - begun - 2 * source_size, 0)) AS BIGINT) AS taken,
  CASE WHEN ramp = 0 THEN share ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share) - (1 - ramp)) / (2 * ramp) END AS first_position FROM u""",
}
