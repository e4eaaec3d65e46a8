"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm.crossentropy import score_documents
from halyard.llm.decontaminate import contamination
from halyard.llm.lines import dedup_lines
from halyard.llm.minhash import near_duplicates
from halyard.llm.packing import pack
from halyard.llm.pii import find_personal_data
from halyard.llm.quality import score_quality
from halyard.llm.secrets import find_secrets
from halyard.llm.spots import against_next
from halyard.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles at 0.85."""
    return near_duplicates(_read(spark, sf_dir, "documents"), words=3, percent=85).drop("row", "row2")


OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^ \\t\\n\\x0b\\x0c\\r]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i : i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS sh
  FROM w WHERE ws IS NOT NULL
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT a AS doc_id, a AS other FROM e
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
), m AS (SELECT doc_id, min(other) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
  least(d.doc_id, coalesce(m.root, d.doc_id))::BIGINT AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.root, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight words; two items make a document contaminated."""
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(" + LOWER.format("text") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7_SQL = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(len(ws), 8) AS size, unnest([array_to_string(ws[i : i + 7], ' ') FOR i IN range(1, greatest(len(ws) - 7, 1) + 1)]) AS w
  FROM b WHERE len(ws) > 0
), d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents
), z AS (SELECT DISTINCT size FROM p
), q AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS ix, ws FROM d, z
), h AS (
  SELECT q.doc_id, q.ix, p.size, p.item FROM q JOIN p ON p.size = q.size AND p.w = array_to_string(q.ws[q.ix : q.ix + q.size - 1], ' ')
), n AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(ix, ix + size)) AS pos FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(i.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens of the lower-casing word vocabulary."""
    import public_tokenizers

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without their repeated lines."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_removed_lines", "text")


def op9_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(_read(spark, sf_dir, "documents"))


def op2_crossentropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_crossentropy": op2_crossentropy,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_spots": op9_spots,
    "op10_lines": op10_lines,
}
SQL: dict[str, str] = {"op1_minhash": OP1_SQL, "op7_decontamination": OP7_SQL}
