"""Frames that several queries start from, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources import read_table

def ascii_words(x: str) -> str:
    """Letters and digits of all scripts as underscores, blanks as U+0020, other non-ASCII characters as a control, so that DuckDB's word boundary sees them as Spark's does."""
    spaces = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '{spaces}', ' ', 'g'), '[^\x00-\x7F\p{{L}}\p{{N}}]', chr(1), 'g'), '[^\x00-\x7F]', '_', 'g')"


NUMBER_SQL = r"\b\d+\.?\d*\b"
NUMBER_EXP_SQL = r"\b\d+\.?\d*(?:[eE][+-]?\d+)?\b"
NUMBER_COMMA_SQL = r"\b\d+(?:[.,]\d+)?\b"
PLACEHOLDER_SQL = r"@@[A-Z]+(?:_[A-Z]+)+_\d{4}_[A-F0-9]{8}@@"
BULLET_SQL = r"(?m)^[\s]*[-•*]\s"
#: White space as Spark's Unicode class has it.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = r"[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def norm_sql(x: str) -> str:
    one = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return f"lower({strip_sql(one)})"


def lines_sql(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda w: regexp_matches(w, '{NWS}')))"


def numbers_sql(x: str, pattern: str = NUMBER_SQL) -> str:
    return f"regexp_extract_all({ascii_words(x)}, '{pattern}')"


def bullets_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{BULLET_SQL}'))"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Distinct requests; rows delivered again count once."""
    return read_table(spark, d, "requests").dropDuplicates(["request_id"])


def results(spark: SparkSession, d: str) -> DataFrame:
    """Distinct results with the backend in one spelling."""
    r = read_table(spark, d, "results").dropDuplicates(["result_id"])
    return r.withColumn("backend", F.translate(F.lower(F.trim("backend")), "-", "_"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate with its request: result_id, idx, request_id, doc_id, block_id, backend, source_text, translated_text, is_header, registry, errors, ok."""
    q = requests(spark, d).select(
        "request_id", "doc_id", "block_id", F.coalesce("text", F.lit("")).alias("source_text"), F.coalesce("is_header", F.lit(False)).alias("is_header"),
        "target_lang", "n_candidates"
    )
    r = results(spark, d).select("result_id", "request_id", "backend", "model", "cached", F.posexplode("candidates").alias("idx", "c"))
    j = r.join(q, "request_id").withColumn("translated_text", F.coalesce("c", F.lit(""))).drop("c")
    reg = F.array_distinct(T.matches(F.col("source_text"), T.PLACEHOLDER))
    j = j.withColumn("registry", reg).withColumn(
        "errors", F.transform(F.filter("registry", lambda p: ~F.col("translated_text").contains(p)), lambda p: F.concat(F.lit("missing_placeholder:"), p))
    )
    return j.withColumn("ok", T.strip(F.col("translated_text")) != "")


PAIRS = rf"""
q0 AS (SELECT DISTINCT request_id, doc_id, block_id, coalesce(text, '') AS source_text, coalesce(is_header, false) AS is_header, target_lang, n_candidates FROM requests),
r0 AS (SELECT DISTINCT result_id, request_id, replace(lower(trim(backend)), '-', '_') AS backend, model, cached, candidates FROM results),
r1 AS (SELECT result_id, request_id, backend, model, cached, unnest(range(len(candidates)))::INT AS idx, candidates FROM r0),
p0 AS (SELECT r1.result_id, r1.idx, r1.request_id, q0.doc_id, q0.block_id, r1.backend, r1.model, r1.cached, q0.source_text, coalesce(r1.candidates[r1.idx + 1],
  '') AS translated_text, q0.is_header, q0.target_lang, q0.n_candidates
       FROM r1 JOIN q0 ON r1.request_id = q0.request_id),
p1 AS (SELECT *, list_distinct(regexp_extract_all(source_text, '{PLACEHOLDER_SQL}')) AS registry FROM p0),
pairs AS (SELECT *, list_transform(list_filter(registry, lambda p: NOT contains(translated_text, p)), lambda p: 'missing_placeholder:' || p) AS errors,
  {strip_sql('translated_text')} <> '' AS ok FROM p1)
"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct blocks."""
    return read_table(spark, d, "blocks").dropDuplicates(["doc_id", "block_id"])


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Distinct spans."""
    return read_table(spark, d, "spans").dropDuplicates(["span_id"])


BLOCKS = "blocks0 AS (SELECT DISTINCT ON (doc_id, block_id) * FROM blocks ORDER BY doc_id, block_id)"
SPANS = "spans0 AS (SELECT DISTINCT ON (span_id) * FROM spans ORDER BY span_id)"


def block_texts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with text (spans of a line joined, lines by line breaks), line count and font sizes of their spans; blocks without spans have null."""
    s = spans(spark, d).select("doc_id", "block_id", "line_no", "span_no", "span_id", F.coalesce("text", F.lit("")).alias("text"), "size", "flags")
    ln = s.groupBy("doc_id", "block_id", "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "span_id", "text"))), lambda x: x["text"]), "").alias("t"),
        F.max("size").alias("hi"), F.sum(F.col("size").cast("decimal(20,6)")).alias("sum"), F.count("size").alias("n"), F.count("*").alias("k"),
        F.count_if(F.col("flags").bitwiseAND(16) > 0).alias("b"), F.min_by("size", F.struct("span_no", "span_id")).alias("first_size"),
    )
    g = ln.groupBy("doc_id", "block_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), "\n").alias("raw"),
        F.max("hi").alias("max_size"), (F.sum("sum").cast("double") / F.sum("n")).alias("avg_size"), (F.sum("b") > F.sum("k") * 0.5).alias("bold"),
        F.min_by("first_size", "line_no").alias("first_size"),
    )
    return blocks(spark, d).join(g, ["doc_id", "block_id"], "left").withColumn("text", F.regexp_replace("raw", r"^\n+|\n+$", "")).drop("raw")


BLOCK_TEXTS = rf"""
{BLOCKS}, {SPANS},
ln AS (SELECT doc_id, block_id, line_no, string_agg(coalesce(text, ''), '' ORDER BY span_no, span_id) AS t, max(size) AS hi, sum(size::DECIMAL(20,6)) AS s,
  count(size) AS n, count(*) AS k,
       count(*) FILTER (flags & 16 > 0) AS b, arg_min(size, (span_no, span_id)) AS first_size FROM spans0 GROUP BY ALL),
bt AS (SELECT doc_id, block_id, string_agg(t, chr(10) ORDER BY line_no) AS raw, max(hi) AS max_size, sum(s)::DOUBLE / sum(n) AS avg_size, sum(b) > sum(k) * 0.5
  AS bold, arg_min(first_size, line_no) AS first_size FROM ln GROUP BY ALL),
block_texts AS (SELECT b.*, regexp_replace(bt.raw, '^\n+|\n+$', '', 'g') AS text, bt.max_size, bt.avg_size, bt.bold, bt.first_size FROM blocks0 b LEFT JOIN bt
  ON b.doc_id = bt.doc_id AND b.block_id = bt.block_id)
"""
