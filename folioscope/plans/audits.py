"""Queries that audit runs: errors of pairs, counters and criteria, routes over backends, styles, languages and lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import classify as C
from folioscope.functions import scoring as S
from folioscope.functions import text as T
from folioscope.operators import layout as G
from folioscope.operators import lookups as L
from folioscope.operators import masking as M
from folioscope.operators import ranking as K
from folioscope.operators import rollups as R
from folioscope.sources import read_table

from . import catalog, pages, reports, scores, texts
from . import frames as X
from .catalog import query

KEY = ["result_id", "idx"]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---- errors and counters --------------------------------------------------------------------------------------------

_TOO_LONG = (
    f"length({X.strip_sql('source_text')}) > 0 AND length({X.strip_sql('translated_text')})::DOUBLE / nullif(length({X.strip_sql('source_text')}), 0) "
    f"> CASE WHEN is_header THEN 2 WHEN length({X.strip_sql('source_text')}) < 50 THEN 3 ELSE 2 END"
)
_GENERIC = " OR ".join(f"contains(lower(translated_text), {_quoted(g)})" for g in T.GENERIC_RESPONSES)
_FAKE = f"len(list_filter(regexp_extract_all(translated_text, '{X.PLACEHOLDER_SQL}'), lambda p: NOT list_contains(registry, p))) > 0"
_ERRORS = f"""
er0 AS (SELECT *, coalesce({_TOO_LONG}, false) OR {_GENERIC} AS unreal, {_FAKE} AS fake, ok AND reason IN ('academic_heading', 'identical') AS same FROM i1),
er1 AS (SELECT *, list_concat(errors, list_filter([CASE WHEN unreal THEN 'hallucination' END, CASE WHEN fake THEN 'fake_placeholders' END, CASE WHEN same THEN
  'identity_translation' END], lambda x: x IS NOT NULL)) AS found FROM er0),
er AS (SELECT * EXCLUDE (found), CASE WHEN len(found) = 0 AND NOT ok THEN ['validation_failed'] ELSE found END AS found FROM er1)
"""


def _with_errors(spark, d):
    """Pairs with their composed errors; ``passed``: none of them and some text."""
    p = X.pairs(spark, d)
    s, t = F.col("source_text"), F.col("translated_text")
    unreal = S.length_suspect(s, t, F.col("is_header")) | T.any_of(F.lower(t), T.GENERIC_RESPONSES)
    fake = F.size(M.invented_tokens(t, F.col("registry"), T.PLACEHOLDER)) > 0
    same = F.col("ok") & C.identity(s, t, F.col("is_header"))["reason"].isin("academic_heading", "identical")
    label = lambda c, x: F.when(c, F.lit(x))
    p = p.withColumn(
        "found",
        F.concat("errors", F.array_compact(F.array(label(unreal, "hallucination"), label(fake, "fake_placeholders"), label(same, "identity_translation"))))
    )
    p = p.withColumn("found", F.when((F.size("found") == 0) & ~F.col("ok"), F.array(F.lit("validation_failed"))).otherwise(F.col("found")))
    return p.withColumn("passed", F.size("found") == 0)


@query(f"WITH {X.PAIRS}, {scores._ID}, {_ERRORS} SELECT result_id, idx, len(found) = 0 AS passed, array_to_string(list_sort(found), ',') AS errors FROM er")
def pair_errors(spark, d):
    """Composed errors of every candidate, and whether it passes (P-22)."""
    return _with_errors(spark, d).select(*KEY, "passed", F.array_join(F.array_sort("found"), ",").alias("errors"))


_COUNTERS = """
rc AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (ok AND len(errors) = 0) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (backend = 'dummy') AS n_emergency,
  count(*) FILTER (ok AND translated_text = source_text) AS n_fallback, count(*) FILTER (ok AND len(errors) > 0) AS n_partial, sum(overall_score::DECIMAL(38,12))::DOUBLE / count(*) AS quality,
  sum(len(issues))::BIGINT AS n_issues, sum(len(warnings))::BIGINT AS n_warnings FROM postx WHERE idx = 0 GROUP BY doc_id),
run AS (SELECT *, n_ok = blocks AS all_translated, quality >= 0.9::DOUBLE AS quality_above_90, n_failed = 0 AS zero_failed, n_emergency < 3 AS emergency_under_3, n_fallback = 0 AS zero_fallbacks FROM rc)
"""
_CRITERIA = ["all_translated", "quality_above_90", "zero_failed", "emergency_under_3", "zero_fallbacks"]


def _run_counters(spark, d):
    p = scores._post(spark, d).filter("idx = 0")
    good = F.col("ok") & (F.size("errors") == 0)
    g = p.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count_if(good).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"),
        F.count_if(F.col("backend") == "dummy").alias("n_emergency"),
        F.count_if(F.col("ok") & (F.col("translated_text") == F.col("source_text"))).alias("n_fallback"),
        F.count_if(F.col("ok") & (F.size("errors") > 0)).alias("n_partial"),
        R.mean_exact(F.col("overall_score")).alias("quality"), F.sum(F.size("issues")).alias("n_issues"), F.sum(F.size("warnings")).alias("n_warnings"),
    )
    tests = {
        "all_translated": F.col("n_ok") == F.col("blocks"), "quality_above_90": F.col("quality") >= 0.9, "zero_failed": F.col("n_failed") == 0,
        "emergency_under_3": F.col("n_emergency") < 3, "zero_fallbacks": F.col("n_fallback") == 0
    }
    g = g.select("*", *[v.alias(k) for k, v in tests.items()])
    passed = F.col(_CRITERIA[0])
    for k in _CRITERIA[1:]:
        passed = passed & F.col(k)
    return g.withColumn("passed", passed)


@query(f"WITH {X.PAIRS}, {scores._POST}, {_COUNTERS} SELECT *, {' AND '.join(_CRITERIA)} AS passed FROM run")
def run_counters(spark, d):
    """Counters and criteria of every document's first candidates (A-06, A-27, P-23); the offline backend's count as emergencies, source texts given back as fallbacks."""
    return _run_counters(spark, d)


@query(
    f"WITH {X.PAIRS}, {scores._POST}, {_COUNTERS} SELECT count(*) AS documents, count(*) FILTER ({' AND '.join(_CRITERIA)}) AS passed, (count(*) FILTER "
    f"({' AND '.join(_CRITERIA)}))::DOUBLE / count(*) AS pass_rate, "
    "sum(quality::DECIMAL(38,12))::DOUBLE / count(*) AS avg_quality, sum(n_issues)::BIGINT AS total_errors, sum(n_warnings)::BIGINT AS total_warnings FROM run"
)
def integration_report(spark, d):
    """Pass rate, quality and totals over all documents (A-26)."""
    p = F.count_if("passed")
    return _run_counters(spark, d).agg(
        F.count("*").alias("documents"), p.alias("passed"), (p / F.count("*")).alias("pass_rate"), R.mean_exact(F.col("quality")).alias("avg_quality"),
        F.sum("n_issues").alias("total_errors"), F.sum("n_warnings").alias("total_warnings")
    )


@query(
    "WITH q AS (SELECT DISTINCT request_id, target_lang FROM requests), r AS (SELECT DISTINCT request_id FROM results) "
    "SELECT target_lang, count(*) AS requests, count(r.request_id) AS answered, count(r.request_id)::DOUBLE / count(*) * 100 AS coverage FROM q LEFT JOIN r "
    "ON q.request_id = r.request_id GROUP BY target_lang"
)
def coverage_report(spark, d):
    """Share of the requests with a result, in per cent, by target language (A-26)."""
    r = X.results(spark, d).select("request_id").distinct().withColumn("there", F.lit(1))
    g = X.requests(spark, d).select("request_id", "target_lang").join(r, "request_id", "left").groupBy("target_lang")
    return g.agg(F.count("*").alias("requests"), F.count("there").alias("answered"), (F.count("there").cast("double") / F.count("*") * 100).alias("coverage"))


@query(
    f"WITH {X.PAIRS}, {scores._HEALTH}, f AS (SELECT backend, result_id, idx, row_number() OVER (PARTITION BY backend ORDER BY result_id, idx) AS k FROM "
    f"health WHERE status = 'failed') "
    "SELECT backend, string_agg(result_id || '/' || idx, ',' ORDER BY k) AS first_failed FROM f WHERE k <= 5 GROUP BY backend"
)
def first_failures(spark, d):
    """The first five failed candidates of every backend (T-03)."""
    w = Window.partitionBy("backend").orderBy(*KEY)
    f = scores._health(spark, d).filter("status = 'failed'").select("backend", *KEY).withColumn("k", F.row_number().over(w)).filter("k <= 5")
    named = F.struct("k", F.concat(F.col("result_id").cast("string"), F.lit("/"), F.col("idx").cast("string")).alias("x"))
    return f.groupBy("backend").agg(F.array_join(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["x"]), ",").alias("first_failed"))


@query(
    f"WITH {X.PAIRS}, {scores._HEALTH}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (status = 'ok') AS good, sum(len(registry))::BIGINT AS tokens, "
    f"count(*) FILTER (len(list_filter(registry, lambda p: contains(p, 'MATH_INLINE'))) > 0) AS formulas, "
    "count(*) FILTER (NOT contains(array_to_string(reason_codes, ' '), 'placeholder')) AS kept FROM health GROUP BY doc_id) SELECT doc_id, 1 - good::DOUBLE / "
    "n AS layout_overlap_rate, "
    "CASE WHEN tokens > 0 THEN kept::DOUBLE / tokens ELSE 1 END AS placeholder_preservation_rate, CASE WHEN formulas > 0 THEN kept::DOUBLE / formulas ELSE 1 "
    "END AS formula_preservation_score FROM g"
)
def layout_evaluation(spark, d):
    """Layout, placeholder and formula rates of every document (A-23)."""
    g = scores._health(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("good"), F.sum(F.size("registry")).alias("tokens"),
        F.count_if(F.exists("registry", lambda p: p.contains("MATH_INLINE"))).alias("formulas"),
        F.count_if(~F.array_join("reason_codes", " ").contains("placeholder")).alias("kept"),
    )
    rate = lambda k: F.when(F.col(k) > 0, F.try_divide("kept", k)).otherwise(F.lit(1.0))
    return g.select(
        "doc_id", (F.lit(1) - F.col("good") / F.col("n")).alias("layout_overlap_rate"), rate("tokens").alias("placeholder_preservation_rate"),
        rate("formulas").alias("formula_preservation_score")
    )


_STATS = (
    "count(*) AS n, sum(value::DECIMAL(38,12))::DOUBLE AS s1, sum((value * value)::DECIMAL(38,12))::DOUBLE AS s2, min(value) AS lowest, max(value) AS highest"
)


@query(
    f"WITH {reports._SPLIT}, u AS (UNPIVOT both_ ON fixed, adaptive INTO NAME metric VALUE value), g AS (SELECT metric, {_STATS} FROM u GROUP BY metric) "
    "SELECT metric, n, s1 / n::DOUBLE AS mean, CASE WHEN n > 1 THEN sqrt(greatest(0::DOUBLE, (s2 - s1 * s1 / n::DOUBLE) / nullif(n::DOUBLE - 1, 0))) END AS "
    "deviation, lowest, highest FROM g"
)
def metric_summary(spark, d):
    """Number, mean, sample deviation, least and greatest value of each metric (A-22)."""
    return R.described(reports._sides(spark, d).unpivot(["doc_id"], ["fixed", "adaptive"], "metric", "value"), ["metric"], "value")


@query(
    f"WITH {reports._RUNS}, q AS (SELECT backend, doc_id, good::DOUBLE / blocks AS quality, failed, blocks FROM runs) SELECT backend, count(*) AS n, "
    f"sum(quality::DECIMAL(38,12))::DOUBLE / count(*) AS avg_quality, min(quality) AS lowest, max(quality) AS highest, "
    "(count(*) FILTER (failed > 0))::DOUBLE / count(*) AS failure_rate FROM q GROUP BY backend"
)
def experiment_rollup(spark, d):
    """Average, least and greatest quality and share of runs with a failure, by backend (A-21)."""
    q = F.col("good").cast("double") / F.col("blocks")
    return reports._runs(spark, d).groupBy("backend").agg(
        F.count("*").alias("n"), R.mean_exact(q).alias("avg_quality"), F.min(q).alias("lowest"), F.max(q).alias("highest"),
        (F.count_if(F.col("failed") > 0) / F.count("*")).alias("failure_rate")
    )


# ---- selection and routes -------------------------------------------------------------------------------------------


@query(
    f"WITH k AS ({catalog._SQL['content_type']}), q AS (SELECT DISTINCT request_id, doc_id, coalesce(is_header, false) AS h FROM requests) SELECT request_id, "
    f"CASE WHEN coalesce(score, 0) >= 60 THEN 'academic' ELSE 'general' END AS content, "
    "CASE WHEN coalesce(score, 0) >= 60 THEN CASE WHEN h THEN 0.98::DOUBLE ELSE 0.95::DOUBLE END ELSE CASE WHEN h THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END END "
    "AS threshold FROM q LEFT JOIN k ON q.doc_id = k.doc_id"
)
def identity_thresholds(spark, d):
    """Similarity from which an answer counts as its source again, by the document's content (P-19)."""
    k = texts.content_type(spark, d).select("doc_id", "score")
    q = X.requests(spark, d).select("request_id", "doc_id", F.coalesce("is_header", F.lit(False)).alias("h")).join(k, "doc_id", "left")
    academic = F.coalesce(F.col("score") >= C.ACADEMIC_SCORE, F.lit(False))
    return q.select(
        "request_id", F.when(academic, "academic").otherwise("general").alias("content"), C.identity_threshold(academic, F.col("h")).alias("threshold")
    )


@query(
    "SELECT source, target, domain, load_seq FROM glossary WHERE contains(lower(source), 'tion') OR contains(lower(target), 'tion') ORDER BY source, load_seq"
)
def glossary_search(spark, d):
    """Entries that hold a word part in either language, in order (P-24)."""
    g = L.glossary_search(read_table(spark, d, "glossary"), "tion")
    return g.select("source", "target", "domain", "load_seq")


_BACKENDS = "(VALUES " + ", ".join(f"('{n}', {p}, {str(slow).lower()})" for n, p, slow in K.BACKENDS) + ") b(backend, priority, slow)"


@query(
    f"SELECT request_id, b.backend, b.priority FROM (SELECT DISTINCT request_id, coalesce(text, '') AS text FROM requests) q, {_BACKENDS} WHERE NOT (b.slow "
    f"AND length(q.text) <= 8)"
)
def backend_routes(spark, d):
    """Backends that are asked for every request, short texts not the slow one (J-18, P-20)."""
    return K.routed(X.requests(spark, d).select("request_id", F.coalesce("text", F.lit("")).alias("text"))).select("request_id", "backend", "priority")


_BONUS = "CASE backend " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in K.BACKEND_BONUS.items()) + " ELSE 0::DOUBLE END"
_PRIORITY = "CASE backend " + " ".join(f"WHEN '{n}' THEN {p}" for n, p, _ in K.BACKENDS) + f" ELSE {len(K.BACKENDS) + 1} END"


@query(
    rf"WITH {X.PAIRS}, {scores._RANK}, c AS (SELECT p.request_id, p.result_id, p.idx, p.backend, k.placeholder >= 1 AS valid, k.placeholder * 10::DOUBLE + "
    rf"k.numeric * 2::DOUBLE + k.format + k.length_score * 3::DOUBLE + {_BONUS} AS total, {_PRIORITY} AS priority "
    "FROM pairs p JOIN rank_parts k ON p.result_id = k.result_id AND p.idx = k.idx) SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY valid DESC, "
    "total DESC, priority, result_id, idx)::INT AS rank FROM c"
)
def cascade_rank(spark, d):
    """Candidates of every request by validity, native total with their backend's bonus, and the backend's priority (W-12, J-19)."""
    p = X.pairs(spark, d)
    k = S.rerank_parts(F.col("source_text"), F.col("translated_text"), F.col("registry"), F.col("is_header"))
    total = k["placeholder"] * 10.0 + k["numeric"] * 2.0 + k["format"] + k["length"] * 3.0
    return K.cascaded(p.select("request_id", *KEY, "backend", (k["placeholder"] >= 1).alias("valid"), total.alias("total")), ["request_id"], KEY)


@query(
    f"WITH {X.PAIRS}, {X.BLOCKS}, j AS (SELECT p.result_id, p.doc_id, b.page_no, b.block_no, p.request_id FROM pairs p JOIN blocks0 b ON p.doc_id = b.doc_id "
    f"AND p.block_id = b.block_id WHERE p.idx = 0) "
    "SELECT result_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, block_no, request_id, result_id)::INT AS position FROM j"
)
def result_order(spark, d):
    """Place of every result in its document's order, whatever order the results came in (W-13)."""
    b = X.blocks(spark, d).select("doc_id", "block_id", "page_no", "block_no")
    w = Window.partitionBy("doc_id").orderBy("page_no", "block_no", "request_id", "result_id")
    return X.pairs(spark, d).filter("idx = 0").join(b, ["doc_id", "block_id"]).select("result_id", "doc_id", F.row_number().over(w).alias("position"))


@query()
def memory_best_match(spark, d):
    """The best match of at least 0.92 among the requests of the week before 25 March 2025, if it holds all of the request's tokens, for ids divisible by 20 (J-07, J-08)."""
    r = X.requests(spark, d).filter("text is not null").select("request_id", F.coalesce("target_lang", F.lit("")).alias("pair"), "text", "requested_at")
    q = r.filter("request_id % 20 = 0").select(F.col("request_id").alias("query_id"), "pair", "text")
    m = r.select(F.col("request_id").alias("memory_id"), "pair", "text", F.lit(1.0).alias("quality"), "requested_at")
    return L.best_match(q, m, F.lit("2025-03-25 00:00:00").cast("timestamp"), 604_800, T.PLACEHOLDER)


# ---- blocks and lines -----------------------------------------------------------------------------------------------


@query(
    f"WITH {pages._IOU}, g AS (SELECT doc_id, page_no, count(*) AS n, sum(iou::DECIMAL(38,18))::DOUBLE AS s, max(iou) AS m FROM io WHERE iou > 0.01::DOUBLE "
    f"GROUP BY doc_id, page_no), "
    "pg AS (SELECT DISTINCT doc_id, page_no FROM blocks0 UNION SELECT doc_id, max(page_no) + 1 FROM blocks0 GROUP BY doc_id) "
    "SELECT doc_id, page_no, coalesce(n, 0) AS overlap_pairs, coalesce(s / n, 0::DOUBLE) AS mean_iou, coalesce(m, 0::DOUBLE) AS max_iou FROM pg LEFT JOIN g "
    "USING (doc_id, page_no)"
)
def rendered_overlap(spark, d):
    """Overlaps above a hundredth by page; zeros for the page behind the last (A-04, J-16)."""
    b = X.blocks(spark, d)
    asked = b.select("doc_id", "page_no").union(b.groupBy("doc_id").agg((F.max("page_no") + 1).alias("page_no"))).distinct()
    return G.page_overlap(b, 0.01, asked)


@query(
    f"WITH {X.SPANS}, {X.BLOCKS}, s AS (SELECT s.*, coalesce(b.is_header, false) AS h FROM spans0 s JOIN blocks0 b ON s.doc_id = b.doc_id AND s.block_id = "
    f"b.block_id), "
    "f AS (SELECT doc_id, block_id, font, count(*) AS n, min((line_no, span_no, span_id)) AS f FROM s WHERE font IS NOT NULL GROUP BY ALL), fr AS (SELECT *, "
    "row_number() OVER (PARTITION BY doc_id, block_id ORDER BY n DESC, f) AS k FROM f), "
    "c AS (SELECT doc_id, block_id, color, count(*) AS n, min((line_no, span_no, span_id)) AS f FROM s WHERE color IS NOT NULL GROUP BY ALL), cr AS (SELECT "
    "*, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY n DESC, f) AS k FROM c), "
    "b AS (SELECT doc_id, block_id, bool_or(h) AS h, max(size) AS hi, sum(size::DECIMAL(20,6))::DOUBLE / count(size) AS mean FROM s GROUP BY doc_id, "
    "block_id), "
    "t AS (SELECT doc_id, block_id, font, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY size DESC, line_no, span_no, span_id) AS k FROM s WHERE "
    "size IS NOT NULL) "
    "SELECT b.doc_id, b.block_id, CASE WHEN b.h THEN t.font ELSE fr.font END AS font, cr.color, CASE WHEN b.h THEN hi ELSE mean END AS size FROM b LEFT JOIN "
    "fr ON fr.doc_id = b.doc_id AND fr.block_id = b.block_id AND fr.k = 1 "
    "LEFT JOIN cr ON cr.doc_id = b.doc_id AND cr.block_id = b.block_id AND cr.k = 1 LEFT JOIN t ON t.doc_id = b.doc_id AND t.block_id = b.block_id AND t.k = 1"
)
def base_style(spark, d):
    """Base style of every block: of headers the largest span's font and size, else the dominant font and the mean size; the dominant colour (G-11, A-08)."""
    s = X.spans(spark, d).join(X.blocks(spark, d).select("doc_id", "block_id", F.coalesce("is_header", F.lit(False)).alias("h")), ["doc_id", "block_id"])
    return R.base_style(s)


_OWN = (
    "CASE WHEN trim(coalesce(font, '')) = '' THEN 'Times-Roman' WHEN contains(font, '+') THEN regexp_replace(trim(font), '^[^+]*\\+', '') ELSE trim(font) END"
)


@query(
    f"WITH {X.SPANS}, f AS (SELECT *, coalesce(font, '') AS n, coalesce(flags, 0) AS b, {_OWN} AS own FROM spans0) SELECT span_id, n || CASE WHEN b & 16 > 0 "
    f"AND NOT contains(lower(n), 'bold') THEN ' Bold' ELSE '' END "
    "|| CASE WHEN b & 2 > 0 AND NOT contains(lower(n), 'italic') AND NOT contains(lower(n), 'oblique') THEN ' Italic' ELSE '' END AS font_key, "
    r"CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^\x00-\x{FF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') THEN own WHEN "
    r"contains(lower(own), 'bold') AND (contains(lower(own), 'italic') OR contains(lower(own), 'oblique')) THEN 'DejaVuSans-BoldOblique' "
    "WHEN contains(lower(own), 'bold') THEN 'DejaVuSans-Bold' WHEN contains(lower(own), 'italic') OR contains(lower(own), 'oblique') THEN "
    "'DejaVuSans-Oblique' ELSE 'DejaVuSans' END AS font_used FROM f"
)
def font_choice(spark, d):
    """Font key with style hints and the font that is used for every span's characters (X-23)."""
    return X.spans(spark, d).select(
        "span_id", T.font_key(F.col("font"), F.col("flags")).alias("font_key"), T.font_for(F.col("text"), F.col("font")).alias("font_used")
    )


_FIRST = (
    f"{X.BLOCK_TEXTS}, o AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, block_no, block_id) AS k FROM "
    f"block_texts), fb AS (SELECT doc_id, string_agg(text, ' ' ORDER BY k) AS text FROM o WHERE k <= 20 GROUP BY doc_id)"
)


@query(
    f"WITH {_FIRST}, {texts._lang_sql('fb', 'doc_id')} SELECT doc_id, CASE WHEN confidence < 0.3::DOUBLE THEN 'en' ELSE detected END AS detected, CASE WHEN "
    f"confidence < 0.3::DOUBLE THEN 0 ELSE confidence END AS confidence FROM l3"
)
def document_language(spark, d):
    """Language of every document from its first twenty blocks; English with confidence 0 below 0.3 (A-13)."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "block_no", "block_id")
    b = X.block_texts(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(w).alias("k")).filter("k <= 20")
    g = b.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ").alias("text"))
    g = g.withColumn("x", C.language(F.col("text")))
    sure = F.col("x.confidence") >= 0.3
    return g.select(
        "doc_id", F.when(sure, F.col("x.lang")).otherwise("en").alias("detected"), F.when(sure, F.col("x.confidence")).otherwise(0.0).alias("confidence")
    )


@query(
    f"WITH {X.SPANS}, ln AS (SELECT doc_id, block_id, line_no, string_agg(coalesce(text, ''), '' ORDER BY span_no, span_id) AS a, string_agg(coalesce(text, "
    f"''), ' ' ORDER BY span_no, span_id) AS b FROM spans0 GROUP BY ALL), "
    f"bt AS (SELECT doc_id, block_id, string_agg(a, chr(10) ORDER BY line_no) AS a, string_agg(b, chr(10) ORDER BY line_no) AS b FROM ln GROUP BY ALL) SELECT "
    f"doc_id, block_id, {X.strip_sql('a')} AS stripped, {X.strip_sql('b')} AS spaced FROM bt"
)
def text_variants(spark, d):
    """Text of every block without white space around it, with its spans joined directly and by blanks (P-02)."""
    s = X.spans(spark, d).groupBy("doc_id", "block_id", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("span_no", "span_id", F.coalesce("text", F.lit("")).alias("text")))).alias("spans")
    )
    b = s.groupBy("doc_id", "block_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "spans"))).alias("lines"))
    return b.select("doc_id", "block_id", T.block_text(F.col("lines"), "", True).alias("stripped"), T.block_text(F.col("lines"), " ", True).alias("spaced"))


@query(
    f"WITH {X.PAIRS}, {X.BLOCKS} SELECT p.result_id, p.idx, coalesce(b.region, '') <> 'table' AND p.ok AND {X.norm_sql('p.translated_text')} <> "
    f"{X.norm_sql('p.source_text')} AS replace "
    "FROM pairs p LEFT JOIN blocks0 b ON p.doc_id = b.doc_id AND p.block_id = b.block_id"
)
def legacy_decision(spark, d):
    """Whether a candidate replaces its block's text: no table, some text, and not the source again (P-10)."""
    b = X.blocks(spark, d).select("doc_id", "block_id", "region")
    p = X.pairs(spark, d).join(b, ["doc_id", "block_id"], "left")
    return p.select(*KEY, G.legacy_decision(F.col("source_text"), F.col("translated_text"), F.col("region")).alias("replace"))


@query(
    f"WITH {X.PAIRS}, l AS (SELECT result_id, string_split(source_text, chr(10)) AS a, string_split(translated_text, chr(10)) AS b FROM pairs WHERE idx = 0), "
    "u AS (SELECT result_id, a, b, unnest(range(greatest(len(a), len(b))))::INT AS line_no FROM l) SELECT result_id, line_no, a[line_no + 1] AS source_line, "
    "b[line_no + 1] AS target_line FROM u"
)
def line_zip(spark, d):
    """Lines of every request beside those of its first candidate, by position; null where one has no more lines (J-22)."""
    z = F.arrays_zip(F.split("source_text", "\n").alias("a"), F.split("translated_text", "\n").alias("b"))
    return X.pairs(spark, d).filter("idx = 0").select("result_id", F.posexplode(z).alias("line_no", "z")).select(
        "result_id", "line_no", F.col("z.a").alias("source_line"), F.col("z.b").alias("target_line")
    )


_HEADLINES = (
    "t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(range(len(ls)))::INT AS line_no, ls "
    "FROM t), h AS (SELECT doc_id, line_no, ls[line_no + 1] AS x FROM l)"
)
_SP = T.SECTION_PREFIX


@query(
    rf"WITH {_HEADLINES}, s AS (SELECT *, regexp_extract(x, '{_SP}', 0) AS prefix, regexp_extract(x, '{_SP}', 2) AS number, lower(regexp_extract(x, '{_SP}', "
    rf"1)) AS w FROM h WHERE regexp_matches(x, '{_SP}')) "
    rf"SELECT doc_id, line_no, prefix, {X.strip_sql('substring(x, length(prefix) + 1)')} AS content, "
    "CASE w WHEN 'section' THEN 'Abschnitt' WHEN 'chapter' THEN 'Kapitel' WHEN 'chapitre' THEN 'Kapitel' ELSE 'Teil' END || ' ' || number || ': ' AS "
    "translated FROM s"
)
def section_lines(spark, d):
    """Lines of all documents that begin with a section prefix, its content and the prefix in German (X-04, X-05)."""
    ln = read_table(spark, d, "documents").select(
        "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "x")
    ).filter(F.col("x").rlike(_SP))
    prefix, content = T.section_prefix(F.col("x"))
    return ln.select("doc_id", "line_no", prefix.alias("prefix"), content.alias("content"), T.translated_section_prefix(prefix, "de").alias("translated"))


_PREFIX = lambda x: texts._numbering_part_sql(x, 0)
_SECTION = r"regexp_extract(source_text, '(?i)^(section\s+\d+\s*[:.\-]\s*)', 1)"


@query(
    rf"WITH {X.PAIRS}, n AS (SELECT *, {_PREFIX('source_text')} AS sp, {_PREFIX('translated_text')} AS tp, {_SECTION} AS sec FROM pairs) SELECT result_id, "
    rf"idx, sp AS prefix, sp <> '' AND tp = '' AS lost, "
    "CASE WHEN sp = '' OR tp <> '' THEN translated_text ELSE CASE WHEN sec <> '' AND NOT starts_with(lower(translated_text), lower(sec)) THEN sec ELSE sp END "
    "|| translated_text END AS fixed FROM n WHERE sp <> ''"
)
def numbering_pairs(spark, d):
    """Candidates of numbered requests with the numbering put back where they lost it (X-08, X-09)."""
    s, t = F.col("source_text"), F.col("translated_text")
    n = T.numbering(s)["prefix"]
    return X.pairs(spark, d).filter(n != "").select(
        *KEY, n.alias("prefix"), (T.numbering(t)["prefix"] == "").alias("lost"), T.keep_numbering(s, t).alias("fixed")
    )


_LINE_SECTION = _SECTION.replace("source_text", "x")


@query(
    rf"WITH {_HEADLINES}, n AS (SELECT doc_id, line_no, x, {_PREFIX('x')} AS sp, {_LINE_SECTION} AS sec FROM h), "
    rf"m AS (SELECT *, substring(x, length(sp) + 1) AS bare FROM n WHERE sp <> ''), k AS (SELECT *, {_PREFIX('bare')} AS tp FROM m) SELECT doc_id, line_no, bare, "
    "CASE WHEN tp <> '' THEN bare WHEN sec <> '' AND NOT starts_with(lower(bare), lower(sec)) THEN sec || bare ELSE sp || bare END AS fixed FROM k"
)
def numbering_lines(spark, d):
    """Numbered lines of all documents with their numbering taken away and put back; what is left of some has a numbering of its own (X-08, X-09)."""
    ln = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "x"))
    ln = ln.withColumn("n", T.numbering(F.col("x"))).filter("n.prefix <> ''").select("doc_id", "line_no", "x", F.col("n.rest").alias("bare"))
    return ln.select("doc_id", "line_no", "bare", T.keep_numbering(F.col("x"), F.col("bare")).alias("fixed"))


_MASKED = (
    "list_reduce(list_concat([coalesce(b.text, '')], coalesce(e.ts, [])), lambda acc, x, i: CASE WHEN x <> '' AND instr(acc, x) > 0 "
    "THEN left(acc, instr(acc, x) - 1) || '@@BLK_MATH_INLINE_' || lpad((i - 1)::VARCHAR, 4, '0') || '@@' || substring(acc, instr(acc, x) + length(x)) ELSE "
    "acc END)"
)


@query(
    f"WITH {pages._EQ}, bn AS (SELECT DISTINCT ON (doc_id, block_id) * FROM blocks ORDER BY doc_id, block_id), ln AS (SELECT doc_id, block_id, line_no, "
    f"string_agg(coalesce(text, ''), '' ORDER BY span_no, span_id) AS t FROM spans0 GROUP BY ALL), "
    "bt AS (SELECT doc_id, block_id, regexp_replace(string_agg(t, chr(10) ORDER BY line_no), '^\\n+|\\n+$', '', 'g') AS text FROM ln GROUP BY ALL), "
    "ee AS (SELECT doc_id, block_id, list(text ORDER BY line_no, span_no, span_id) FILTER (is_equation) AS ts FROM eq GROUP BY ALL) "
    f"SELECT b.doc_id, b.block_id, {_MASKED} AS masked, len(e.ts)::INT AS equations FROM bt b JOIN bn ON bn.doc_id = b.doc_id AND bn.block_id = b.block_id "
    f"JOIN ee e ON e.doc_id = b.doc_id AND e.block_id = b.block_id WHERE len(e.ts) > 0"
)
def equation_masks(spark, d):
    """Texts of the blocks with equations, the first occurrence of each as a token (M-10); checksums are left out of the tokens shown."""
    e = pages._equations(spark, d).filter("is_equation").groupBy("doc_id", "block_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "span_no", "span_id", "text"))), lambda x: x["text"]).alias("ts")
    )
    b = X.block_texts(spark, d).select("doc_id", "block_id", "text").join(e, ["doc_id", "block_id"])
    m = M.mask_equations(F.col("text"), F.col("ts"))
    return b.select(
        "doc_id", "block_id", F.regexp_replace(m["masked"], "(@@BLK_MATH_INLINE_[0-9]{4})_[0-9A-F]{8}@@", "$1@@").alias("masked"),
        F.size("ts").alias("equations")
    )
