"""Queries over request-answer pairs: checks, health, scores, identity, ranking, glossary, memory."""

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
from folioscope.sources.artifacts import translations_json

from . import frames as X
from . import texts
from .catalog import query

KEY = ["result_id", "idx"]
_N, _NE, _NC = (lambda x, p=p: X.numbers_sql(x, p) for p in (X.NUMBER_SQL, X.NUMBER_EXP_SQL, X.NUMBER_COMMA_SQL))
_PH = X.PLACEHOLDER_SQL


@query(
    rf"WITH {X.PAIRS} SELECT result_id, idx, (len(regexp_extract_all(translated_text, '{_PH}')) < len(regexp_extract_all(source_text, '{_PH}')))::INT AS "
    rf"missing_placeholders, (list_sort({_NC('source_text')}) <> list_sort({_NC('translated_text')}))::INT AS numeric_mismatch, "
    rf"({X.bullets_sql('source_text')} > 0 AND {X.bullets_sql('translated_text')} = 0)::INT AS dropped_bullets FROM pairs"
)
def format_checks_pairs(spark, d):
    """Quick format checks of every candidate (R-05, U-03)."""
    q = S.quick_checks(F.col("source_text"), F.col("translated_text"))
    return X.pairs(spark, d).select(*KEY, *[v.alias(k) for k, v in q.items()])


def _multiset_sql(a: str, b: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = "
        f"x))))), 0)"
    )


_HEALTH = rf"""
h0 AS (SELECT *, {_NE('source_text')} AS ns, {_NE('translated_text')} AS nt, {X.bullets_sql('source_text')} AS bs, {X.bullets_sql('translated_text')} AS bt,
  len(errors) > 0 AS lost, NOT ok AS failed, regexp_matches(translated_text, '{_PH}') AS remains,
  length(source_text) > 0 AND length(translated_text)::DOUBLE / nullif(length(source_text), 0) > 1.5::DOUBLE AS long FROM pairs),
h1 AS (SELECT *, len(ns) > 0 AND {_multiset_sql('ns', 'nt')}::DOUBLE / nullif(len(ns), 0) < 0.9::DOUBLE AS drift, bs > 0 AND bt < bs * 0.8::DOUBLE AS fmt FROM h0),
h2 AS (SELECT *, least(1::DOUBLE, CASE WHEN lost THEN 0 ELSE 1 END, CASE WHEN failed THEN 0.3::DOUBLE ELSE 1 END, CASE WHEN drift THEN 0.7::DOUBLE ELSE 1 END,
  CASE WHEN fmt THEN 0.6::DOUBLE ELSE 1 END, CASE WHEN remains THEN 0.4::DOUBLE ELSE 1 END, CASE WHEN long THEN 0.8::DOUBLE ELSE 1 END) AS score,
  list_filter([CASE WHEN lost THEN 'placeholder_missing' END, CASE WHEN failed THEN 'translation_failed' END, CASE WHEN drift THEN 'numeric_drift' END, CASE
    WHEN fmt THEN 'format_drift' END, CASE WHEN remains THEN 'placeholder_not_restored' END, CASE WHEN long THEN 'potential_overflow' END], lambda x: x IS NOT
    NULL) AS reason_codes FROM h1),
health AS (SELECT *, CASE WHEN lost OR failed OR score < 0.5::DOUBLE THEN 'failed' WHEN score >= 0.85::DOUBLE AND len(reason_codes) = 0 THEN 'ok' ELSE
  'warning' END AS status FROM h2)
"""


def _health(spark, d):
    p = X.pairs(spark, d).withColumn("h", S.health(F.col("source_text"), F.col("translated_text"), F.col("ok"), F.col("errors")))
    return p.select("*", "h.status", "h.score", "h.reason_codes").drop("h")


@query(rf"WITH {X.PAIRS}, {_HEALTH} SELECT result_id, idx, status, score, array_to_string(reason_codes, ',') AS reasons FROM health")
def block_health_pairs(spark, d):
    """Health of every candidate (R-06)."""
    return _health(spark, d).select(*KEY, "status", "score", F.array_join("reason_codes", ",").alias("reasons"))


@query(
    rf"WITH {X.PAIRS}, {_HEALTH}, {X.BLOCKS} SELECT h.doc_id, b.page_no, count(*) FILTER (status = 'ok') AS ok_blocks, count(*) FILTER (status = 'warning') "
    rf"AS warning_blocks, count(*) FILTER (status = 'failed') AS failed_blocks, count(*) AS total_blocks, sum(score::DECIMAL(38,12))::DOUBLE / count(*) AS "
    rf"mean_score, (count(*) FILTER (status = 'ok'))::DOUBLE / count(*) AS health_ratio FROM health h JOIN blocks0 b ON h.doc_id = b.doc_id AND h.block_id = "
    rf"b.block_id GROUP BY h.doc_id, b.page_no"
)
def page_health(spark, d):
    """Health of every page (A-02, J-02)."""
    b = X.blocks(spark, d).select("doc_id", "block_id", "page_no")
    return R.health_summary(_health(spark, d).join(b, ["doc_id", "block_id"]), ["doc_id", "page_no"])


@query(
    rf"WITH {X.PAIRS}, {_HEALTH}, e AS (SELECT unnest(list_concat(errors, reason_codes)) AS x FROM health WHERE status = 'failed') SELECT split_part(x, ':', "
    rf"1) AS error, count(*) AS n FROM e GROUP BY 1"
)
def error_histogram(spark, d):
    """Errors of failed candidates (A-05)."""
    h = _health(spark, d).filter("status = 'failed'").select(F.concat("errors", "reason_codes").alias("e"))
    return R.label_histogram(h, "e", "error")


def _share_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 1::DOUBLE ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct({a})) END"


def _chars_sql(x: str) -> str:
    return f"list_distinct(string_split({x}, ''))"


_POST = rf"""
a0 AS (SELECT *, source_text AS s, translated_text AS t, {X.norm_sql('source_text')} AS sn, {X.norm_sql('translated_text')} AS tn, {_N('source_text')} AS ns,
  {_N('translated_text')} AS nt, {X.bullets_sql('source_text')} AS bs, {X.bullets_sql('translated_text')} AS bt,
  {X.lines_sql('source_text')} AS ls, {X.lines_sql('translated_text')} AS lt, {X.words_sql('lower(translated_text)')} AS w, length(translated_text)::DOUBLE /
    greatest(length(source_text), 1) AS ratio FROM pairs),
a1 AS (SELECT *, sn <> '' AND tn <> '' AS both_, len(list_intersect({_chars_sql('sn')}, {_chars_sql('tn')}))::DOUBLE /
  nullif(len(list_distinct(list_concat({_chars_sql('sn')}, {_chars_sql('tn')}))), 0) AS overlap, list_filter(w, lambda x: length(x) > 3) AS lw,
  len(registry) AS n, len(list_filter(registry, lambda p: contains(t, p))) AS still, len(registry) > 0 AND len(errors) > 0 AS rerr,
    len(list_filter(regexp_extract_all(t, '{_PH}'), lambda p: NOT list_contains(registry, p))) > 0 AS alien FROM a0),
a2 AS (SELECT *, both_ AND sn = tn AS same_, both_ AND sn <> tn AND overlap > 0.95::DOUBLE AS high, both_ AND sn <> tn AND overlap > 0.85::DOUBLE AND overlap
  <= 0.95::DOUBLE AS some_,
  CASE WHEN rerr AND still > 0 THEN (n - still)::DOUBLE / n WHEN rerr THEN greatest(0::DOUBLE, (n - len(errors))::DOUBLE / n) WHEN n > 0 AND still > 0 THEN (n
    - still)::DOUBLE / n ELSE 1 END AS ph0, n > 0 AND NOT rerr AND still > 0 AS left_,
  {_share_sql('ns', 'nt')} AS numeric_score, ls > 0 AND (lt::DOUBLE / nullif(ls, 0) < 0.7::DOUBLE OR lt::DOUBLE / nullif(ls, 0) > 1.3::DOUBLE) AS odd_lines,
  coalesce(list_max(list_transform(list_distinct(lw), lambda x: len(list_filter(lw, lambda y: y = x)))), 1) AS top_, ratio < 0.5::DOUBLE OR ratio > 2 AS odd_len FROM a1),
a3 AS (SELECT *, CASE WHEN same_ THEN 0::DOUBLE WHEN high THEN 0.3::DOUBLE WHEN some_ THEN 0.6::DOUBLE ELSE 1 END AS identity_score, CASE WHEN alien THEN
  least(ph0, 0.5::DOUBLE) ELSE ph0 END AS placeholder_score,
  CASE WHEN bs > 0 THEN least(bt::DOUBLE / nullif(bs, 0), 1::DOUBLE) ELSE 1::DOUBLE END * CASE WHEN odd_lines THEN 0.9::DOUBLE ELSE 1 END AS format_score,
    len(w) > 5 AND top_::DOUBLE / nullif(len(w), 0) > 0.3::DOUBLE AS rep,
  CASE WHEN ratio >= 0.8::DOUBLE AND ratio <= 1.5::DOUBLE THEN 1::DOUBLE WHEN ratio >= 0.6::DOUBLE AND ratio <= 2 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS fidelity_score FROM a2),
a4 AS (SELECT *, CASE WHEN rep THEN 0.7::DOUBLE ELSE 1::DOUBLE END * CASE WHEN odd_len THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS fluency_score,
  list_concat(errors, list_filter([CASE WHEN same_ AND is_header THEN 'identity_translation:header_exact_match' END, CASE WHEN same_ AND NOT is_header THEN
    'identity_translation:exact_match' END, CASE WHEN high THEN 'identity_translation:high_similarity' END, CASE WHEN rerr THEN
    'placeholder_restoration_failed' END,
    CASE WHEN left_ THEN 'placeholder_not_restored' END, CASE WHEN alien THEN 'placeholder_hallucinated' END, CASE WHEN numeric_score < 0.9::DOUBLE THEN
      'numeric_drift' END, CASE WHEN bs > 0 AND bt::DOUBLE / nullif(bs, 0) < 0.8::DOUBLE THEN 'format_drift:bullets' END, CASE WHEN fidelity_score =
      0.7::DOUBLE THEN 'fidelity_concern:length' END], lambda x: x IS NOT NULL)) AS issues,
  list_filter([CASE WHEN some_ THEN 'identity_translation:moderate_similarity' END, CASE WHEN alien THEN 'placeholder_hallucinated_count' END, CASE WHEN
    numeric_score >= 0.9::DOUBLE AND numeric_score < 1 THEN 'minor_numeric_variation' END, CASE WHEN odd_lines THEN 'line_count_variation' END, CASE WHEN rep
    THEN 'high_repetition' END, CASE WHEN odd_len THEN 'length_ratio_unusual' END], lambda x: x IS NOT NULL) AS warnings FROM a3),
a5 AS (SELECT *, CASE WHEN n > 0 THEN identity_score * 0.2::DOUBLE + placeholder_score * 0.3::DOUBLE + numeric_score * 0.2::DOUBLE + format_score *
  0.15::DOUBLE + fluency_score * 0.1::DOUBLE + fidelity_score * 0.05::DOUBLE
  ELSE identity_score * 0.25::DOUBLE + numeric_score * 0.25::DOUBLE + format_score * 0.2::DOUBLE + fluency_score * 0.15::DOUBLE + fidelity_score * 0.15::DOUBLE END AS o FROM a4),
a6 AS (SELECT *, CASE WHEN identity_score < 0.5::DOUBLE THEN o * 0.5::DOUBLE ELSE o END AS overall_score FROM a5),
post AS (SELECT *, identity_score < 0.5::DOUBLE OR (n > 0 AND placeholder_score < 0.9::DOUBLE) OR numeric_score < 0.8::DOUBLE OR (is_header AND overall_score <
  0.85::DOUBLE) OR len(issues) > 2 AS needs_retry, overall_score < 0.75::DOUBLE OR len(issues) >= 2 OR identity_score < 0.7::DOUBLE AS needs_review,
  greatest(0::DOUBLE, 1::DOUBLE - (len(issues) * 0.15::DOUBLE + len(warnings) * 0.05::DOUBLE)) AS confidence FROM a6),
postx AS (SELECT *, overall_score >= 0.85::DOUBLE AND NOT needs_retry AND len(list_filter(issues, lambda i:
  {" OR ".join(f"contains(i, '{c}')" for c in S.CRITICAL)})) = 0 AS acceptable FROM post)
"""


def _post(spark, d):
    return S.with_post_scores(X.pairs(spark, d), "source_text", "translated_text", "registry", "errors", "is_header")


_SCORES = [
    "overall_score", "identity_score", "placeholder_score", "numeric_score", "format_score", "fluency_score", "fidelity_score", "needs_retry", "needs_review",
    "confidence", "acceptable"
]


@query(
    rf"WITH {X.PAIRS}, {_POST} SELECT result_id, idx, {', '.join(_SCORES)}, array_to_string(list_sort(issues), ',') AS issues, "
    rf"array_to_string(list_sort(warnings), ',') AS warnings FROM postx"
)
def post_score_pairs(spark, d):
    """Post-score of every candidate (R-03, R-04, U-02, U-04)."""
    return _post(spark, d).select(
        *KEY, *_SCORES, F.array_join(F.array_sort("issues"), ",").alias("issues"), F.array_join(F.array_sort("warnings"), ",").alias("warnings")
    )


_MEANS = {
    "document_quality": "overall_score", "document_confidence": "confidence", "avg_placeholder_preservation": "placeholder_score",
    "avg_numeric_accuracy": "numeric_score",
    "avg_format_preservation": "format_score", "avg_fluency": "fluency_score", "avg_fidelity": "fidelity_score",
}


@query(
    f"WITH {X.PAIRS}, {_POST}, {texts.PRE_REQUESTS}, g AS (SELECT backend, "
    f"{', '.join(f'sum({c}::DECIMAL(38,12))::DOUBLE / count(*) AS {k}' for k, c in _MEANS.items())}, count(*) AS blocks_total, count(*) FILTER (acceptable) "
    f"AS blocks_acceptable, "
    "count(*) FILTER (needs_review) AS blocks_need_review, count(*) FILTER (needs_retry) AS blocks_need_retry, sum(len(issues))::BIGINT AS total_issues, "
    "sum(len(warnings))::BIGINT AS total_warnings FROM postx GROUP BY backend), "
    "c AS (SELECT r0.backend, sum(complexity_score::DECIMAL(38,12))::DOUBLE / count(*) AS avg_source_complexity, count(*) FILTER (complexity_score > "
    "0.6::DOUBLE) AS complex_blocks FROM r0 JOIN pre ON r0.request_id = pre.request_id GROUP BY r0.backend) "
    "SELECT g.*, coalesce(avg_source_complexity, 0::DOUBLE) AS avg_source_complexity, coalesce(complex_blocks, 0) AS complex_blocks, "
    "blocks_acceptable::DOUBLE / blocks_total AS acceptance_rate FROM g LEFT JOIN c ON g.backend = c.backend"
)
def backend_scores(spark, d):
    """All metrics of every backend, its requests' complexity included (A-01, J-03, A-18)."""
    pre = X.results(spark, d).select("request_id", "backend").join(texts.pre_requests(spark, d).select("request_id", "complexity_score"), "request_id")
    return R.score_summary(_post(spark, d), pre, ["backend"])


def _upper_sql(x):
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


_ID = rf"""
i0 AS (SELECT *, {X.norm_sql('source_text')} AS sn, {X.norm_sql('translated_text')} AS tn, {X.strip_sql('source_text')} AS raw, {X.words_sql('source_text')} AS w FROM pairs),
i1 AS (SELECT *, CASE WHEN tn = '' THEN 'empty' WHEN sn = '' OR sn <> tn THEN 'different' WHEN
  list_contains({"[" + ", ".join(f"'{x}'" for x in C.ACADEMIC_WORDS) + "]"}, sn) THEN 'academic_heading' WHEN NOT regexp_matches(source_text,
  '[\p{{L}}\p{{M}}\p{{Nl}}\p{{No}}_]') THEN 'no_letters'
  WHEN {" OR ".join(f"contains(upper(source_text), '{x}')" for x in sorted({y.upper() for y in C.TECHNICAL_TERMS}))} THEN 'technical_term'
  WHEN NOT contains(raw, ' ') AND raw <> '' AND ((length(raw) <= 4 AND {_upper_sql('raw')}) OR (length(raw) <= 8 AND regexp_full_match(raw,
    '[A-Z0-9][A-Z0-9\-/.]+')) OR (length(raw) <= 6 AND regexp_full_match(raw, '[A-Za-z]{{1,4}}\d{{1,3}}[A-Za-z]{{0,2}}')) OR regexp_full_match(raw,
    '[A-Za-z]{{1,3}}/[A-Za-z]{{1,3}}') OR list_contains({"[" + ", ".join(f"'{x}'" for x in C.UNITS) + "]"}, lower(raw))) THEN 'short_token'
  WHEN len(w) BETWEEN 2 AND 3 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\p{{Lu}}'))) = 0 THEN 'proper_noun' WHEN
    list_contains({"[" + ", ".join(f"'{x}'" for x in C.COMMON_PHRASES) + "]"}, sn) THEN 'common_phrase' ELSE 'identical' END AS reason FROM i0)
"""


@query(
    rf"WITH {X.PAIRS}, {_ID} SELECT result_id, idx, reason, reason IN ('empty', 'academic_heading', 'identical') AS is_identity, reason IN ('empty', "
    rf"'academic_heading') OR (reason = 'identical' AND is_header) AS should_retry FROM i1"
)
def identity_ladder(spark, d):
    """Answers that equal their source, by reason (C-08, C-07)."""
    p = X.pairs(spark, d).withColumn("i", C.identity(F.col("source_text"), F.col("translated_text"), F.col("is_header")))
    return p.select(*KEY, "i.reason", "i.is_identity", "i.should_retry")


@query(
    rf"WITH {X.PAIRS}, c AS (SELECT *, length({X.strip_sql('source_text')}) AS n, length({X.strip_sql('translated_text')}) AS m FROM pairs) SELECT result_id, "
    rf"idx, n > 0 AND m > 0 AND m::DOUBLE / nullif(n, 0) > CASE WHEN is_header THEN 2 WHEN n < 50 THEN 3 ELSE 2 END AS too_long, "
    rf"len(list_filter(list_distinct(regexp_extract_all(translated_text, '{_PH}')), lambda p: NOT list_contains(registry, p)))::INT AS invented, "
    rf"len(list_filter(registry, lambda p: NOT contains(regexp_replace(translated_text, '\s*_\s*', '_', 'g'), p)))::INT AS missing, "
    rf"{' OR '.join(f'contains(lower(translated_text), {chr(39)}{g.replace(chr(39), chr(39) * 2)}{chr(39)})' for g in T.GENERIC_RESPONSES)} AS generic, "
    rf"{' OR '.join(f'contains(lower(translated_text), {chr(39)}{g}{chr(39)})' for g in T.SPILLOVER_WORDS)} AS spillover FROM c"
)
def hallucination_flags(spark, d):
    """Answers that are too long, generic, or hold invented tokens or instructions (R-11, J-11, J-12, X-02, X-03, U-06)."""
    t = F.col("translated_text")
    return X.pairs(spark, d).select(
        *KEY, S.length_suspect(F.col("source_text"), t, F.col("is_header")).alias("too_long"),
        F.size(M.invented_tokens(t, F.col("registry"), T.PLACEHOLDER)).alias("invented"), F.size(M.missing_tokens(F.col("registry"), t)).alias("missing"),
        T.any_of(F.lower(t), T.GENERIC_RESPONSES).alias("generic"), T.has_spillover(t).alias("spillover")
    )


_RANK = rf"""
k0 AS (SELECT *, source_text AS s, translated_text AS c, {_NE('source_text')} AS ns, {_NE('translated_text')} AS nc, {X.bullets_sql('source_text')} AS bs,
  {X.bullets_sql('translated_text')} AS bc, {X.lines_sql('source_text')} AS ls, {X.lines_sql('translated_text')} AS lc, length(translated_text)::DOUBLE /
  nullif(length(source_text), 0) AS ratio FROM pairs),
rank_parts AS (SELECT result_id, idx, CASE WHEN len(registry) = 0 THEN 1::DOUBLE ELSE len(list_filter(registry, lambda p: contains(c, p)))::DOUBLE /
  len(registry) END AS placeholder, {_share_sql('list_transform(ns, lambda x: x::DOUBLE)', 'list_transform(nc, lambda x: x::DOUBLE)')} AS numeric,
  CASE WHEN bs > 0 THEN least(bc::DOUBLE / nullif(bs, 0), 1::DOUBLE) ELSE 1::DOUBLE END * 0.5::DOUBLE + CASE WHEN ls > 0 THEN least(lc::DOUBLE / nullif(ls, 0),
    1::DOUBLE) ELSE 1::DOUBLE END * 0.5::DOUBLE AS format,
  CASE WHEN s = '' THEN 1::DOUBLE WHEN ratio > 2.5::DOUBLE OR ratio < 0.4::DOUBLE THEN 0.2::DOUBLE WHEN ratio > 2 OR ratio < 0.5::DOUBLE THEN 0.3::DOUBLE WHEN
    ratio > 1.8::DOUBLE OR ratio < 0.6::DOUBLE THEN 0.6::DOUBLE WHEN ratio > 1.5::DOUBLE OR ratio < 0.7::DOUBLE THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS
    length_score FROM k0)
"""


@query(rf"WITH {X.PAIRS}, {_RANK} SELECT * FROM rank_parts")
def rerank_native(spark, d):
    """Native rank components of every candidate (R-07, V-06)."""
    p = S.rerank_parts(F.col("source_text"), F.col("translated_text"), F.col("registry"), F.col("is_header"))
    return X.pairs(spark, d).select(
        *KEY, p["placeholder"].alias("placeholder"), p["numeric"].alias("numeric"), p["format"].alias("format"), p["length"].alias("length_score")
    )


@query()
def rerank_full(spark, d):
    """Candidates of every result in rank order, their share of the glossary's terms included (R-07..R-10, W-10, W-11, U-05)."""
    p = X.pairs(spark, d).withColumnRenamed("translated_text", "candidate")
    g = L.adherence(p, KEY, "source_text", "candidate", _glossary(spark, d), anywhere=True).select(*KEY, F.col("adherence_rate").alias("glossary_score"))
    p = p.join(g, KEY, "left")
    return K.ranked(p, ["result_id"]).select(*KEY, "rank", "valid", "total", "similarity", "semantic_part")


@query(
    rf"WITH {X.PAIRS} SELECT result_id, idx, CASE WHEN count(*) OVER (PARTITION BY result_id) > 1 THEN (count(*) OVER (PARTITION BY result_id) - idx) * "
    rf"0.5::DOUBLE ELSE 0 END AS bonus FROM pairs"
)
def position_bonus(spark, d):
    """Bonus of early candidates (W-11)."""
    n = F.count("*").over(Window.partitionBy("result_id"))
    return X.pairs(spark, d).select(*KEY, F.when(n > 1, (n - F.col("idx")) * F.lit(0.5)).otherwise(F.lit(0.0)).alias("bonus"))


def _clean_sql(x: str) -> str:
    q = lambda t: t.replace("'", "''")
    mark = "[' || chr(34) || chr(39) || ']"  # either quotation mark, inside an SQL string
    t = rf"regexp_replace(regexp_replace({X.strip_sql(x)}, '(?s)```.*?```', '', 'g'), '^{mark}([^\n\r]+){mark}$', '\1')"
    steps = [f"c0 AS (SELECT *, {t} AS t0 FROM pairs)"]
    for i, p in enumerate(T.SPILLOVER_PREFIXES):
        trimmed = X.strip_sql(f"regexp_replace(t{i}, '(?i)^{q(p)}:?\\s*', '')")
        steps.append(f"c{i + 1} AS (SELECT * EXCLUDE (t{i}), {trimmed} AS t{i + 1} FROM c{i})")
    k = len(T.SPILLOVER_PREFIXES)
    bad = q("|".join(f"(?:{p})" for p in T.SPILLOVER_LINES))
    only = "[" + ", ".join(f"'{q(w)}'" for w in T.SPILLOVER_ONLY) + "]"
    line = (
        f"list_filter(string_split(t{k}, chr(10)), lambda x: NOT (regexp_full_match(lower({X.strip_sql('x')}), '{bad}') OR list_contains({only}, "
        f"lower({X.strip_sql('x')}))))"
    )
    any_ = lambda c, words: "(" + " OR ".join(f"contains({c}, '{q(w)}')" for w in words) + ")"
    para = (
        f"list_filter(list_transform(string_split(array_to_string({line}, chr(10)), chr(10) || chr(10)), lambda p: {X.strip_sql('p')}), lambda p: p <> '' AND "
        f"NOT (length(p) < 50 AND {any_('lower(p)', T.SPILLOVER_SHORT)}) AND NOT {any_('lower(p)', T.SPILLOVER_MARKERS)})"
    )
    joined = f"regexp_replace(array_to_string({para}, chr(10) || chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    trimmed = X.strip_sql(f"regexp_replace({joined}, '(?m)[ \\t]+$', '', 'g')")
    steps.append(f"cz AS (SELECT result_id, idx, {x}, CASE WHEN {X.strip_sql(x)} = '' THEN {x} ELSE {trimmed} END AS cleaned FROM c{k})")
    return ", ".join(steps)


@query(f"WITH {X.PAIRS}, {_clean_sql('translated_text')} SELECT result_id, idx, cleaned, true AS modified FROM cz WHERE cleaned <> translated_text")
def spillover_clean(spark, d):
    """Answers without instruction spillover, where that changes them (X-01)."""
    c = T.clean_spillover(F.col("translated_text"))
    return X.pairs(spark, d).select(*KEY, c.alias("cleaned"), (c != F.col("translated_text")).alias("modified")).filter("modified")


_NUM = (
    "n0 AS (SELECT row_number() OVER (ORDER BY source, target, load_seq) AS k, source, target FROM glossary), n1 AS (SELECT k, CASE k % 4 WHEN 0 THEN k || '. "
    "' || source WHEN 1 THEN 'IV) ' || source WHEN 2 THEN '• ' || source ELSE source END AS s, CASE WHEN k % 8 < 4 THEN target ELSE k || '. ' || target END AS "
    "t FROM n0)"
)


@query(
    rf"WITH {_NUM} SELECT k, CASE WHEN k % 4 = 3 OR k % 8 >= 4 THEN t WHEN k % 4 = 0 THEN k || '. ' || t WHEN k % 4 = 1 THEN 'IV) ' || t ELSE '• ' || t END "
    rf"AS fixed, CASE WHEN k % 8 >= 4 OR k % 4 = 3 THEN false ELSE true END AS lost FROM n1"
)
def numbering_repair(spark, d):
    """Numbering and bullets of headings put back where a translation lost them (X-08, X-09)."""
    k = F.row_number().over(Window.orderBy("source", "target", "load_seq")).cast("bigint")  # a fixed table of 120 rows
    g = read_table(spark, d, "glossary").select(k.alias("k"), "source", "target")
    s = F.when(
        F.col("k") % 4 == 0, F.concat("k", F.lit(". "), "source")
    ).when(F.col("k") % 4 == 1, F.concat(F.lit("IV) "), "source")).when(F.col("k") % 4 == 2, F.concat(F.lit("• "), "source")).otherwise(F.col("source"))
    t = F.when(F.col("k") % 8 < 4, F.col("target")).otherwise(F.concat("k", F.lit(". "), "target"))
    fixed = T.keep_numbering(s, t)
    return g.select("k", fixed.alias("fixed"), (fixed != t).alias("lost"))


_BUL = "[" + T.BULLETS.replace("-", r"\-") + "]"
_FULL = lambda x: f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {X.strip_sql('x')}), lambda x: x <> '')"
_MARK = lambda x: rf"regexp_extract({x}, '^\s*({_BUL})[ \d]', 1)"
_N_BUL = lambda x: f"len(list_filter({x}, lambda x: {_MARK('x')} <> ''))::INT"
_SPILT = " OR ".join(f"contains(lower(x), '{w}')" for w in T.BULLET_SPILLOVER)


@query(
    rf"WITH b0 AS (SELECT doc_id, text, regexp_replace(text, '(?m)^(\s*){_BUL} ', '\1', 'g') AS bare FROM documents WHERE regexp_matches(text, "
    rf"'(?m)^\s*{_BUL} ')), b1 AS (SELECT *, {_FULL('text')} AS s, {_FULL('bare')} AS t FROM b0), "
    rf"b2 AS (SELECT *, list_transform(s, lambda x: {_MARK('x')}) AS marks, list_filter(t, lambda x: NOT ({_SPILT})) AS kept FROM b1), b3 AS (SELECT *, "
    rf"list_filter(marks, lambda x: x <> '') AS used FROM b2), "
    "b4 AS (SELECT *, CASE WHEN len(used) > len(s) * 0.5 THEN used[1] ELSE '' END AS extra FROM b3), "
    rf"b5 AS (SELECT *, CASE WHEN (len(s) <= 1 AND len(t) <= 1) OR len(used) = 0 OR len(kept) = 0 THEN string_split(bare, chr(10)) ELSE list_transform(kept, "
    rf"lambda x, i: CASE WHEN CASE WHEN i <= len(s) THEN marks[i] ELSE extra END IN ('', {_MARK('x')}) THEN x "
    rf"ELSE CASE WHEN i <= len(s) THEN marks[i] ELSE extra END || ' ' || CASE WHEN {_MARK('x')} = '' THEN x ELSE {X.strip_sql('substring(x, 2)')} END END) "
    rf"END AS ls FROM b4) "
    f"SELECT doc_id, {_N_BUL('string_split(text, chr(10))')} AS before, {_N_BUL('string_split(bare, chr(10))')} AS without, {_N_BUL('ls')} AS after FROM b5"
)
def bullet_repair(spark, d):
    """Lists whose bullets are taken away and put back by the source's (X-10): lines with bullets before, without, and after."""
    t = read_table(spark, d, "documents").select("doc_id", "text").filter(F.col("text").rlike(rf"(?m)^\s*[{T.BULLETS.replace('-', chr(92) + '-')}] "))
    bare = F.regexp_replace("text", rf"(?m)^(\s*)[{T.BULLETS.replace('-', chr(92) + '-')}] ", "$1")
    n = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: T.bullet_of(x) != ""))
    return t.select("doc_id", n(F.col("text")).alias("before"), n(bare).alias("without"), n(T.keep_bullets(F.col("text"), bare)).alias("after"))


@query(
    rf"WITH {X.PAIRS} SELECT result_id, idx, ok AND trim(translated_text) <> '' AS replace, CASE WHEN ok AND trim(translated_text) <> '' THEN translated_text "
    rf"ELSE source_text END AS text FROM pairs"
)
def render_decision(spark, d):
    """Text that a page shows for every candidate (P-09)."""
    x = G.render_decision(F.col("source_text"), F.col("translated_text"), F.col("ok"))
    return X.pairs(spark, d).select(*KEY, x["replace"].alias("replace"), x["text"].alias("text"))


_GL = (
    "gl AS (SELECT * FROM (SELECT *, lower(source) AS term_key, row_number() OVER (PARTITION BY lower(source) ORDER BY load_seq DESC, source, target) AS r "
    "FROM glossary WHERE source <> '') WHERE r = 1)"
)


def _glossary(spark, d):
    return L.merged_glossary(read_table(spark, d, "glossary"))


@query(f"WITH {_GL} SELECT term_key, source, target, domain, load_seq FROM gl")
def glossary_merge(spark, d):
    """The glossary with later entries winning (U-01, S-08)."""
    return _glossary(spark, d).select("term_key", "source", "target", "domain", "load_seq")


@query("SELECT domain, count(*) AS n, count(DISTINCT lower(source)) AS n_terms FROM glossary GROUP BY domain")
def glossary_stats(spark, d):
    """Entries by domain (A-15)."""
    return read_table(spark, d, "glossary").groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct(F.lower("source")).alias("n_terms"))


@query(
    f"WITH {_GL}, q AS (SELECT DISTINCT request_id, text FROM requests WHERE text IS NOT NULL) SELECT request_id, term_key, target FROM q JOIN gl ON "
    f"contains(lower(text), term_key)"
)
def glossary_substring_terms(spark, d):
    """Terms contained in requests (J-09)."""
    q = X.requests(spark, d).select("request_id", "text").filter("text is not null")
    return L.terms_contained(q, "text", _glossary(spark, d)).select("request_id", "term_key", "target")


@query(
    f"WITH {_GL}, q AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, term_key, row_number() OVER (PARTITION BY doc_id "
    f"ORDER BY length(source) DESC, term_key) AS rank FROM q JOIN gl ON contains(lower(text), term_key)) SELECT doc_id, term_key, rank::INT AS rank FROM f "
    f"WHERE rank <= 3"
)
def glossary_top_terms(spark, d):
    """The three longest terms of each document (T-02)."""
    q = read_table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    return L.top_terms(L.terms_contained(q, "text", _glossary(spark, d)), ["doc_id"], 3).select("doc_id", "term_key", "rank")


_WORD = lambda t, term: rf"contains({t}, {term}) AND regexp_matches({X.ascii_words(t)}, '\b' || {X.ascii_words(term)} || '\b')"


@query(
    rf"WITH {X.PAIRS}, {_GL}, f AS (SELECT p.result_id, p.idx, contains(lower(p.translated_text), lower(gl.target)) AS good FROM pairs p JOIN gl ON CASE WHEN "
    rf"gl.case_sensitive THEN {_WORD('p.source_text', 'gl.source')} ELSE {_WORD('lower(p.source_text)', 'gl.term_key')} END), "
    "a AS (SELECT result_id, idx, count(*) AS n, count(*) FILTER (good) AS g FROM f GROUP BY ALL) SELECT p.result_id, p.idx, coalesce(n, 0) AS terms_found, "
    "coalesce(g, 0) AS terms_enforced, coalesce(n, 0) - coalesce(g, 0) AS terms_violated, coalesce(g::DOUBLE / n, 1::DOUBLE) AS adherence_rate FROM pairs p "
    "LEFT JOIN a ON p.result_id = a.result_id AND p.idx = a.idx"
)
def glossary_adherence(spark, d):
    """Adherence of every candidate to the glossary, terms as whole words (J-10, A-16)."""
    return L.adherence(X.pairs(spark, d), KEY, "source_text", "translated_text", _glossary(spark, d))


_TITLE = lambda x: f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ')"
_STEP = (
    "CASE WHEN contains(lower(p.a), lower(x.t)) THEN p.a ELSE regexp_replace(p.a, CASE WHEN x.c THEN '' ELSE '(?i)' END || '\\b' || regexp_escape(x.s) || "
    "'\\b', "
    f"CASE WHEN upper(x.s) = x.s AND lower(x.s) <> x.s THEN upper(x.t) WHEN {_TITLE('x.s')} = x.s THEN {_TITLE('x.t')} ELSE x.t END, 'g') END"
)


@query(
    rf"WITH {X.PAIRS}, {_GL}, f AS (SELECT p.result_id, p.idx, list({{'s': gl.source, 't': gl.target, 'c': gl.case_sensitive, 'a': ''}} ORDER BY gl.source, "
    rf"gl.target, gl.case_sensitive) AS ts FROM pairs p JOIN gl "
    rf"ON CASE WHEN gl.case_sensitive THEN {_WORD('p.source_text', 'gl.source')} ELSE {_WORD('lower(p.source_text)', 'gl.term_key')} END GROUP BY "
    rf"p.result_id, p.idx) "
    f"SELECT p.result_id, p.idx, list_reduce(list_concat([{{'s': '', 't': '', 'c': false, 'a': p.translated_text}}], f.ts), lambda p, x: {{'s': '', 't': '', "
    f"'c': false, 'a': {_STEP}}}).a AS enforced_text "
    "FROM pairs p JOIN f ON p.result_id = f.result_id AND p.idx = f.idx"
)
def glossary_enforced(spark, d):
    """Answers with untranslated terms replaced (X-14, X-15)."""
    p = X.pairs(spark, d).select(*KEY, "source_text", "translated_text")
    f = L.terms_as_words(p, "source_text", _glossary(spark, d)).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("source", "target", "case_sensitive"))).alias("terms")
    )
    return L.enforced(p.join(f, KEY), "translated_text", "terms").select(*KEY, "enforced_text")


_KEYS = "'cache_' || substring(sha256(concat_ws('|', coalesce(backend, ''), coalesce(model, ''), source_text, coalesce(target_lang, ''), '', 'v1')), 1, 16)"


@query(
    rf"WITH {X.PAIRS}, k AS (SELECT result_id, {_KEYS} AS cache_key, backend, request_id FROM pairs WHERE idx = 0), c AS (SELECT DISTINCT ON (k.cache_key) "
    rf"k.cache_key, CASE WHEN k.result_id % 5 = 0 THEN 'v0' ELSE 'v1' END AS version, CASE WHEN k.result_id % 7 = 0 THEN NULL ELSE r.created_at END AS "
    rf"created_at FROM k JOIN (SELECT DISTINCT result_id, created_at FROM results) r ON k.result_id = r.result_id WHERE k.result_id % 3 <> 0 ORDER BY "
    rf"k.cache_key, created_at DESC NULLS LAST, version) "
    rf"SELECT k.result_id, k.cache_key, CASE WHEN c.cache_key IS NULL THEN 'miss_not_found' WHEN c.version <> 'v1' THEN 'miss_version' WHEN c.created_at IS "
    rf"NULL THEN 'miss_no_timestamp' WHEN date_diff('second', date_trunc('second', c.created_at), TIMESTAMP '2025-03-25 00:00:00') > 604800 THEN "
    rf"'miss_expired' ELSE 'hit' END AS cache_status FROM k LEFT JOIN c ON k.cache_key = c.cache_key"
)
def cache_status_ladder(spark, d):
    """Cache look-up with version and age (J-04, S-11, R-12, N-02, Z-01): results as requests, two thirds of them as the cache."""
    p = X.pairs(spark, d).filter("idx = 0")
    p = p.withColumn(
        "cache_key", T.cache_key(F.col("backend"), F.col("model"), F.col("source_text"), F.col("target_lang"), F.lit(""), F.lit("v1"))
    ).select("result_id", "cache_key")
    made = X.results(spark, d).select("result_id", "created_at", "candidates")
    c = p.join(made, "result_id").filter("result_id % 3 <> 0").select(
        "cache_key", "candidates", F.when(F.col("result_id") % 5 == 0, "v0").otherwise("v1").alias("version"),
        F.when(F.col("result_id") % 7 != 0, F.col("created_at")).alias("created_at")
    )
    return L.cache_lookup(p, c, F.lit("2025-03-25 00:00:00").cast("timestamp"), 604_800, "v1").select("result_id", "cache_key", "cache_status")


_MEM = (
    "m0 AS (SELECT DISTINCT request_id, text, target_lang FROM requests), m AS (SELECT request_id, coalesce(target_lang, '') || ':' || CASE WHEN length(text) "
    "<= 100 THEN text ELSE md5(text) END AS key FROM m0 WHERE text IS NOT NULL)"
)


@query(
    f"WITH {_MEM}, f AS (SELECT key, min(request_id) AS first_id, count(*) AS n FROM m GROUP BY key) SELECT m.request_id, f.first_id, f.n FROM m JOIN f ON "
    f"m.key = f.key WHERE f.n > 1"
)
def memory_exact(spark, d):
    """Requests whose text a translation memory already holds for the same language (J-05)."""
    q = X.requests(spark, d).filter("text is not null").select(
        "request_id",
        F.concat(F.coalesce("target_lang", F.lit("")), F.lit(":"), F.when(F.length("text") <= 100, F.col("text")).otherwise(F.md5("text"))).alias("key")
    )
    f = q.groupBy("key").agg(F.min("request_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return q.join(f, "key").select("request_id", "first_id", "n")


@query(f"WITH {_MEM} SELECT target_lang, count(*) AS n, count(DISTINCT text) AS n_texts FROM m0 GROUP BY target_lang")
def memory_stats(spark, d):
    """Memory entries by language (A-14)."""
    return X.requests(spark, d).groupBy("target_lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


@query()
def memory_fuzzy_topk(spark, d):
    """The three most similar texts of other requests in the same target language, for every request whose id is divisible by 20 (J-06, T-01, R-13)."""
    r = X.requests(spark, d).filter("text is not null").select("request_id", F.coalesce("target_lang", F.lit("")).alias("pair"), "text")
    q = r.filter("request_id % 20 = 0").withColumnRenamed("request_id", "query_id")
    m = r.withColumnRenamed("request_id", "memory_id").withColumn("quality", F.lit(1.0))
    return L.fuzzy_matches(q, m, 0.85, 3, others=True)


@query(
    f"WITH q AS (SELECT DISTINCT request_id, is_header FROM requests), r AS (SELECT DISTINCT request_id FROM results) SELECT q.request_id, "
    f"coalesce(q.is_header, false) AS is_header FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.request_id = q.request_id)"
)
def coverage_anti(spark, d):
    """Requests without a result (J-13, U-07, P-21)."""
    return L.missing_rows(
        X.requests(spark, d).select("request_id", F.coalesce("is_header", F.lit(False)).alias("is_header")), X.results(spark, d), ["request_id"]
    )


@query(
    rf"WITH {X.PAIRS}, {_HEALTH}, old AS (SELECT request_id, translated_text, ok AND status <> 'failed' AS ok FROM health WHERE idx = 0), new AS (SELECT "
    rf"request_id, translated_text, ok AND status <> 'failed' AS ok FROM health WHERE idx = 1) "
    rf"SELECT old.request_id, CASE WHEN coalesce(new.ok, false) AND NOT old.ok THEN new.translated_text ELSE old.translated_text END AS translated_text, "
    rf"old.ok OR coalesce(new.ok, false) AS ok, coalesce(new.ok, false) AND NOT old.ok AS repaired FROM old LEFT JOIN new ON old.request_id = new.request_id"
)
def repair_merge(spark, d):
    """First candidates with failed ones replaced by good second ones (J-14, P-08)."""
    h = _health(spark, d).withColumn("ok", F.col("ok") & (F.col("status") != "failed"))
    old = h.filter("idx = 0").select("request_id", "translated_text", "ok")
    new = h.filter("idx = 1").select("request_id", "translated_text", "ok").join(old.filter("not ok").select("request_id"), "request_id", "left_semi")
    return L.repaired(old, new, ["request_id"])


@query(rf"WITH {X.PAIRS} SELECT doc_id, count(*) AS n, count(*) FILTER (translated_text <> '') AS n_answered FROM pairs WHERE idx = 0 GROUP BY doc_id")
def export_json(spark, d):
    """Translations of every document as one JSON text, counted back from it (S-12, S-04, N-01)."""
    p = X.pairs(spark, d).filter("idx = 0").select("doc_id", F.col("request_id").alias("block_no"), "block_id", "source_text", "translated_text")
    j = translations_json(p, ["doc_id"], F.struct(F.lit("1").alias("version")))
    a = F.from_json("json", "struct<translations:array<struct<block_no:bigint,translated_text:string>>>")["translations"]
    return j.select("doc_id", F.size(a).cast("bigint").alias("n"), F.size(F.filter(a, lambda x: x["translated_text"] != "")).cast("bigint").alias("n_answered"))


@query("SELECT DISTINCT request_id, 0 AS idx, upper(coalesce(target_lang, '')) || ': ' || coalesce(text, '') AS candidate FROM requests")
def offline_candidates(spark, d):
    """Candidates of an offline backend for every request (V-01..V-03)."""
    return K.generated(X.requests(spark, d).select("request_id", "text", "target_lang", "n_candidates"), "prefix").select("request_id", "idx", "candidate")


_HARD = "complexity_score > 0.6::DOUBLE"


@query(
    f"WITH {texts.PRE_REQUESTS}, h AS (SELECT *, CASE WHEN {_HARD} THEN recommended_candidates ELSE coalesce(n_candidates, 1) END AS k FROM pre) SELECT "
    f"request_id, greatest(60::DOUBLE, n::DOUBLE / 50 * 10) AS timeout, "
    f"CASE WHEN is_header THEN greatest(k, 3) ELSE k END AS candidates, CASE WHEN {_HARD} THEN recommended_temperature ELSE temperature END AS temperature, n "
    f"<= 8 AS fast_route FROM h"
)
def request_routing(spark, d):
    """Time-outs, candidates, temperatures and routes of all requests: complex ones take what their pre-score recommends, headers three candidates at least (P-16, P-17, P-20, J-03)."""
    q = texts.pre_requests(spark, d)
    n, hard = F.col("n"), F.col("complexity_score") > 0.6
    k = F.when(hard, F.col("recommended_candidates")).otherwise(F.coalesce("n_candidates", F.lit(1)))
    return q.select(
        "request_id", F.greatest(F.lit(60.0), n.cast("double") / 50 * 10).alias("timeout"),
        F.when(F.col("is_header"), F.greatest(k, F.lit(3))).otherwise(k).alias("candidates"),
        F.when(hard, F.col("recommended_temperature")).otherwise(F.col("temperature")).alias("temperature"), (n <= 8).alias("fast_route"),
    )
