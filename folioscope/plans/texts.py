"""Queries over single texts: pre-scores, language, tables, numbering, prefixes, masks, content."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import classify as C
from folioscope.functions import scoring as S
from folioscope.functions import text as T
from folioscope.operators import masking as M
from folioscope.operators import rollups as R
from folioscope.sources import read_table

from . import frames as X
from .catalog import query


def with_pre_scores(t, keep):
    """Kept columns with the pre-score of the column text."""
    f = S.pre_flags(F.col("text"))
    t = t.select(*keep, *[v.alias(k) for k, v in f.items()])
    t = t.withColumn("complexity_score", S.complexity({k: F.col(k) for k in f})).withColumn("s", S.strategy(F.col("complexity_score")))
    return t.select(
        "*", F.col("s.temperature").alias("recommended_temperature"), F.col("s.candidates").alias("recommended_candidates"),
        F.col("s.constraints").alias("recommended_constraints")
    ).drop("s")


def _pre(spark, d):
    return with_pre_scores(read_table(spark, d, "documents").select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"])


_PRE = rf"""
t1 AS (SELECT *, {X.words_sql('text')} AS w FROM t0),
t2 AS (SELECT t1.* EXCLUDE (text, w), regexp_matches(text, '(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]') AS has_math, regexp_matches(text, '```|`[^`]+`') AS has_code,
  regexp_matches(text, 'https?://|www\.') AS has_urls,
  regexp_matches(text, '\[\d+\]|\[\d+,\s*\d+\]') AS has_citations, regexp_matches(text, '\|.*\|') AS has_tables, regexp_matches(text, '{X.BULLET_SQL}') AS
    has_bullets, len({X.numbers_sql('text')}) > 0 AS has_numbers,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '{X.NWS}')))::INT AS sentence_count, len(w)::INT AS word_count,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE / greatest(len(w), 1) AS avg_word_length, len(list_filter(w, lambda x: length(x) >
    8))::DOUBLE / greatest(len(w), 1) AS technical_term_density FROM t1),
t3 AS (SELECT *, least(CASE WHEN has_math THEN 0.25::DOUBLE ELSE 0::DOUBLE END + CASE WHEN has_code THEN 0.2::DOUBLE ELSE 0::DOUBLE END + CASE WHEN has_tables
  THEN 0.15::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN has_urls OR has_citations THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN has_bullets THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN
    has_numbers THEN 0.05::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN avg_word_length > 6 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN technical_term_density > 0.3::DOUBLE THEN 0.1::DOUBLE ELSE 0::DOUBLE END +
    CASE WHEN sentence_count > 5 THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE) AS complexity_score FROM t2),
pre AS (SELECT *, CASE WHEN complexity_score > 0.7::DOUBLE THEN 0::DOUBLE WHEN complexity_score > 0.4::DOUBLE THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS recommended_temperature,
  CASE WHEN complexity_score > 0.7::DOUBLE THEN 5 ELSE 3 END AS recommended_candidates, CASE WHEN complexity_score > 0.7::DOUBLE THEN 'strict' WHEN
    complexity_score > 0.4::DOUBLE THEN 'normal' ELSE 'relaxed' END AS recommended_constraints FROM t3)
"""
PRE = f"t0 AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),{_PRE}"
#: Pre-scores of the distinct requests.
PRE_REQUESTS = (
    "t0 AS (SELECT DISTINCT request_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, coalesce(is_header, false) AS is_header, n_candidates, "
    "temperature FROM requests),"
    f"{_PRE}"
)


def pre_requests(spark, d):
    """Distinct requests with their pre-scores."""
    keep = ["request_id", "is_header", "n_candidates", "temperature"]
    q = X.requests(spark, d).select(
        "request_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_header", F.lit(False)).alias("is_header"), "n_candidates", "temperature"
    )
    return with_pre_scores(q.withColumn("n", F.length("text")), [*keep, "n"])


@query(f"WITH {PRE} SELECT * FROM pre")
def pre_score_documents(spark, d):
    """Pre-score of every document (R-01, R-02)."""
    return _pre(spark, d)


@query(
    f"WITH {PRE} SELECT lang, count(*) AS n, sum(complexity_score::DECIMAL(38,12))::DOUBLE / count(*) AS avg_complexity, count(*) FILTER (complexity_score > "
    f"0.6::DOUBLE) AS n_complex, count(*) FILTER (recommended_constraints = 'strict') AS n_strict, count(*) FILTER (recommended_constraints = 'normal') AS "
    f"n_normal FROM pre GROUP BY lang"
)
def pre_score_by_lang(spark, d):
    """Complexity and strategies by declared language: the flagship query."""
    c, k = F.col("complexity_score"), F.col("recommended_constraints")
    return _pre(spark, d).groupBy("lang").agg(
        F.count("*").alias("n"), R.mean_exact(c).alias("avg_complexity"), F.count_if(c > 0.6).alias("n_complex"), F.count_if(k == "strict").alias("n_strict"),
        F.count_if(k == "normal").alias("n_normal")
    )


@query(
    f"WITH {PRE} SELECT recommended_constraints, recommended_candidates, count(*) AS n, count(*) FILTER (complexity_score > 0.6::DOUBLE OR has_math) AS "
    f"n_extra FROM pre GROUP BY ALL"
)
def strategy_histogram(spark, d):
    """Number of documents by recommended strategy."""
    return _pre(spark, d).groupBy("recommended_constraints", "recommended_candidates").agg(
        F.count("*").alias("n"), F.count_if((F.col("complexity_score") > 0.6) | F.col("has_math")).alias("n_extra")
    )


def _lists(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _lang_sql(table: str, key: str) -> str:
    score = {
        k: f"(len(list_filter(w, lambda x: list_contains({_lists(c)}, x))) * 0.5::DOUBLE + len(list_filter(w, lambda x: list_contains({_lists(a)}, x))) * 2::DOUBLE) / len(w)"
        for k,
        (c, a) in C.LANGUAGE_WORDS.items()
    }
    return rf"""
l0 AS (SELECT {key}, left(coalesce(text, ''), 500) AS s FROM {table}),
l1 AS (SELECT *, len(regexp_extract_all(s, '[一-鿿]')) AS zh, len(regexp_extract_all(s, '[\x{{3040}}-\x{{30FF}}]')) AS ja, len(regexp_extract_all(s,
  '[\x{{AC00}}-\x{{D7AF}}]')) AS ko, len(regexp_extract_all(s, '[\x{{3000}}-\x{{303F}}]')) AS marks,
  list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '{C.WORD_CLASS[1:-1]}')) AS w FROM l0),
l2 AS (SELECT *, (zh + ja + ko + marks * 0.5::DOUBLE) / length(s) AS share, {", ".join(f"{v} AS s_{k}" for k, v in score.items())} FROM l1),
l3 AS (SELECT {key}, CASE WHEN {X.strip_sql('s')} = '' THEN 'en' WHEN share > 0.3::DOUBLE THEN CASE WHEN zh > ja AND zh > ko THEN 'zh' WHEN ja > ko THEN 'ja'
  WHEN ko > 0 THEN 'ko' ELSE 'zh' END WHEN len(w) = 0 THEN 'en'
   WHEN s_en = greatest(s_en, s_fr, s_es, s_de) THEN 'en' WHEN s_fr = greatest(s_en, s_fr, s_es, s_de) THEN 'fr' WHEN s_es = greatest(s_en, s_fr, s_es, s_de)
     THEN 'es' ELSE 'de' END AS detected,
  CASE WHEN {X.strip_sql('s')} = '' THEN 0::DOUBLE WHEN share > 0.3::DOUBLE THEN least(share * 1.5::DOUBLE, 0.9::DOUBLE) WHEN len(w) = 0 THEN 0.1::DOUBLE ELSE
    least(greatest(s_en, s_fr, s_es, s_de) * 1.5::DOUBLE, 0.8::DOUBLE) END AS confidence FROM l2)
"""


@query(f"WITH {_lang_sql('documents', 'doc_id')} SELECT doc_id, detected, confidence FROM l3")
def language_detect(spark, d):
    """Language of every document by its first 500 characters (L-01)."""
    x = C.language(F.col("text"))
    return read_table(spark, d, "documents").select("doc_id", x["lang"].alias("detected"), x["confidence"].alias("confidence"))


@query(
    f"WITH {_lang_sql('documents', 'doc_id')} SELECT lower(trim(documents.lang)) AS declared, detected, count(*) AS n FROM l3 JOIN documents USING (doc_id) "
    f"GROUP BY ALL"
)
def language_confusion(spark, d):
    """Declared against detected language."""
    return read_table(spark, d, "documents").select(
        F.lower(F.trim("lang")).alias("declared"), C.language(F.col("text"))["lang"].alias("detected")
    ).groupBy("declared", "detected").agg(F.count("*").alias("n"))


def _columns_sql(x: str) -> str:
    st = lambda e: X.strip_sql(e)
    return (
        f"list_filter(list_transform(CASE WHEN contains({x}, '|') THEN string_split({x}, '|') WHEN contains({x}, chr(9)) THEN string_split({x}, chr(9)) ELSE "
        f"regexp_split_to_array({x}, '\\s{{2,}}') END, lambda c: {st('c')}), lambda c: c <> '')"
    )


def _heading_sql(x: str) -> str:
    any_ = " OR ".join(f"contains(lower({x}), '{k}')" for k in C.HEADING_WORDS)
    return rf"(regexp_matches({x}, '[A-Za-z]') AND (regexp_matches({x}, '^\d+(?:\.\d+)*{X.WS}*[.:]?{X.WS}+[\p{{L}}\p{{N}}_]') OR {any_}))"


_TABLE = rf"""
tb0 AS (SELECT doc_id, block_id, coalesce(text, '') AS c, coalesce(type, '') = 'text' AS is_text, coalesce(is_header, false) OR coalesce(block_type, '') IN
  ('title', 'header', 'subheader') AS is_heading FROM block_texts),
tb1 AS (SELECT *, {X.strip_sql('c')} AS st, string_split(c, chr(10)) AS ls FROM tb0),
tb2 AS (SELECT *, len(ls) AS n, contains(c, '|') OR contains(c, chr(9)) AS sep, len({_columns_sql('c')}) AS cells, list_transform(regexp_extract_all(c, '  +'),
  lambda g: length(g)) AS gaps,
  len(list_filter({X.words_sql('c')}, lambda w: regexp_matches(w, '\d'))) AS nums, list_filter(list_transform(ls, lambda l: len({_columns_sql('l')})), lambda k: k >= 2) AS cc,
  len(regexp_extract_all(c, '\d')) AS digits, len(list_filter(ls, lambda l: {X.strip_sql('l')} <> '' AND length({X.strip_sql('l')}) <= 20)) AS short,
    len(list_filter(ls, lambda l: regexp_matches(l, '\d'))) AS numeric, len(list_filter(ls, lambda l: contains(l, '  '))) AS dbl FROM tb1),
tb3 AS (SELECT *, NOT (length(c) < 100 AND ({_heading_sql('st')} OR (st LIKE '%:' AND length(st) < 50))) AND ((sep AND cells >= 2) OR (contains(c, '  ') AND
  (cells >= 3 OR nums >= 4) AND len(gaps) >= 2 AND list_max(gaps) <= list_min(gaps) * 3)) AS one,
  sep::INT + coalesce(len(cc) >= 2 AND list_max(cc) - list_min(cc) <= 1, false)::INT + (digits::DOUBLE / greatest(length(c), 1) > 0.22::DOUBLE)::INT +
    (contains(c, '  ') AND dbl >= n * 0.5::DOUBLE)::INT AS signals FROM tb2),
tables AS (SELECT doc_id, block_id, c AS text, coalesce(is_text AND NOT is_heading AND st <> '' AND CASE WHEN n = 1 THEN one ELSE (n >= 6 AND short::DOUBLE / n
  >= 0.7::DOUBLE AND numeric::DOUBLE / n >= 0.3::DOUBLE) OR signals >= 2 END, false) AS is_table,
  regexp_matches(lower(st), '^(figure|fig\.|table)') AS is_caption FROM tb3)
"""


def _tables(spark, d):
    b = X.block_texts(spark, d)
    heading = F.coalesce("is_header", F.lit(False)) | F.coalesce(F.col("block_type"), F.lit("")).isin("title", "header", "subheader")
    return b.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "is_table", C.table_candidate(F.col("text"), F.coalesce("type", F.lit("")) == "text", heading)
    ).withColumn("is_caption", C.caption_candidate(F.col("text")))


@query(f"WITH {X.BLOCK_TEXTS}, {_TABLE} SELECT doc_id, block_id, is_table, is_caption FROM tables")
def table_candidates(spark, d):
    """Tables and captions among the blocks (C-01..C-03, X-12, X-13, P-12)."""
    return _tables(spark, d).select("doc_id", "block_id", "is_table", "is_caption")


@query(
    rf"WITH {X.BLOCK_TEXTS} SELECT doc_id, block_id, coalesce(text, '') AS text, CASE WHEN regexp_matches(coalesce(text, ''), '[一-鿿぀-ヿ가-힯]') THEN 'cjk' WHEN "
    rf"regexp_matches(coalesce(text, ''), '[Ѐ-ӿ]') THEN 'cyrillic' ELSE 'latin' END AS script FROM block_texts"
)
def block_text(spark, d):
    """Text and script of every block from its spans (P-01, P-13, S-03)."""
    return X.block_texts(spark, d).select(
        "doc_id", "block_id", F.coalesce("text", F.lit("")).alias("text"), T.script_category(F.coalesce("text", F.lit(""))).alias("script")
    )


def _numbering_sql(x: str) -> str:
    out = "''"
    for kind, p, g, _ in reversed(T.NUMBERINGS):
        out = f"CASE WHEN regexp_matches({x}, '{p}') THEN '{kind}' ELSE {out} END"
    return out


def _numbering_part_sql(x: str, which: int) -> str:
    out = "''"
    for _, p, g, sep in reversed(T.NUMBERINGS):
        group = {0: 0, 1: g, 2: sep}[which]
        value = "''" if which == 1 and not g else f"regexp_extract({x}, '{p}', {group})"
        out = f"CASE WHEN regexp_matches({x}, '{p}') THEN {value} ELSE {out} END"
    return out


@query(
    rf"WITH t AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INT AS line_no, string_split(coalesce(text, ''), chr(10)) AS "
    rf"ls FROM documents), l AS (SELECT doc_id, line_no, ls[line_no + 1] AS x FROM t) "
    rf"SELECT doc_id, line_no, {_numbering_sql('x')} AS kind, {_numbering_part_sql('x', 1)} AS number, {_numbering_part_sql('x', 2)} AS separator FROM l "
    rf"WHERE {_numbering_sql('x')} <> ''"
)
def numbering_kinds(spark, d):
    """Numbered lines of all documents by kind (X-07, P-15)."""
    ln = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "x"))
    n = T.numbering(F.col("x"))
    return ln.select("doc_id", "line_no", n["kind"].alias("kind"), n["number"].alias("number"), n["separator"].alias("separator")).filter("kind <> ''")


_GLOSSARY_HEADS = (
    "g0 AS (SELECT row_number() OVER (ORDER BY source, target, load_seq) AS k, source, target FROM glossary), s0 AS (SELECT k, CASE WHEN k % 3 = 0 THEN "
    "'Section ' || k || ': ' || source WHEN k % 3 = 1 THEN 'chapter ' || k || ') ' || source ELSE source END AS head, target FROM g0)"
)


def _heads(spark, d):
    """Headings of the glossary, two thirds of them with a section prefix put before."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.orderBy("source", "target", "load_seq"))  # a fixed table of 120 rows
    g = read_table(spark, d, "glossary").select(k.cast("bigint").alias("k"), "source", "target")
    head = F.when(
        F.col("k") % 3 == 0, F.concat(F.lit("Section "), "k", F.lit(": "), "source")
    ).when(F.col("k") % 3 == 1, F.concat(F.lit("chapter "), "k", F.lit(") "), "source")).otherwise(F.col("source"))
    return g.select("k", head.alias("head"), "target")


_SP = T.SECTION_PREFIX


@query(
    rf"WITH {_GLOSSARY_HEADS} SELECT k, regexp_extract(head, '{_SP}', 0) AS prefix, CASE WHEN regexp_extract(head, '{_SP}', 0) = '' THEN head ELSE {X.strip_sql(f'''substring(head, length(regexp_extract(head, '{_SP}', 0)) + 1)''')} END AS content, "
    rf"CASE WHEN regexp_extract(head, '{_SP}', 0) = '' THEN target WHEN lower(regexp_extract(head, '{_SP}', 1)) = 'chapter' THEN 'Chapitre ' || "
    rf"regexp_extract(head, '{_SP}', 2) || ' : ' || target ELSE 'Section ' || regexp_extract(head, '{_SP}', 2) || ' : ' || target END AS translated FROM s0"
)
def section_prefix(spark, d):
    """Section prefixes split off, translated and put back (X-04..X-06)."""
    h = _heads(spark, d)
    prefix, content = T.section_prefix(F.col("head"))
    return h.select("k", prefix.alias("prefix"), content.alias("content"), T.with_section_prefix(F.col("target"), prefix, "fr").alias("translated"))


@query(
    rf"WITH {X.BLOCK_TEXTS}, {_TABLE}, {_lang_sql('tables', 'doc_id, block_id')}, m AS (SELECT t.*, l3.detected, l3.confidence, d.lang AS dl FROM tables t "
    rf"JOIN l3 USING (doc_id, block_id) LEFT JOIN documents d USING (doc_id)) "
    rf"SELECT doc_id, block_id, CASE WHEN is_table AND NOT ((contains(lower(text), 'contents') AND length(text) < 100) OR ((contains(lower(text), 'figure') "
    rf"OR contains(lower(text), 'fig.') OR contains(lower(text), 'table') OR contains(lower(text), 'tab.')) AND length(text) < 200)) THEN 'table' "
    rf"WHEN {X.strip_sql('text')} = '' THEN 'empty' WHEN detected <> coalesce(dl, '') AND detected <> 'en' AND confidence > 0.5::DOUBLE THEN 'preserve_lang_' "
    rf"|| detected END AS skip_reason FROM m"
)
def routing_reasons(spark, d):
    """Why blocks aren't translated into English (P-04..P-07, P-03)."""
    t = _tables(spark, d).join(read_table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left")
    return t.select("doc_id", "block_id", C.skip_reason(F.col("text"), F.col("is_table"), F.col("lang"), F.lit("en")).alias("skip_reason"))


_MASKS = [(k, p) for k, p in M.RULES if k != "PERSON_NAME"]
#: The pattern without its look-ahead, which only keeps it from an empty formula.
_RE2 = {"MATH_INLINE": r"(?s)\$[^$\n]+\$|\\\(.*?\\\)"}


@query(
    "SELECT doc_id, "
    + ", ".join(
        f"len(regexp_extract_all({X.ascii_words('coalesce(text, chr(32))') if chr(92) + 'b' in p or k == 'TOC_ENTRY' else 'coalesce(text, chr(32))'}, "
        f"'{_RE2.get(k, p)}'))::INT AS n_{k.lower()}"
        for k,
        p in _MASKS
    )
    + " FROM documents"
)
def mask_kind_counts(spark, d):
    """Matches of the protective patterns in every document (M-02); names, which DuckDB has no pattern for, are in mask_restore_roundtrip."""
    t = F.coalesce("text", F.lit(" "))
    return read_table(spark, d, "documents").select("doc_id", *[F.regexp_count(t, F.lit(p)).alias(f"n_{k.lower()}") for k, p in _MASKS])


@query()
def mask_restore_roundtrip(spark, d):
    """Masked texts, their tokens, and whether restoring gives the text back (M-01, M-03, M-05..M-08, A-07, W-09)."""
    m = M.mask(read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    r = M.restore(m.withColumn("translated_text", F.col("masked_text")))
    return r.select(
        "doc_id", "masked_text", F.size("registry").alias("n_tokens"), "mask_counts", (F.col("restored_text") == F.col("text")).alias("same"), "restore_errors"
    )


@query()
def person_names(spark, d):
    """Texts with names that the masking engine protects (M-06, M-07)."""
    m = M.mask(read_table(spark, d, "documents").select("doc_id", "text"))
    return m.select(
        "doc_id", F.explode(F.transform(F.filter("registry", lambda x: x["ph"].contains("_PERSON_NAME_")), lambda x: x["original"])).alias("name")
    ).groupBy("name").agg(F.count("*").alias("n"))


@query(
    rf"SELECT request_id, len(regexp_extract_all(coalesce(text, ''), '{X.PLACEHOLDER_SQL}'))::INT AS n_tokens, "
    rf"len(list_distinct(regexp_extract_all(coalesce(text, ''), '{X.PLACEHOLDER_SQL}')))::INT AS n_distinct, regexp_full_match(coalesce(text, ''), "
    rf"'{X.WS}*{X.PLACEHOLDER_SQL}{X.WS}*') AS only_token FROM (SELECT DISTINCT request_id, text FROM requests)"
)
def placeholder_scan(spark, d):
    """Protected tokens of the requests (M-04, P-26)."""
    t = F.coalesce("text", F.lit(""))
    m = T.matches(t, T.PLACEHOLDER)
    return X.requests(spark, d).select(
        "request_id", F.size(m).alias("n_tokens"), F.size(F.array_distinct(m)).alias("n_distinct"), t.rlike(rf"(?U)^\s*{T.PLACEHOLDER}\s*$").alias("only_token")
    )


_KW = " + ".join(f"contains(t, '{k}')::INT" for k in C.CONTENT_KEYWORDS)


@query(
    rf"""WITH {X.BLOCK_TEXTS}, b AS (SELECT doc_id, block_no, block_id, lower(coalesce(text, '')) AS t, coalesce(text, '') AS raw, coalesce(is_header, false) OR coalesce(block_type, '') IN ('title', 'header', 'subheader') AS head FROM block_texts),
g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY block_no, block_id) AS t, count(*) AS n, count(*) FILTER (regexp_matches(raw, '@@[A-Z_]*MATH_')) AS m, count(*)
  FILTER (head AND ({" OR ".join(f"contains(t, '{h}')" for h in C.CONTENT_HEADERS)})) AS hs FROM b GROUP BY doc_id),
k AS (SELECT doc_id, ({_KW})::INT AS keywords, (len(regexp_extract_all(t, '\[\d+\]')) + len(regexp_extract_all({X.ascii_words('t')}, '\bet\s+al\.')))::INT AS
  citations, m::DOUBLE / n AS math_share, hs::INT AS headers FROM g)
SELECT *, (least(40, 2 * keywords) + least(20, citations)) + least(20::DOUBLE, math_share * 100) + CASE WHEN headers >= 3 THEN 20 WHEN headers >= 1 THEN 10
  ELSE 0 END AS score FROM k"""
)
def content_type(spark, d):
    """Academic score of every document (A-12)."""
    b = X.block_texts(spark, d).select(
        "doc_id", "block_no", "block_id", F.coalesce("text", F.lit("")).alias("raw"),
        (F.coalesce("is_header", F.lit(False)) | F.coalesce(F.col("block_type"), F.lit("")).isin("title", "header", "subheader")).alias("head")
    )
    low = F.lower("raw")
    g = b.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "block_id", low.alias("t")))), lambda x: x["t"]), " ").alias("t"),
        F.count("*").alias("n"),
        F.count_if(F.col("raw").rlike("@@[A-Z_]*MATH_")).alias("m"), F.count_if(F.col("head") & T.any_of(low, C.CONTENT_HEADERS)).cast("int").alias("headers"),
    )
    keywords = sum((F.col("t").contains(k).cast("int") for k in C.CONTENT_KEYWORDS[1:]), F.col("t").contains(C.CONTENT_KEYWORDS[0]).cast("int"))
    k = g.select(
        "doc_id", keywords.alias("keywords"),
        (F.size(T.matches(F.col("t"), r"\[\d+\]")) + F.size(T.matches(F.col("t"), r"\bet(?U:\s+)al\."))).alias("citations"),
        (F.col("m") / F.col("n")).alias("math_share"), "headers"
    )
    score = (
        F.least(F.lit(40), 2 * F.col("keywords")) + F.least(F.lit(20), "citations")
    ) + F.least(F.lit(20.0), F.col("math_share") * 100) + F.when(F.col("headers") >= 3, 20).when(F.col("headers") >= 1, 10).otherwise(0)
    return k.withColumn("score", score)


@query(rf"SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '\', '\textbackslash{{}}'), '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{{', '\{{'), '}}', '\}}'), '~', '\textasciitilde{{}}'), '^', '\textasciicircum{{}}') AS tex FROM documents")
def latex_export(spark, d):
    """Texts escaped for LaTeX in the fixed order (S-13)."""
    return read_table(spark, d, "documents").select("doc_id", T.latex_escaped(F.coalesce("text", F.lit(""))).alias("tex"))


@query(
    "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(CASE WHEN instr(left(text, 80), ' ') > 0 AND 80 - instr(reverse(left(text, "
    "80)), ' ') > 64 THEN left(text, (80 - instr(reverse(left(text, 80)), ' '))::INT) ELSE left(text, 80) END, '[.,;:!?]+$', '') || '...' END AS short FROM "
    "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
)
def truncated_texts(spark, d):
    """Texts cut to 80 characters at a word (X-11)."""
    return read_table(spark, d, "documents").select("doc_id", T.truncated(F.coalesce("text", F.lit("")), 80).alias("short"))
