"""Queries over runs: benchmarks, ablations, experiments, evaluation, criteria; results by backend and day are the runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import rollups as R
from folioscope.sources import read_table

from . import frames as X
from .catalog import query

_RUNS = rf"""{X.PAIRS},
ru AS (SELECT r.result_id, r.backend, q.doc_id, q.idx, q.ok, q.translated_text = q.source_text AS same_, length(q.translated_text) AS n, r.cached,
  date_trunc('day', c.created_at) AS day FROM pairs q JOIN r0 r ON q.result_id = r.result_id JOIN (SELECT DISTINCT result_id, created_at FROM results) c ON
  c.result_id = r.result_id),
runs AS (SELECT backend, doc_id, count(*) AS blocks, count(*) FILTER (ok AND NOT same_) AS good, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (cached)
  AS cached, sum(n)::BIGINT AS chars FROM ru GROUP BY backend, doc_id)"""


def _runs(spark, d):
    p = X.pairs(spark, d).withColumn("same_", F.col("translated_text") == F.col("source_text"))
    return p.groupBy("backend", "doc_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("ok") & ~F.col("same_")).alias("good"), F.count_if(~F.col("ok")).alias("failed"),
        F.count_if("cached").alias("cached"), F.sum(F.length("translated_text")).alias("chars")
    )


@query(
    f"WITH {_RUNS} SELECT backend, count(*) AS runs, sum(blocks)::BIGINT AS total_blocks, sum(good)::BIGINT AS total_ok, sum(failed)::BIGINT AS total_failed, "
    f"sum(failed)::DOUBLE / greatest(1, sum(blocks)) AS failure_rate, sum(cached)::DOUBLE / greatest(1, sum(blocks)) AS cache_hit_rate, sum(chars)::DOUBLE / "
    f"count(*) AS chars_per_run FROM runs GROUP BY backend"
)
def benchmark_rollup(spark, d):
    """Runs by backend with rates (A-18..A-20, A-30, S-19)."""
    s = lambda c: F.sum(c).cast("double")
    one = F.greatest(F.lit(1), F.sum("blocks"))
    return _runs(spark, d).groupBy("backend").agg(
        F.count("*").alias("runs"), F.sum("blocks").alias("total_blocks"), F.sum("good").alias("total_ok"), F.sum("failed").alias("total_failed"),
        (s("failed") / one).alias("failure_rate"), (s("cached") / one).alias("cache_hit_rate"), (s("chars") / F.count("*")).alias("chars_per_run")
    )


@query(
    f"WITH {_RUNS}, b AS (SELECT backend, sum(good)::DOUBLE / sum(blocks) AS quality FROM runs GROUP BY backend) SELECT backend, quality, quality - (SELECT "
    f"quality FROM b WHERE backend = 'cascade_free') AS delta, quality = (SELECT max(quality) FROM b) AS is_best, CASE WHEN quality >= 0.9::DOUBLE THEN "
    f"'Excellent' WHEN quality >= 0.75::DOUBLE THEN 'Good' WHEN quality >= 0.5::DOUBLE THEN 'Fair' ELSE 'Poor' END AS band FROM b"
)
def ablation_best(spark, d):
    """Best backend and differences to the base (A-25, P-25)."""
    b = _runs(spark, d).groupBy("backend").agg((F.sum("good").cast("double") / F.sum("blocks")).alias("quality"))
    base = b.agg(F.max(F.when(F.col("backend") == "cascade_free", F.col("quality"))).alias("base"), F.max("quality").alias("best"))
    q = F.col("quality")
    return b.join(F.broadcast(base)).select(
        "backend", "quality", (q - F.col("base")).alias("delta"), (q == F.col("best")).alias("is_best"),
        F.when(q >= 0.9, "Excellent").when(q >= 0.75, "Good").when(q >= 0.5, "Fair").otherwise("Poor").alias("band")
    )


_SPLIT = (
    f"{_RUNS}, sides AS (SELECT doc_id, sum(good) FILTER (backend = 'cascade_free')::DOUBLE / sum(blocks) FILTER (backend = 'cascade_free') AS fixed, "
    f"sum(good) FILTER (backend <> 'cascade_free')::DOUBLE / sum(blocks) FILTER (backend <> 'cascade_free') AS adaptive FROM runs GROUP BY doc_id), both_ AS "
    f"(SELECT * FROM sides WHERE fixed IS NOT NULL AND adaptive IS NOT NULL)"
)


def _sides(spark, d):
    c = F.col("backend") == "cascade_free"
    s = lambda cond, v: F.sum(F.when(cond, F.col(v)))
    g = _runs(spark, d).groupBy("doc_id").agg(
        (s(c, "good").cast("double") / s(c, "blocks")).alias("fixed"), (s(~c, "good").cast("double") / s(~c, "blocks")).alias("adaptive")
    )
    return g.filter("fixed is not null and adaptive is not null")


@query(
    f"WITH {_SPLIT} SELECT doc_id, fixed, adaptive, adaptive - fixed AS delta, CASE WHEN fixed <> 0 THEN (adaptive - fixed) / fixed * 100 END AS improvement "
    f"FROM both_"
)
def experiment_delta(spark, d):
    """One system against another by document (J-20, J-21)."""
    return _sides(spark, d).select(
        "doc_id", "fixed", "adaptive", (F.col("adaptive") - F.col("fixed")).alias("delta"),
        R.improvement(F.col("fixed"), F.col("adaptive")).alias("improvement")
    )


@query(
    f"WITH {_SPLIT}, u AS (UNPIVOT both_ ON fixed, adaptive INTO NAME metric VALUE value) SELECT metric, count(*) AS n, min(value) AS lowest, max(value) AS "
    f"highest, sum(value::DECIMAL(38,12))::DOUBLE / count(*) AS average FROM u GROUP BY metric"
)
def evaluation_unpivot(spark, d):
    """Summary of the metrics, one row each (A-24)."""
    u = _sides(spark, d).unpivot(["doc_id"], ["fixed", "adaptive"], "metric", "value")
    return u.groupBy("metric").agg(
        F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"), R.mean_exact(F.col("value")).alias("average")
    )


@query(
    f"WITH {_SPLIT}, s AS (SELECT count(*) AS n, sum((adaptive - fixed)::DECIMAL(38,12))::DOUBLE AS s1, sum(((adaptive - fixed) * (adaptive - "
    f"fixed))::DECIMAL(38,12))::DOUBLE AS s2 FROM both_), v AS (SELECT n, s1 / n::DOUBLE AS mean_difference, (s2 - s1 * s1 / n::DOUBLE) / nullif(n::DOUBLE - "
    f"1, 0) AS var FROM s) SELECT n, mean_difference, CASE WHEN var > 0 THEN mean_difference / (sqrt(var) / sqrt(n::DOUBLE)) END AS t FROM v"
)
def paired_t(spark, d):
    """Paired t statistic of the two systems (A-22)."""
    return R.paired_t(_sides(spark, d), "adaptive", "fixed")


@query(
    f"WITH {_RUNS} SELECT doc_id, sum(failed) = 0 AS none_failed, sum(good)::DOUBLE / sum(blocks) >= 0.9::DOUBLE AS quality_ok, sum(failed) = 0 AND "
    f"sum(good)::DOUBLE / sum(blocks) >= 0.9::DOUBLE AS success FROM runs GROUP BY doc_id"
)
def success_criteria(spark, d):
    """Criteria of success by document (P-23)."""
    none, good = F.sum("failed") == 0, F.sum("good").cast("double") / F.sum("blocks") >= 0.9
    return _runs(spark, d).groupBy("doc_id").agg(none.alias("none_failed"), good.alias("quality_ok"), (none & good).alias("success"))


@query(
    f"WITH {_RUNS}, b AS (SELECT backend, day, count(*) AS n, count(*) FILTER (ok) AS good FROM ru GROUP BY backend, day) SELECT backend, day, n, (sum(n) "
    f"OVER w)::BIGINT AS done, (sum(good) OVER w)::DOUBLE / sum(n) OVER w AS success_rate FROM b WINDOW w AS (PARTITION BY backend ORDER BY day ROWS "
    f"UNBOUNDED PRECEDING)"
)
def batch_progress(spark, d):
    """Running success rate of every backend by day (A-28)."""
    made = X.results(spark, d).select("result_id", F.date_trunc("day", "created_at").alias("day"))
    b = X.pairs(spark, d).join(made, "result_id").groupBy("backend", "day").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))
    w = Window.partitionBy("backend").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("backend", "day", "n", F.sum("n").over(w).alias("done"), (F.sum("good").over(w).cast("double") / F.sum("n").over(w)).alias("success_rate"))


@query(
    f"WITH {_RUNS}, b AS (SELECT backend, sum(failed)::DOUBLE / sum(blocks) AS f FROM runs GROUP BY backend) SELECT CASE WHEN f = 0 THEN 'healthy' WHEN f < "
    f"0.05::DOUBLE THEN 'degraded' ELSE 'error' END AS category, string_agg(backend, ',' ORDER BY backend) AS backends FROM b GROUP BY 1"
)
def backend_status(spark, d):
    """Backends by state (A-29)."""
    b = _runs(spark, d).groupBy("backend").agg((F.sum("failed").cast("double") / F.sum("blocks")).alias("f"))
    return b.groupBy(
        F.when(F.col("f") == 0, "healthy").when(F.col("f") < 0.05, "degraded").otherwise("error").alias("category")
    ).agg(F.array_join(F.array_sort(F.collect_list("backend")), ",").alias("backends"))


@query(
    rf"WITH {X.PAIRS} SELECT backend, count(*) AS n, greatest(60::DOUBLE, 30::DOUBLE + count(*) * ((sum(length(source_text))::DOUBLE / count(*)) / 100 * 10) "
    rf"* 0.3::DOUBLE) AS timeout FROM pairs GROUP BY backend"
)
def batch_timeouts(spark, d):
    """Time-out of one batch of everything, by backend (P-18)."""
    n = F.count("*")
    return X.pairs(spark, d).groupBy("backend").agg(
        n.alias("n"), F.greatest(F.lit(60.0), F.lit(30.0) + n * ((F.sum(F.length("source_text")).cast("double") / n) / 100 * 10) * 0.3).alias("timeout")
    )


@query(
    rf"WITH {X.PAIRS}, e AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (len(errors) = 0) AS kept, count(*) FILTER (len(registry) > 0) AS protected_, "
    rf"count(*) FILTER (len(registry) > 0 AND len(errors) = 0) AS intact FROM pairs GROUP BY doc_id) SELECT doc_id, kept::DOUBLE / blocks AS preservation, "
    rf"CASE WHEN protected_ > 0 THEN intact::DOUBLE / protected_ END AS formula_preservation FROM e"
)
def evaluation_metrics(spark, d):
    """Preservation of protected parts by document (A-23)."""
    e = X.pairs(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("b"), F.count_if(F.size("errors") == 0).alias("k"), F.count_if(F.size("registry") > 0).alias("p"),
        F.count_if((F.size("registry") > 0) & (F.size("errors") == 0)).alias("i")
    )
    return e.select("doc_id", (F.col("k") / F.col("b")).alias("preservation"), F.when(F.col("p") > 0, F.col("i") / F.col("p")).alias("formula_preservation"))


@query(
    "WITH d AS (SELECT doc_id, source_path, received_at FROM documents WHERE source_path IS NOT NULL) SELECT source_path, count(*) AS n, min(received_at) AS "
    "first_at, date_diff('second', date_trunc('second', min(received_at)), date_trunc('second', max(received_at))) AS age_seconds FROM d GROUP BY source_path"
)
def source_ages(spark, d):
    """Files with the time between their first and last rows (N-02, T-05)."""
    t = F.col("received_at")
    return read_table(spark, d, "documents").filter("source_path is not null").groupBy("source_path").agg(
        F.count("*").alias("n"), F.min(t).alias("first_at"), (F.unix_timestamp(F.max(t)) - F.unix_timestamp(F.min(t))).alias("age_seconds")
    )


@query(
    f"WITH l AS (SELECT code, english_name FROM lang_codes), q AS (SELECT DISTINCT request_id, lower(trim(source_lang)) AS s, target_lang FROM requests) "
    f"SELECT q.request_id, l.code IS NOT NULL AS source_valid, t.english_name AS target_name FROM q LEFT JOIN l ON q.s = l.code LEFT JOIN l t ON "
    f"q.target_lang = t.code"
)
def language_codes(spark, d):
    """Codes that are valid, and names of target languages (L-02)."""
    l = read_table(spark, d, "lang_codes").select("code", "english_name")
    q = X.requests(spark, d).select("request_id", F.lower(F.trim("source_lang")).alias("s"), "target_lang")
    j = q.join(F.broadcast(l.select(F.col("code").alias("s"), F.lit(True).alias("ok"))), "s", "left").join(
        F.broadcast(l.select(F.col("code").alias("target_lang"), F.col("english_name").alias("target_name"))), "target_lang", "left"
    )
    return j.select("request_id", F.coalesce("ok", F.lit(False)).alias("source_valid"), "target_name")


_TERMS = rf"""gl AS (SELECT * FROM (SELECT *, lower(source) AS term_key, row_number() OVER (PARTITION BY lower(source) ORDER BY load_seq DESC, source, target) AS r FROM glossary WHERE source <> '') WHERE r = 1), q AS (SELECT DISTINCT request_id, text, source_lang, target_lang FROM requests),
f AS (SELECT q.request_id, gl.source, gl.target, row_number() OVER (PARTITION BY q.request_id ORDER BY length(gl.source) DESC, term_key) AS k FROM q JOIN gl ON
  contains(lower(q.text), gl.term_key) AND CASE WHEN gl.case_sensitive THEN contains(q.text, gl.source) AND regexp_matches({X.ascii_words('q.text')}, '\b' ||
  {X.ascii_words('gl.source')} || '\b') ELSE regexp_matches({X.ascii_words('lower(q.text)')}, '\b' || {X.ascii_words('gl.term_key')} || '\b') END),
t AS (SELECT request_id, string_agg('  • "' || source || '" → "' || target || '"', chr(10) ORDER BY k) AS terms FROM f WHERE k <= 20 GROUP BY request_id)"""


@query(
    f"WITH {_TERMS} SELECT q.request_id, 'Translate from ' || coalesce(source_lang, 'the source language') || ' to ' || coalesce(target_lang, 'the target "
    f"language') || '. Keep every protected token unchanged.' || CASE WHEN terms IS NULL THEN '' ELSE chr(10) || 'Use these terminology translations:' || "
    f"chr(10) || terms END AS prompt, '{T.PROMPT_VERSION}' AS version FROM q LEFT JOIN t ON q.request_id = t.request_id"
)
def prompts(spark, d):
    """Prompt text of every request with its relevant terms (X-16, X-17)."""
    from folioscope.operators import lookups as L

    q = X.requests(spark, d).select("request_id", "text", "source_lang", "target_lang")
    g = L.merged_glossary(read_table(spark, d, "glossary"))
    t = L.top_terms(L.terms_as_words(q.select("request_id", "text").filter("text is not null"), "text", g), ["request_id"], 20)
    lines = t.groupBy("request_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("  • \""), "source", F.lit("\" → \""), "target", F.lit("\"")).alias("l")))),
                lambda x: x["l"]
            ),
            "\n"
        ).alias("terms")
    )
    head = F.concat(
        F.lit("Translate from "), F.coalesce("source_lang", F.lit("the source language")), F.lit(" to "),
        F.coalesce("target_lang", F.lit("the target language")), F.lit(". Keep every protected token unchanged.")
    )
    return q.join(lines, "request_id", "left").select(
        "request_id",
        F.concat_ws("\n", head, F.when(F.col("terms").isNotNull(), F.concat(F.lit("Use these terminology translations:\n"), "terms"))).alias("prompt"),
        F.lit(T.PROMPT_VERSION).alias("version")
    )


@query()
def text_comparison(spark, d):
    """Requests compared with their first candidates: similarity, lines of the unified diff, lines added and removed, ratio of the lengths (X-18)."""
    from folioscope.operators.lookups import comparison
    from folioscope.sources import ship_package

    ship_package(spark)
    p = X.pairs(spark, d).filter("idx = 0").select("result_id", "source_text", "translated_text")
    x = p.withColumn("x", comparison()("source_text", "translated_text"))
    ratio = F.coalesce(F.try_divide(F.length("translated_text"), F.length("source_text")), F.lit(0.0))
    return x.select("result_id", "x.similarity", F.array_join("x.diff", "\n").alias("diff"), "x.added", "x.removed", ratio.alias("length_ratio"))
