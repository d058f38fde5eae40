"""Scores of source texts, of translated pairs and of candidates, as column expressions.

The additions are written in the order in which the scores are defined: thresholds compare strictly, and another order of the
same doubles would decide some of them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

NUMBER, NUMBER_EXP, NUMBER_COMMA = T.NUMBER, T.NUMBER_EXP, T.NUMBER_COMMA
#: Parts of an issue that make a translation unacceptable.
CRITICAL = ("placeholder_restoration_failed", "placeholder_not_restored", "placeholder_hallucinated", "identity_translation", "missing_placeholder")
RERANK_WEIGHTS = {
    "placeholder": 10.0, "glossary": 3.0, "numeric": 2.0, "format": 1.0, "semantic": 4.0, "identity": 8.0, "length": 3.0, "spillover": 6.0, "hallucinated": 6.0
}
#: Words of an unrelated answer.
SUSPICIOUS = ["result", "résultat", "document", "layout", "mise", "page", "en"]


def _d(x: float) -> Column:
    return F.lit(float(x))


def _div(a: Column, b: Column) -> Column:
    """Quotient; null for a divisor of 0, also where the caller's condition would have kept it from being used."""
    return F.try_divide(a, b)


def pre_flags(c: Column) -> dict[str, Column]:
    """Flags and statistics of a source text; a null text counts as empty."""
    c = F.coalesce(c, F.lit(""))
    w = T.words(c)
    n = F.size(w)
    at_least_one = F.greatest(n, F.lit(1))
    return {
        "has_math": c.rlike(r"(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]"),
        "has_code": c.rlike(r"```|`[^`]+`"),
        "has_urls": c.rlike(r"https?://|www\."),
        "has_citations": c.rlike(r"\[\d+\]|\[\d+,\s*\d+\]"),
        "has_tables": c.rlike(r"\|.*\|"),
        "has_bullets": c.rlike(T.BULLET_LINE),
        "has_numbers": c.rlike(NUMBER),
        "sentence_count": F.size(F.filter(F.split(c, "[.!?]+"), lambda x: x.rlike(r"(?U)\S"))),
        "word_count": n,
        "avg_word_length": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / at_least_one,
        "technical_term_density": F.size(F.filter(w, lambda x: F.length(x) > 8)) / at_least_one,
    }


def complexity(f: dict[str, Column]) -> Column:
    """Complexity from 0 to 1 of the flags of :func:`pre_flags` (columns may also be references to them)."""
    add = lambda cond, x: F.when(cond, _d(x)).otherwise(_d(0))
    total = add(f["has_math"], 0.25) + add(f["has_code"], 0.20) + add(f["has_tables"], 0.15) + add(
        f["has_urls"] | f["has_citations"], 0.10
    ) + add(f["has_bullets"], 0.05) + add(f["has_numbers"], 0.05)
    total = total + add(f["avg_word_length"] > 6, 0.10) + add(f["technical_term_density"] > 0.3, 0.10) + add(f["sentence_count"] > 5, 0.05)
    return F.least(total, _d(1))


def strategy(score: Column) -> Column:
    """Struct temperature, candidates, constraints recommended for a complexity."""
    s = lambda t, n, c: F.struct(_d(t).alias("temperature"), F.lit(n).alias("candidates"), F.lit(c).alias("constraints"))
    return F.when(score > 0.7, s(0.0, 5, "strict")).when(score > 0.4, s(0.1, 3, "normal")).otherwise(s(0.2, 3, "relaxed"))


def share_kept(source: Column, target: Column) -> Column:
    """Share of the distinct elements of one array that another holds; 1 for an empty one."""
    s = F.array_distinct(source)
    return F.when(F.size(s) == 0, _d(1)).otherwise(_div(F.size(F.array_intersect(s, F.array_distinct(target))), F.size(s)))


def multiset_kept(source: Column, target: Column) -> Column:
    """Number of elements of an array that another one holds as often."""
    n = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.aggregate(F.array_distinct(source), F.lit(0), lambda acc, x: acc + F.least(n(source, x), n(target, x)))


def most_frequent(a: Column) -> Column:
    """How often the most frequent element of an array occurs, by the runs of the sorted array; 1 for an empty one."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(1).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(a), start, step, lambda s: s["best"])


def bullets(c: Column) -> Column:
    return F.size(T.matches(c, T.BULLET_LINE))


def post_facts(source: Column, target: Column, registry: Column, errors: Column) -> dict[str, Column]:
    """What the scores of a translated pair are made of; nulls count as empty."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    empty = F.array().cast("array<string>")
    registry, errors = F.coalesce(registry, empty), F.coalesce(errors, empty)
    sets = lambda a, b: F.struct(F.array_distinct(F.split(a, "")).alias("a"), F.array_distinct(F.split(b, "")).alias("b"))
    overlap = lambda a, b: T.let(sets(a, b), lambda x: _div(F.size(F.array_intersect(x["a"], x["b"])), F.size(F.array_union(x["a"], x["b"]))))
    # 0: told apart or blank, 1: some overlap of characters, 2: high overlap, 3: equal
    level = lambda a, b: F.when((a == "") | (b == ""), 0).when(a == b, 3).otherwise(T.let(overlap(a, b), lambda o: F.when(o > 0.95, 2).when(o > 0.85, 1).otherwise(0)))
    both = F.struct(T.normalised(s).alias("s"), T.normalised(t).alias("t"))
    words = T.words(F.lower(t))
    repetition = T.let(words, lambda w: F.when(F.size(w) > 5, _div(most_frequent(F.filter(w, lambda x: F.length(x) > 3)), F.size(w))).otherwise(_d(0)))
    return {
        "f_level": T.let(both, lambda x: level(x["s"], x["t"])),
        "f_tokens": F.size(registry),
        "f_still": F.size(F.filter(registry, lambda p: t.contains(p))),
        "f_restore": F.exists(errors, lambda e: F.lower(e).contains("placeholder")),
        "f_missing": F.size(F.filter(errors, lambda e: F.lower(e).contains("missing_placeholder"))),
        "f_foreign": F.size(F.filter(T.matches(t, T.PLACEHOLDER), lambda p: ~F.array_contains(registry, p))) > 0,
        "numeric_score": share_kept(T.matches(s, NUMBER), T.matches(t, NUMBER)),
        "f_bullets": bullets(s), "f_bullets_t": bullets(t), "f_lines": T.line_count(s), "f_lines_t": T.line_count(t),
        "f_repetition": repetition,
        "f_ratio": F.length(t) / F.greatest(F.length(s), F.lit(1)),
    }


def post_parts(f: dict[str, Column], errors: Column, is_header: Column) -> dict[str, Column]:
    """Dimension scores of a translated pair and its issues and warnings (bare labels, without figures) from :func:`post_facts`."""
    errors, header = F.coalesce(errors, F.array().cast("array<string>")), F.coalesce(is_header, F.lit(False))
    same, high, some = f["f_level"] == 3, f["f_level"] == 2, f["f_level"] == 1
    identity = F.when(same, _d(0)).when(high, _d(0.3)).when(some, _d(0.6)).otherwise(_d(1))
    n, still = f["f_tokens"], f["f_still"]
    restore_error, foreign = (n > 0) & f["f_restore"], f["f_foreign"]
    left = (n > 0) & ~restore_error & (still > 0)
    placeholder = F.when(restore_error & (still > 0), _div(n - still, n)).when(
        restore_error & (f["f_missing"] > 0), F.greatest(_d(0), _div(n - f["f_missing"], n))
    ).when(restore_error, _d(0.7)).when(left, _div(n - still, n)).otherwise(_d(1))
    placeholder = F.when(foreign, F.least(placeholder, _d(0.5))).otherwise(placeholder)
    numeric, ratio = f["numeric_score"], f["f_ratio"]
    bullet_ratio, line_ratio = _div(f["f_bullets_t"], f["f_bullets"]), _div(f["f_lines_t"], f["f_lines"])
    odd_lines = (f["f_lines"] > 0) & ((line_ratio < 0.7) | (line_ratio > 1.3))
    fmt = F.when(f["f_bullets"] > 0, F.least(bullet_ratio, _d(1))).otherwise(_d(1)) * F.when(odd_lines, _d(0.9)).otherwise(_d(1))
    repeated, odd_length = f["f_repetition"] > 0.3, (ratio < 0.5) | (ratio > 2.0)
    fluency = F.when(repeated, _d(0.7)).otherwise(_d(1)) * F.when(odd_length, _d(0.8)).otherwise(_d(1))
    fidelity = F.when((ratio >= 0.8) & (ratio <= 1.5), _d(1)).when((ratio >= 0.6) & (ratio <= 2.0), _d(0.9)).otherwise(_d(0.7))
    issue = lambda cond, label: F.when(cond, F.lit(label))
    issues = F.concat(
        errors,
        F.array_compact(
            F.array(
                issue(same & header, "identity_translation:header_exact_match"), issue(same & ~header, "identity_translation:exact_match"),
                issue(high, "identity_translation:high_similarity"), issue(restore_error, "placeholder_restoration_failed"),
                issue(left, "placeholder_not_restored"),
                issue(foreign, "placeholder_hallucinated"), issue(numeric < 0.9, "numeric_drift"),
                issue((f["f_bullets"] > 0) & (bullet_ratio < 0.8), "format_drift:bullets"), issue(fidelity == 0.7, "fidelity_concern:length"),
            )
        ),
    )
    warnings = F.array_compact(
        F.array(
            issue(some, "identity_translation:moderate_similarity"), issue(foreign, "placeholder_hallucinated_count"),
            issue((numeric >= 0.9) & (numeric < 1), "minor_numeric_variation"), issue(odd_lines, "line_count_variation"), issue(repeated, "high_repetition"),
            issue(odd_length, "length_ratio_unusual")
        )
    )
    return {
        "identity_score": identity, "placeholder_score": placeholder, "numeric_score": numeric, "format_score": fmt, "fluency_score": fluency,
        "fidelity_score": fidelity, "issues": issues, "warnings": warnings, "has_registry": n > 0
    }


def post_overall(p: dict[str, Column]) -> Column:
    """Weighted overall score of the parts; halved for an identity."""
    i, ph, nu, fo, fl, fi = (p[f"{k}_score"] for k in ("identity", "placeholder", "numeric", "format", "fluency", "fidelity"))
    with_tokens = i * _d(0.20) + ph * _d(0.30) + nu * _d(0.20) + fo * _d(0.15) + fl * _d(0.10) + fi * _d(0.05)
    without = i * _d(0.25) + nu * _d(0.25) + fo * _d(0.20) + fl * _d(0.15) + fi * _d(0.15)
    overall = F.when(p["has_registry"], with_tokens).otherwise(without)
    return F.when(i < 0.5, overall * _d(0.5)).otherwise(overall)


def post_decisions(p: dict[str, Column], overall: Column, is_header: Column) -> dict[str, Column]:
    """needs_retry, needs_review, confidence, acceptable."""
    n = F.size(p["issues"])
    retry = (p["identity_score"] < 0.5) | (
        p["has_registry"] & (p["placeholder_score"] < 0.9)
    ) | (p["numeric_score"] < 0.8) | (F.coalesce(is_header, F.lit(False)) & (overall < 0.85)) | (n > 2)
    review = (overall < 0.75) | (n >= 2) | (p["identity_score"] < 0.7)
    confidence = F.greatest(_d(0), _d(1) - (n * _d(0.15) + F.size(p["warnings"]) * _d(0.05)))
    bad = F.exists(p["issues"], lambda i: T.any_of(i, list(CRITICAL)))
    return {"needs_retry": retry, "needs_review": review, "confidence": confidence, "acceptable": (overall >= 0.85) & ~retry & ~bad}


def with_post_scores(df: DataFrame, source: str, target: str, registry: str, errors: str, is_header: str) -> DataFrame:
    """Add the scores, issues, warnings and decisions of every pair. In stages, so that each fact is worked out once."""
    keep = df.columns
    f = post_facts(F.col(source), F.col(target), F.col(registry), F.col(errors))
    d = df.select("*", *[v.alias(k) for k, v in f.items()])
    p = {k: v for k, v in post_parts({k: F.col(k) for k in f}, F.col(errors), F.col(is_header)).items() if k != "numeric_score"}
    d = d.select(*keep, "numeric_score", *[v.alias(k) for k, v in p.items()])
    refs = {k: F.col(k) for k in (*p, "numeric_score")}
    d = d.withColumn("overall_score", post_overall(refs))
    return d.select("*", *[v.alias(k) for k, v in post_decisions(refs, F.col("overall_score"), F.col(is_header)).items()])


def quick_checks(source: Column, target: Column) -> dict[str, Column]:
    """1 or 0 for missing placeholders, another multiset of numbers, all bullets dropped."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    flag = lambda c: c.cast("int")
    return {
        "missing_placeholders": flag(F.size(T.matches(t, T.PLACEHOLDER)) < F.size(T.matches(s, T.PLACEHOLDER))),
        "numeric_mismatch": flag(F.array_sort(T.matches(s, NUMBER_COMMA)) != F.array_sort(T.matches(t, NUMBER_COMMA))),
        "dropped_bullets": flag((bullets(s) > 0) & (bullets(t) == 0)),
    }


def health(source: Column, target: Column, ok: Column, errors: Column) -> Column:
    """Struct status, score, reason_codes of a translated block."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    errors = F.coalesce(errors, F.array().cast("array<string>"))
    hit = F.get(F.filter(errors, lambda e: F.lower(e).contains("placeholder") | e.contains("validation_failed")), F.lit(0))
    lost, invalid = F.coalesce(F.lower(hit).contains("placeholder"), F.lit(False)), F.coalesce(~F.lower(hit).contains("placeholder"), F.lit(False))
    failed = ~F.coalesce(ok, F.lit(False))
    ns, nt = T.matches(s, NUMBER_EXP), T.matches(t, NUMBER_EXP)
    drift = (F.size(ns) > 0) & (_div(multiset_kept(ns, nt), F.size(ns)) < 0.9)
    bs = bullets(s)
    format_drift = (bs > 0) & (bullets(t) < bs * 0.8)
    left = t.rlike(T.PLACEHOLDER)
    long = (F.length(s) > 0) & (_div(F.length(t), F.length(s)) > 1.5)
    code = lambda c, x: F.when(c, F.lit(x))
    ladder = (
        (lost, "placeholder_missing", 0.0), (invalid, "validation_failed", 0.5), (failed, "translation_failed", 0.3), (drift, "numeric_drift", 0.7),
        (format_drift, "format_drift", 0.6), (left, "placeholder_not_restored", 0.4), (long, "potential_overflow", 0.8)
    )
    codes = F.array_compact(F.array(*[code(c, x) for c, x, _ in ladder]))
    score = F.least(_d(1), *[F.when(c, _d(v)).otherwise(_d(1)) for c, _, v in ladder])
    status = F.when(lost | failed | (score < 0.5), "failed").when((score >= 0.85) & (F.size(codes) == 0), "ok").otherwise("warning")
    return F.struct(status.alias("status"), score.alias("score"), codes.alias("reason_codes"))


def length_suspect(source: Column, target: Column, is_header: Column) -> Column:
    """Whether a translation is so much longer than its source that it is made up."""
    n, m = F.length(T.strip(source)), F.length(T.strip(target))
    most = F.when(F.coalesce(is_header, F.lit(False)), _d(2)).when(n < 50, _d(3)).otherwise(_d(2))
    return (n > 0) & (m > 0) & (_div(m, n) > most)


def rerank_parts(source: Column, candidate: Column, registry: Column, is_header: Column) -> dict[str, Column]:
    """Native components of a candidate's rank: placeholder, numeric, format, length, spillover, hallucinated, semantic."""
    s, c = F.coalesce(source, F.lit("")), F.coalesce(candidate, F.lit(""))
    registry = F.coalesce(registry, F.array().cast("array<string>"))
    n = F.size(registry)
    present = F.size(F.filter(registry, lambda p: c.contains(p)))
    as_number = lambda a: F.transform(a, lambda x: x.cast("double"))
    bs, bc, ls, lc = bullets(s), bullets(c), T.line_count(s), T.line_count(c)
    ratio = _div(F.length(c), F.length(s))
    tokens = F.array_union(F.array_union(*[T.matches(c, p) for p in T.PLACEHOLDER_FORMS[:2]]), T.matches(c, T.PLACEHOLDER_FORMS[2]))
    extra = F.size(F.filter(tokens, lambda p: ~F.array_contains(registry, p))) > 0
    length = F.when(s == "", _d(1)).when(
        (ratio > 2.5) | (ratio < 0.4), _d(0.2)
    ).when((ratio > 2.0) | (ratio < 0.5), _d(0.3)).when((ratio > 1.8) | (ratio < 0.6), _d(0.6)).when((ratio > 1.5) | (ratio < 0.7), _d(0.8)).otherwise(_d(1))
    section, answer = r"(?i)^(section|chapter|part|appendix)\s+(\d+|[ivx]+)[:\s]+", r"(?i)^(section|chapitre|chapter|partie|part|annexe|appendix)\s+(\d+|[ivx]+)[:\s]+"
    ss, sc = T.strip(s), T.strip(c)
    has, kept = ss.rlike(section) & F.coalesce(is_header, F.lit(False)), sc.rlike(answer)
    digits = F.array(*[F.lit(str(k)) for k in range(10)])
    ws, wc = F.array_except(
        F.array_distinct(T.matches(F.lower(s), r"(?U)\w+")), digits
    ), F.array_except(F.array_distinct(T.matches(F.lower(c), r"(?U)\w+")), digits)
    unrelated = (F.size(ws) > 0) & (F.size(ws) <= 5) & (F.size(wc) > 0) & ~F.arrays_overlap(ws, wc) & F.arrays_overlap(
        wc, F.array(*[F.lit(x) for x in SUSPICIOUS])
    )
    less = lambda cond, x: F.when(cond, _d(x)).otherwise(_d(0))
    semantic = _d(1) - less(has & ~kept, 0.6) - less(has & kept & (F.regexp_extract(ss, section, 2) != F.regexp_extract(sc, answer, 2)), 0.3)
    semantic = semantic - F.when((ratio < 0.5) | (ratio > 2.5), _d(0.4)).when((ratio < 0.7) | (ratio > 1.8), _d(0.2)).otherwise(_d(0))
    semantic = semantic - less(s.contains(":") != c.contains(":"), 0.1) - less(unrelated, 0.5)
    return {
        "placeholder": F.when(n == 0, _d(1)).otherwise(_div(present, n)),
        "numeric": share_kept(as_number(T.matches(s, NUMBER_EXP)), as_number(T.matches(c, NUMBER_EXP))),
        "format": F.when(
            bs > 0, F.least(_div(bc, bs), _d(1))
        ).otherwise(_d(1)) * _d(0.5) + F.when(ls > 0, F.least(_div(lc, ls), _d(1))).otherwise(_d(1)) * _d(0.5),
        "length": length,
        "spillover": F.when(T.has_spillover(c), _d(0.2)).otherwise(_d(1)),
        "hallucinated": F.when(extra, _d(0.2)).otherwise(_d(1)),
        "semantic": F.when((ss == "") | (sc == ""), _d(0.5)).otherwise(F.greatest(_d(0), semantic)),
    }


def identity_penalty(similarity: Column) -> Column:
    """Penalty of a similarity to the source."""
    return F.when(similarity > 0.85, _d(0.1)).when(similarity > 0.75, _d(0.3)).when(similarity > 0.65, _d(0.6)).otherwise(_d(1))
