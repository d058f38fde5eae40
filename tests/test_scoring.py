import pytest
from pyspark.sql import functions as F

from folioscope.functions import scoring as S


def pre(spark, text):
    f = S.pre_flags(F.col("t"))
    d = spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in f.items()])
    return d.withColumn("c", S.complexity({k: F.col(k) for k in f})).withColumn("s", S.strategy(F.col("c"))).first()


def test_simple_sentence(spark):
    r = pre(spark, "This is a simple sentence. It has no special content.")
    assert r.c < 0.4 and not r.has_math and not r.has_code and r.s.temperature > 0.1


def test_formula_text(spark):
    r = pre(spark, "Einstein's famous equation $$E = mc^2$$ relates energy and mass [1]. See Table 2 at https://example.org for 42 values.\n| a | b |")
    assert r.has_math and r.c >= 0.4 and r.s.temperature <= 0.2 and r.s.candidates >= 3


def test_technical_sentence(spark):
    r = pre(spark, "Electroencephalography demonstrates neurophysiological characteristics throughout experimentation procedures")
    assert r.technical_term_density > 0.3 and r.c >= 0.2 and r.avg_word_length > 6


def test_short_text_and_null(spark):
    assert (pre(spark, "Hello world.").s.candidates, pre(spark, "Hello world.").s.constraints) == (3, "relaxed")
    r = pre(spark, None)
    assert r.c == 0.0 and r.word_count == 0 and r.sentence_count == 0


def post(spark, source, target, registry=(), errors=(), header=False):
    d = spark.createDataFrame([(source, target, list(registry), list(errors), header)], "s string, t string, r array<string>, e array<string>, h boolean")
    return S.with_post_scores(d, "s", "t", "r", "e", "h").withColumnRenamed("overall_score", "overall").first()


def test_good_pair(spark):
    r = post(spark, "The value is 42 and the equation is placeholder.", "La valeur est 42 et l'équation est placeholder.")
    assert r.overall > 0.9 and r.placeholder_score == 1 and r.numeric_score == 1 and r.acceptable and not r.needs_retry


def test_lost_token(spark):
    r = post(spark, "Text", "Texte", ["@@BLK_URL_0001_00000000@@"], ["missing_placeholder"])
    assert r.placeholder_score < 1 and r.needs_retry and len(r.issues) >= 1


def test_numeric_drift(spark):
    r = post(spark, "42.5 and 123", "99 et 123")
    assert r.numeric_score < 1 and r.issues[0].startswith("numeric_drift")


def test_identity_of_a_header(spark):
    r = post(spark, "Results", "results", header=True)
    assert r.identity_score == 0 and "identity_translation:header_exact_match" in r.issues and r.needs_retry


def test_nulls_are_empty(spark):
    r = post(spark, None, None)
    assert r.identity_score == 1 and r.placeholder_score == 1 and r.numeric_score == 1


@pytest.mark.parametrize(
    "source,target,ok,errors,status,codes",
    [
        ("Hello 123", "Bonjour 123", True, [], "ok", []),
        ("Hello 123", "Bonjour 123", False, ["missing_placeholder:x"], "failed", ["placeholder_missing", "translation_failed"]),
        ("The value is 42.5", "La valeur est 99", True, [], "warning", ["numeric_drift"]),
        ("a", "a" * 9, True, [], "warning", ["potential_overflow"]),
        (None, None, True, None, "ok", []),
    ],
)
def test_health(spark, source, target, ok, errors, status, codes):
    r = spark.createDataFrame(
        [(source, target, ok, errors)], "s string, t string, ok boolean, e array<string>"
    ).select(S.health(F.col("s"), F.col("t"), F.col("ok"), F.col("e")).alias("h")).first().h
    assert r.status == status and r.reason_codes == codes
    assert (r.score >= 0.9) == (status == "ok")


def rank_parts(spark, source, candidate, registry=()):
    p = S.rerank_parts(F.col("s"), F.col("c"), F.col("r"), F.lit(False))
    return spark.createDataFrame(
        [(source, candidate, list(registry))], "s string, c string, r array<string>"
    ).select(*[v.alias(k) for k, v in p.items()]).first()


def test_rank_components(spark):
    reg = ["@@BLK_A_B_0001_AAAAAAAA@@", "@@BLK_A_B_0002_BBBBBBBB@@"]
    assert [rank_parts(spark, "x", c, reg).placeholder for c in (" ".join(reg), reg[0], "x")] == [1.0, 0.5, 0.0]
    assert [rank_parts(spark, "42.5 and 123", c).numeric for c in ("123 et 42.50", "123")] == [1.0, 0.5]
    assert rank_parts(spark, "x", "you must not").spillover == 0.2
    assert rank_parts(spark, "x", "a @@BLK_A_B_0001_AAAAAAAA@@").hallucinated == 0.2
    assert rank_parts(spark, "Short", "A much much longer text than the source").length == 0.2


def test_quick_checks(spark):
    q = S.quick_checks(F.col("s"), F.col("t"))
    rows = [("- a\n- b 3,5", "a\nb 3,5"), ("7 8", "8 7"), (None, None)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "s string, t string").select(*q.values()).collect()]
    assert got == [(0, 0, 1), (0, 0, 0), (0, 0, 0)]
