import pytest
from pyspark.sql import functions as F

from folioscope.functions import classify as C
from folioscope.functions import text as T
from folioscope.operators import masking as M


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,kind,number,rest",
    [
        ("1. Item", "decimal", "1", "Item"), ("2.3) Item", "decimal", "2.3", "Item"), ("IV. Item", "roman", "IV", "Item"), ("B) Item", "alpha", "B", "Item"),
        ("Section 3: Title", "section", "3", "Title"), ("• Point", "bullet", "", "Point"), ("Plain", "", "", "Plain"), (None, "", "", "")
    ]
)
def test_numbering(spark, text, kind, number, rest):
    r = one(spark, text, T.numbering)
    assert (r.kind, r.number, r.rest) == (kind, number, rest)


def test_numbering_kept(spark):
    f = lambda s, t: spark.createDataFrame([(s, t)], "s string, t string").select(T.keep_numbering(F.col("s"), F.col("t"))).first()[0]
    assert f("1. Results", "Résultats") == "1. Résultats"
    assert f("1. Results", "2. Résultats") == "2. Résultats"
    assert f("Results", "Résultats") == "Résultats"
    assert f("Section 2: Results", "Résultats") == "Section 2: Résultats"


def test_bullets_kept(spark):
    f = lambda s, t: spark.createDataFrame([(s, t)], "s string, t string").select(T.keep_bullets(F.col("s"), F.col("t"))).first()[0]
    assert f("• a\n• b", "x\n- y") == "• x\n• y"
    assert f("a\nb", "x\ny") == "x\ny"
    assert f("• a", "x") == "x"
    assert f("• a\n• b", "x\ny\nz") == "• x\n• y\n• z"


def test_section_prefix(spark):
    assert one(spark, "Section 1: Introduction", lambda c: F.struct(*T.section_prefix(c))) == ("Section 1: ", "Introduction")
    assert one(spark, "Normal text", lambda c: F.struct(*T.section_prefix(c))) == ("", "Normal text")
    assert one(spark, "chapter 3", lambda c: T.translated_section_prefix(T.section_prefix(c)[0], "fr")) == "Chapitre 3 : "
    assert one(spark, "Introduction", lambda c: T.with_section_prefix(c, F.lit("Part 2: "), "de")) == "Teil 2: Introduction"


def test_truncation(spark):
    assert one(spark, "word " * 30, lambda c: T.truncated(c, 43)) == "word word word word word word word word..."
    assert one(spark, "short", lambda c: T.truncated(c, 43)) == "short"
    assert one(spark, "x" * 60, lambda c: T.truncated(c, 43)) == "x" * 43 + "..."


def test_spillover(spark):
    assert one(spark, "Here is the translation: Bonjour", T.clean_spillover) == "Bonjour"
    assert one(spark, "Bonjour\nRemember: keep tokens\nle monde", T.clean_spillover) == "Bonjour\nle monde"
    assert one(spark, "  ", T.clean_spillover) == "  "
    assert one(spark, None, T.clean_spillover) is None
    assert one(spark, "you must do it", T.has_spillover) is True


def test_latex(spark):
    assert one(spark, "a_b & 50%", T.latex_escaped) == r"a\_b \& 50\%"


def test_keys(spark):
    k = lambda t: one(spark, t, lambda c: T.cache_key(F.lit("b"), F.lit("m"), c, F.lit("en"), F.lit("fr"), F.lit("1")))
    assert k("a") == k("a") != k("b") and k("a").startswith("cache_") and len(k("a")) == 22
    assert one(
        spark, "x" * 101, lambda c: T.memory_key(F.lit("en"), F.lit("fr"), c)
    ).startswith("en-fr:") and one(spark, "hi", lambda c: T.memory_key(F.lit("en"), F.lit("fr"), c)) == "en-fr:hi"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("| Col1 | Col2 |", True), ("12.3  45.6  78.9  10.1", True), ("Name    Value    Notes", True), ("This is a paragraph.", False),
        ("Section 1: Introduction", False), ("Results:", False), ("Page 12 of 45", False), ("", False), (None, False), ("a  1\nb  2\nc  3", True)
    ],
)
def test_tables(spark, text, expected):
    assert one(spark, text, lambda c: C.table_candidate(c, F.lit(True), F.lit(False))) is expected
    assert one(spark, text, lambda c: C.table_candidate(c, F.lit(True), F.lit(True))) is False


@pytest.mark.parametrize(
    "text,lang",
    [
        ("the cat and the dog", "en"), ("le chat et la souris", "fr"), ("der Hund und die Katze", "de"), ("el perro y la gata", "es"), ("这是一个测试", "zh"),
        ("これはテストです", "ja"), ("", "en"), (None, "en"), ("12 34", "en")
    ]
)
def test_language(spark, text, lang):
    assert one(spark, text, C.language).lang == lang


@pytest.mark.parametrize(
    "text,font,expected",
    [
        ("∑", "CMSY10", True), ("α + β", "Arial", True), ("$x^2$", "Arial", True), ("x = y + 2", "Arial", True), ("H₂O + x²", "Arial", True),
        ("a b c", "Arial", True), ("0 ≤ x ≤ 1", "Arial", True), ("a/b", "Arial", True), ("Normal text", "Arial", False),
        ("The year 2025 and value 42.", "Arial", False), ("2025", "Arial", False), ("", "Arial", False)
    ],
)
def test_equations(spark, text, font, expected):
    assert one(spark, text, lambda c: C.is_equation(c, F.lit(font), F.lit(0))) is expected


@pytest.mark.parametrize(
    "source,target,reason",
    [
        ("Introduction", "introduction", "academic_heading"), ("12 / 3", "12 / 3", "no_letters"), ("GPT-3", "GPT-3", "technical_term"),
        ("Yxz-1", "Yxz-1", "identical"), ("John Smith", "John Smith", "proper_noun"), ("hello", "hello", "common_phrase"),
        ("one two three four", "one two three four", "identical"), ("a", "b", "different"), ("a", " ", "empty"), (None, None, "empty")
    ]
)
def test_identity(spark, source, target, reason):
    r = spark.createDataFrame([(source, target)], "s string, t string").select(C.identity(F.col("s"), F.col("t"), F.lit(False)).alias("x")).first().x
    assert r.reason == reason


def test_mask_and_restore(spark):
    text = "This is $E=mc^2$ and a URL https://example.com and `code`."
    masked, registry, counts = M.mask_text(text)
    assert masked != text and counts["MATH_INLINE"] == 1
    restored, errors = M.restore_text(masked, [{"ph": p, "original": o} for _, p, o in registry])
    assert restored == text and errors == []
    restored, errors = M.restore_text("nothing", [{"ph": p, "original": o} for _, p, o in registry])
    assert errors and all(e.startswith("missing_placeholder") for e in errors)
    # blanks inside a token are tolerated, and those behind it go with it
    split = masked.replace("_", " _ ")
    assert M.restore_text(split, [{"ph": p, "original": o} for _, p, o in registry]) == ("This is $E=mc^2$and a URL https://example.comand `code`.", [])
    assert M.mask_text(None) == ("", [], {})


def test_checksum_is_native_too(spark):
    token = M.placeholder("MATH_INLINE", 1, "$E=mc^2$")
    assert token.endswith("_0001_49A9A563@@")
    assert spark.range(1).select(M.placeholder_column("MATH_INLINE", F.lit(1), F.lit("$E=mc^2$"))).first()[0] == token


@pytest.mark.parametrize(
    "text,expected",
    [
        ("John Smith", True), ("John Paul Smith", True), ("John T. Smith", True), ("Content Analysis", False), ("Machine Learning", False),
        ("Data System", False), ("JOHN SMITH", False)
    ]
)
def test_person_names(text, expected):
    assert M.person_name(text) is expected


@pytest.mark.parametrize(
    "text",
    [
        *M.TERMS, "Section 1: Content Analysis", "Section 2: Methodology", "Chapter 3: Results", "Part 1: Introduction", "1. Introduction",
        "Section 2: Results", "Chapter 3: Conclusion", "Method\nAccuracy\nSpeed"
    ]
)
def test_terms_and_headings_are_never_masked(text):
    assert M.mask_text(text) == (text, [], {})


@pytest.mark.parametrize("text", ["John Smith", "Jane Doe", "Alice Johnson", "Bob Williams", "written by John T. Smith in Paris"])
def test_names_are_masked(text):
    assert M.mask_text(text)[2] == {"PERSON_NAME": 1}


def test_names_natively(spark):
    texts = [
        "John Smith", "John T. Smith", "Random Forest", "Data System", "JOHN SMITH", "Section Smith", "Novel Design", "John", "A Long Name Of Five",
        "Computer Vision"
    ]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(M.person_name_column(F.col("t"))).collect()
    assert [r[0] for r in got] == [M.person_name(t) for t in texts]


def test_nested_and_invented_tokens():
    text = "Figure 3: John Smith at https://x.org/a shows it"
    masked, registry, _ = M.mask_text(text)
    entries = [{"ph": p, "original": o} for _, p, o in registry]
    assert M.restore_text(masked, entries) == (text, [])
    alien = "@@BLK_URL_0009_AAAAAAAA@@"
    assert M.restore_text(masked + alien, entries) == (text, [f"hallucinated_placeholder:{alien}"])
    assert M.restore_text(masked.lower().replace("@@blk", "@@ blk"), entries)[1] == []


def test_equations_are_masked_in_order(spark):
    d = spark.createDataFrame([("E = 5 and x² and E = 5", ["E = 5", "x²", "", "y"]), (None, ["a"]), ("a", None)], "text string, spans array<string>")
    rows = [r.m for r in d.select(M.mask_equations(F.col("text"), F.col("spans")).alias("m")).collect()]
    assert rows[0].masked == f"{M.placeholder('MATH_INLINE', 1, 'E = 5')} and {M.placeholder('MATH_INLINE', 2, 'x²')} and E = 5" and rows[0].n == 3
    assert [r.masked for r in rows[1:]] == ["", "a"] and [(x.seq, x.original) for x in rows[0].registry] == [(0, "E = 5"), (1, "x²")]


def test_mask_frame_with_nulls_and_repeats(spark):
    d = spark.createDataFrame([(1, "see [12]"), (1, "see [12]"), (2, None), (3, "")], "id int, text string")
    rows = {r.id: r for r in M.restore(M.mask(d).withColumn("translated_text", F.col("masked_text"))).collect()}
    assert rows[1].restored_text == "see [12]" and rows[1].mask_counts == {"CIT": 1}
    assert rows[2].masked_text == "" and rows[3].registry == []
    assert M.mask(d.limit(0)).count() == 0


def test_round_trip_of_random_texts(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet="ab $`\\[]()1.@-_\n", max_size=40))
    def check(t):
        masked, registry, _ = M.mask_text(t)
        nested = any("@@BLK_" in o for _, _, o in registry)
        if not nested:
            assert M.restore_text(masked, [{"ph": p, "original": o} for _, p, o in registry])[0] == t

    check()
