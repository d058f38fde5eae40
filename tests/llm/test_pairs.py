import pytest
from pyspark.sql import functions as F

from folioscope.llm import endings as E
from folioscope.llm import pairs as P
from folioscope.llm.common import code_lookup


@pytest.mark.parametrize(
    "text,core,hit",
    [
        ("abc [...]", "abc", True), ("abc…", "abc", True), ("abc��", "abc", True), ("abc @@BLK_UR", "abc", True),
        ("abc @@BLK_URL_0001_AAAAAAAA@@", "abc @@BLK_URL_0001_AAAAAAAA@@", False), ("abc <su", "abc", True), ("abc &am", "abc", True), ('abc"}', "abc", True),
        ("abc.", "abc.", False), ("abc", "abc", False), ("", "", False), ("...", "", True)
    ]
)
def test_break_marks(text, core, hit):
    assert E.strip_break(text) == (core, hit)


@pytest.mark.parametrize("text", [None, "", " ", "​", "null", "None", "N/A", "[]", '""', "...", "—", "。", " \t "])
def test_unreadable(text):
    assert not P.readable(text)


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("The cat sat on the mat.", "THE CAT SAT ON THE MAT", True), ("The cat sat on the mat.", '"The cat sat on the mat."', True),
        ("The cat sat on the mat.", "The  cat sat\non the mat!", True), ("The cat sat on the mat.", "Output:\nThe cat sat on the mat.", True),
        ("The cat sat.", "The cat sat. The cat sat.", True), ("The cat sat on the mat.", "Le chat est assis sur le tapis.", False), ("", "", True)
    ]
)
def test_copies(a, b, same):
    assert P.is_copy(a, b) is same


@pytest.mark.parametrize(
    "text,no",
    [
        ("I'm sorry, but I can't translate this text.", True), ("Je suis désolé, mais je ne peux pas traduire ce texte.", True),
        ("Es tut mir leid, aber ich kann das nicht übersetzen.", True), ("抱歉，我无法翻译这段文字。", True), ("عذرا، لا أستطيع ترجمة هذا النص.", True),
        ("ขออภัย ฉันไม่สามารถแปลข้อความนี้ได้", True), ("The method cannot translate inputs above 20 pages.", False), ("Le modèle montre une tendance.", False)
    ]
)
def test_refusals(text, no):
    assert P.is_refusal("Some other text", text) is no


@pytest.fixture(scope="module")
def tables(spark):
    """Translations built from parts, with planted defects."""
    import random

    random.seed(9)
    subj = {
        "en": ["The method", "The parser", "Our model", "The table"], "fr": ["La méthode", "L'analyseur", "Notre modèle", "Le tableau"],
        "de": ["Die Methode", "Der Parser", "Unser Modell", "Die Tabelle"]
    }
    verb = {
        "en": ["shows a stable trend", "needs more memory", "agrees with the values", "loses some precision"],
        "fr": ["montre une tendance stable", "demande plus de mémoire", "concorde avec les valeurs", "perd en précision"],
        "de": ["zeigt einen stabilen Verlauf", "braucht mehr Speicher", "stimmt mit den Werten überein", "verliert an Genauigkeit"]
    }
    tail = {
        "en": ["in all regions", "at night", "under dry conditions", "in most cases"],
        "fr": ["dans toutes les régions", "pendant la nuit", "par temps sec", "dans la plupart des cas"],
        "de": ["in allen Regionen", "in der Nacht", "bei trockenem Wetter", "in den meisten Fällen"]
    }
    q, r, want = [], [], {}
    for i in range(900):
        ks = [(random.randrange(4), random.randrange(4), random.randrange(4), random.randint(10, 99)) for _ in range(random.randint(1, 4))]
        say = lambda l: " ".join(f"{subj[l][a]} {verb[l][b]} ({n}) {tail[l][c]}." for a, b, c, n in ks)  # noqa: E731,B023
        source, target = say("en"), say("fr")
        kind = ["fine"] * 6 + ["truncated", "copy", "wrong_language", "refusal", "empty"]
        kind = kind[i % len(kind)]
        if kind == "truncated":
            target = target[: random.randrange(12, len(target) - 6)].rstrip(". ") if i % 2 else target[:40]
            if target[-1] in ".)":
                target = target[:-2]
        elif kind == "copy":
            target = source.upper() if i % 2 else source
        elif kind == "wrong_language":
            target = say("de")
        elif kind == "refusal":
            target = "I'm sorry, but I can't translate this text."
        elif kind == "empty":
            target = [None, "", "N/A"][i % 3]
        q.append((i, source, "en", "fr", "clash"))
        r.append((i, i, [target], ["Alpha", "alpha ", "beta-x"][i % 3], "clash"))
        if kind != "fine":
            want[i, 0] = kind
    for i in range(150):  # the other languages occur among the requests too
        l = "fr" if i % 2 else "de"
        ks = [(random.randrange(4), random.randrange(4), random.randrange(4), 5) for _ in range(2)]
        q.append((6000 + i, " ".join(f"{subj[l][a]} {verb[l][b]} ({n}) {tail[l][c]}." for a, b, c, n in ks), l, "en", ""))
    q.append((5000, None, "en", "fr", ""))
    r += [(5000, 5000, None, None, ""), (5001, 0, [], "beta_x", ""), (5002, 99999, ["x"], "beta_x", ""), r[0]]
    want |= {(5000, 0): "empty", (5001, 0): "empty"}
    return spark.createDataFrame(
        q, "request_id bigint, text string, source_lang string, target_lang string, kind string"
    ), spark.createDataFrame(r, "result_id bigint, request_id bigint, candidates array<string>, backend string, text string"), want


def test_planted_defects(spark, data, tables):
    q, r, want = tables
    rows = [tuple(x) for x in P.defects(q, r, code_lookup(spark, data)).collect()]
    got = {(a, b): c for a, b, c in rows}
    assert len(rows) == len(got)
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.97 * len(want), [(k, v, got.get(k)) for k, v in want.items() if got.get(k) != v][:10]
    assert right >= 0.97 * len(got), [(k, v) for k, v in got.items() if want.get(k) != v][:10]
    cut = {tuple(x) for x in P.truncated(q, r).collect()}
    assert cut == {k for k, v in got.items() if v == "truncated"}


def test_rates_join_spellings(spark, tables):
    q, r, _ = tables
    rates = {x.backend: x for x in P.truncation_rates(q, r).collect()}
    assert set(rates) == {"alpha", "beta_x"} and all(0 <= x.rate <= 1 for x in rates.values())


def test_limits_are_found(spark):
    import random

    random.seed(3)
    sizes = [("a", min(120, int(random.gauss(110, 40)))) for _ in range(4000)] + [("b", int(random.gauss(110, 40))) for _ in range(4000)]
    d = spark.createDataFrame([(b, n, "fine") for b, n in sizes if n > 0], "backend string, size int, kind string")
    got = {(x.backend, x["size"]) for x in P.cut_lengths(d).collect()}
    assert ("a", 120) in got and len([x for x in got if x != ("a", 120)]) <= 3


def test_empty_tables(spark, data, tables):
    q, r, _ = tables
    assert P.truncated(q.limit(0), r.limit(0)).count() == 0
    assert P.defects(q, r.limit(0), code_lookup(spark, data)).count() == 0


def test_endings_are_counted_over_all_texts(spark, monkeypatch):
    import random

    random.seed(5)
    words = ["method", "parser", "methods", "value", "values", "भाषा का अनुवाद", "ตารางแสดงผล", "12", "数据处理", "(x)"]
    texts = [
        " ".join(random.choices(words, k=random.randint(1, 5))) + random.choice(["", ".", " valu", "…"]) for _ in range(700)
    ] + ["Rare heading"] * E.OFTEN + [None, ""]
    e = E.Endings()
    for t in texts:
        e.add(t or "")
    e.any = E.Counter({k: v for k, v in e.any.items() if v >= E.SUPPORT or k in e.end})
    e.whole = E.Counter({k: v for k, v in e.whole.items() if v >= E.OFTEN})
    monkeypatch.setattr(E, "HELD", 40)  # counts meet only in the sum
    rows = [(i, [t, None]) for i, t in enumerate(texts)] + [(9000, None), (9001, [])]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    got = E.ending_counts(d, spark.createDataFrame(rows, "result_id bigint, candidates array<string>")).toArrow()
    counts = dict(zip(got["result_id"].to_pylist(), (got["counts"].combine_chunks()[i : i + 1] for i in range(len(got)))))
    for i, t in enumerate(texts):
        one = E.counted(counts[i]) if i in counts else E.Endings()
        for asked in ("A request.", "Heading", "Some 12 values that go on and on (x) over a longer sentence than the other ones."):
            assert E.incomplete(asked, t or "", one) == E.incomplete(asked, t or "", e), t
    assert E.counted(counts[texts.index("Rare heading")]).whole["rare heading"] == E.OFTEN


def test_long_refusals_and_copies():
    no = "I'm sorry, but I can't translate this text. " + "It touches on matters that I would rather leave alone. " * 8
    assert len(no) > 400 and P.is_refusal("The 12 samples came from the lake. They were dry.", no)
    fair = "Je ne peux pas le dire. " + "La méthode a 12 pages. " * 6
    assert not P.is_refusal("The method has 12 pages. " * 6, fair)
    text = "The control group confirms the result of the pilot study in all three regions."
    assert P.is_copy(text, "Here is the translation that you have asked me for, as exact as can be:\n\n" + text)
    assert P.is_copy(text, text + " Let me know whether anything else has to be done here.")
    assert P.is_copy(text, " ".join([text] * 9)) and not P.is_copy(text, text[:40])
    assert not P.is_copy("Introduction", "Introduction to the methods of the analysis of long tables")


def test_both_ways_to_the_counts_agree(spark, monkeypatch, tables):
    q, r, _ = tables
    one = sorted((x.result_id, x.idx) for x in P.truncated(q, r).collect())
    monkeypatch.setattr(E, "BROADCAST_ENDINGS", 0)
    assert sorted((x.result_id, x.idx) for x in P.truncated(q, r).collect()) == one and one


def test_limits_are_those_of_incomplete_endings(spark):
    import random

    random.seed(4)
    rows = [
        ("a", random.randint(20, 200), 0) for _ in range(6000)
    ] + [("a", 40, 0) for _ in range(900)] + [("a", 120, 1) for _ in range(60)] + [("a", random.randint(20, 200), 2) for _ in range(60)]
    got = [
        x["size"] for x in P.cut_lengths(spark.createDataFrame([(*x, "fine") for x in rows], "backend string, size int, strength int, kind string")).collect()
    ]
    assert got == [120]  # many headings of one length are no limit
