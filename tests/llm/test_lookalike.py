import itertools

import pytest

from folioscope.llm import lookalike as L

SAME = [
    ("café", "café"), ("ＡＢＣ １２", "ABC 12"), ("a b", "a b"), ("a b", "a b"), ("word", "wo​rd"), ("word", "wo­rd"), ("first", "ﬁrst"), ("office", "oﬃce"),
    ("5 Å", "5 Å"), ("3 Ω", "3 Ω"), ("4 µm", "4 μm"),
    ("x-y", "x‑y"), ("データ", "ﾃﾞｰﾀ"), ("مصادر الخطأ", "مصادر الخطأ"), ("﻿Text", "Text"), ("Data preparation", "Dаtа рrераratiοn"),
]
DIFFERENT = [
    ("x²", "x2"), ("H₂O", "H2O"), ("①", "1"), ("ℝ", "R"), ("½", "1/2"), ("Text", "text"), ("cafe", "café"), ("a-b", "a—b"), ("5 °C", "5 C"), ("は", "ば"),
    ("𝑎", "a")
]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert L.skeleton(L.canonical(a)) == L.skeleton(L.canonical(b))


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_other_look(a, b):
    assert L.skeleton(L.canonical(a)) != L.skeleton(L.canonical(b))


SCHEMA = "span_id bigint, doc_id bigint, text string, form string, look string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_pairs_equal_brute_force(spark):
    rows = []
    for k, (a, b) in enumerate(SAME + DIFFERENT):
        rows += [(3 * k, k, a), (3 * k + 1, k, b), (3 * k + 2, k, a)]
    rows += [(900, 900, None), (901, 900, ""), (902, 900, " ​"), (903, None, "x"), (0, 0, SAME[0][0])]
    want = {
        (x[0], y[0]) for x,
        y in itertools.combinations(sorted({r for r in rows if r[1] is not None and r[2] and L.canonical(r[2])}), 2) if x[1] == y[1] and x[0] < y[0]
        and x[2] != y[2] and L.skeleton(L.canonical(x[2])) == L.skeleton(L.canonical(y[2]))
    }
    got = [tuple(r) for r in L.alike_pairs(frame(spark, rows)).collect()]
    assert set(got) == want and len(got) == len(want) == 2 * len(SAME)
    assert L.alike_pairs(frame(spark, rows).limit(0)).count() == 0


def test_repair_needs_the_vocabulary(spark):
    dirty, unknown, russian = "mоdel", "qоzzx", "модель"
    rows = [(1, 1, dirty), (2, 1, "model"), (3, 1, unknown), (4, 2, russian), (5, 3, "а model"), (6, 3, "a")]
    got = {r.span_id: r.repaired for r in L.repaired_texts(frame(spark, rows).select("span_id", "text")).collect()}
    assert got == {1: "model", 2: "model", 3: unknown, 4: russian, 5: "a model", 6: "a"}
    # what no vocabulary backs still compares by its look
    assert L.skeleton(unknown) == "qozzx"


def test_one_document_may_hold_most_rows(spark):
    rows = [(i, 1, "text" if i % 2 else "te​xt") for i in range(60)] + [(100 + i, 2 + i, "text") for i in range(20)]
    assert L.alike_pairs(frame(spark, rows)).count() == 30 * 30


def test_tokens_of_look_alikes_only_go_by_their_document(spark):
    rows = [(1, 1, "(А) 307"), (2, 1, "(A) 307"), (3, 1, "Figure label"), (4, 2, "у₂ равно"), (5, 2, "y₂ равно"), (6, 2, "длина"), (7, 3, "у₂"), (8, 4, "y₂")]
    got = {r.span_id: r.repaired for r in L.repaired_texts(frame(spark, rows), keep=("doc_id",), document="doc_id").collect()}
    assert got[1] == got[2] == "(A) 307" and got[4] == got[5] == "у₂ равно"
    assert got[7] == got[8] == "y₂"  # without other letters the Latin reading comes first


def test_the_vocabulary_decides_between_readings():
    assert L.readings("mоdel", "lcg") == ["model"] and L.readings("сор", "clg")[:2] == ["сор", "cop"] and L.readings("жz", "lcg") == []
    assert L.proposals("сор", "lcg") == [(0, 3, ["cop", "сор", "ϲορ"])] and L.proposals("сор", "clg") == []


def test_copies_are_not_compared_with_each_other(spark):
    rows = [(i, 1, "hot text") for i in range(3000)] + [(5000, 1, "hоt text"), (5001, 1, "hot\u00a0text")]
    assert L.alike_pairs(frame(spark, rows)).count() == 2 * 3000 + 1
