import pytest

from folioscope.llm import canonical as C

REF = [
    (1, "Velmora", ["VEAX0"]), (2, "Quillon Sans", ["QUNSa1"]), (3, "Quillon Serif", ["QUNSe1"]), (4, "Thalveg Sans Condensed", ["THSC4"]),
    (5, "Thalveg Sans", ["THS4"]), (6, "Mardenne Display", None), (7, "Grolsund", [])
] + [(10 + i, f"{n} {k}", []) for i, (n, k) in enumerate(
    (n, k) for n in ("Ostrevik", "Hexbury", "Bantriel", "Wexcombe", "Cindrake") for k in ("Sans", "Serif")
)]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REF, "family_id int, canonical_name string, aliases array<string>")


CASES = [
    ("Velmora-Bold", None, None, 1), ("ABCDEF+velmora", "velmora", "VELMORA", 1), ("F3", "F3", "Quillon_Serif", 3), ("Qui1lon Sans", None, None, 2),
    ("Quilon Sans,BoldItalic", None, None, 2), ("GHIJKL+QuillonSerifPSMT", None, None, 3), ("ITXQuillon#20Sans", None, None, 2),
    ("F1", None, "Display, Mardenne", 6), ("qunse1", None, None, 3), ("ThalvegSansCondensed-Light", None, None, 4), ("Tahlveg Sans", None, None, 5),
    ("Gro1sund", None, None, 7), ("Quillón Sans (TrueType)", None, None, 2),
    ("Times-Roman", "Times-Roman", "Times", 0), ("Ezzarine Serif", None, None, 0), (None, None, None, 0), ("", " ", "", 0), ("(null)", None, "Embedded", 0),
    ("Sans", "Serif", None, 0), ("F3", None, None, 0),
]


def test_cases(spark, reference):
    rows = [(i, r, n, f, "clash") for i, (r, n, f, _) in enumerate(CASES)]
    d = spark.createDataFrame(rows + rows[:3], "font_id bigint, raw_name string, normalized_name string, family string, entry string")
    got = [tuple(r) for r in C.found(d, reference).collect()]
    assert sorted(got) == [(i, e) for i, (*_, e) in enumerate(CASES)]


def test_literal_names_are_no_cases(spark, reference):
    d = spark.createDataFrame([(1, "x", None, "Velmora"), (2, "x", None, "velmora")], "font_id bigint, raw_name string, normalized_name string, family string")
    assert [tuple(r) for r in C.found(d, reference).collect()] == [(2, 1)]
    assert C.found(d.limit(0), reference).count() == 0
    assert C.found(d, reference.limit(0)).collect() == [(1, 0), (2, 0)] or sorted(map(tuple, C.found(d, reference.limit(0)).collect())) == [(1, 0), (2, 0)]


def test_report(spark, reference):
    d = spark.createDataFrame(
        [(1, "Zork Sans", None, "Zork Sans"), (2, "Zork Sans-Bold", None, "Zork Sans"), (3, "Velmora", None, "Velmora"), (3, "Velmora", None, "Velmora")],
        "font_id bigint, raw_name string, normalized_name string, family string"
    )
    assert [tuple(r) for r in C.report(d, reference).collect()] == [("zorksans", 2)]


def test_random_typos_are_found(spark):
    import random

    random.seed(4)
    names = ["Velmora Text", "Ostrevik Mono", "Dunhollow Serif", "Fennimar Slab", "Hexbury Sans", "Lumbrade", "Wexcombe Serif", "Zephandra Slab"]
    ref = spark.createDataFrame([(i + 1, n, None) for i, n in enumerate(names)], "family_id int, canonical_name string, aliases array<string>")
    rows = []
    for k in range(300):
        i = random.randrange(len(names))
        n = names[i].lower().replace(" ", "")
        p = random.randrange(1, len(n) - 1)
        n = random.choice([n[:p] + n[p + 1 :], n[:p] + random.choice("abcdefghij") + n[p:], n[: p - 1] + n[p] + n[p - 1] + n[p + 1 :]])
        rows.append((k, n, None, None, i + 1))
    got = dict(
        map(
            tuple,
            C.found(spark.createDataFrame([r[:4] for r in rows], "font_id bigint, raw_name string, normalized_name string, family string"), ref).collect()
        )
    )
    assert sum(got[k] == e for k, *_, e in rows) >= 0.98 * len(rows)


def test_short_names_and_long_lists(spark, monkeypatch):
    ref = spark.createDataFrame(
        [(1, "Ubu", "sans", []), (2, "Helvetica", "sans", ["Helv"]), (3, "Garamond", "serif", [])],
        "family_id int, canonical_name string, generic_class string, aliases array<string>"
    )
    rows = [(1, "UBU-Bold", None, "ubu"), (2, "Helvetca", None, "helvetca"), (3, None, None, "xyz"), (4, None, None, "Garamont")]
    d = spark.createDataFrame(rows, "font_id bigint, raw_name string, normalized_name string, family string")
    one = {tuple(r) for r in C.found(d, ref).collect()}
    assert one == {(1, 1), (2, 2), (3, 0), (4, 3)}
    monkeypatch.setattr(C, "BROADCAST_ENTRIES", 0)
    assert {tuple(r) for r in C.found(d, ref).collect()} == one
