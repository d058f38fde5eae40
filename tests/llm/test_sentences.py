import pytest

from folioscope.llm import sentences as S

STATS = S.Statistics(
    abbreviations={"*": frozenset({"Dr", "Prof", "e.g", "p", "Fig", "vol"})}, ordinary={"*": frozenset({"etc", "noise"})},
    numbered={"*": frozenset({"p", "Fig", "vol"})}, starters={"*": frozenset({"The", "However,", "In"})},
    openings=frozenset({"อย่างไรก็ตาม"}), heads=frozenset({"กลุ่ม", "วิธีก"}), tails=frozenset({"สัปดาห์"[-5:]}),
)
CASES = [
    ("One here. Two here.", ["One here.", "Two here."]),
    ("By 7.31 units (e.g. Kx3). Next one!", ["By 7.31 units (e.g. Kx3).", "Next one!"]),
    ("We use e.g. Kx397 in Fig. 3 here. The end", ["We use e.g. Kx397 in Fig. 3 here.", "The end"]),
    ("Of J. S. Bach, p. 3, etc. The next", ["Of J. S. Bach, p. 3, etc.", "The next"]),
    ('Dr. Vek notes: "It works. It does." The next one.', ['Dr. Vek notes: "It works. It does."', "The next one."]),
    ('The remark "It works." comes from Vek. The next.', ['The remark "It works." comes from Vek.', "The next."]),
    ("free of noise.The parser is on?However, it is.", ["free of noise.", "The parser is on?", "However, it is."]),
    ("A line that\ngoes on here. And\nends.", ["A line that\ngoes on here.", "And\nends."]),
    (
        "4.2 Heading\n\nText here.\n\n- first item\n- second item.\n\n| a | b |\n| c | d |\n\nx = y + 2\n\n1.2 Title ........ 12",
        ["4.2 Heading", "Text here.", "- first item", "- second item.", "| a | b |", "| c | d |", "x = y + 2", "1.2 Title ........ 12"]
    ),
    ("第一句。第二句？“第三句。”这句话出自某人。", ["第一句。", "第二句？", "“第三句。”这句话出自某人。"]),
    ("पहला वाक्य। दूसरा वाक्य।", ["पहला वाक्य।", "दूसरा वाक्य।"]),
    ("الجملة الأولى. هل هذه الثانية؟ نعم.", ["الجملة الأولى.", "هل هذه الثانية؟", "نعم."]),
    ("อย่างไรก็ตาม วิธีการนี้ใช้เวลา 5 วัน กลุ่มควบคุมดี", ["อย่างไรก็ตาม วิธีการนี้ใช้เวลา 5 วัน", "กลุ่มควบคุมดี"]),
    ("The model ... goes on. What?! Yes.", ["The model ... goes on.", "What?!", "Yes."]),
    ("See https://a.example.org/c.9 now. n-renquil starts.", ["See https://a.example.org/c.9 now.", "n-renquil starts."]),
    ("Unbalanced (bracket. And so on.", ["Unbalanced (bracket.", "And so on."]),
    ("", []), (" \n\t ", []), ("...", ["..."]), (".", ["."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in S.split(text, STATS)] == want


def test_units_are_ordered_disjoint_and_whole():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="ab A.?!\n\"()“”。|-1 กด…«»", max_size=60))
    def check(t):
        at = 0
        for a, b in S.split(t, STATS):
            assert at <= a < b and not t[at:a].strip() and t[a:b] == t[a:b].strip()
            at = b
        assert not t[at:].strip()

    check()


def test_statistics_are_learned(spark):
    starts = ["The data came late.", "However, it rained.", "In all, it worked.", "The rest is known."]
    rows = [
        (
            i,
            f"{starts[i % 4]}\n\nThe model works well (see noise). The team of Dr. Vek{i} uses e.g. Kx{i} a lot, p. {i}. The parser needs data, etc. The "
            f"noise stays.\n\nThe end is known. The rest of it works!  The rest.",
            "en"
        )
        for i in range(80)
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    s = S.learn(d)
    assert {"Dr", "e.g", "p"} <= s.abbreviations["en"] and "p" in s.numbered["en"] and "The" in s.starters["en"]
    assert "etc" not in s.abbreviations["en"] and "known" not in s.abbreviations["en"]


def test_frame(spark):
    long = "A sentence of some length. " * 20000
    rows = [(1, "One. Two.", "en", 7), (2, None, None, 7), (3, "", "en", 7), (4, " \n ", None, 7), (5, long, "en", 7), (1, "One. Two.", "en", 7)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, start_pos int")
    got = [tuple(r) for r in S.sentences(d, STATS).collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert {x[0] for x in got} == {1, 5} and sum(x[0] == 5 for x in got) == 20000
    assert S.sentences(d.limit(0)).count() == 0
    assert S.sentences(d).filter("doc_id = 1").count() == 4


def test_statistics_do_not_depend_on_batches(spark):
    starts = ["The data came late.", "However, it rained.", "In all, it worked.", "The rest is known."]
    rows = [(f"{starts[i % 4]}\n\nThe team of Dr. Vek{i} uses e.g. Kx{i} a lot, p. {i}.", "en") for i in range(60)]
    rows += [(f"some parser needs data, etc. The noise of Prof. However stays. In it The end. It", ["en", "de"][i % 2]) for i in range(60)]
    d = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    one = S.learn(d)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        assert S.learn(d.repartition(5)) == one
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    n = S.count_batch(*map(list, zip(*rows)))
    parts = sum((S.count_batch([t], [lang]) for t, lang in rows), S.Counter())
    assert n == parts and n["en", "T", "The", ""] == 60 + 30 + 30 + 30 and n["de", "P", "etc", "The"] == 30


def test_brackets_of_any_length_and_depth():
    inside = "(see one. Two " * 40 + "end. Of it" + ")" * 40
    text = f"The model {inside} works. Next one."
    assert [text[a:b] for a, b in S.split(text, STATS)] == [text[: text.index(" Next")], "Next one."]
    prose = "The list (" + "\n".join(f"word number {i} of it." for i in range(200)) + ") ends here.\n"
    text = prose + "Next one."
    assert [text[a:b] for a, b in S.split(text, STATS)] == [prose.strip(), "Next one."]


def test_learned_words_are_all_that_is_asked_for(spark):
    starts = ["The data came late.", "However, it rained.", "In all, it worked.", "The rest is known."]
    rows = [
        (f"{starts[i % 4]}\n\nThe team of Dr. Vek{i} sees representations. The end.of it is here. The rest of set. The noise stays.", "en") for i in range(80)
    ]
    s = S.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert "set" in s.ordinary["en"] and "representations" not in s.ordinary["en"]  # long ordinary words decide nothing
