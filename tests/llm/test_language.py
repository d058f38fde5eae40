import pytest
from pyspark.sql import functions as F

from folioscope.llm import language as L
from folioscope.llm.common import code_lookup

WORDS = {
    "en": "the method shows a stable trend over many weeks and the parser needs more memory than the earlier version of this model",
    "fr": "la méthode montre une tendance stable sur plusieurs semaines et le modèle demande plus de mémoire que la version précédente",
    "de": "die Methode zeigt über viele Wochen einen stabilen Verlauf und das Modell braucht mehr Speicher als die frühere Fassung",
    "es": "el método muestra una tendencia estable durante muchas semanas y el modelo necesita más memoria que la versión anterior",
}
OTHER = {
    "ru": "Метод показывает устойчивую тенденцию.", "zh": "该方法呈现稳定的趋势。", "ja": "この手法は安定した傾向を示す。", "ar": "الأسلوب يظهر اتجاها مستقرا.",
    "hi": "यह तरीका स्थिर रुझान दिखाता है।", "th": "วิธีการนี้แสดงแนวโน้มคงที่"
}


@pytest.fixture(scope="module")
def requests(spark):
    import random

    random.seed(1)
    rows, k = [], 1000
    for lang, text in WORDS.items():
        for _ in range(60):
            ws = text.split()
            random.shuffle(ws)
            rows.append((k, " ".join(ws[:9]).capitalize() + ".", lang))
            k += 1
    for lang, text in OTHER.items():
        rows += [(k + i, text, lang) for i in range(20)]
        k += 20
    return spark.createDataFrame(rows, "request_id bigint, text string, source_lang string")


CASES = [
    (1, "The method needs memory.", "en-US", []), (2, "The method needs memory.", "English", []), (3, "The method needs memory.", "fr", ["en"]),
    (4, "The method needs memory.", None, ["en"]), (5, "The method needs memory.", "unknown", ["en"]),
    (6, "The method needs more memory. La méthode montre une tendance stable.", "en", ["en", "fr"]), (7, "[12]", None, []), (8, "α + β = 5", "xx", []),
    (9, "Kx397", "", []), (10, None, None, []), (11, "", "en", []), (12, "  ", None, []),
    (13, "该方法呈现稳定的趋势。この手法は安定した傾向を示す。", "zh", ["zh", "ja"]), (14, "The method (“Une tendance”) needs more memory than this version.", "en", []),
    (15, "Das Modell braucht mehr Speicher. Метод показывает тенденцию. Die Methode zeigt Wochen.", "de", ["de", "ru", "de"]),
    (16, "The method needs memory.", " EN ", []), (17, "@@BLK_URL_0001_AAAAAAAA@@", None, []), (18, "วิธีการนี้แสดงแนวโน้มคงที่", "de", ["th"]),
]


def test_cases(spark, data, requests):
    own = spark.createDataFrame([c[:3] for c in CASES] + [CASES[2][:3]], "request_id bigint, text string, source_lang string")
    got = {}
    for r in L.found(requests.unionByName(own), code_lookup(spark, data)).collect():
        got.setdefault(r.request_id, {})[r.seg_no] = r.lang
    for i, text, declared, want in CASES:
        assert [v for _, v in sorted(got.get(i, {}).items())] == want, (text, declared)
    assert not [i for i in got if i >= 1000]


def test_held_out_accuracy(spark, data):
    r = L.labelled_requests(spark.read.parquet("/root/testdata/sf0.01/requests.parquet"), code_lookup(spark, data))
    train, test = r.filter("request_id % 4 <> 0"), r.filter("request_id % 4 = 0")
    model = L.fit_model(train.select(F.col("request_id").alias("id"), "text", F.col("declared").alias("lang")))
    s = L.segments(test, model, keep=("declared",)).filter("n_segments = 1 and declared is not null")
    n, same = s.count(), s.filter("lang = declared").count()
    assert n > 200 and same / n > 0.85  # a part of the labels is wrong on purpose
    assert s.filter("confidence < 0 or confidence > 1").count() == 0


def test_long_text_and_empty_table(spark, data, requests):
    long = " ".join(["The method needs more memory."] * 3000 + ["La méthode montre une tendance stable."])
    own = spark.createDataFrame([(1, long, "en")], "request_id bigint, text string, source_lang string")
    assert [
        (r.seg_no, r.lang) for r in L.found(requests.unionByName(own), code_lookup(spark, data)).filter("request_id = 1").orderBy("seg_no").collect()
    ] == [(1, "en"), (2, "fr")]
    assert L.found(requests.limit(0), code_lookup(spark, data)).count() == 0


def test_other_languages_are_unknown(spark, data, requests):
    model = L.fit_model(requests.select(F.col("request_id").alias("id"), "text", F.col("source_lang").alias("lang")))
    texts = {
        "이 방법은 안정적인 추세를 보인다.": "und", "Η μέθοδος δείχνει σταθερή τάση.": "und", "השיטה מראה מגמה יציבה.": "und",
        "Цей метод виявляє сталу тенденцію і її зміни.": "und", "یہ طریقہ ایک مستحکم رجحان دکھاتا ہے۔": "und", "Метод показывает устойчивую тенденцию.": "ru"
    }
    got = model.label(list(texts))
    assert [[s[0] for s in segs] for segs in got] == [[v] for v in texts.values()]
    one, many = model.label(["Метод", "Метод показывает устойчивую тенденцию во всех трёх областях."])
    assert 0.5 < one[0][1] < 0.9 < many[0][1] < 1  # a script alone proves little
    d = spark.createDataFrame([(1, "이 방법은 안정적인 추세를 보인다.", "ko"), (2, "α + β", None)], "request_id bigint, text string, source_lang string")
    assert [tuple(r) for r in L.found(requests.unionByName(d), code_lookup(spark, data)).filter("request_id < 3").collect()] == [(1, 1, "und")]


def test_few_rows_are_kept(monkeypatch):
    model = L.LanguageModel()
    model.fit([L.tokens(t) for t in WORDS.values()], list(WORDS))
    want = [[s[0] for s in x] for x in model.label(list(OTHER.values()) * 3)]
    monkeypatch.setattr(L, "ROWS", 3)
    for _ in range(3):
        assert [[s[0] for s in x] for x in model.label(list(OTHER.values()) * 3)] == want and len(model.rows) < 100
