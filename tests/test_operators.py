import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.operators import layout as G
from folioscope.operators import lookups as L
from folioscope.operators import ranking as K
from folioscope.operators import rollups as R
from folioscope.sources import artifacts as A
from folioscope.streaming import blocks as B

BLOCKS = (
    "doc_id bigint, page_no int, page_width double, page_height double, block_no int, block_id string, type string, bbox "
    "struct<x0:double,y0:double,x1:double,y1:double>, text string, size double"
)


def page(spark, boxes, **extra):
    rows = [(1, 1, 600.0, 842.0, i, f"b{i}", "text", b, f"t{i}", 11.0) for i, b in enumerate(boxes, 1)]
    return spark.createDataFrame(rows, BLOCKS)


def test_columns_and_order(spark):
    b = page(spark, [(50.0, 100.0, 250.0, 120.0), (300.0, 100.0, 500.0, 120.0), (50.0, 130.0, 250.0, 150.0), (300.0, 130.0, 500.0, 150.0)])
    assert sorted((r.column_no, r.n_blocks) for r in G.columns(b).collect()) == [(0, 2), (1, 2)]
    assert [r.block_id for r in G.reading_order(b).orderBy("position").collect()] == ["b1", "b3", "b2", "b4"]


def test_regions(spark):
    from folioscope.functions import classify as C

    b = page(spark, [(0.0, 20.0, 9.0, 40.0), (0.0, 100.0, 9.0, 120.0), (0.0, 130.0, 9.0, 150.0), (0.0, 800.0, 9.0, 820.0)])
    assert [
        r[0] for r in b.orderBy("block_no").select(C.region(F.col("bbox.y0"), F.col("bbox.y1"), F.col("page_height"))).collect()
    ] == ["header", "body", "body", "footer"]


def test_overlap_equals_brute_force(spark):
    import random

    random.seed(5)
    boxes = []
    for _ in range(40):
        x, y = random.uniform(0, 400), random.uniform(0, 900)
        boxes.append((x, y, x + random.uniform(1, 200), y + random.uniform(1, 300)))
    got = {(r.a, r.b): r.iou for r in G.text_pairs(page(spark, boxes)).collect() if r.iou > 0}
    want = {}
    for i, a in enumerate(boxes, 1):
        for j, b in enumerate(boxes, 1):
            if i < j:
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                if w > 0 and h > 0:
                    inter = w * h
                    want[i, j] = inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_overlap_of_pages_without_boxes(spark):
    b = page(spark, [(0.0, 0.0, 9.0, 9.0), None, (3.0, 3.0, 3.0, 3.0)])
    r = G.page_overlap(b).first()
    assert (r.overlap_pairs, r.mean_iou, r.max_iou) == (0, 0.0, 0.0)
    assert G.page_overlap(b.limit(0)).count() == 0


def test_merging(spark):
    near = page(spark, [(50.0, 100.0, 150.0, 115.0), (50.0, 120.0, 150.0, 135.0)])
    r = G.merge_paragraphs(G.reading_order(near)).collect()
    assert [(x.n_blocks, x.text) for x in r] == [(2, "t1\nt2")]
    far = page(spark, [(50.0, 100.0, 150.0, 115.0), (300.0, 120.0, 400.0, 135.0), None])
    assert sorted(x.n_blocks for x in G.merge_paragraphs(G.reading_order(far)).collect()) == [1, 1]
    assert G.merge_paragraphs(G.reading_order(far.limit(0))).count() == 0


def test_merging_is_the_same_for_any_partitioning(spark):
    import random

    random.seed(3)
    rows = [
        (
            k % 7, 1 + k % 2, 600.0, 842.0, k, f"b{k}", "text", (50.0, 20.0 * (k // 14), 250.0, 20.0 * (k // 14) + random.choice([5.0, 15.0])), f"t{k}",
            random.choice([11.0, 14.0, None])
        )
        for k in range(200)
    ]
    d = G.reading_order(spark.createDataFrame(rows, BLOCKS))
    one = sorted(map(tuple, G.merge_paragraphs(d).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    many = sorted(map(tuple, G.merge_paragraphs(d.repartition(9)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert one == many


def test_safe_boxes(spark):
    r = {x.block_no: (x.x0, x.y0, x.x1, x.y1) for x in G.safe_boxes(page(spark, [(0.0, 0.0, 100.0, 50.0), (0.0, 40.0, 100.0, 90.0)])).collect()}
    assert r[1] == (0.0, 0.0, 99.0 if False else 100.0, 50.0) or r[1][2] <= 100.0
    assert G.safe_boxes(page(spark, [(5.0, 5.0, 5.0, 5.0)])).first().x1 == 55.0


def glossary(spark):
    return spark.createDataFrame(
        [
            ("Neural network", "réseau neuronal", "ml", False, 0), ("neural network", "réseau de neurones", "ml", False, 1), ("AI", "IA", "ml", True, 0),
            (None, "x", "ml", False, 0), ("", "y", "ml", False, 0)
        ],
        "source string, target string, domain string, case_sensitive boolean, load_seq int"
    )


def test_glossary(spark):
    g = L.merged_glossary(glossary(spark))
    assert {r.term_key: r.target for r in g.collect()} == {"neural network": "réseau de neurones", "ai": "IA"}
    t = spark.createDataFrame([(1, "A Neural Network and AI"), (2, "ai said"), (3, "neural networks"), (4, None)], "id int, text string")
    assert sorted((r.id, r.term_key) for r in L.terms_as_words(t, "text", g).collect()) == [(1, "ai"), (1, "neural network")]
    assert sorted((r.id, r.term_key) for r in L.terms_contained(t, "text", g).collect()) == [(1, "ai"), (1, "neural network"), (2, "ai"), (3, "neural network")]
    p = t.withColumn("out", F.lit("un réseau de neurones"))
    r = {x.id: (x.terms_found, x.terms_enforced, x.adherence_rate) for x in L.adherence(p, ["id"], "text", "out", g).collect()}
    assert r == {1: (2, 1, 0.5), 2: (0, 0, 1.0), 3: (0, 0, 1.0), 4: (0, 0, 1.0)}


def test_large_glossary_gives_the_same(spark, monkeypatch):
    g = L.merged_glossary(glossary(spark))
    t = spark.createDataFrame([(1, "A Neural Network and AI"), (2, "AI")], "id int, text string")
    small = sorted((r.id, r.term_key) for r in L.terms_as_words(t, "text", g).collect())
    monkeypatch.setattr(L, "BROADCAST_TERMS", 1)
    assert sorted((r.id, r.term_key) for r in L.terms_as_words(t, "text", g).collect()) == small


def test_contained_terms_whatever_the_glossary(spark, monkeypatch):
    rows = [("work", "a"), ("net work", "b"), ("é", "c"), ("ab", "d"), ("a.b", "e"), ("  x", "f"), ("Ünïcode", "g")]
    g = L.merged_glossary(
        spark.createDataFrame([(s, t, "x", False, 0) for s, t in rows], "source string, target string, domain string, case_sensitive boolean, load_seq int")
    )
    texts = ["network", "Net Work", "é", "xabx a.b", "", None, "a  x b", "über ÜNÏCODE", "w" * 5000 + "work"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((i, s.lower()) for i, x in enumerate(texts) for s, _ in rows if x and s.lower() in x.lower())
    for limit in (1_000, 1):
        monkeypatch.setattr(L, "BROADCAST_TERMS", limit)
        assert sorted((r.id, r.term_key) for r in L.terms_contained(t, "text", g).collect()) == want
        assert L.terms_contained(t, "text", g.limit(0)).count() == 0


def test_enforcement(spark):
    d = spark.createDataFrame(
        [("the neural network", [("neural network", "réseau", False)]), ("rien", None)],
        "t string, terms array<struct<source:string,target:string,case_sensitive:boolean>>"
    )
    assert [r.enforced_text for r in L.enforced(d, "t", "terms").collect()] == ["the réseau", "rien"]


def test_cache_ladder(spark):
    now = dt.datetime(2025, 1, 10)
    cache = spark.createDataFrame(
        [
            ("a", ["x"], "v1", now - dt.timedelta(hours=1)), ("a", ["old"], "v1", now - dt.timedelta(days=30)), ("b", ["x"], "v0", now),
            ("c", ["x"], "v1", None), ("d", ["x"], "v1", now - dt.timedelta(days=9))
        ],
        "cache_key string, candidates array<string>, version string, created_at timestamp"
    )
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), (None,)], "cache_key string")
    r = {x.cache_key: (x.cache_status, x.cached_candidates) for x in L.cache_lookup(q, cache, F.lit(now), 7 * 86400, "v1").collect()}
    assert r == {
        "a": ("hit", ["x"]), "b": ("miss_version", None), "c": ("miss_no_timestamp", None), "d": ("miss_expired", None), "e": ("miss_not_found", None),
        None: ("miss_not_found", None)
    }


def test_fuzzy_equals_brute_force(spark):
    import random

    random.seed(2)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [" ".join(random.choices(words, k=random.randint(1, 6))) for _ in range(120)] + ["", None, "alpha", "alpha"]
    m = spark.createDataFrame([(i, "en-fr", t, float(i % 3)) for i, t in enumerate(texts)], "memory_id bigint, pair string, text string, quality double")
    q = m.filter("memory_id % 10 = 0").select(F.col("memory_id").alias("query_id"), "pair", "text")
    got = {(r.query_id, r["rank"]): (r.memory_id, round(r.similarity, 9)) for r in L.fuzzy_matches(q, m, 0.7, 2).collect()}
    best = {}
    for t in {t for t in texts if t}:
        ids = [i for i, x in enumerate(texts) if x == t]
        best[t] = min(ids, key=lambda i: (-(i % 3), i))
    want = {}
    for i in range(0, len(texts), 10):
        if texts[i]:
            c = sorted(((-L.indel_ratio(texts[i], t), -(j % 3), j) for t, j in best.items() if L.indel_ratio(texts[i], t) >= 0.7))[:2]
            want |= {(i, k): (j, round(-s, 9)) for k, (s, _, j) in enumerate(c, 1)}
    assert got == want


def test_indel_ratio():
    assert L.indel_ratio("", "") == 1.0 and L.indel_ratio("abc", "abc") == 1.0 and L.indel_ratio("abc", "xyz") == 0.0
    assert L.indel_ratio("lewenstein", "levenshtein") == pytest.approx(2 * 9 / 21)


def test_repair_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False)], "id int, translated_text string, ok boolean")
    new = spark.createDataFrame([(1, "A", True), (3, "C", False), (9, "Z", True)], "id int, translated_text string, ok boolean")
    assert sorted(
        (r.id, r.translated_text, r.ok, r.repaired) for r in L.repaired(old, new, ["id"]).collect()
    ) == [(1, "A", True, True), (2, "b", True, False), (3, "c", False, False)]
    a = spark.createDataFrame([("k", 1, "x"), ("l", 5, "y")], "k string, at int, v string")
    b = spark.createDataFrame([("k", 1, "new"), ("l", 4, "older")], "k string, at int, v string")
    assert sorted((r.k, r.v) for r in L.upserted(a, b, ["k"], "at").collect()) == [("k", "new"), ("l", "y")]


def test_ranking(spark):
    ph = "@@BLK_A_B_0001_AAAAAAAA@@"
    rows = [(1, i, f"The result {ph} is 5", c, [ph], False, 1.0) for i, c in enumerate([f"Le résultat {ph} est 5", "Le résultat est 5", f"Résultat {ph}: 5"])]
    d = spark.createDataFrame(rows, "id int, idx int, source_text string, candidate string, registry array<string>, is_header boolean, glossary_score double")
    r = K.ranked(d, ["id"]).orderBy("rank").collect()
    assert len(r) == 3 and r[0].valid and ph in r[0].candidate and not r[2].valid


def test_generation(spark):
    q = spark.createDataFrame([(1, "hi", "fr", 2), (2, None, None, None)], "request_id bigint, text string, target_lang string, n_candidates int")
    assert sorted((r.request_id, r.idx, r.candidate) for r in K.generated(q, "prefix").collect()) == [(1, 0, "FR: hi"), (2, 0, ": ")]
    def broken(r):
        raise RuntimeError("down")
    assert {(r.candidate, r.error) for r in K.generated(q, broken, retries=1).collect()} == {("", "down")}


def test_rollups(spark):
    d = spark.createDataFrame([(1, "A", 3), (1, "B", 1), (1, "B", 2), (1, "A", 0), (2, None, 0)], "k int, f string, o int")
    assert [(r.k, r.f, r.n) for r in R.dominant(d, ["k"], "f", ["o"]).collect()] == [(1, "A", 2)]
    m = spark.createDataFrame([(1, x) for x in (4.0, 1.0, 3.0, 2.0, None)], "k int, v double")
    assert R.upper_median(m, ["k"], "v").first().upper_median == 3.0
    b = spark.range(1, 700).select(R.batch_numbers(F.col("id"), F.lit(700)).alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in b][:7] == [32] * 7 and [r["count"] for r in b][7:12] == [64] * 5 and b[12]["count"] == 96
    t = R.paired_t(spark.createDataFrame([(1.0, 0.0), (3.0, 1.0), (2.0, 1.5)], "a double, b double"), "a", "b").first()
    assert t.n == 3 and t.t == pytest.approx(2.646, abs=1e-3)


def test_artifacts(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"terms": {"a": "b"}}')
    (tmp_path / "h.json").write_text('{"c": "d"}')
    assert sorted((r.source, r.target) for r in A.read_glossary(spark, str(tmp_path / "*.json")).collect()) == [("a", "b"), ("c", "d")]
    (tmp_path / "e.env").write_text("export KEY=\"v 1\"\n# no\nOTHER='x'\nPLAIN=7 # seven\n")
    assert {(r.name, r.value) for r in A.read_env(spark, str(tmp_path / "e.env")).collect()} == {("KEY", "v 1"), ("OTHER", "x"), ("PLAIN", "7")}
    d = spark.createDataFrame([(1, 1, "b", "s", "t")], "doc_id int, block_no int, block_id string, source_text string, translated_text string")
    A.write_stage(d, str(tmp_path / "out"), "translations")
    assert A.read_stage(spark, str(tmp_path / "out"), "translations").count() == 1
    with pytest.raises(ValueError):
        A.write_stage(d, str(tmp_path / "out"), "nothing")
    A.write_summary(d, str(tmp_path / "sum"))
    A.latex_lines(d).write.text(str(tmp_path / "tex"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"doc_id": "d", "page_no": 1, "block_no": 1, "lines": [{"spans": [{"text": "x"}, {"text": "y"}]}, {"spans": [{"text": "z"}]}]}'
    )
    from folioscope.functions import text as T

    assert A.read_blocks(spark, str(tmp_path / "in"), "*.json").select(T.block_text(F.col("lines"))).first()[0] == "xy\nz"


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("k1", t0, "a 1"), ("k1", t0 + dt.timedelta(minutes=1), "b 2"), ("k2", t0 + dt.timedelta(minutes=2), "$x$")]
    spark.createDataFrame(rows, "key string, at timestamp, text string").write.parquet(str(tmp_path / "in"))
    s = B.block_stream(spark, str(tmp_path / "in"), "key string, at timestamp, text string")
    q = B.scored_stream(B.first_within(s, "key", "at", "1 hour")).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.table("scored").collect()) == ["k1", "k2"]
    q = s.writeStream.foreachBatch(B.upsert_into(str(tmp_path / "state"), ["key"], "at")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.text) for r in B.read_state(spark, str(tmp_path / "state")).collect()} == {("k1", "b 2"), ("k2", "$x$")}
    q = B.windowed_counts(s, "at", "key").writeStream.format("memory").outputMode("complete").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("counts").collect()) == 3


def test_fuzzy_gives_copies_of_the_own_text(spark):
    rows = [(1, "fr", "the same text"), (2, "fr", "the same text"), (3, "fr", "the same text"), (4, "fr", "the same texts"), (5, "de", "the same text")]
    m = spark.createDataFrame([(*r, 1.0) for r in rows], "memory_id bigint, pair string, text string, quality double")
    q = m.select(F.col("memory_id").alias("query_id"), "pair", "text")
    got = {(r.query_id, r["rank"]): r.memory_id for r in L.fuzzy_matches(q, m, 0.85, 3, others=True).collect()}
    assert got == {(1, 1): 2, (1, 2): 4, (2, 1): 1, (2, 2): 4, (3, 1): 1, (3, 2): 4, (4, 1): 1}


def test_memory_query_keeps_own_copies(spark, tmp_path):
    from folioscope.plans import scores

    rows = [(i, "the same text", "fr") for i in (20, 21, 22)] + [
        (23 + i, f"the same text{c}", "fr") for i, c in enumerate("abcd")
    ] + [(40, "the same text", "fr")]
    full = spark.read.parquet("/root/testdata/sf0.001/requests.parquet")
    d = spark.createDataFrame(rows, "request_id bigint, text string, target_lang string")
    d.select(*[F.col(c) if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in full.dtypes]).write.parquet(str(tmp_path / "requests.parquet"))
    got = [(r.query_id, r["rank"], r.memory_id) for r in scores.memory_fuzzy_topk(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(20, 1, 21), (20, 2, 23), (20, 3, 24), (40, 1, 20), (40, 2, 23), (40, 3, 24)]


def test_full_ranking_scores_the_glossary(spark, data):
    from folioscope.plans import frames as X
    from folioscope.plans import scores

    terms = [(r.term_key, r.target.lower()) for r in L.merged_glossary(scores.read_table(spark, data, "glossary")).collect()]
    want = {}
    for r in X.pairs(spark, data).collect():
        here = [t for k, t in terms if k in (r.source_text or "").lower()]
        want[r.result_id, r.idx] = sum(t in (r.translated_text or "").lower() for t in here) / len(here) if here else 1.0
    assert min(want.values()) < 1
    flat = K.ranked(X.pairs(spark, data).withColumnRenamed("translated_text", "candidate").withColumn("glossary_score", F.lit(1.0)), ["result_id"])
    before = {(r.result_id, r.idx): r.total for r in flat.select("result_id", "idx", "total").collect()}
    got = {(r.result_id, r.idx): r.total for r in scores.rerank_full(spark, data).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - (before[k] - 3 * (1 - want[k]))) < 1e-9 for k in want)


def test_state_over_gaps_and_repeats(spark, tmp_path):
    path = str(tmp_path / "state")
    put = B.upsert_into(path, ["key"], "at")
    batch = lambda rows: spark.createDataFrame(rows, "key string, at int, text string")
    assert B.read_state(spark, path) is None
    put(batch([("a", 1, "a1"), ("b", 1, "b1")]), 0)
    put(batch([("a", 2, "a2"), ("c", 1, "c1")]), 3)  # the numbers between belong to no batch
    put(batch([("a", 2, "a2"), ("c", 1, "c1")]), 3)  # run again
    put(batch([]), 4)
    put(batch([("b", 0, "late"), ("d", 1, "d1")]), 7)
    assert {(r.key, r.text) for r in B.read_state(spark, path).collect()} == {("a", "a2"), ("b", "b1"), ("c", "c1"), ("d", "d1")}


def test_best_match_needs_age_and_tokens(spark):
    now = dt.datetime(2025, 1, 10)
    token = "@@BLK_URL_0001_AAAAAAAA@@"
    rows = [
        (1, "fr", f"see the page {token} of it"), (2, "fr", f"see the page {token} of it."), (3, "fr", f"see the page {token.replace('1_A', '2_A')} of it"),
        (4, "fr", "a plain old text"), (5, "fr", "a plain old texts")
    ]
    m = spark.createDataFrame(
        [(*r, 1.0, now - dt.timedelta(days=30 if r[0] == 5 else 1)) for r in rows],
        "memory_id bigint, pair string, text string, quality double, requested_at timestamp"
    )
    q = m.filter("memory_id in (1, 3, 4)").select(F.col("memory_id").alias("query_id"), "pair", "text")
    got = {(r.query_id, r.memory_id) for r in L.best_match(q, m, F.lit(now), 7 * 86400, r"@@[A-Z]+(?:_[A-Z]+)+_\d{4}_[A-F0-9]{8}@@", 0.9).collect()}
    assert got == {(1, 2)}  # 3's best match has another token, and 4's is too old


def test_cascade(spark):
    q = spark.createDataFrame([(1, "short"), (2, "a longer text"), (3, None)], "request_id int, text string")
    got = {(r.request_id, r.backend) for r in K.routed(q).collect()}
    slow = [n for n, _, s in K.BACKENDS if s]
    assert len(got) == 3 * len(K.BACKENDS) - 2 * len(slow) and (2, slow[0]) in got
    c = spark.createDataFrame(
        [
            (1, 0, "cloud_pro", True, 1.0), (1, 1, "local_small", True, 0.5), (1, 2, "relay_v2", True, 1.0), (1, 3, "odd", True, 1.0),
            (1, 4, "hub_api", False, 9.0)
        ],
        "id int, idx int, backend string, valid boolean, total double"
    )
    assert [r.idx for r in K.cascaded(c, ["id"], ["idx"]).orderBy("rank").collect()] == [1, 0, 2, 3, 4]


def test_sinks_read_back(spark, tmp_path):
    g = L.merged_glossary(glossary(spark))
    A.write_glossary(g, str(tmp_path / "g"))
    assert {(r.source, r.target) for r in A.read_glossary(spark, str(tmp_path / "g")).collect()} == {(r.source, r.target) for r in g.collect()}
    A.write_glossary(g, str(tmp_path / "none"), "no such domain")
    assert A.read_glossary(spark, str(tmp_path / "none")).count() == 0
    m = spark.createDataFrame([("en-fr", "a", "b", 1.0, 1, dt.datetime(2025, 1, 1)), ("en-de", "a", None, None, None, None)], A.MEMORY)
    A.write_memory(m, str(tmp_path / "m"))
    assert A.read_memory(spark, str(tmp_path / "m")).count() == 2 and A.read_memory(spark, str(tmp_path / "m"), "en-fr").first().translation == "b"
    t = spark.createDataFrame(
        [(1, 2, "b2", "x", "y & z"), (1, 1, "b1", "s", None)], "doc_id bigint, block_no bigint, block_id string, source_text string, translated_text string"
    )
    A.export(t, str(tmp_path / "json"), "json")
    A.export(t, str(tmp_path / "latex"), "latex")
    assert '"block_no":1' in spark.read.text(str(tmp_path / "json")).first()[0] and any(
        "y \\& z" in r[0] for r in spark.read.text(str(tmp_path / "latex")).collect()
    )
    with pytest.raises(ValueError):
        A.export(t, str(tmp_path / "doc"), "word")
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "report.json").write_text('{\n "quality": 0.5\n}')
    assert sorted((r.run, r.quality) for r in A.read_reports(spark, str(tmp_path / "runs"), "quality double").collect()) == [("r1", 0.5), ("r2", 0.5)]
    assert sorted(r.name for r in A.read_folder(spark, str(tmp_path / "runs"), "*.json").collect()) == ["report.json"] * 2
    A.write_table(spark.createDataFrame([("b_1", 0.5), ("a", None)], "backend string, rate double"), str(tmp_path / "t"), "Rates")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "t/latex")).collect()]
    assert lines[0] == r"\begin{table}" and lines[3:5] == [r"a &  \\", r"b\_1 & 0.5 \\"]
    assert spark.read.option("header", True).csv(str(tmp_path / "t/csv")).count() == 2
    assert [r[0] for r in spark.createDataFrame([(1,), (0,), (None,)], "t int").select(A.block_type(F.col("t"))).collect()] == ["image", "text", "text"]


def test_base_style_and_summary(spark):
    s = spark.createDataFrame(
        [
            (1, "b", 0, 0, 1, "A", 10.0, 1, False), (1, "b", 0, 1, 2, "B", 12.0, 1, False), (1, "b", 1, 0, 3, "A", 11.0, None, False),
            (1, "h", 0, 0, 4, "C", 9.0, None, True), (1, "h", 0, 1, 5, "D", 20.0, None, True), (1, "n", 0, 0, 6, None, None, None, False)
        ],
        "doc_id int, block_id string, line_no int, span_no int, span_id int, font string, size double, color int, h boolean"
    )
    assert {
        r.block_id: (r.font, r.color, r["size"]) for r in R.base_style(s).collect()
    } == {"b": ("A", 1, 11.0), "h": ("D", None, 20.0), "n": (None, None, None)}
    d = {
        r.k: (r.n, r.mean, r.deviation)
        for r in R.described(spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 2.0), ("z", None)], "k string, v double"), ["k"], "v").collect()
    }
    assert d == {"x": (2, 2.0, pytest.approx(2**0.5)), "y": (1, 2.0, None)}
