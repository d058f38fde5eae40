import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope.operators import lookups as L
from folioscope.operators import nearest as N


def brute(queries, memory, t, k):
    out = []
    for a in queries:
        some = sorted((-s, j) for j, b in enumerate(memory) if a != b and (s := L.indel_ratio(a, b)) >= t)
        out.append(some[:k])
    return out


def odd_texts(rng):
    words = [
        *"the method agrees with a measured value of every sample 12 3.5 (fig. 7)".split(), "проба", "метод", "表", "結果", "ونتيجة", "ผล", "𝑥", "α+β", "é"
    ]
    texts = [rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(150)]
    for x in texts[:80]:  # texts a few changes away
        y = list(x)
        for _ in range(rng.randint(1, 1 + len(y) // 5)):
            p = rng.randrange(len(y))
            y[p : p + 1] = rng.choice(["", y[p] + "e", "z"])
        texts.append("".join(y) or "z")
    long = "".join(rng.choices("ab cdefgh", k=1_500))
    return [*texts, "a", "b", "ab", "a" * 300, "a" * 310, "a" * 254 + "b", "a" * 255, long, long[3:], long[::-1], "same", "same"]


@pytest.mark.parametrize("t, k", [(0.85, 3), (0.7, 1), (0.5, 5)])
@pytest.mark.parametrize("tile, block, pairs", [(8_192, 32, 16_384), (37, 5, 11)])
def test_nearest_equals_brute_force(monkeypatch, t, k, tile, block, pairs):
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PAIRS", pairs)
    texts = odd_texts(random.Random(4))
    queries = [*texts[::3], "not of the memory", "新", "a" * 255 + "b"]
    assert N.nearest(queries, texts, t, k, lambda j: j) == brute(queries, texts, t, k)
    assert N.nearest([], texts, t, k, lambda j: j) == [] and N.nearest(["a"], [], t, k, lambda j: j) == [[]]


def sentences(rng, n):
    words = "the calibration curve helps every crew sort more cards quickly while our parser leaves order of pages unchanged near lakes".split()
    return [" ".join(rng.sample(words, len(words))) for _ in range(n)]


def test_texts_of_the_same_characters_are_rarely_compared_whole(monkeypatch):
    rng = random.Random(1)
    memory = sentences(rng, 600)
    queries = [memory[i] for i in range(0, 600, 20)] + [memory[i].replace("curve", "curves") for i in range(5)]
    calls = []
    whole = N.lcs_length
    monkeypatch.setattr(N, "lcs_length", lambda *x: calls.append(1) or whole(*x))
    got = N.nearest(queries, memory, 0.85, 3, lambda j: j)
    assert len(calls) < 0.02 * len(queries) * len(memory)
    assert got == brute(queries, memory, 0.85, 3)


def test_many_texts_of_the_same_characters_in_time(spark):
    rng = random.Random(3)
    texts = sentences(rng, 8_000)
    m = spark.createDataFrame([(i, "fr", x, 1.0) for i, x in enumerate(texts)], "memory_id bigint, pair string, text string, quality double").cache()
    m.count()
    q = m.filter("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), "pair", F.concat("text", F.lit("s")).alias("text"))
    began = time.time()
    got = {(r.query_id, r["rank"], r.memory_id) for r in L.fuzzy_matches(q, m, 0.85, 3).collect()}
    took = time.time() - began
    m.unpersist()
    assert {(i, 1, i) for i in range(0, 8_000, 20)} <= got
    assert took < 30
