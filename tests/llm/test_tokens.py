import base64
import os

import pytest
import tiktoken

from folioscope.llm import tokens as K

PATH = K.default_tokenizer_path()
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_reference_on_difficult_texts(reference):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" '\n\tstrelvmd1²Ⅳ,!中ก่้ 　", max_size=25)), min_size=1, max_size=6))
    def check(texts):
        flat, at = K.tokenizer(PATH).encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in texts]

    check()


def test_frame(spark, reference):
    long = "Ein sehr langer Text, it's long. " * 3000
    rows = [(1, "it's 12 cats", "x"), (2, None, "y"), (3, "", "z"), (4, long, None), (1, "it's 12 cats", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in K.token_ids(d, PATH).collect()]
    assert sorted(got) == sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert K.token_ids(d, PATH).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert K.token_ids(d.limit(0), PATH).count() == 0
    assert {r.doc_id: r.n_tokens for r in K.token_counts(d, PATH, keep=("doc_id",)).collect()}[2] == 0
    assert K.decode(dict(got)[4], PATH) == long


def test_whole_table(spark, data, reference):
    d = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    assert {r.doc_id: r.ids for r in K.token_ids(d, PATH).collect()} == {i: reference.encode_ordinary(t) for i, t in texts.items()}


def test_no_vocabulary_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for d, _, fs in os.walk(root) if ".git" not in d for f in fs if f.endswith((".tiktoken", ".model"))]


def thue_morse(k):
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("k", [8, 10, 11, 12])
def test_equal_hashes_give_their_own_ids(reference, k):
    # words whose weighted sums agree modulo any power of two
    texts = [*thue_morse(k), "other words", thue_morse(k)[0]]
    flat, at = K.tokenizer(PATH).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_long_random_slices(reference):
    import random

    r = random.Random(3)
    texts = ["".join(r.choices("abcdefgh", k=r.randrange(1, 3000))) for _ in range(40)]
    flat, at = K.tokenizer(PATH).encode(texts + texts[::-1])
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in texts + texts[::-1]]


def test_offsets_and_round_trip(spark):
    rows = [(1, "naïve 中文 text, it's"), (2, None), (3, ""), (4, "ก่้ x " * 500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in K.decoded(K.token_ids(d, PATH, offsets=True), PATH).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        t = K.tokenizer(PATH)
        assert r.decoded.encode() == raw and all(
            raw[o : o + len(t.pieces[i])] == t.pieces[i] for i, o in zip(r.ids, r.offsets)
        ) and len(r.ids) == len(r.offsets)
