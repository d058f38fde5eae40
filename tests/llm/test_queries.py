import importlib

import pytest

import __spark_entry__ as E

Q = importlib.import_module("folioscope.llm.queries")
COLUMNS = {
    "p1_found": {"request_id", "seg_no", "lang"}, "p2_found": {"result_id", "idx"}, "p3_found": {"result_id", "idx", "defect"},
    "p4_found": {"span_id_a", "span_id_b"}, "p5_found": {"font_id", "family_id"}, "p6_ids": {"doc_id", "ids"}, "p8_found": {"doc_id", "start_pos", "end_pos"},
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    rows = df.count()
    assert rows > 0
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name] and df.distinct().count() == rows


def test_entry_has_them():
    assert set(Q.QUERIES) <= set(E.queries())
