"""The pipeline queries over the smallest tables: as many rows as the tables are known to hold, and no id twice."""

import os

import pytest

import __spark_entry__ as entry

ROWS = {"p2_found": 5, "p3_found": 16, "p4_found": 168, "p5_found": 191, "p6_found": 4, "p6_report": 4, "p7_shares": 11, "p8_found": 11}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows(spark, name):
    if not os.path.isdir(entry.DATA):
        pytest.skip("no test data")
    rows = [tuple(r) for r in entry.queries()[name](spark, entry.DATA).collect()]
    assert len(rows) == len(set(rows)) == ROWS[name]


def test_recall(spark):
    if os.path.isdir(entry.DATA):
        assert entry.queries()["p5_recall"](spark, entry.DATA).first().recall >= 0.99


def test_mix_reaches_its_shares(spark):
    if os.path.isdir(entry.DATA):
        rows = entry.queries()["p7_mix"](spark, entry.DATA).collect()
        assert rows and len({r.doc_id for r in rows}) == len(rows) and min(r.repeats for r in rows) >= 1
