"""Every query of the subpackage runs on the smallest tables and has the columns it must have."""

import pytest

from quaylight.llm.queries import QUERIES
from quaylight.plans import core_queries

COLUMNS = {
    "p1_found": [("tbl", "string"), ("seq", "bigint"), ("utc_us", "bigint")],
    "p2_found": [("tbl", "string"), ("first_seq", "bigint"), ("seq", "bigint")],
    "p3_found": [("msg_id_a", "bigint"), ("msg_id_b", "bigint")],
    "p4_found": [("device_id", "string"), ("report_day", "string"), ("metric", "string")],
    "p5_found": [("tbl", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
    "p6_found": [("tbl", "string"), ("row_key", "string"), ("place", "string"), ("kind", "string"), ("found_text", "string")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint")],
}
ALL = {**core_queries(), **QUERIES}


@pytest.mark.parametrize("name", sorted({*QUERIES, *COLUMNS}))
def test_query(spark, sf, name):
    df = ALL[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        if name != "p7_ids":
            assert len({tuple(r) for r in rows}) == len(rows)
    assert rows
    if name == "p3_found":
        assert all(r[0] < r[1] for r in rows)
    if name == "p5_found":
        assert all(r[1] < r[2] for r in rows)
    if name == "p2_found":
        assert all(r[1] < r[2] for r in rows)
