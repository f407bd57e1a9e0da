"""Encoding: exact round trips, spans and the two libraries against each other."""

import pytest
from pyspark.sql import functions as F

from quaylight.llm import tokens as K

TEXTS = ["Hello  world\n", "长尾评测室 ☕️ ok", "", None, "  ", "a<|endoftext|>b", "x" * 20000, "𠀀é́\r\n﻿​", "Hello  world\n"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_round_trip_and_empty(df):
    got = {r.doc_id: r for r in K.encode(df, "text", ["doc_id"]).withColumn("back", K.decode(F.col("ids"))).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i].back == (t or "")
    assert got[2].ids == [] and got[3].ids == []
    assert 50256 not in got[5].ids and got[0].ids == got[8].ids


def test_counts_agree_with_ids(df):
    a = {r.doc_id: len(r.ids) for r in K.encode(df, "text", ["doc_id"]).collect()}
    b = {r.doc_id: r.n_tokens for r in K.token_counts(df, "text", ["doc_id"]).collect()}
    assert a == b


def test_both_libraries_agree_on_a_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: len(r.ids) for r in K.encode(d, "text", ["doc_id"]).collect()}
    b = {r.doc_id: r.n_tokens for r in K.token_counts(d, "text", ["doc_id"]).collect()}
    assert a == b and len(a) == d.count()


def test_spans_cover_the_text(df):
    table = K.token_bytes(K.BYTE_BPE_50K)
    for r in K.encode(df, "text", ["doc_id"], spans=True).collect():
        t = TEXTS[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        for i, a, b in zip(r.ids, r.starts, r.ends):
            assert table[i] in t[a:b].encode()
            if b - a > 1:
                assert table[i].decode("utf-8", "ignore") in t[a:b]
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(t)
            assert all(x <= y for x, y in zip(r.starts, r.starts[1:]))


def test_empty_table_and_cut_characters(df, spark):
    assert K.encode(df.where("false"), "text", ["doc_id"]).count() == 0
    one = spark.createDataFrame([(1, "你")], "doc_id long, text string")
    ids = K.encode(one, "text", ["doc_id"]).first().ids
    if len(ids) > 1:
        cut = spark.createDataFrame([(ids[:1],), (None,)], "ids array<int>")
        assert [r[0] for r in cut.select(K.decode(F.col("ids"))).collect()] == ["�", None]
