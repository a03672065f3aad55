"""Store queries over every row, short and long texts and all ids alike."""

from __future__ import annotations

import hashlib

import pytest

from arborlake.plans import catalog

TEXTS = {1: "a", 2: "short é", 3: "", 7: "word " * 900, 50: "fifty", 97: "x" * 3000, 101: "0123456789abcdef" * 40}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, t, len(t)) for i, t in TEXTS.items()], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return str(path)


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_g6_rehashes_every_document(spark, store):
    assert by_id(catalog.QUERIES["G6_fsck"](spark, store), "ok") == {i: i != 50 for i in TEXTS}


def test_f17_patches_every_document(spark, store):
    assert by_id(catalog.QUERIES["F17_binary_diff"](spark, store), "same") == dict.fromkeys(TEXTS, True)


def test_d4_rebuilds_every_document(spark, store):
    half = lambda t: b"head" + t.encode()[: len(t.encode()) // 2]
    assert by_id(catalog.QUERIES["D4_delta_interpreter"](spark, store), "first") == {i: hashlib.sha256(half(t)).hexdigest() for i, t in TEXTS.items()}


def test_sk17_encodes_every_document(spark, store):
    got = catalog.QUERIES["SK17_archive_stream"](spark, store)
    assert by_id(got, "same") == dict.fromkeys(TEXTS, True)
    assert by_id(got, "size") == {i: len(t.encode()) for i, t in TEXTS.items()}


def test_sc6_loads_every_document(spark, store):
    assert by_id(catalog.QUERIES["SC6_content_load"](spark, store), "text") == TEXTS


def test_sc7_looks_up_what_any_edge_names(spark, tmp_path):
    tables = {
        "lineitem": ([(1, 1, 1), (2, 2, 1)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint"), "orders": ([(1, 5.0), (2, 6.0)], "o_orderkey bigint, o_totalprice double"), "part": ([(1, 11), (2, 12), (3, 13)], "p_partkey bigint, p_size int"),
        "supplier": ([(1, 4)], "s_suppkey bigint, s_nationkey int"), "nation": ([(4, 0)], "n_nationkey int, n_regionkey int"), "region": ([(0,)], "r_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalog.QUERIES["SC7_storage_size"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("f1", 11), ("f2", 12), ("n4", 20), ("r0", 30), ("s1", 10)]
