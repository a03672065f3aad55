"""Every store query with an oracle returns the oracle's rows on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from arborlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(plain(v) for v in r) for r in want.fetchall())


def test_every_query_without_oracle_is_named():
    # Hashes that the oracle lacks, a folder listing, a sequential packing, and two chunkings: plain code tests them.
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"F13_crc32", "F14_siphash", "SC10_folder_import", "W11_part_packing", "W12_content_chunks", "J5_chunk_join"}
