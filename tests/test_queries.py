"""Every registered query of the graph engine gives the rows of its SQL."""

from __future__ import annotations

import pytest
from oracle import connection, of_spark, of_sql

import __spark_entry__ as entry
from medloom.plans import queries as graph


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(graph.ORACLES))
def test_query_matches_sql(spark, small, con, name):
    got = of_spark(graph.QUERIES[name](spark, small))
    assert got == of_sql(con, graph.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(graph.QUERIES) - set(graph.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert graph.QUERIES[name](spark, small).columns


def test_entry_gives_findings(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient", "a", "b", "mid", "mechanism", "score", "confidence"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunks_keep_order_and_size(spark, small):
    rows = graph.chunk_packing(spark, small).collect()
    sizes = {(r.conv_id, r.turn): len(r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    expected = {}
    for conv, turn in sorted(sizes):
        chunk, used = expected.get(conv, (0, 0))[:2] if conv in expected else (0, 0)
        n = sizes[conv, turn]
        if used and used + n > 1500:
            chunk, used = chunk + 1, 0
        expected[conv] = (chunk, used + n)
        expected[conv, turn] = chunk
    assert {(r.conv_id, r.turn): r.chunk for r in rows} == {k: v for k, v in expected.items() if isinstance(k, tuple)}
