"""Queries whose SQL tells more than the smallest tables show: half of the documents without a vector, ratios on a half."""

import duckdb
import pytest

from anvilgrid.plans import catalogue, evaluation_queries  # noqa: F401  (the second registers with the first)
from test_catalogue import TABLES, plain

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert con.sql("select count(*) from documents where doc_id not in (select vec_id from embeddings)").fetchall()[0][0] > 400
    return con


def same(spark, tables, name):
    want = tables.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, DATA)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["benchmark_run", "benchmark_blocks"])
def test_statistics_count_texts_without_vectors(spark, tables, name):
    same(spark, tables, name)


def test_ratios_of_categories_round_halves_up(spark, tables):
    same(spark, tables, "summary_by_category")
