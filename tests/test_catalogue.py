"""Every query with SQL against DuckDB on the smallest tables; the greedy gain against a plain model."""

import math

import duckdb
import pytest

from anvilgrid.functions import text as T
from anvilgrid.operators import citations, runs
from anvilgrid.plans import catalogue, evaluation_queries  # noqa: F401  (the second registers with the first)
from anvilgrid.sources import readers

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    def value(x):
        return "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(value(r[names.index(n)]) for n in sorted(names)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_gain_prefers_what_is_not_covered(spark):
    rows = [(1, 10, 100, 0, [0.9, 0.1], [0.0, 0.0]), (1, 10, 101, 1, [0.8, 0.0], [0.0, 0.0]), (1, 10, 102, 2, [0.0, 0.5], [0.0, 0.0]), (1, 11, 100, 3, [0.9, 0.1], [0.0, 0.0])]
    got = citations.gain_select(spark.createDataFrame(rows, "query_id long, parent_id long, chunk_id long, ord long, target array<double>, coverage array<double>"))
    assert [(r["chunk_id"], round(r["gain"], 6)) for r in got.orderBy("rank").collect()] == [(100, 0.9), (102, 0.4)]


def test_options_and_last_wins(spark):
    df = spark.createDataFrame([("Option 2",), ("option2",), ("Option 0",), ("Option 12.",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.extract_option(df["t"])).collect()] == ["option 2", "option 2", None, "option 12", None, None]
    r = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, None)], "k string, line long, v boolean")
    assert sorted((x["k"], x["v"]) for x in runs.last_wins(r, "k", "line").collect()) == [("a", False), ("b", None)]


@pytest.mark.parametrize("text", ['{"question_id":"q 1","is_correct":true}\n\n{"question_id":"q 2"}', '[{"question_id":"q 1","is_correct":true},{"question_id":"q 2"}]', '{"records":[{"question_id":"q 1","is_correct":true},{"question_id":"q 2"}]}', '{"q 1":{"is_correct":true},"q 2":{}}'])
def test_checkpoint_shapes(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    assert [(r["question_id"], r["is_correct"]) for r in readers.checkpoint(spark, str(tmp_path / "c.json")).orderBy("line").collect()] == [("q 1", True), ("q 2", None)]


def test_facets(spark):
    rows = [('{"facets": ["a [3GPP Release 17] b", "a  b", 7, "c;", "in Release 15", "d of the", "e", "f"]}', "q"), ("no json", "[3GPP Release 17] What?"), ('["a"]', " w "), ('{"facets": "a"}', "q"), (None, "q")]
    df = spark.createDataFrame(rows, "reply string, question string")
    assert [list(r[0]) for r in df.select(T.facets(df["reply"], df["question"])).collect()] == [["a b", "c", "d", "e"], ["What?"], ["w"], ["q"], ["q"]]
