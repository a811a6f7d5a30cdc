"""Queries on tables larger or odder than the given ones, against their SQL."""

import collections
import math

import duckdb

import __spark_entry__ as entry
from thermaline.operators import score
from thermaline.plans import queries as plans


def differences(spark, path, name: str, **tables: str) -> tuple[list, list]:
    """Rows that a query and its SQL don't share, over tables given as SQL."""
    db = duckdb.connect()
    for table, sql in tables.items():
        db.execute(f"CREATE TABLE {table} AS {sql}")
        db.execute(f"COPY {table} TO '{path}/{table}.parquet' (FORMAT parquet)")
    got = collections.Counter(repr(tuple(r)) for r in entry.queries()[name](spark, str(path)).collect())
    want = collections.Counter(map(repr, db.execute(entry.oracle_sql()[name]).fetchall()))
    assert want
    return sorted((got - want).elements()), sorted((want - got).elements())


def test_active_stations_beyond_the_list(spark, tmp_path):
    assert differences(spark, tmp_path, "active_stations", customer="SELECT range AS c_custkey FROM range(1, 12001)") == ([], [])


def test_gain_over_a_grid_without_error(spark, tmp_path):
    customer = "SELECT * FROM (VALUES (1, 'A'), (2, 'A'), (3, 'B')) AS t(c_custkey, c_mktsegment)"
    # Remainder 5 by 13 is a grid without error; with remainder 3 by 7 the model has an error of 0.06, with 6 of none.
    orders = "SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, 12345.67 * k::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate FROM (VALUES (31, 1), (83, 2), (84, 3)) AS t(k, c)"
    assert differences(spark, tmp_path, "band_score_fine", customer=customer, orders=orders) == ([], [])
    gains = {r.zone: r.gain_model for r in entry.queries()["band_score_fine"](spark, str(tmp_path)).collect()}
    assert gains["1"] == float("-inf") and math.isnan(gains["2"]) and abs(gains["3"]) < 10


def test_index_holds_every_training_row(spark, tmp_path):
    # More than 20,000 training rows; the few queries lie between the last of them.
    customer = "SELECT 2 * range AS c_custkey, 0.5 * range AS c_acctbal, range % 25 AS c_nationkey FROM range(1, 24001) UNION ALL SELECT 2 * range + 1, 0.5 * range + 0.125, range % 25 FROM range(23000, 23100)"
    assert differences(spark, tmp_path, "aoa_index", customer=customer) == ([], [])


def test_bias_on_its_bound(spark, tmp_path):
    # The mean of the four applied rows is 0.25 but for rounding: only the SQL's own doubles give its verdict.
    customer = "SELECT 1::BIGINT AS c_custkey, 'A' AS c_mktsegment"
    orders = "SELECT k::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, p::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate FROM (VALUES (40000002801, 195892.98), (40000004857, 122951.93), (40000051714, 87685.66), (40000085983, 373660.83), (40000099410, 52197.7), (40000117423, 318975.73)) AS t(k, p)"
    assert differences(spark, tmp_path, "band_score_fine", customer=customer, orders=orders) == ([], [])


def test_rounding_as_the_sql(spark):
    values = [0.10906249999999999, -0.10906249999999999, 0.1109375, 5e-7, 4.9e-7, -1e-9, 123456.7890125, 1e300, float("-inf"), float("nan"), None]
    got = [r.v for r in plans._round_scaled(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")).collect()]
    assert repr(got) == repr([duckdb.execute("SELECT round(?::DOUBLE, 6) + 0", [v]).fetchone()[0] for v in values])


def test_bias_in_any_order(spark):
    rows = [("t", "z", "s", float(v), 0.0, 0.0, True) for v in [0.1] * 10 + [0.3, 1e3, 0.7, -1e3]]
    columns = "target string, zone string, station_id string, truth double, grid double, delta double, applied boolean"
    got = {score.score_band(spark.createDataFrame(r, columns).coalesce(1), "salt").first().bias_model_c for r in (rows, rows[::-1], rows[7:] + rows[:7])}
    assert got == {math.fsum(r[3] for r in rows) / len(rows)}
