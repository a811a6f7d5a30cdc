"""Row construction, logs, storage, the stream, and every query against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaline.operators import blend, ledger, rows
from thermaline.plans import queries
from thermaline.sources import store
from thermaline.streaming import hourly

DATA = "/root/testdata/sf0.001"
HOURS = "station_id string, ts timestamp, zone_name string, t double, wind double, is_fallback boolean"


def hours(spark, skip=()):
    got = spark.range(72).selectExpr("'s' AS station_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts", "'UTC' AS zone_name", "cast(id AS double) AS t", "cast(id % 5 AS double) AS wind", "id = 20 AS is_fallback")
    return got.where(~F.hour("ts").isin(*skip)) if skip else got


def test_incomplete_days_and_nights_are_left_out(spark):
    assert [(str(r.day), r.tmax, r.tmin) for r in rows.daily_extremes(hours(spark)).orderBy("day").collect()] == [("2024-01-01", 23.0, 0.0), ("2024-01-02", 47.0, 24.0), ("2024-01-03", 71.0, 48.0)]
    assert rows.daily_extremes(hours(spark, (3,))).count() == 0
    assert [str(r.day) for r in rows.night_wind(hours(spark)).collect()] == ["2024-01-02"]  # the first has a fallback, the last is half


def test_tenures(spark):
    e = spark.createDataFrame([("c", 1, "tenure_start", "a", "m1"), ("c", 2, "tenure_end", "a", "m0"), ("d", 3, "tenure_start", "b", "m1"), ("d", 4, "tenure_end", "b", "m1")], "cell string, line int, event string, author string, start_month string")
    assert [r.cell for r in ledger.active_tenures(e).collect()] == ["c"]
    assert {r.cell: r.holder for r in ledger.holder(e).collect()} == {"c": None, "d": None}


def test_streak_stops_at_another_submission(spark):
    c = spark.createDataFrame([("c", "2024-01", 1, "s", "win"), ("c", "2024-02", 2, "r", "win"), ("c", "2024-03", 3, "s", "win"), ("c", "2024-04", 4, "s", "win")], "cell string, cycle string, line int, submission string, result string")
    assert ledger.win_streak(c).first().streak == 2


def test_append_only(spark):
    base = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "line int, text string")
    head = spark.createDataFrame([(0, "a", "x"), (1, "B", "y"), (3, "d", "x"), (4, "e", None), (5, "e", None)], "line int, text string, id string")
    assert {r.line: r.violation for r in ledger.append_only(base, head).collect()} == {1: "edited", 2: "deleted", 3: "duplicate"}


def test_partitions_and_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("b", "era5", "2024-01", 1.0), ("a", "era5", "2024-01", 2.0), ("a", "era5", "2024-02", 3.0), ("a", "lag_fill", "2024-01", 4.0)], "station_id string, band string, month string, v double")
    store.write_partitions(df, path, ["band", "month"], ["station_id"])
    store.write_partitions(df.where("month = '2024-02'").withColumn("v", F.lit(9.0)), path, ["band", "month"], ["station_id"])
    got = store.read_partitions(spark, path, df.schema, "era5")
    assert sorted((r.station_id, r.v) for r in got.collect()) == [("a", 2.0), ("a", 9.0), ("b", 1.0)]
    assert store.read_partitions(spark, path, df.schema, "era5", ["2023-01"]).count() == 0
    with pytest.raises(ValueError):
        store.read_partitions(spark, path, df.schema, "nope")
    claimed = store.manifest(spark, path)
    assert claimed.count() == 3 and store.verify(claimed, store.manifest(spark, path)).count() == 0
    frozen = spark.createDataFrame(claimed.collect(), claimed.schema)
    os.remove(next(Path(path).rglob("band=lag_fill/*/*.parquet")))
    assert [r.violation for r in store.verify(frozen, store.manifest(spark, path)).collect()] == ["missing"]


def test_log_keeps_its_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [(r.line, r.a) for r in store.read_log(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [(0, 1), (2, 2)]


def test_stream(spark, tmp_path):
    hours(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(HOURS).parquet(str(tmp_path / "in"))
    q = hourly.daily_extremes(stream, "1 hour").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [str(r.day) for r in spark.table("days").orderBy("day").collect()] == ["2024-01-01", "2024-01-02"]


def _plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(queries.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(_plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(_plain(x[c]) for c in cols) for x in df.collect()) == want


def test_blend_gate_against_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(z, float(t), 0.0, float(m) if i % 5 else None, float(s) if i % 7 else None, 0.4) for z, n in (("a", 200), ("b", 20), ("c", 120)) for i, (t, m, s) in enumerate(zip(rng.normal(0.1, 1, n), rng.normal(0, 0.3, n), rng.normal(0, 0.3, n)))]
    rows += [("d", 1.0, 0.0, 0.5, 0.75, 0.4)] * 40 + [("", 1.0, 0.0, 1.0, 1.0, 0.4), (None, 1.0, 0.0, 1.0, 1.0, 0.4)]
    frame = spark.createDataFrame(rows, "zone string, truth double, grid double, delta_model double, delta_station double, lam double")
    frame = frame.selectExpr("*", "coalesce((1 - lam) * delta_model + lam * delta_station, delta_station, delta_model) AS delta_blend")
    got = {r.zone: r for r in blend.blend_gate(frame).collect()}
    assert set(got) == set("abcd")
    for z in "ac":
        own = [(t, m, s) for zone, t, _, m, s, _ in rows if zone == z and m is not None and s is not None]
        t, m, s = np.array(own).T
        d = (t - m) ** 2 - (t - (0.6 * m + 0.4 * s)) ** 2
        assert got[z].blend_beats_model == (d.mean() > d.std(ddof=1) / np.sqrt(len(d))) and got[z].n_both == len(d)
    assert got["b"].blend_beats_model is None and got["b"].passes is False
    # Without spread a gain over zero is enough, but a bias without a standard error isn't judged.
    assert got["d"].blend_beats_model and got["d"].station_beats_grid and got["d"].bias_bounded is None and not got["d"].passes


def test_promotions(spark):
    c = spark.createDataFrame([("a", "x", 1, "win", 2), ("b", "x", 1, "win", 1), ("c", "x", 1, "loss", 3), ("d", "x", 1, "win", 2), ("e", "x", 2, "win", 5), ("f", "x", 1, "win", 2)], "cell string, author string, submission int, result string, streak int")
    h = spark.createDataFrame([("d", "y", 9), ("e", "x", 1), ("f", "x", 1)], "cell string, author string, submission int")
    got = {tuple(r) for r in ledger.promotions(c, h).collect()}
    assert got == {("a", "tenure_start", "x", 1), ("d", "tenure_end", "y", 9), ("d", "tenure_start", "x", 1), ("e", "tenure_start", "x", 2)}
