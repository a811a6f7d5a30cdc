"""Models against plain ones, and neighbours against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaline.operators import blend, rows, train


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    return x, 2 * x[:, 0] + np.where(x[:, 1] > 0, 1.5, -1.5) + 0.1 * rng.normal(size=n)


def test_forest_learns_and_its_quantiles_cover():
    x, y = data()
    forest = train.Forest(x[:300], y[:300], trees=40)
    q = forest.predict(x[300:])
    assert (q[:, 0] <= q[:, 1]).all() and (q[:, 1] <= q[:, 2]).all()
    assert np.sqrt(np.mean((q[:, 1] - y[300:]) ** 2)) < 0.6 * y[300:].std()
    assert np.mean((y[300:] >= q[:, 0]) & (y[300:] <= q[:, 2])) > 0.85
    share = forest.importances()
    assert share.sum() == pytest.approx(1) and share[:2].sum() > 0.8
    flat = train.Forest(x[:50], np.ones(50), trees=3)
    assert flat.importances().tolist() == [0.25] * 4 and (flat.predict(x[:5]) == 1).all()


def test_a_tree_splits_where_the_error_falls_most():
    x = np.array([[0.0], [1.0], [2.0], [3.0], [4.0], [5.0]])
    y = np.array([0.0, 0, 0, 9, 9, 9])
    tree = train.Tree(train.Binned(x)(x), y, np.arange(6), np.random.default_rng(0), 1, 1, 1)
    leaves = tree.leaves(train.Binned(x)(x))
    assert len(set(leaves[:3])) == 1 and len(set(leaves[3:])) == 1 and leaves[0] != leaves[5]


def test_boosting_beats_the_constant_quantile():
    x, y = data(600)
    loss = lambda p, q: np.mean(np.maximum(q * (y[400:] - p), (q - 1) * (y[400:] - p)))
    for q in train.QUANTILES:
        got = train.boosted(x[:400], y[:400], x[400:], q, 0.1, 80, 10)
        assert loss(got, q) < 0.7 * loss(np.full(200, np.quantile(y[:400], q)), q)


def test_kriging_is_exact_at_its_points_and_fails_without_structure():
    rng = np.random.default_rng(2)
    place = rng.uniform(0, 10, (80, 2))
    value = np.sin(place[:, 0]) + np.cos(place[:, 1])
    nugget, sill, reach = train.fit_variogram(place, value)
    assert sill > 0 and reach > 0
    if nugget < 1e-9:
        assert train.krige(place, value, place[:5]) == pytest.approx(value[:5], abs=1e-6)
    at = rng.uniform(1, 9, (40, 2))
    assert np.abs(train.krige(place, value, at) - np.sin(at[:, 0]) - np.cos(at[:, 1])).mean() < 0.35
    with pytest.raises(ValueError):
        train.fit_variogram(place, np.ones(80))


def test_folds_predict_every_row_once_and_skip_small_ones(spark):
    rng = random.Random(3)
    rows_ = [(i, f"r{i % 4}" if i < 240 else "only", float(rng.randrange(50)), float(rng.randrange(50)), [rng.random(), rng.random()], rng.random()) for i in range(250)]
    df = spark.createDataFrame(rows_, "id long, region string, lon double, lat double, x array<double>, y double")
    got = train.forest_cv(df, trees=3).collect()
    assert sorted(r.id for r in got) == list(range(250)) and all(r.lo <= r.mid <= r.hi and r.distance >= 0 for r in got)
    assert sorted(r.id for r in train.kriging_cv(df).collect()) == list(range(250))
    assert train.forest_cv(df, trees=2, least=10**6).count() == 0
    two = train.forest_cv(df, train.combos(2)[:2], trees=2)
    assert two.groupBy("combo").count().count() == 2 and len(train.combos(2)) == 60 and train.combo_id(train.combos(1)[0]) == "leaf5_featsqrt_depthNone"
    trained = train.train(df.withColumn("zone", F.lit("Cfb")), "tmax", trees=2)
    assert trained["metrics"].count() == 2 and trained["q95"].where("zone = '_default'").count() == 1 and trained["oof"].where("pred_kriging IS NULL").count() == 0


def test_columns_have_to_be_in_order():
    train.check_features(list(train.FEATURES))
    with pytest.raises(ValueError):
        train.check_features(train.FEATURES[::-1])


def test_neighbours_at_the_poles_and_the_date_line(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), rng.uniform(-90, -86)]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 182), 180.0, -180.0])) for i in range(250)]
    df = spark.createDataFrame([(i, "d", la, lo, 1.0, 0.0) for i, la, lo in points], "id long, day string, lat double, lon double, anomaly double, elevation double")

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(h, 1)))

    for radius in (50.0, 400.0, 3000.0):
        want = {(a[0], b[0]) for a in points for b in points if a[0] != b[0] and km(a, b) <= radius}
        got = [(r.id, r.other) for r in blend.neighbours(df, radius).select("id", "other").collect()]
        assert set(got) == want and len(got) == len(want)


def test_streams_of_values_without_spread(spark):
    r = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "id long, a double, b double")
    moments = rows.column_moments(r, ["a", "b"])
    assert [x.x for x in blend.standardised(r, moments, ["a", "b"]).orderBy("id").collect()] == [[0.0, -1.0], [0.0, 1.0]]


def test_fetched_days_and_updates(spark):
    days = spark.createDataFrame([("s", "2020-01-01", 5.0, None)], "station_id string, date string, tmax double, tmin double")
    assert rows.merge_chunks(days.withColumn("chunk", F.lit(1)), "chunk").count() == 1
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sorted(tuple(r) for r in rows.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_a_bundle_comes_back_and_predicts(spark):
    from thermaline.operators.quantiles import monotone
    from thermaline.sources import models, store

    x, y = data(200)
    forest = train.Forest(x, y, trees=5)
    bundle = models.Bundle("m1", {"tmax": forest}, {"tmax": x}, 0.5, [("tmax", "Cfb", True)], [("tmax", "_default", 1.0)])
    path = store.scratch(spark)
    models.save(spark, bundle, path)
    again = models.load(spark, path)
    rows_ = spark.createDataFrame([(i, v, i != 3) for i, v in enumerate(x[:10].tolist())], "id long, x array<double>, complete boolean")
    got = monotone(models.raw_predictions(rows_, again, "tmax")).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2, 4, 5, 6, 7, 8, 9] and all(r.distance == 0 for r in got)
    assert [r.mid for r in got] == forest.predict(x[[0, 1, 2, 4, 5, 6, 7, 8, 9]])[:, 1].tolist()
    assert models.gate_of(spark, again).first().passes and models.q95_of(spark, again).first().q95 == 1.0
    models.save(spark, models.Bundle("m2", {}, {}, None, [], [], features=("a",)), path)
    with pytest.raises(ValueError):
        models.load(spark, path)


def test_sweeps_score_both_targets(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "tmax" if i % 2 else "tmin", "Cfb", f"r{i % 3}", 0.0, 0.0, [rng.random(), rng.random()], rng.random()) for i in range(300)], "id long, target string, zone string, region string, lon double, lat double, x array<double>, y double")
    got = train.sweep(df, 1, limit=2, trees=2).collect()
    assert {(r.combo, r.target, r.whole) for r in got} == {(f"leaf{n}_featsqrt_depthNone", t, w) for n in (5, 20) for t in ("tmax", "tmin") for w in (True, False)}
    assert all(r.n == 150 for r in got)
