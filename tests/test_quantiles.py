from pyspark.sql import functions as F

from thermaline.functions import expr
from thermaline.operators import gates, quantiles, rows


def test_quantiles_are_ordered_and_crossings_counted(spark):
    df = spark.createDataFrame([("a", 3, 1, 2), ("a", 1, 2, 3), ("a", 1, None, 0), ("b", None, None, None)], "zone string, lo int, mid int, hi int")
    assert [tuple(r)[1:] for r in quantiles.monotone(df).collect()] == [(1, 2, 3), (1, 2, 3), (0, 1, None), (None, None, None)]
    assert [tuple(r) for r in quantiles.crossing_rate(df).collect()] == [("a", 2, 0.5)]


def test_weights_are_uniform_without_a_positive_sum(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r.w for r in df.select(quantiles.importance_weights(F.col("v")).alias("w")).collect()] == [[0.25, 0.75], [0.5, 0.5]]


def test_best_variant_takes_only_passing_ones(spark):
    df = spark.createDataFrame([("a", "x", 1.0, False), ("a", "y", 2.0, True), ("a", "w", 2.0, True), ("b", "x", 1.0, None)], "zone string, variant string, rmse double, passes boolean")
    assert {r.zone: (r.variant, r.rmse) for r in quantiles.best_variant(df).collect()} == {"a": ("w", 2.0), "b": (None, None)}


def test_density_and_ids(spark):
    s = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "station_id int, name string")
    a = spark.createDataFrame([("p", 10.0, 4.0), ("q", 10.0, 0.0)], "name string, population double, area_km2 double")
    assert {r.station_id: r.density for r in rows.density(s, a).collect()} == {1: 2.5, 2: None, 3: None}
    month, sequence = expr.split_id(F.col("name"))
    t = spark.createDataFrame([("2026-07-001", "B"), ("2026-7-1", "x")], "name string, g string")
    assert [tuple(r) for r in t.select(month, sequence, expr.group_ordinal(F.col("g"))).collect()] == [("2026-07", 1, 1), (None, None, None)]


def test_cell_status(spark):
    cells = [("tmin", "a", True, None), ("tmin", "b", False, True), ("tmin", "c", False, False), ("tmin", "d", False, None), ("tmin", "e", True, True)]
    df = spark.createDataFrame([(t, z, few, beats, 1, 1.0, 1.0, None, None) for t, z, few, beats in cells], "target string, zone string, too_few boolean, beats_with_margin boolean, n_grid long, rmse_grid_c double, rmse_model_c double, rmse_debiased_cv_c double, bias_correction_c double")
    assert [r.status for r in gates.cell_status(df).orderBy("zone").collect()] == ["insufficient_n", "win", "loss", "loss", "insufficient_n"]
