"""Thin and uncovered cells come from all rows."""

from thermaline.operators import score
from thermaline.plans import queries

DATA = "/root/testdata/sf0.001"


def test_thin_zones_over_all_orders(spark):
    got = queries.QUERIES["band_score_fine"](spark, DATA).collect()
    joined = spark.read.parquet(f"{DATA}/orders.parquet").join(spark.read.parquet(f"{DATA}/customer.parquet").selectExpr("c_custkey AS o_custkey"), "o_custkey")
    assert sum(r.n_grid for r in got) == joined.count() and any(r.too_few for r in got) and all(r.rmse_debiased_cv_c is None for r in got)


def test_unapplied_zones_are_uncovered(spark):
    assert {"0", "1", "2", "3", "4"} <= {r.zone for r in queries.QUERIES["uncovered_cells_unapplied"](spark, DATA).collect()}


def test_a_zone_without_applied_rows_has_no_model_score(spark):
    rows = [("tmax", "z", "s", 20.0, 19.0, 0.5, False)] * 3
    got = score.score_band(spark.createDataFrame(rows, "target string, zone string, station_id string, truth double, grid double, delta double, applied boolean"), "salt").first()
    assert (got.n_grid, got.n_applied, got.rmse_grid_c, got.rmse_model_c, got.gain_model) == (3, 0, 1.0, None, None)
