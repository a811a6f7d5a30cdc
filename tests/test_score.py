"""Scores against constructed residuals and a row-level computation."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaline.functions import expr
from thermaline.operators import gates, score

SCHEMA = "target string, zone string, station_id string, truth double, grid double, delta double, applied boolean"


def constructed(zone, bias, stations, n=240):
    out = []
    for i in range(n):
        raw = 5.0 if i % 2 else -5.0
        out.append(("tmax", zone, f"s{i % stations}", 20 + raw, 20.0, raw - (bias + (0.01 if i % 4 < 2 else -0.01)), True))
    return out


def test_thin_zones_need_a_bounded_bias(spark):
    rows = constructed("a", 0.1, 2) + constructed("b", 0.8, 2) + constructed("c", 0.249, 2) + constructed("d", 0.30, 2) + constructed("e", 0.8, 12) + constructed("f", 0.1, 2, 29) + [("tmax", None, "x", 1.0, 2.0, 0.0, True), ("tmax", "g", None, 1.0, 2.0, 0.5, True)]
    got = {r.zone: r for r in score.score_band(spark.createDataFrame(rows, SCHEMA), "salt").collect()}
    assert {z: got[z].beats_with_margin for z in "abcdef"} == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": None}
    assert got["a"].rmse_grid_c == pytest.approx(5) and got["b"].bias_correction_c is None and got["e"].bias_correction_c == pytest.approx(0.8, abs=0.01)
    assert got["f"].too_few and got["f"].beats_grid is None and None not in got and got["g"].se_bias_c is None


def test_against_rows(spark):
    rng = np.random.default_rng(1)
    rows = [("tmax", "z", f"s{i % 23}", float(t), float(g), float(d), bool(a)) for i, (t, g, d, a) in enumerate(zip(rng.normal(20, 3, 900), rng.normal(19, 3, 900), rng.normal(1, 2, 900), rng.random(900) > 0.2))]
    got = score.score_band(spark.createDataFrame(rows, SCHEMA), "salt").first()
    use = [r for r in rows if r[6]]
    e, d = np.array([r[3] - r[4] for r in use]), np.array([r[5] for r in use])
    k = np.array([int(hashlib.md5(f"salt:{r[2]}".encode()).hexdigest(), 16) % 5 for r in use])
    deb, aff = np.empty(len(e)), np.empty(len(e))
    for f in range(5):
        a, c = np.polyfit(d[k != f], e[k != f], 1)
        deb[k == f], aff[k == f] = (e - d)[k == f] - (e - d)[k != f].mean(), e[k == f] - a * d[k == f] - c
    assert got.rmse_debiased_cv_c == pytest.approx(math.sqrt((deb**2).mean()), rel=1e-9)
    assert got.rmse_affine_cv_c == pytest.approx(math.sqrt((aff**2).mean()), rel=1e-9)


def test_constant_delta_takes_the_least_norm_fit(spark):
    rows = [("tmax", "z", f"s{i % 15}", 20.0 + i % 3, 20.0, 2.0, True) for i in range(90)]
    got = score.score_band(spark.createDataFrame(rows, SCHEMA), "salt").first()
    e = np.array([i % 3 for i in range(90)], float)
    k = np.array([int(hashlib.md5(f"salt:s{i % 15}".encode()).hexdigest(), 16) % 5 for i in range(90)])
    want = np.concatenate([e[k == f] - np.column_stack([np.full((k == f).sum(), 2.0), np.ones((k == f).sum())]) @ np.linalg.lstsq(np.column_stack([np.full((k != f).sum(), 2.0), np.ones((k != f).sum())]), e[k != f], rcond=None)[0] for f in range(5)])
    assert got.rmse_affine_cv_c == pytest.approx(math.sqrt((want**2).mean()), rel=1e-9)


def test_nan_is_never_better(spark):
    rows = [(*r[:5], float("nan"), True) for r in constructed("n", 0.1, 12)]
    got = score.score_band(spark.createDataFrame(rows, SCHEMA), "salt")
    r = got.first()
    assert r.beats_grid is False and r.beats_with_margin is False and gates.build_gate(got).count() == 0


def test_fold_is_the_whole_digest(spark):
    got = spark.range(300).selectExpr("cast(id AS string) AS s").union(spark.sql("SELECT cast(NULL AS string)")).select("s", expr.fold(F.col("s"), "x").alias("k")).collect()
    assert all(r.k == int(hashlib.md5(f"x:{r.s}".encode()).hexdigest(), 16) % 5 for r in got)


def test_regate_cases(spark):
    rows = spark.createDataFrame([("a", "d", "tmax", "z"), ("b", "d", "tmax", "z"), ("c", "d", "tmax", "y"), ("e", "d", "tmax", "z")], "station_id string, date string, target string, zone string")
    p = spark.createDataFrame([("a", "d", "tmax", 1, 9.0, True, []), ("a", "d", "tmax", 2, 1.0, True, []), ("b", "d", "tmax", 1, None, False, ["m"]), ("c", "d", "tmax", 1, 1.0, True, [])], "station_id string, date string, target string, ord int, delta_c double, applied boolean, covariates_missing array<string>")
    gate = spark.createDataFrame([("tmax", "z", True, 0.5, 2.0, 0.25)], "target string, zone string, enabled boolean, bias_correction double, scale double, offset double")
    got = {r.station_id: (r.applied, r.delta_c, r.reason, r.covariates_missing) for r in gates.regate(rows, p, gate).collect()}
    assert got == {"a": (True, 2.25, "applied", []), "b": (False, None, "not_applied", ["m"]), "c": (False, None, "gate_closed", []), "e": (False, None, "no_prediction", [])}


def test_fidelity_drops_what_is_not_finite(spark):
    s = "station_id string, date string, tmax double, tmin double"
    a = spark.createDataFrame([("a", "1", 1.0, 1.0), ("a", "2", float("nan"), 1.0), ("a", "3", 3.0, None)], s)
    assert tuple(score.fidelity(a, spark.createDataFrame([("a", "1", 0.0, 3.0), ("a", "2", 1.0, 1.0), ("a", "3", 1.0, 1.0)], s)).first()) == (1, 1.0, 0.0, -2.0, 0.0)
    assert score.fidelity(a.limit(0), a).first().n == 0


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [1.0] * 300 + [5.0] * 20, "many": rng.exponential(size=5000).tolist(), "some": rng.normal(size=99).tolist(), "more": rng.normal(size=101).tolist()}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in x], "zone string, s double")
    got = {r.zone: (r.n, r.q) for r in score._quantile(df, 0.95).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in groups.items()}
    assert all(abs(got[k][1] - np.quantile(v, 0.95)) < 1e-12 for k, v in groups.items())
    none = spark.createDataFrame([], "zone string, y double, pred double, lo double, hi double")
    assert [tuple(r) for r in score.conformal_q95(none).collect()] == [("_default", 1.0)]
