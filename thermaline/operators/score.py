"""Scores of a correction against station truth, from one pass of moments for each zone and fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, fold, ge, lt

# Fixed values of the verdicts.
MIN_ROWS, MARGIN, BIAS_FLOOR, MIN_STATIONS = 30, 0.03, 0.25, 10
#: Sums of multiples of 1 / STEP are exact in any order, up to 2^53 / STEP.
STEP = 2.0**20


def score_band(rows: DataFrame, salt: str) -> DataFrame:
    """rows: target, zone, station_id, truth, grid, delta, applied. A row for each target and zone.

    Leave-one-fold-out means and fits come from the folds' counts, means, variances and covariances: the rows of a zone
    are read once, and only five small rows of a zone meet. The bias can lie on its bound, so its errors are added up as
    multiples of 1 / STEP and what is left of them: the order of the rows doesn't count.
    """
    e, d = F.col("truth") - F.col("grid"), F.when(F.col("applied"), F.col("delta"))
    base = rows.where("zone IS NOT NULL").select("target", "zone", F.coalesce(F.col("station_id").cast("string"), F.lit("None")).alias("station"), e.alias("all_e"), F.when(F.col("applied"), e).alias("e"), d.alias("d"), (e - d).alias("q"), "applied", fold(F.col("station_id"), salt).alias("k"))
    small = F.abs("q") < 2.0**53 / STEP
    base = base.withColumn("step_q", F.when(small, F.rint(F.col("q") * STEP) / STEP).otherwise(F.col("q"))).withColumn("rest_q", F.when(small, F.col("q") - F.col("step_q")).otherwise(0.0))
    agg = [F.count("*").alias("n_grid"), F.sum(F.col("all_e") * F.col("all_e")).alias("ss_grid"), F.count(F.when(F.col("applied"), 1)).alias("n")]
    sums = [F.sum(c).alias(c) for c in ("step_q", "rest_q")]
    agg += sums + [F.count("q").alias("n_q"), F.try_divide(F.sum("step_q") + F.sum("rest_q"), F.count("q")).alias("m_q")]
    agg += [F.avg(c).alias(f"m_{c}") for c in "ed"] + [(F.var_pop(c) * F.count(c)).alias(f"v_{c}") for c in "edq"] + [(F.covar_pop("d", "e") * F.count("d")).alias("c_de")]
    folds = base.groupBy("target", "zone", "k").agg(*agg, F.countDistinct(F.when(F.col("applied"), F.col("station"))).alias("stations"))
    j = folds.where("n > 0").select("target", "zone", *[F.col(c).alias(f"j_{c}") for c in ("k", "n", "m_e", "m_d", "m_q", "v_d", "c_de")])
    out = folds.join(j, ["target", "zone"], "left")
    other = lambda x: F.sum(F.when(F.col("j_k") != F.col("k"), x))
    keep = [c for c in folds.columns if c not in ("target", "zone", "k")]
    t = out.groupBy("target", "zone", "k").agg(
        *[F.first(c).alias(c) for c in keep], F.coalesce(other(F.col("j_n")), F.lit(0)).alias("t_n"),
        *[F.coalesce(other(F.col("j_n") * F.col(f"j_m_{c}")), F.lit(0.0)).alias(f"t_{c}") for c in "edq"],
        other(F.col("j_v_d") + F.col("j_n") * F.col("j_m_d") * F.col("j_m_d")).alias("t_dd"), other(F.col("j_c_de") + F.col("j_n") * F.col("j_m_d") * F.col("j_m_e")).alias("t_de"),
    )
    for c in "edq":
        t = t.withColumn(f"b_{c}", F.coalesce(F.try_divide(F.col(f"t_{c}"), F.col("t_n")), F.lit(0.0)))
    t = t.withColumns({"slope": _slope("t_dd", "t_de", "t_n", "b_d", "b_e")}).withColumn("offset", F.when(_flat("t_dd", "t_n", "b_d"), F.col("b_e") / (F.col("b_d") * F.col("b_d") + 1)).otherwise(F.col("b_e") - F.col("slope") * F.col("b_d")))
    a, c = F.col("slope"), F.col("offset")
    gap = F.col("m_e") - a * F.col("m_d") - c
    t = t.withColumns({"r_q": F.col("n") * (F.col("m_q") - F.col("b_q")), "rr_q": F.col("v_q") + F.col("n") * F.pow(F.col("m_q") - F.col("b_q"), 2), "r_a": F.col("n") * gap, "rr_a": F.col("v_e") - 2 * a * F.col("c_de") + a * a * F.col("v_d") + F.col("n") * gap * gap})
    z = t.groupBy("target", "zone").agg(
        F.sum("n_grid").alias("n_grid"), F.sum("n").alias("n"), F.sum("stations").alias("stations"), F.sum("ss_grid").alias("ss_grid"), *[F.sum(x).alias(x) for x in ("r_q", "rr_q", "r_a", "rr_a")],
        *[F.sum(F.col("n") * F.col(f"m_{x}")).alias(f"s_{x}") for x in "ed"], *sums, F.sum((F.col("n") - F.col("n_q")) * F.col("m_q")).alias("gap_q"), F.sum(F.col("v_q") + F.col("n") * F.col("m_q") * F.col("m_q")).alias("qq"),
        F.sum(F.col("v_d") + F.col("n") * F.col("m_d") * F.col("m_d")).alias("dd"), F.sum(F.col("c_de") + F.col("n") * F.col("m_d") * F.col("m_e")).alias("de"),
    )
    n = F.col("n")
    z = z.withColumn("s_q", F.col("step_q") + F.col("rest_q") + F.col("gap_q"))
    for x in "edq":
        z = z.withColumn(f"a_{x}", F.try_divide(F.col(f"s_{x}"), n))
    cv = F.col("stations") >= MIN_STATIONS
    root = lambda x: F.sqrt(F.greatest(F.try_divide(x, n), F.lit(0.0)))
    spread = F.greatest(F.col("qq") - n * F.col("a_q") * F.col("a_q"), F.lit(0.0))
    z = z.withColumns({
        "rmse_grid_c": F.sqrt(F.col("ss_grid") / F.col("n_grid")), "rmse_model_c": F.when(n > 0, root(F.col("qq"))), "bias_model_c": F.col("a_q"), "se_bias_c": F.when(n > 1, F.sqrt(spread / (n - 1)) / F.sqrt(n)),
        "rmse_debiased_cv_c": F.when(cv, root(F.col("rr_q"))), "bias_debiased_cv_c": F.when(cv, F.col("r_q") / n), "rmse_affine_cv_c": F.when(cv, root(F.col("rr_a"))), "bias_affine_cv_c": F.when(cv, F.col("r_a") / n), "scale": _slope("dd", "de", "n", "a_d", "a_e"),
    })
    z = z.withColumn("shift", F.when(_flat("dd", "n", "a_d"), F.col("a_e") / (F.col("a_d") * F.col("a_d") + 1)).otherwise(F.col("a_e") - F.col("scale") * F.col("a_d")))
    better = F.coalesce(lt(F.col("rmse_affine_cv_c"), F.col("rmse_debiased_cv_c")), F.lit(False))
    gain = lambda c: F.when(F.col("rmse_grid_c") > 0, (F.col("rmse_grid_c") - F.col(c)) / F.col("rmse_grid_c"))
    z = z.withColumns({"gain_model": gain("rmse_model_c"), "gain_debiased_cv": gain("rmse_debiased_cv_c"), "gain_affine_cv": gain("rmse_affine_cv_c"), "bias_correction_c": F.when(cv, F.col("bias_model_c")), "delta_scale": F.when(better, F.col("scale")), "delta_offset": F.when(better, F.col("shift"))})
    bounded = F.when(F.col("se_bias_c").isNotNull(), ge(3 * F.col("se_bias_c"), F.abs("bias_model_c")) | ge(F.lit(BIAS_FLOOR), F.abs("bias_model_c")))
    enough = n >= MIN_ROWS
    z = z.withColumns({
        "bias_bounded": bounded, "beats_grid": F.when(enough, lt(F.col("rmse_model_c"), F.col("rmse_grid_c"))),
        "beats_with_margin": F.when(enough, F.when(F.col("gain_debiased_cv").isNotNull(), ge(F.col("gain_debiased_cv"), F.lit(MARGIN))).otherwise(F.coalesce(ge(F.col("gain_model"), F.lit(MARGIN)) & bounded, F.lit(False)))),
        "beats_with_margin_affine": F.when(enough & F.col("gain_affine_cv").isNotNull(), ge(F.col("gain_affine_cv"), F.lit(MARGIN))), "too_few": n < MIN_ROWS,
    })
    return z.select("target", "zone", "n_grid", n.alias("n_applied"), *_METRICS, "bias_bounded", "beats_grid", "beats_with_margin", "beats_with_margin_affine", "too_few")


_METRICS = ("rmse_grid_c", "rmse_model_c", "bias_model_c", "se_bias_c", "rmse_debiased_cv_c", "bias_debiased_cv_c", "rmse_affine_cv_c", "bias_affine_cv_c", "gain_model", "gain_debiased_cv", "gain_affine_cv", "bias_correction_c", "delta_scale", "delta_offset")


def _flat(dd: str, n: str, mean: str):
    """No spread of d to fit a slope on."""
    return F.coalesce(F.col(dd), F.lit(0.0)) - F.col(n) * F.col(mean) * F.col(mean) <= 1e-12 * F.greatest(F.coalesce(F.col(dd), F.lit(0.0)), F.lit(1e-12))


def _slope(dd: str, de: str, n: str, md: str, me: str):
    least_norm = F.col(me) * F.col(md) / (F.col(md) * F.col(md) + 1)
    return F.when(_flat(dd, n, md), least_norm).otherwise(F.try_divide(F.col(de) - F.col(n) * F.col(md) * F.col(me), F.col(dd) - F.col(n) * F.col(md) * F.col(md)))


def fidelity(band: DataFrame, reference: DataFrame, order: str = "ord") -> DataFrame:
    """Both: station_id, date, tmax, tmin; the reference also `order`, by which the last of double keys holds. Count, means
    and population deviations."""
    right = reference.groupBy("station_id", "date").agg(F.max_by(F.struct("tmax", "tmin"), order).alias("r"))
    both = band.join(right, ["station_id", "date"]).where(finite(F.col("tmax")) & finite(F.col("tmin")) & finite(F.col("r.tmax")) & finite(F.col("r.tmin")))
    dx, dn = F.col("tmax") - F.col("r.tmax"), F.col("tmin") - F.col("r.tmin")
    return both.agg(F.count("*").alias("n"), F.avg(dx).alias("tmax_mean"), F.stddev_pop(dx).alias("tmax_sd"), F.avg(dn).alias("tmin_mean"), F.stddev_pop(dn).alias("tmin_sd"))


def cv_metrics(oof: DataFrame) -> DataFrame:
    """oof: zone, y, pred, lo, hi. Metrics by zone and over all (zone NULL)."""
    err = F.col("y") - F.col("pred")
    got = oof.rollup("zone").agg(F.grouping("zone").alias("whole"), F.count("*").alias("n"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rmse_grid"), F.sqrt(F.avg(err * err)).alias("rmse_model"), F.avg(err).alias("bias"), F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"))
    return got.withColumn("beats_grid", lt(F.col("rmse_model"), F.col("rmse_grid")))


def _quantile(s: DataFrame, q: float) -> DataFrame:
    """s: zone, s. n and the exact quantile (linear between ranks) of each zone: approximate bounds around it, the number of rows
    below them, and the ranks of the few rows between. Groups of under 100 rows are ranked whole."""
    about = s.groupBy("zone").agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("s").alias("most"), F.percentile_approx("s", F.array(F.lit(q - 0.04), F.lit(min(q + 0.04, 1.0))), F.lit(10_000)).alias("b"))
    about = about.select(F.col("zone").alias("z"), "n", F.when(F.col("n") < 100, F.col("least")).otherwise(F.col("b")[0]).alias("lo"), F.when(F.col("n") < 100, F.col("most")).otherwise(F.col("b")[1]).alias("hi"))
    met = s.join(about, F.col("zone").eqNullSafe(F.col("z"))).select("zone", "s", "n", "lo", "hi")
    below = met.where("s < lo").groupBy("zone").agg(F.count("*").alias("below"))
    near = met.where("s BETWEEN lo AND hi").groupBy("zone", "n", "s").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy("zone").orderBy("s"))  # distinct values of some 8 % of a zone's rows
    ranked = near.withColumn("last", upto).join(F.broadcast(below.select(F.col("zone").alias("z"), "below")), F.col("zone").eqNullSafe(F.col("z")), "left").withColumn("last", F.col("last") + F.coalesce("below", F.lit(0)) - 1)
    at = F.lit(q) * (F.col("n") - 1)
    held = lambda k: F.max(F.when((F.col("last") - F.col("times") < k) & (F.col("last") >= k), F.col("s")))
    got = ranked.groupBy("zone", "n").agg(held(F.floor(at)).alias("a"), held(F.ceil(at)).alias("c"))
    return got.select("zone", "n", (F.col("a") + (at - F.floor(at)) * (F.col("c") - F.col("a"))).alias("q"))


def conformal_q95(oof: DataFrame, min_rows: int = 20) -> DataFrame:
    """Exact 95th percentile of error over half-width, by zone with enough rows, and over all as _default (1 without rows)."""
    half = (F.col("hi") - F.col("lo")) / 2
    s = oof.where(half > 0).select("zone", (F.abs(F.col("y") - F.col("pred")) / half).alias("s")).where("s IS NOT NULL")
    zones = _quantile(s.where("zone IS NOT NULL"), 0.95).where(F.col("n") >= min_rows).select("zone", F.col("q").alias("q95"))
    whole = _quantile(s.withColumn("zone", F.lit("_default")), 0.95).agg(F.coalesce(F.max("q"), F.lit(1.0)).alias("q95"))
    return zones.unionByName(whole.select(F.lit("_default").alias("zone"), "q95"))


def conformal_coverage(oof: DataFrame, q95: DataFrame) -> DataFrame:
    default = q95.where("zone = '_default'").select(F.col("q95").alias("d95"))
    got = oof.join(F.broadcast(q95), "zone", "left").join(F.broadcast(default), how="cross")  # one row
    return got.agg(F.avg((F.abs(F.col("y") - F.col("pred")) <= (F.col("hi") - F.col("lo")) / 2 * F.coalesce("q95", "d95")).cast("double")).alias("coverage"))


def compare_reports(claimed: DataFrame, reproduced: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Both reports long: target, zone, metric, value. Largest deviation of each metric in tolerance (metric, allowed)."""
    c = claimed.where("value IS NOT NULL").join(reproduced.where("value IS NOT NULL").withColumnRenamed("value", "again"), ["target", "zone", "metric"])
    worst = c.groupBy("metric").agg(F.max(F.abs(F.col("value") - F.col("again"))).alias("worst"))
    return tolerance.join(worst, "metric", "left").select("metric", F.coalesce("worst", F.lit(0.0)).alias("worst"), (F.coalesce("worst", F.lit(0.0)) <= F.col("allowed")).alias("ok"))
