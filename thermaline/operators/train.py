"""Training rows, cross-validation over regions, and the live model.

Models are numpy code inside applyInPandas, one task for each fold (and quantile or combination). A fold's task holds its
training rows, so these are bounded: at most `cap` rows of all regions train, those of least seeded hash (a parameter);
every row is predicted.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import confidence, doy_trig, finite, log_population

# The model's columns in order, quantiles, and bounds.
FEATURES = (
    "grid_daily_value_c", "lst_warm_season_anomaly_c", "canopy_height_mean_m", "canopy_frac_over_3m", "wc_built_frac", "wc_tree_frac", "wc_water_frac", "ghsl_urban_fraction", "log1p_pop_density", "elevation_rel_to_gridcell_m",
    "koppen_main_group_code", "elevation_mean_m", "slope_deg", "aspect_sin", "aspect_cos", "grid_diurnal_range_c", "doy_sin", "doy_cos", "latitude", "grid_specific_humidity_kgkg", "nighttime_wind_ms",
)
QUANTILES = (0.025, 0.5, 0.975)
MIN_TRAIN, VARIOGRAM_ROWS, CLOSEST, SEED = 50, 3_000, 30, 20260718
CAP = 200_000
GRIDS = {
    1: {"min_samples_leaf": (5, 20, 50, 100, 200), "max_features": ("sqrt",), "max_depth": (None,)},
    2: {"min_samples_leaf": (5, 20, 50, 100, 200), "max_features": ("sqrt", "0.33", "0.5", "1.0"), "max_depth": (None, 10, 20)},
}
BOOSTED = [(rate, n, least) for rate, n in ((0.10, 500), (0.05, 1000), (0.02, 2500)) for least in (50, 200)]


def check_features(order) -> None:
    """An error unless a model's columns are these in this order: they are used by position."""
    if tuple(order) != FEATURES:
        raise ValueError(f"the model's columns {tuple(order)} aren't {FEATURES}")


def matrix(rows: DataFrame, target: str) -> DataFrame:
    """rows with x (the 21 features in order; zeros for an incomplete row), missing (names that are null) and complete.
    Nothing is imputed, and NaN counts as present."""
    s, c = doy_trig(F.col("date"))
    made = {
        "grid_daily_value_c": F.col(f"grid_{target}_c"), "log1p_pop_density": log_population(F.col("pop_density_per_km2")), "aspect_sin": F.sin(F.radians("aspect_deg")), "aspect_cos": F.cos(F.radians("aspect_deg")),
        "grid_diurnal_range_c": F.col("grid_tmax_c") - F.col("grid_tmin_c"), "doy_sin": s, "doy_cos": c, "latitude": F.col("lat"),
    }
    values = [made.get(f, F.col(f) if f not in made else None).cast("double") for f in FEATURES]
    got = rows.withColumn("missing", F.array_compact(F.array(*[F.when(v.isNull(), F.lit(f)) for f, v in zip(FEATURES, values, strict=True)])))
    got = got.withColumn("complete", F.size("missing") == 0)
    return got.withColumn("x", F.when(F.col("complete"), F.array(*values)).otherwise(F.array(*[F.lit(0.0)] * len(FEATURES))))


TRAINING = ("station_id", "date", "lon", "lat", "region", "climate_zone", "station_tmax_c", "station_tmin_c", "grid_tmax_c", "grid_tmin_c", "delta_tmax_c", "delta_tmin_c", "koppen_main_group_code", "grid_specific_humidity_kgkg", "nighttime_wind_ms", "lst_warm_season_anomaly_c", "canopy_height_mean_m", "canopy_frac_over_3m", "wc_built_frac", "wc_tree_frac", "wc_water_frac", "ghsl_urban_fraction", "pop_density_per_km2", "elevation_rel_to_gridcell_m", "elevation_mean_m", "slope_deg", "aspect_deg")


def training_rows(table: DataFrame) -> DataFrame:
    """The columns that training reads, of rows with a region, a zone, and both grid values and deltas."""
    needed = ("region", "climate_zone", "grid_tmax_c", "grid_tmin_c", "delta_tmax_c", "delta_tmin_c")
    return table.select(*TRAINING).where(" AND ".join(f"{c} IS NOT NULL" for c in needed))  # NaN isn't null


def validation_rows(table: DataFrame, zones: list[str] | None = None, sample: int | None = None, seed: int = SEED) -> DataFrame:
    """Rows with station and grid values, of some zones or all, and of these a seeded random sample or all."""
    got = table.where("station_tmax_c IS NOT NULL AND station_tmin_c IS NOT NULL AND grid_tmax_c IS NOT NULL AND grid_tmin_c IS NOT NULL")
    got = got.where(F.col("climate_zone").isin(zones)) if zones else got
    return seeded_sample(got, ["station_id", "date"], sample, seed) if sample else got


def seeded_sample(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for one seed: those of least hash of seed and key."""
    return rows.withColumn("_at", F.xxhash64(F.lit(seed), *key)).orderBy("_at", *key).limit(n).drop("_at")


def training_matrix(rows: DataFrame, target: str) -> DataFrame:
    """id columns, x and y of rows that are complete and whose delta is finite."""
    y = F.col(f"delta_{target}_c")
    got = matrix(rows, target).where(F.col("complete") & finite(y))
    return got.select("station_id", "date", F.lit(target).alias("target"), "region", F.col("climate_zone").alias("zone"), "lon", "lat", "x", y.alias("y"))


def drop_counts(rows: DataFrame, target: str) -> DataFrame:
    """How many rows there are, and how many training drops."""
    kept = F.col("complete") & finite(F.col(f"delta_{target}_c"))
    return matrix(rows, target).agg(F.count("*").alias("n"), F.count(F.when(~kept, 1)).alias("dropped"))


class Tree:
    """A regression tree on binned features, grown by greatest fall of squared error; leaves keep the training rows."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, rows: np.ndarray, rng, leaf: int, features: int, depth: int | None):
        self.feature, self.cut, self.left, self.right, self.rows, self.gain = [], [], [], [], [], np.zeros(bins.shape[1])
        todo = [(rows, 0, -1, 0)]
        while todo:
            own, level, parent, side = todo.pop()
            node = len(self.feature)
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            for x, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.rows, own)):
                x.append(v)
            if len(own) < 2 * leaf or (depth is not None and level >= depth):
                continue
            best = (1e-12, -1, 0)
            total, n = y[own].sum(), len(own)
            for f in rng.choice(bins.shape[1], features, replace=False):
                b = bins[own, f]
                count, part = np.bincount(b, minlength=64).cumsum()[:-1], np.bincount(b, y[own], minlength=64).cumsum()[:-1]
                ok = np.flatnonzero((count >= leaf) & (n - count >= leaf))
                if len(ok):
                    gain = part[ok] ** 2 / count[ok] + (total - part[ok]) ** 2 / (n - count[ok]) - total**2 / n
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), int(f), int(ok[k])))
            if best[1] >= 0:
                self.feature[node], self.cut[node], self.rows[node] = best[1], best[2], None
                self.gain[best[1]] += best[0]
                low = bins[own, best[1]] <= best[2]
                todo += [(own[low], level + 1, node, 0), (own[~low], level + 1, node, 1)]
        self.feature, self.cut, self.left, self.right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while (go := self.feature[at] >= 0).any():
            i = np.flatnonzero(go)
            low = bins[i, self.feature[at[i]]] <= self.cut[at[i]]
            at[i] = np.where(low, self.left[at[i]], self.right[at[i]])
        return at


class Binned:
    """Features cut at 63 quantiles of the training rows."""

    def __init__(self, x: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 64)[1:-1])) for c in x.T]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)]).astype(np.int64)


class Forest:
    """A quantile regression forest: a quantile is taken over training rows, weighted by the share of the leaves they meet."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 300, leaf: int = 5, features: str = "sqrt", depth: int | None = None, seed: int = SEED):
        rng, p = np.random.default_rng(seed), x.shape[1]
        self.bin, self.y = Binned(x), y
        bins, k = self.bin(x), max(1, int(np.sqrt(p)) if features == "sqrt" else round(float(features) * p))
        self.trees = [Tree(bins, y, rng.integers(0, len(y), len(y)), rng, leaf, k, depth) for _ in range(trees)]
        self.order = np.argsort(y, kind="stable")

    def importances(self) -> np.ndarray:
        """Shares of the fall in squared error; equal ones where nothing fell."""
        gain = sum(t.gain for t in self.trees)
        return gain / gain.sum() if gain.sum() > 0 else np.full(len(gain), 1 / len(gain))

    def predict(self, x: np.ndarray, quantiles=QUANTILES) -> np.ndarray:
        bins, out = self.bin(x), np.zeros((len(x), len(quantiles)))
        leaves = [t.leaves(bins) for t in self.trees]
        for i in range(len(x)):
            weight = np.zeros(len(self.y))
            for t, at in zip(self.trees, leaves, strict=True):
                own = t.rows[at[i]]
                np.add.at(weight, own, 1 / len(own))
            w = weight[self.order].cumsum()
            out[i] = self.y[self.order[np.searchsorted(w, np.array(quantiles) * w[-1], "left").clip(max=len(w) - 1)]]
        return out


def boosted(x: np.ndarray, y: np.ndarray, at: np.ndarray, quantile: float, rate: float, rounds: int, leaf: int, depth: int = 5, seed: int = SEED) -> np.ndarray:
    """Predictions at `at` of gradient boosting on the pinball loss: trees on its slope, leaves moved by their quantile of
    what is left; half of the rows and a quarter of the features a round."""
    rng, bin_ = np.random.default_rng(seed), Binned(x)
    train, test = bin_(x), bin_(at)
    now, out = np.full(len(y), np.quantile(y, quantile)), np.full(len(at), np.quantile(y, quantile))
    k = max(1, round(0.25 * x.shape[1]))
    for _ in range(rounds):
        slope = np.where(y > now, quantile, quantile - 1.0)
        tree = Tree(train, slope, rng.permutation(len(y))[: max(2, len(y) // 2)], rng, leaf, k, depth)
        value = np.array([0.0 if own is None or not len(own) else np.quantile(y[own] - now[own], quantile) for own in tree.rows])
        now = now + rate * value[tree.leaves(train)]
        out = out + rate * value[tree.leaves(test)]
    return out


def spherical(h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """A variogram that is 0 at 0 and flat beyond its reach."""
    r = np.minimum(h / reach, 1.0)
    return np.where(h > 0, nugget + sill * (1.5 * r - 0.5 * r**3), 0.0)


def fit_variogram(place: np.ndarray, value: np.ndarray) -> tuple[float, float, float]:
    """Nugget, partial sill and reach of least squares on six lags; an error where there is no spread to fit."""
    i, j = np.triu_indices(len(value), 1)
    h, g = np.hypot(*(place[i] - place[j]).T), 0.5 * (value[i] - value[j]) ** 2
    lag = np.minimum((h / (h.max() or 1) * 6).astype(int), 5)
    n = np.bincount(lag, minlength=6)
    used = n > 0
    hs, gs = np.bincount(lag, h, 6)[used] / n[used], np.bincount(lag, g, 6)[used] / n[used]
    if len(hs) < 3 or gs.max() <= 1e-12:
        raise ValueError("no spatial structure")
    fits = []
    for reach in np.linspace(hs.min(), h.max(), 40)[1:]:
        shape = np.column_stack([np.ones(len(hs)), spherical(hs, 0.0, 1.0, reach)])
        c = np.maximum(np.linalg.lstsq(shape, gs, rcond=None)[0], 0.0)
        fits.append((float(((shape @ c - gs) ** 2).sum()), float(c[0]), float(c[1]), float(reach)))
    return min(fits)[1:]


def krige(place: np.ndarray, value: np.ndarray, at: np.ndarray, closest: int = CLOSEST) -> np.ndarray:
    """Ordinary kriging from the closest points."""
    model = fit_variogram(place, value)
    k, out = min(closest, len(value)), np.zeros(len(at))
    for i, p in enumerate(at):
        h = np.hypot(*(place - p).T)
        near = np.argpartition(h, k - 1)[:k]
        a = np.ones((k + 1, k + 1))
        a[:k, :k] = spherical(np.hypot(*(place[near][:, None] - place[near][None]).transpose(2, 0, 1)), *model)
        a[k, k] = 0
        out[i] = np.linalg.lstsq(a, np.append(spherical(h[near], *model), 1.0), rcond=None)[0][:k] @ value[near]
    return out


def distances_to(x: np.ndarray, train: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least weighted z-scored distance of each row to the training rows."""
    mean, std = train.mean(axis=0), train.std(axis=0)
    scale = np.sqrt(weights) / np.where(std > 0, std, 1.0)
    a, b = (x - mean) * scale, (train - mean) * scale
    out = np.empty(len(a))
    for i in range(0, len(a), 256):
        best = np.full(len(a[i : i + 256]), np.inf)
        for j in range(0, len(b), 1024):
            best = np.minimum(best, ((a[i : i + 256, None] - b[None, j : j + 1024]) ** 2).sum(axis=2).min(axis=1))
        out[i : i + 256] = np.sqrt(best)
    return out


def _folds(rows: DataFrame, tasks: DataFrame, cap: int, seed: int) -> DataFrame:
    """rows (id, region, lon, lat, x, y) for each of tasks (fold and parameters): those of the fold's region to be predicted,
    and of the others those that train."""
    regions = rows.select(F.col("region").alias("fold")).distinct()
    sampled = seeded_sample(rows, ["id"], cap, seed).select("id", F.lit(True).alias("trains"))
    marked = rows.join(sampled, "id", "left").withColumn("trains", F.coalesce("trains", F.lit(False)))
    each = regions.join(F.broadcast(tasks), how="cross")  # folds by combinations, some hundred rows
    met = marked.join(F.broadcast(each), (F.col("region") == F.col("fold")) | F.col("trains"))
    return met.withColumn("held", F.col("region") == F.col("fold"))


def _arrays(part: pd.DataFrame):
    return np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(float)


def _none(*columns: str) -> pd.DataFrame:
    """No rows."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _one(spark) -> DataFrame:
    return spark.createDataFrame([("all",)], "combo string")


def forest_cv(rows: DataFrame, combos: list[dict] | None = None, trees: int = 300, cap: int = CAP, least: int = MIN_TRAIN) -> DataFrame:
    """rows: id, region, lon, lat, x, y. Out-of-fold lo, mid, hi and distance (to the training rows) of each row, by
    combination; folds with fewer than `least` training rows give none."""
    chosen = {combo_id(c): c for c in combos or [{"min_samples_leaf": 5, "max_features": "sqrt", "max_depth": None}]}

    def fit(key, part: pd.DataFrame) -> pd.DataFrame:
        test, train = part[part["held"]], part[~part["held"]]
        if len(train) < least or not len(test):
            return _none("combo", "id", "lo", "mid", "hi", "distance")
        train = train.sort_values("id")
        c, (x, y), (at, _) = chosen[key[0]], _arrays(train), _arrays(test)
        forest = Forest(x, y, trees, c["min_samples_leaf"], c["max_features"], c["max_depth"])
        q = forest.predict(at)
        return pd.DataFrame({"combo": key[0], "id": test["id"].to_numpy(), "lo": q[:, 0], "mid": q[:, 1], "hi": q[:, 2], "distance": distances_to(at, x, forest.importances())})

    tasks = rows.sparkSession.createDataFrame([(k,) for k in chosen], "combo string")
    return _folds(rows, tasks, cap, SEED).groupBy("combo", "fold").applyInPandas(fit, "combo string, id long, lo double, mid double, hi double, distance double")


def kriging_cv(rows: DataFrame, cap: int = CAP, least: int = MIN_TRAIN, points: int = VARIOGRAM_ROWS) -> DataFrame:
    """Out-of-fold id, pred and kriged: a linear trend, and the training residuals kriged from a seeded sample of `points`;
    where that fails the trend alone, and kriged is false."""

    def fit(key, part: pd.DataFrame) -> pd.DataFrame:
        test, train = part[part["held"]], part[~part["held"]].sort_values("id")
        if len(train) < least or not len(test):
            return _none("id", "pred", "kriged")
        (x, y), (at, _) = _arrays(train), _arrays(test)
        one = lambda m: np.column_stack([np.ones(len(m)), m])
        trend = np.linalg.lstsq(one(x), y, rcond=None)[0]
        left = y - one(x) @ trend
        place = train[["lon", "lat"]].to_numpy(float)
        some = np.random.default_rng(SEED).permutation(len(left))[:points] if len(left) > points else np.arange(len(left))
        try:
            extra, ok = krige(place[some], left[some], test[["lon", "lat"]].to_numpy(float)), True
        except (ValueError, np.linalg.LinAlgError):
            extra, ok = np.zeros(len(test)), False
        return pd.DataFrame({"id": test["id"].to_numpy(), "pred": one(at) @ trend + extra, "kriged": ok})

    return _folds(rows, _one(rows.sparkSession), cap, SEED).groupBy("fold").applyInPandas(fit, "id long, pred double, kriged boolean")


def boosted_cv(rows: DataFrame, rate: float, rounds: int, leaf: int, cap: int = CAP, least: int = MIN_TRAIN) -> DataFrame:
    """Out-of-fold id, lo, mid, hi, each fold and quantile a task of its own; only folds with all quantiles count. The
    quantiles aren't in order yet (quantiles.monotone), so that their crossing can be seen."""

    def fit(key, part: pd.DataFrame) -> pd.DataFrame:
        test, train = part[part["held"]], part[~part["held"]].sort_values("id")
        if len(train) < least or not len(test):
            return _none("fold", "quantile", "id", "v")
        (x, y), (at, _) = _arrays(train), _arrays(test)
        return pd.DataFrame({"fold": key[1], "quantile": key[0], "id": test["id"].to_numpy(), "v": boosted(x, y, at, key[0], rate, rounds, leaf)})

    tasks = rows.sparkSession.createDataFrame([(q,) for q in QUANTILES], "quantile double")  # folds by quantiles
    got = _folds(rows, tasks, cap, SEED).groupBy("quantile", "fold").applyInPandas(fit, "fold string, quantile double, id long, v double")
    pick = lambda q: F.max(F.when(F.col("quantile") == q, F.col("v")))
    wide = got.groupBy("fold", "id").agg(F.countDistinct("quantile").alias("n"), *[pick(q).alias(c) for c, q in zip(("lo", "mid", "hi"), QUANTILES, strict=True)])
    return wide.where(F.col("n") == len(QUANTILES)).select("id", "lo", "mid", "hi")


def combos(stage: int) -> list[dict]:
    grid = GRIDS[stage]
    return [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]


def combo_id(c: dict) -> str:
    return f"leaf{c['min_samples_leaf']}_feat{c['max_features']}_depth{c['max_depth']}"


def tasks(spark, stage: int, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """targets: target, region. Combination by target and region, one row a fit; limit keeps the first combinations."""
    ids = spark.createDataFrame([(i, combo_id(c)) for i, c in enumerate(combos(stage)[:limit])], "number int, combo string")
    return targets.distinct().join(F.broadcast(ids), how="cross")  # some hundred rows by at most 60


def sweep_metrics(oof: DataFrame) -> DataFrame:
    """oof: combo, target, zone, y, mid, lo, hi. Metrics of each combination and target by zone, and over all (zone null)."""
    e = F.col("y") - F.col("mid")
    groups = oof.select("combo", "target", F.explode(F.array(F.struct(F.lit(False).alias("whole"), F.col("zone").alias("zone")), F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("zone")))).alias("g"), "y", e.alias("e"), F.col("y").between(F.col("lo"), F.col("hi")).cast("double").alias("inside"))
    got = groups.groupBy("combo", "target", "g").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rmse_grid"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse_model"), F.avg("e").alias("bias"), F.avg("inside").alias("coverage"))
    return got.select("combo", "target", "g.zone", "g.whole", "n", "rmse_grid", "rmse_model", "bias", "coverage", (F.col("rmse_model") < F.col("rmse_grid")).alias("beats_grid"))


def predict(rows: DataFrame, raw: DataFrame, cv_gate: DataFrame, extra_gate: DataFrame | None, corrections: DataFrame, q95: DataFrame, threshold: float | None, model_version: str) -> DataFrame:
    """The live path after the model. rows: id, target, zone, complete, missing; raw: id, lo, mid, hi, distance; cv_gate and
    extra_gate: target, zone, passes (no row: doesn't pass; extra_gate None: not asked); corrections: target, zone,
    bias_correction, scale, offset; q95: target, zone, q95, where zone _default holds for zones without one.

    The eight fields of a prediction, a row for each row: incomplete before gate closed before applied. The interval is the
    half-width by q95, and outside the area of applicability by the distance over its threshold.
    """
    default = q95.where("zone = '_default'").select("target", F.col("q95").alias("_d95"))
    gate = lambda g, name: F.broadcast(g.where("passes").select("target", "zone", F.lit(True).alias(name)).distinct())  # noqa: E731  cells of a gate
    got = rows.join(raw, "id", "left").join(gate(cv_gate, "_cv"), ["target", "zone"], "left")
    got = got.join(gate(extra_gate, "_extra"), ["target", "zone"], "left") if extra_gate is not None else got.withColumn("_extra", F.lit(True))
    got = got.join(F.broadcast(corrections.select("target", "zone", "bias_correction", "scale", "offset")), ["target", "zone"], "left").join(F.broadcast(q95), ["target", "zone"], "left").join(F.broadcast(default), "target", "left")
    open_, limit = F.coalesce("_cv", F.lit(False)) & F.coalesce("_extra", F.lit(False)), F.lit(threshold).cast("double")
    far = F.coalesce((limit != 0) & (F.col("distance") > limit), F.lit(False))
    on = F.col("complete") & open_
    ci = (F.col("hi") - F.col("lo")) / 2 * F.coalesce("q95", "_d95", F.lit(1.0)) * F.when(far, F.col("distance") / limit).otherwise(1.0)
    delta = F.when(F.col("scale").isNotNull(), F.col("mid") * F.col("scale") + F.col("offset")).otherwise(F.col("mid") + F.coalesce("bias_correction", F.lit(0.0)))
    none = F.array().cast("array<string>")
    return got.select(
        *[rows[c] for c in ("id", "target", "zone")], F.when(on, delta).alias("delta_c"), F.when(on, ci).alias("ci95_c"), F.when(on, confidence(ci, far)).otherwise("low").alias("confidence"), on.alias("applied"),
        F.when(F.col("complete"), far).alias("out_of_distribution"), F.when(F.col("complete"), none).otherwise(F.col("missing")).alias("covariates_missing"), F.when(F.col("complete"), open_).alias("cv_gate_passed"), F.lit(model_version).alias("model_version"),
    )


def freeze(predictions: DataFrame, band: str) -> DataFrame:
    """Live predictions as a snapshot keeps them: rows of station_id, date, target and the eight fields, with the band."""
    fields = ("delta_c", "ci95_c", "confidence", "applied", "out_of_distribution", "covariates_missing", "cv_gate_passed", "model_version")
    return predictions.select("station_id", "date", "target", *fields, F.lit(band).alias("band"))


def train(rows: DataFrame, target: str, trees: int = 300, cap: int = CAP) -> dict[str, DataFrame]:
    """The frames that a model's metadata is made of, for one target: oof (with kriging's predictions), metrics by zone and
    q95. rows as training_matrix() gives them, with an id."""
    from .score import conformal_q95, cv_metrics

    cv = forest_cv(rows, trees=trees, cap=cap).drop("combo")
    krig = kriging_cv(rows, cap=cap).select("id", F.col("pred").alias("pred_kriging"))
    oof = rows.select("id", "zone", "y").join(cv.withColumnRenamed("mid", "pred"), "id").join(krig, "id", "left")
    return {"oof": oof.withColumn("target", F.lit(target)), "metrics": cv_metrics(oof), "q95": conformal_q95(oof).withColumn("target", F.lit(target))}


def variants(rows: DataFrame) -> DataFrame:
    """rows: zone, fold, e (truth less grid), d (delta). Four corrections, each with what its fold's other rows say: the delta
    as it is, less its mean error, by a line fitted on it, and the mean of e alone. RMSE and bias of each by zone."""
    base = rows.where("zone IS NOT NULL")
    by = base.groupBy("zone", "fold").agg(F.count("*").alias("n"), F.sum("e").alias("se"), F.sum("d").alias("sd"), F.sum(F.col("d") * F.col("d")).alias("sdd"), F.sum(F.col("d") * F.col("e")).alias("sde"))
    other = by.alias("a").join(by.alias("b"), (F.col("a.zone") == F.col("b.zone")) & (F.col("a.fold") != F.col("b.fold")), "left").groupBy("a.zone", "a.fold").agg(*[F.coalesce(F.sum(f"b.{c}"), F.lit(0.0)).alias(c) for c in ("n", "se", "sd", "sdd", "sde")])
    me, md = F.coalesce(F.try_divide("se", "n"), F.lit(0.0)), F.coalesce(F.try_divide("sd", "n"), F.lit(0.0))
    slope = F.coalesce(F.try_divide(F.col("sde") - F.col("n") * md * me, F.col("sdd") - F.col("n") * md * md), F.lit(1.0))
    known = other.select("zone", "fold", me.alias("me"), md.alias("md"), slope.alias("slope"))
    q = base.join(F.broadcast(known), ["zone", "fold"])  # zones by folds
    error = {"raw": F.col("e") - F.col("d"), "debiased": F.col("e") - F.col("d") - (F.col("me") - F.col("md")), "affine": F.col("e") - F.col("slope") * F.col("d") - (F.col("me") - F.col("slope") * F.col("md")), "grid_only": F.col("e") - F.col("me")}
    got = q.groupBy("zone").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse_grid"), *[F.struct(F.lit(k).alias("variant"), F.sqrt(F.avg(x * x)).alias("rmse"), F.avg(x).alias("bias")).alias(k) for k, x in error.items()])
    return got.select("zone", "rmse_grid", F.inline(F.array(*error))).withColumn("passes", (F.col("rmse_grid") - F.col("rmse")) / F.col("rmse_grid") >= 0.03)


def sweep(rows: DataFrame, stage: int, limit: int | None = None, trees: int = 300, cap: int = CAP) -> DataFrame:
    """Metrics of each combination of a stage (the first `limit` of them) on rows with id, target, zone, region, lon, lat, x, y;
    ids are distinct over targets."""
    chosen = combos(stage)[:limit]
    parts = [forest_cv(rows.where(F.col("target") == t), chosen, trees, cap) for t in ("tmax", "tmin")]
    return sweep_metrics(parts[0].unionByName(parts[1]).join(rows.select("id", "target", "zone", "y"), "id"))
