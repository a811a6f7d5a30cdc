"""Model bundles: the forests, what they were trained on, and the gate that their cross-validation gives."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.train import FEATURES, Forest, check_features, distances_to


class Bundle:
    """Of each target the forest and the training sample of its area of applicability; and the metadata."""

    def __init__(self, version: str, forests: dict[str, Forest], samples: dict, threshold: float | None, gate: list[tuple[str, str, bool]], q95: list[tuple[str, str, float]], features=FEATURES):
        self.version, self.forests, self.samples, self.threshold, self.gate, self.q95, self.features = version, forests, samples, threshold, gate, q95, tuple(features)


def save(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """One row: version and the pickled bundle, whose size the forests' sample bounds."""
    spark.createDataFrame([(bundle.version, bytearray(pickle.dumps(bundle)))], "version string, bundle binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Bundle:
    """A bundle that save() wrote, from a folder that is trusted; an error if its columns aren't this package's."""
    bundle = pickle.loads(spark.read.parquet(path).select("bundle").first()[0])
    check_features(bundle.features)
    return bundle


def gate_of(spark: SparkSession, bundle: Bundle) -> DataFrame:
    return spark.createDataFrame(bundle.gate, "target string, zone string, passes boolean")


def q95_of(spark: SparkSession, bundle: Bundle) -> DataFrame:
    return spark.createDataFrame(bundle.q95, "target string, zone string, q95 double")


def raw_predictions(rows: DataFrame, bundle: Bundle, target: str) -> DataFrame:
    """rows: id, x, complete. id, lo, mid, hi and distance of the complete rows; the model is sent to all executors."""
    import numpy as np
    import pandas as pd

    sent = rows.sparkSession.sparkContext.broadcast((bundle.forests[target], bundle.samples[target]))

    def apply(frames):
        forest, sample = sent.value
        for f in frames:
            x = np.stack(f["x"].to_numpy()).astype(float) if len(f) else np.zeros((0, forest.bin.edges.__len__()))
            q = forest.predict(x)
            yield pd.DataFrame({"id": f["id"], "lo": q[:, 0], "mid": q[:, 1], "hi": q[:, 2], "distance": distances_to(x, sample, forest.importances())})

    return rows.where(F.col("complete")).select("id", "x").mapInPandas(apply, "id long, lo double, mid double, hi double, distance double")
