"""Gates: which zone of which target a correction is switched on for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import broken, finite


def build_gate(scores: DataFrame) -> DataFrame:
    """Zones that meet the evidence bar on either path; NULL verdicts are no evidence."""
    plain, affine = F.coalesce("beats_with_margin", F.lit(False)), F.coalesce("beats_with_margin_affine", F.lit(False))
    return scores.where(plain | affine).select("target", "zone", F.lit(True).alias("enabled"), F.when(plain, F.col("bias_correction_c")).alias("bias_correction"), F.when(affine, F.col("delta_scale")).alias("scale"), F.when(affine, F.col("delta_offset")).alias("offset"), F.col("beats_grid").alias("spatial_skill"))


def merge_patch(gate: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """The gate with the patch's leaves in it: a leaf that the patch has replaces the gate's leaf of its keys, every other one
    stays, keys of the patch alone are added. scale and offset are one leaf. Keys may be null; of repeated keys on one
    side the largest value of a leaf holds."""
    rest = [c for c in gate.columns if c not in keys]
    leaves = [[c, "offset"] if c == "scale" and "offset" in rest else [c] for c in rest if c != "offset" or "scale" not in rest]
    both = gate.select(*keys, *rest, F.lit(0).alias("_from")).unionByName(patch.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    got = both.groupBy(*keys).agg(*[F.max(F.when(F.col(x[0]).isNotNull(), F.struct("_from", *x))).alias(f"_{x[0]}") for x in leaves])
    return got.select(*keys, *[F.col(f"_{x[0]}.{c}").alias(c) for x in leaves for c in x])


def dropped(current: DataFrame, new: DataFrame) -> DataFrame:
    """(target, zone) that the current gate has and the new one hasn't, whatever the verdict in it."""
    return current.select("target", "zone").distinct().join(new.select("target", "zone").distinct(), ["target", "zone"], "left_anti")


def uncovered(claims: DataFrame, scores: DataFrame) -> DataFrame:
    """Claimed cells (target, zone) without a scored row or without applied rows."""
    return claims.join(scores.select("target", "zone", "n_applied"), ["target", "zone"], "left").where(F.coalesce("n_applied", F.lit(0)) == 0).select("target", "zone")


def cells(claims: DataFrame) -> DataFrame:
    """claims with arrays targets and zones, as one row a cell."""
    rest = [c for c in claims.columns if c not in ("targets", "zones")]
    return claims.select(*rest, F.explode("targets").alias("target"), "zones").select(*rest, "target", F.explode("zones").alias("zone"))


def regate(rows: DataFrame, predictions: DataFrame, gate: DataFrame, model_version: str) -> DataFrame:
    """Frozen predictions on rows (station_id, date, target, zone), under a gate; of double predictions the last `ord` holds.
    A row for each row, with reason and the eight fields of a prediction.

    Cases in this order: no prediction; frozen as not applied, which keeps its missing covariates and both flags; gate
    closed; applied, where scale and offset win over bias. A null zone has no gate. What isn't known of a row without a
    prediction is null.
    """
    fields = F.struct("delta_c", "ci95_c", "confidence", "applied", "out_of_distribution", "covariates_missing", "cv_gate_passed")
    last = predictions.groupBy("station_id", "date", "target").agg(F.max_by(fields, "ord").alias("p"))
    got = rows.join(last, ["station_id", "date", "target"], "left").join(gate.select("target", "zone", "enabled", "bias_correction", "scale", "offset"), ["target", "zone"], "left")
    reason = F.when(F.col("p").isNull(), "no_prediction").when(~F.coalesce("p.applied", F.lit(False)), "not_applied").when(~F.coalesce("enabled", F.lit(False)), "gate_closed").otherwise("applied")
    got = got.withColumn("reason", reason)
    on, kept = F.col("reason") == "applied", F.col("reason") == "not_applied"
    delta = F.when(F.col("scale").isNotNull(), F.col("scale") * F.col("p.delta_c") + F.col("offset")).otherwise(F.col("p.delta_c") + F.coalesce("bias_correction", F.lit(0.0)))
    return got.select(
        *rows.columns, "reason", F.when(on, delta).alias("delta_c"), F.when(on, F.col("p.ci95_c")).alias("ci95_c"), F.when(on, F.col("p.confidence")).otherwise("low").alias("confidence"), on.alias("applied"),
        F.col("p.out_of_distribution").alias("out_of_distribution"), F.when(kept, F.coalesce("p.covariates_missing", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("covariates_missing"),
        F.when(on, True).when(kept, F.col("p.cv_gate_passed")).when(F.col("reason") == "gate_closed", False).alias("cv_gate_passed"), F.lit(model_version).alias("model_version"),
    )


def cell_status(scores: DataFrame) -> DataFrame:
    """A cycle's verdict on each scored cell: insufficient_n before anything else, then by the margin without the affine
    path; an undecided margin is a loss. Cells without new rows have no score and so no verdict."""
    status = F.when(F.col("too_few"), "insufficient_n").when(F.col("beats_with_margin"), "win").otherwise("loss")
    return scores.select("target", "zone", "n_grid", "rmse_grid_c", "rmse_model_c", "rmse_debiased_cv_c", "bias_correction_c", status.alias("status"))


def refusals(reports: DataFrame, band: str | None = None, variant: str | None = None, subzone: bool = False) -> DataFrame:
    """reports: report_id, band, variant, zones, regions, exclude_regions (arrays). report_id and refusal, one row a reason
    why a report can't become a gate, or with subzone a patch: another band (not asked for where band is null); another
    variant; zones without a variant; regions in a gate, none or several in a patch."""
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    why = [(F.lit(band is not None) & ~F.col("band").eqNullSafe(F.lit(band)), "band"), (~F.col("variant").eqNullSafe(F.lit(variant)), "variant")]
    if subzone:
        why += [(~some("regions"), "no_region"), (F.size("regions") > 1, "several_regions")]
    else:
        why += [(some("zones") & F.lit(variant is None), "zones_without_variant"), (some("regions") | some("exclude_regions"), "regions")]
    return broken(reports, ["report_id"], why, "refusal")


def subzone_patch(scores: DataFrame, subzone: str) -> DataFrame:
    """The scores of one region as leaves (target, zone, subzone): the same bar as for a gate, corrections alone."""
    gate = build_gate(scores).where("bias_correction IS NOT NULL OR scale IS NOT NULL")
    return gate.select("target", "zone", F.lit(subzone).alias("subzone"), "bias_correction", "scale", "offset")


def patch_violations(patch: DataFrame, gate: DataFrame) -> DataFrame:
    """Zones of a patch that the gate hasn't enabled, and one row of nulls for a patch without leaves."""
    missing = patch.select("target", "zone").distinct().join(gate.where("enabled").select("target", "zone").distinct(), ["target", "zone"], "left_anti").withColumn("violation", F.lit("not_enabled"))
    empty = patch.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("zone"), F.lit("empty").alias("violation"))
    return missing.unionByName(empty)


def patch_zones(patch: DataFrame) -> DataFrame:
    """The distinct zones of a patch's two maps, by target: those with a bias and those with a scale."""
    bias, scale = patch.where("bias_correction IS NOT NULL"), patch.where("scale IS NOT NULL")
    return bias.select("target", "zone").union(scale.select("target", "zone")).distinct()


def cell_schema_violations(gate: DataFrame) -> DataFrame:
    """Rows of a gate that its schema doesn't allow: unknown target, no zone, half a scale, corrections that aren't finite."""
    wrong = F.when(~F.coalesce(F.col("target").isin("tmax", "tmin"), F.lit(False)), "target").when(F.coalesce(F.col("zone"), F.lit("")) == "", "zone")
    wrong = wrong.when(F.col("scale").isNull() != F.col("offset").isNull(), "scale")
    for c in ("bias_correction", "scale", "offset"):
        wrong = wrong.when(F.col(c).isNotNull() & ~finite(F.col(c)), c)
    return gate.withColumn("violation", wrong).where("violation IS NOT NULL").select("target", "zone", "violation")


def cv_gate(report: DataFrame) -> DataFrame:
    """report: target, by_zone (map of zone to struct with beats_grid). A row for each reported zone; what isn't reported
    isn't there and so doesn't pass."""
    return report.select("target", F.explode("by_zone").alias("zone", "m")).select("target", "zone", F.coalesce("m.beats_grid", F.lit(False)).alias("passes"))


def publish(gate: DataFrame, current: DataFrame, allow_drops: bool = False) -> DataFrame:
    """The gate that is to be written, one JSON document a target; an error names the zones that it would drop."""
    lost = dropped(current, gate).orderBy("target", "zone").take(20)
    if lost and not allow_drops:
        raise ValueError("the new gate drops " + ", ".join(f"{r.target}/{r.zone}" for r in lost))
    cell = F.struct("zone", "enabled", "bias_correction", "scale", "offset", "spatial_skill")
    return gate.groupBy("target").agg(F.to_json(F.sort_array(F.collect_list(cell))).alias("document"))


def gate_key(band: str, variant: str | None = None) -> str:
    """Under which name a gate is published; a variant never shares the plain one's."""
    return f"{band}_{variant}" if variant else band


def publish_subzone(gate: DataFrame, patch: DataFrame) -> DataFrame:
    """The published gate (target, zone, subzone, enabled and leaves; subzone null for a zone's own) with a patch in it; an error
    without a gate, without leaves, or where a zone of the patch isn't enabled."""
    if gate.isEmpty():
        raise ValueError("there is no gate to patch")
    wrong = patch_violations(patch, gate.where("subzone IS NULL")).take(5)
    if wrong:
        raise ValueError("; ".join(f"{r.target}/{r.zone}: {r.violation}" for r in wrong))
    return merge_patch(gate, patch, ["target", "zone", "subzone"])
