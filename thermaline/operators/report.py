"""The referee: reports of a band, what a submission claims, and whether both agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import broken
from ..sources.store import BANDS
from .ledger import ID, RUNGS, SHA, TARGETS, TRACKS
from .score import compare_reports, fidelity, score_band

# Version of the report, and the largest tolerance that a submission may ask for.
VERSION = 1
CEILINGS = {"rmse_improvement_pct_debiased_cv": 0.01, "bias_correction_c": 0.05, "rmse_qrf_c": 0.02, "rmse_grid_c": 0.02, "rmse_debiased_cv_c": 0.02}
ENVELOPE = ("report_schema_version", "model_version", "band_key", "snapshot_version", "sample_requested", "rows_sampled", "rows_paired", "fidelity_check", "by_target")
REQUIRED = ("n_grid", "n_applied")


def by_target(rows: DataFrame) -> DataFrame:
    """Band rows with both targets as rows of one target each: station_id, date, zone, target, truth, grid."""
    pair = lambda t: F.struct(F.lit(t).alias("target"), F.col(f"station_{t}_c").alias("truth"), F.col(f"grid_{t}_c").alias("grid"))
    return rows.select("station_id", "date", F.col("climate_zone").alias("zone"), F.inline(F.array(pair("tmax"), pair("tmin"))))


def build_report(scores: DataFrame, fidelity_check: DataFrame, envelope: dict, extra: dict | None = None) -> DataFrame:
    """One row: the envelope, fidelity_check (a struct) and by_target (an array of a struct for each cell). extra: further
    fields, none of which may be one of the envelope's."""
    if clash := sorted(set(extra or {}) & {*ENVELOPE, *envelope}):
        raise ValueError(f"fields of the envelope: {clash}")
    cells = scores.agg(F.sort_array(F.collect_list(F.struct(*scores.columns))).alias("by_target"))  # a row for each zone and target
    checked = fidelity_check.select(F.struct(*fidelity_check.columns).alias("fidelity_check"))
    got = cells.join(checked, how="cross")  # one row each
    return got.withColumns({k: F.lit(v) for k, v in {"report_schema_version": VERSION, **envelope, **(extra or {})}.items()})


def report_violations(reports: DataFrame) -> DataFrame:
    """reports: report_id, document (JSON). report_id and violation: what the schema asks for and the document lacks."""
    schema = "report_schema_version int, model_version string, band_key string, snapshot_version string, sample_requested bigint, rows_sampled bigint, rows_paired bigint, fidelity_check struct<n:bigint>, by_target array<struct<target:string,zone:string,n_grid:bigint,n_applied:bigint>>"
    r = reports.select("report_id", F.from_json("document", schema).alias("r")).select("report_id", "r.*")
    bad = [(F.col(c).isNull(), c) for c in ENVELOPE]
    bad += [(F.col("report_schema_version") != VERSION, "version"), (F.col("fidelity_check").isNotNull() & F.col("fidelity_check.n").isNull(), "fidelity_check.n")]
    lacks = lambda c: F.exists("by_target", lambda x: x[c].isNull())
    bad += [(lacks(c), f"cell without {c}") for c in REQUIRED]
    bad += [(F.exists("by_target", lambda x: ~F.coalesce(x["target"].isin(*TARGETS), F.lit(False))), "target")]
    return broken(r, ["report_id"], bad)


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """manifests: submission_id, github, track, rung, manifest_sha256, claims (array of model_version, band_key, targets,
    zones), tolerance (map). submission_id and violation, the rules of form and the ceilings of tolerances."""
    c = F.col
    no = lambda x: ~F.coalesce(x, F.lit(False))
    ceilings = F.create_map(*[F.lit(x) for pair in CEILINGS.items() for x in pair])
    bad = [
        (no(c("submission_id").rlike(ID)), "submission_id"), (no(F.length("github") > 0), "github"), (no(c("track").isin(*TRACKS)), "track"), (no(c("rung").isin(*RUNGS)), "rung"), (no(c("manifest_sha256").rlike(SHA)), "manifest_sha256"), (no(F.size("claims") > 0), "claims"),
        (F.exists("claims", lambda x: no(x["band_key"].isin(*BANDS))), "band_key"), (F.exists("claims", lambda x: no(F.size(x["targets"]) > 0) | F.exists(x["targets"], lambda t: ~t.isin(*TARGETS)) | (F.size(F.array_distinct(x["targets"])) < F.size(x["targets"]))), "targets"),
        (F.exists("claims", lambda x: no(F.size(x["zones"]) > 0) | (F.size(F.array_distinct(x["zones"])) < F.size(x["zones"]))), "zones"),
        (F.exists(F.map_values("tolerance"), lambda v: no(v > 0)), "tolerance"), (F.exists(F.map_entries("tolerance"), lambda e: F.coalesce(e["value"] > F.try_element_at(ceilings, e["key"]), F.lit(False))), "tolerance above its ceiling"),
    ]
    return broken(manifests, ["submission_id"], bad)


def cross_check(submissions: DataFrame, package_version: str) -> DataFrame:
    """submissions: path, submission_id, github, pr_author (null: not asked), rung, package_version, claims, snapshot_version,
    and of the claimed report report_band, report_model, report_snapshot. path and violation: identities that disagree."""
    c = F.col
    form = r"submissions/(\d{4}-\d{2})/(\d{3})-([\w-]+)/?$"
    found = c("path").rlike(form)
    month, number, rest = (F.regexp_extract("path", form, i) for i in (1, 2, 3))
    one = F.size("claims") == 1
    claim = F.get("claims", F.lit(0))
    differs = lambda a, b: ~a.eqNullSafe(b)
    bad = [
        (~found, "path"), (found & differs(F.concat_ws("-", month, number), c("submission_id")), "submission_id"), (found & ~F.startswith(F.lower(rest), F.concat(F.lower("github"), F.lit("-"))), "author of the path"),
        (found & (F.lower("github") != F.lower("pr_author")), "author"), (differs(c("rung"), F.lit("A")), "rung"), (~one, "claims"), (one & differs(c("report_band"), claim["band_key"]), "band_key"), (one & differs(c("report_model"), claim["model_version"]), "model_version"),
        (one & differs(c("report_snapshot"), c("snapshot_version")), "snapshot_version"), (differs(c("package_version"), F.lit(package_version)), "package_version"),
    ]
    return broken(submissions, ["path"], bad)


def exactly_one(paths: DataFrame) -> str:
    """The folder of the only manifest among paths; an error where there are more or none."""
    got = paths.where(F.col("path").rlike(r"[^/]+/[^/]+/manifest\.(yaml|json)$")).select(F.regexp_replace("path", r"/[^/]*$", "").alias("d")).distinct().orderBy("d").take(2)
    if len(got) != 1:
        raise ValueError(f"one submission is expected, not {[r.d for r in got]}")
    return got[0].d


def find_manifest(paths: DataFrame, submission_id: str) -> DataFrame:
    """The manifests of a submission's folder: its month, and its number with three digits before a hyphen."""
    month, number = submission_id.rsplit("-", 1)
    return paths.where(F.col("path").rlike(rf"(^|/){month}/{int(number):03d}-[^/]+/manifest\.(yaml|json)$"))


MANIFEST = "submission_id string, author struct<github:string>, track string, rung string, snapshot struct<version:string,manifest_sha256:string>, claims array<struct<model_version:string,band_key:string,targets:array<string>,zones:array<string>>>, method struct<package_version:string>, claimed_report string, tolerance map<string,double>"


def load_submission(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The manifest (JSON) as one row, as manifest_violations() and cross_check() take it, and the claimed report's text; an
    error where either breaks a rule."""
    text = spark.read.text(f"{folder}/manifest.json", wholetext=True)
    m = text.select(F.from_json("value", MANIFEST).alias("m")).select("m.*")
    flat = m.select("submission_id", F.col("author.github").alias("github"), "track", "rung", F.col("snapshot.version").alias("snapshot_version"), F.col("snapshot.manifest_sha256").alias("manifest_sha256"), "claims", F.col("method.package_version").alias("package_version"), "claimed_report", "tolerance")
    name = flat.first()
    wrong = [r.violation for r in manifest_violations(flat).collect()]  # of one row
    if wrong or name is None or not name.claimed_report:
        raise ValueError(f"the manifest breaks: {wrong or ['claimed_report']}")
    claimed = spark.read.text(f"{folder}/{name.claimed_report}", wholetext=True).select(F.lit(name.submission_id).alias("report_id"), F.col("value").alias("document"))
    wrong = [r.violation for r in report_violations(claimed).collect()]  # of one row
    if wrong:
        raise ValueError(f"the claimed report breaks: {wrong}")
    return flat, claimed


def frozen(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """rows by target with delta and applied of their frozen prediction (station_id, date, target, delta_c, applied, ord);
    without one a row isn't applied."""
    last = predictions.groupBy("station_id", "date", "target").agg(F.max_by(F.struct("delta_c", "applied"), "ord").alias("p"))
    got = rows.join(last, ["station_id", "date", "target"], "left")
    return got.select(*rows.columns, F.col("p.delta_c").alias("delta"), F.coalesce("p.applied", F.lit(False)).alias("applied"))


def reproduce(band: DataFrame, predictions: DataFrame, reference: DataFrame | None, model_version: str, band_key: str, snapshot: str) -> DataFrame:
    """The whole report on band rows (the snapshot's columns) and their frozen predictions: both targets in one pass over the
    rows. reference: the reference band with `ord`, or None where the band is the reference."""
    scores = score_band(frozen(by_target(band), predictions), snapshot)
    two = [F.col("station_id"), F.col("date"), F.col("grid_tmax_c").alias("tmax"), F.col("grid_tmin_c").alias("tmin")]
    checked = fidelity(band.select(*two), reference.select(*two, "ord")) if reference is not None else band.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"))
    n = band.count()
    return build_report(scores, checked, {"model_version": model_version, "band_key": band_key, "snapshot_version": snapshot, "sample_requested": 0, "rows_sampled": n, "rows_paired": n})


def live_report(rows: DataFrame, salt: str, checked: DataFrame, envelope: dict, variant: str | None = None, zones: list[str] | None = None, regions: list[str] | None = None) -> DataFrame:
    """The report of a live band, stamped with the scope of its run. rows as score_band() takes them."""
    texts = lambda x: F.array(*[F.lit(y) for y in x]) if x else F.array().cast("array<string>")
    got = build_report(score_band(rows, salt), checked, envelope)
    return got.withColumns({"base_variant": F.lit(variant).cast("string"), "zones": texts(zones), "regions": texts(regions)})


def cells_of(report: DataFrame) -> DataFrame:
    """A report's cells as rows."""
    return report.select(F.inline("by_target"))


def long(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """target, zone, metric, value."""
    return cells.unpivot(["target", "zone"], [F.col(c).cast("double").alias(c) for c in metrics], "metric", "value")


def agreement(claimed: DataFrame, reproduced: DataFrame, tolerance: DataFrame) -> DataFrame:
    """One row of both reports' cells: passed, and the largest deviations by metric that the tolerance names."""
    names = [r.metric for r in tolerance.select("metric").collect()]  # as many as metrics
    got = compare_reports(long(claimed, names), long(reproduced, names), tolerance)
    return got.agg(F.every("ok").alias("passed"), F.map_from_entries(F.collect_list(F.struct("metric", "worst"))).alias("max_abs_deviation"))


def comment(cells: DataFrame) -> DataFrame:
    """Markdown lines of the provisional results, in order: target, zone, and figures with four digits."""
    figure = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("None"))
    flag = F.when(F.col("beats_with_margin"), "True").when(~F.col("beats_with_margin"), "False").otherwise("None")
    text = F.concat(F.lit("| "), F.concat_ws(" | ", "target", "zone", F.col("n_applied").cast("string"), figure("rmse_grid_c"), figure("rmse_model_c"), figure("gain_debiased_cv"), flag), F.lit(" |"))
    return cells.select("target", "zone", text.alias("text"))


def ranking(cells: DataFrame) -> DataFrame:
    """One row a target: the verdict of each zone as a map, and the gain of those that have one."""
    entry = lambda v: F.struct("zone", v)
    some = F.collect_list(F.when(F.col("gain_model").isNotNull(), entry(F.round("gain_model", 6))))
    return cells.groupBy("target").agg(F.map_from_entries(F.sort_array(F.collect_list(entry(F.coalesce("beats_grid", F.lit(False)))))).alias("beats"), F.map_from_entries(F.sort_array(some)).alias("gain"))


def passing(cells: DataFrame) -> DataFrame:
    """Sorted lists of the zones that pass and that don't, by target."""
    ok = F.coalesce("beats_with_margin", F.lit(False))
    return cells.groupBy("target").agg(F.sort_array(F.collect_list(F.when(ok, F.col("zone")))).alias("passing"), F.sort_array(F.collect_list(F.when(~ok, F.col("zone")))).alias("failing"))


def marginal(cells: DataFrame, margin: float = 0.03) -> DataFrame:
    """Cells that miss the margin, those with least headroom first; without a gain last (999)."""
    headroom = F.coalesce(F.lit(margin) - F.coalesce("gain_debiased_cv", "gain_model"), F.lit(999.0))
    return cells.where(~F.coalesce("beats_with_margin", F.lit(False))).select("target", "zone", headroom.alias("headroom")).orderBy("headroom", "target", "zone")
