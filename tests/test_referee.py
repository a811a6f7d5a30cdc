"""The referee, the snapshot and the logs: what queries can't show, and cases at the edges."""

import json

import pytest
from pyspark.sql import functions as F

from thermaline.operators import gates, ledger, report
from thermaline.plans import referee
from thermaline.sources import snapshot, store
from thermaline.streaming import logs

DATA = "/root/testdata/sf0.001"


def test_a_changed_file_and_a_changed_manifest_are_noticed(spark):
    path = store.scratch(spark)
    snapshot.write_rows(referee.snap(spark, DATA), path)
    pinned = snapshot.write_manifest(spark, path, "v1", "0", "1", "CC0")
    assert snapshot.verify_snapshot(spark, path, pinned).count() == 0
    claimed = snapshot.read_manifest(spark, path).select(F.inline("partitions"))
    forged = claimed.withColumn("sha256", F.when(F.col("file").contains("1995-03"), "x").otherwise(F.col("sha256"))).unionByName(claimed.limit(1).withColumn("file", F.lit("bands/none")))
    assert {(r.violation) for r in store.verify(forged, snapshot.partitions(spark, path)).collect()} == {"differs", "missing"}
    assert [r.violation for r in snapshot.verify_snapshot(spark, path, "0" * 64).collect()] == ["differs"]
    with pytest.raises(ValueError):
        snapshot.read_rows(spark, path, "era6")


def test_envelope_and_its_clashes(spark):
    one = spark.range(1).select(F.lit(0).cast("long").alias("n"))
    cells = spark.createDataFrame([("tmax", "Cfb", 3, 3)], "target string, zone string, n_grid long, n_applied long")
    got = report.build_report(cells, one, {"model_version": "m", "band_key": "era5"}, {"lead_days": 3}).first()
    assert got.lead_days == 3 and got.by_target[0].zone == "Cfb" and got.fidelity_check.n == 0
    for extra in ({"model_version": "x"}, {"by_target": 1}):
        with pytest.raises(ValueError):
            report.build_report(cells, one, {"model_version": "m"}, extra)


def test_one_submission_is_expected(spark):
    paths = spark.createDataFrame([("submissions/2026-01/001-me-x/manifest.yaml",), ("submissions/2026-01/001-me-x/claimed.json",)], "path string")
    assert report.exactly_one(paths) == "submissions/2026-01/001-me-x"
    for some in (paths.limit(0), paths.union(spark.createDataFrame([("submissions/2026-02/002-me-y/manifest.json",)], "path string"))):
        with pytest.raises(ValueError):
            report.exactly_one(some)


def test_a_gate_that_drops_zones_is_refused(spark):
    schema = "target string, zone string, enabled boolean, bias_correction double, scale double, offset double, spatial_skill boolean"
    now = spark.createDataFrame([("tmax", "Cfb", True, 0.1, None, None, True), ("tmax", "BSk", False, None, None, None, None)], schema)
    new = now.where("zone = 'Cfb'")
    with pytest.raises(ValueError, match="tmax/BSk"):
        gates.publish(new, now)
    assert [c["zone"] for c in json.loads(gates.publish(new, now, allow_drops=True).first().document)] == ["Cfb"]
    assert gates.patch_violations(gates.subzone_patch(spark.createDataFrame([], "target string, zone string, beats_with_margin boolean, beats_with_margin_affine boolean, bias_correction_c double, delta_scale double, delta_offset double, beats_grid boolean"), "FR"), now).first().violation == "empty"


def test_only_valid_lines_are_appended(spark):
    path = store.scratch(spark)
    line = {"ts": "t", "event": "tenure_start", "cell": {"model_version": "m", "band_key": "era5", "target": "tmax", "zone": "Cfb"}, "author_github": "me", "submission_id": "2026-01-001", "start_month": "2026-01", "end_month": None}
    texts = lambda **k: spark.createDataFrame([(json.dumps(line | k),)], "text string")
    ledger.append_lines(texts(), path, "credit")
    ledger.append_lines(texts(submission_id="2026-01-002"), path, "credit")
    for wrong in ({"submission_id": "1"}, {"event": "other"}, {"start_month": None}, {"end_month": "2026-02"}, {"cell": None}):
        with pytest.raises(ValueError):
            ledger.append_lines(texts(**wrong), path, "credit")
    assert spark.read.text(path).count() == 2
    with pytest.raises(ValueError):
        ledger.violations(texts(), "other")


def test_streams_keep_holders_and_score_files_once(spark, tmp_path):
    source, state = tmp_path / "log", f"file://{tmp_path}/state"
    source.mkdir()
    line = lambda n, event, author: json.dumps({"line": n, "ts": "t", "event": event, "cell": {"model_version": "m", "band_key": "era5", "target": "tmax", "zone": "Cfb" if n < 10 else "BSk"}, "author_github": author})
    (source / "a.jsonl").write_text("\n".join([line(1, "tenure_start", "a"), line(2, "tenure_end", "a"), line(11, "tenure_start", "c")]))
    run = lambda: logs.holders(logs.read_lines(spark, f"file://{source}", "credit"), state, f"{tmp_path}/check").awaitTermination()
    run()
    assert {r.cell.zone: r.holder for r in logs.current(spark, state, 0).collect()} == {"Cfb": None, "BSk": "c"}
    (source / "b.jsonl").write_text(line(3, "tenure_start", "b"))
    run()
    assert {r.cell.zone: r.holder for r in logs.current(spark, state, 1).collect()} == {"Cfb": "b", "BSk": "c"}
    months = tmp_path / "months"
    spark.range(5).write.parquet(f"file://{months}/m1")
    scored = lambda: logs.score_new(spark.readStream.schema("id long").parquet(f"file://{months}/*"), lambda b: b.groupBy().count(), f"file://{tmp_path}/out", f"{tmp_path}/check2").awaitTermination()
    scored()
    spark.range(7).write.parquet(f"file://{months}/m2")
    scored()
    assert sorted(r["count"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [5, 7]


def test_series_in_zip_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "tx.zip", "w") as z:
        z.writestr("TX_STAID000012.txt", "Header, with, five, odd, fields\n SOUID, DATE, x, y, z\n 12, 20200101, 1, 0, 0\n".replace("x, y, z", "TX, Q, N") + "12,7,20200102,  55,0\n12,7,20200103,-9999,0\n12,7,20200104,60,9\n12,7,20990101,60,0\n12,7,20200105,-31,    0\n12,7,notaday,1,0\n")
        z.writestr("readme.txt", "12,7,20200102,55,0\n")
    got = snapshot.read_series(spark, f"file://{tmp_path}/tx.zip", "2020-01-01", "2020-12-31").orderBy("date").collect()
    assert [(r.station_id, str(r.date), r.value) for r in got] == [("12", "2020-01-02", 5.5), ("12", "2020-01-05", -3.1)]


def test_submissions_are_loaded_only_whole(spark, tmp_path):
    manifest = {"submission_id": "2026-01-001", "author": {"github": "me"}, "track": "research", "rung": "A", "snapshot": {"version": "v1", "manifest_sha256": "a" * 64}, "claims": [{"model_version": "m", "band_key": "era5", "targets": ["tmax"], "zones": ["Cfb"]}], "method": {"package_version": "1"}, "claimed_report": "claimed.json", "tolerance": {"rmse_grid_c": 0.01}}
    claimed = {"report_schema_version": 1, "model_version": "m", "band_key": "era5", "snapshot_version": "v1", "sample_requested": 0, "rows_sampled": 1, "rows_paired": 1, "fidelity_check": {"n": 0}, "by_target": []}

    def load(m, c):
        (tmp_path / "manifest.json").write_text(json.dumps(m))
        (tmp_path / "claimed.json").write_text(json.dumps(c))
        return report.load_submission(spark, f"file://{tmp_path}")

    flat, document = load(manifest, claimed)
    assert flat.first().github == "me" and document.first().report_id == "2026-01-001"
    for m, c in ((manifest | {"rung": "Z"}, claimed), (manifest | {"tolerance": {"rmse_grid_c": 1.0}}, claimed), (manifest, {**claimed, "band_key": None})):
        with pytest.raises(ValueError):
            load(m, c)
    paths = spark.createDataFrame([("submissions/2026-01/001-me-x/manifest.json",), ("submissions/2026-01/0011-me-x/manifest.json",), ("submissions/2026-01/010-me-x/manifest.json",)], "path string")
    assert [r.path for r in report.find_manifest(paths, "2026-01-1").collect()] == ["submissions/2026-01/001-me-x/manifest.json"]


def test_a_patch_needs_an_enabled_zone(spark):
    schema = "target string, zone string, subzone string, enabled boolean, bias_correction double, scale double, offset double"
    gate = spark.createDataFrame([("tmax", "Cfb", None, True, 0.1, None, None), ("tmax", "BSk", None, False, None, None, None)], schema)
    patch = spark.createDataFrame([("tmax", "Cfb", "FR", 0.2, None, None)], "target string, zone string, subzone string, bias_correction double, scale double, offset double")
    got = {(r.zone, r.subzone): r.bias_correction for r in gates.publish_subzone(gate, patch).collect()}
    assert got == {("Cfb", None): 0.1, ("BSk", None): None, ("Cfb", "FR"): 0.2} and gates.gate_key("era5", "v") == "era5_v"
    for g, p in ((gate.limit(0), patch), (gate, patch.limit(0)), (gate, patch.withColumn("zone", F.lit("BSk")))):
        with pytest.raises(ValueError):
            gates.publish_subzone(g, p)


def test_unfinished_jobs_aren_t_complete(spark):
    path = store.scratch(spark)
    store.flush(spark.range(3), path, 0)
    store.flush(spark.range(4), path, 0)
    assert not store.is_complete(spark, path)
    store.flush(spark.range(2), path, 1, complete=True)
    assert store.is_complete(spark, path) and spark.read.parquet(path).count() == 6
