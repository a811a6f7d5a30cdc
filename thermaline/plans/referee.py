"""Queries of the snapshot, the logs, the gates and the referee; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates, ledger, report
from ..sources import snapshot, store
from .queries import _BAND, _DELTA, _GATE, _SCORE, _SCORES_OUT, _STEEP, _band, _gate, _query, _round, _t, _with
from ..operators.score import score_band


def made(spark, d, tables: list[str], columns: dict[str, str], join: str | None = None) -> DataFrame:
    """Columns from expressions that mean the same in both dialects; join is an equality of two columns."""
    got = _t(spark, d, tables[0])
    for t in tables[1:]:
        a, b = join.split(" = ")
        got = got.join(_t(spark, d, t), F.col(a) == F.col(b))
    return got.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


def cte(name: str, tables: list[str], columns: dict[str, str], join: str | None = None) -> str:
    return f"{name} AS (SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {tables[0]}" + "".join(f" JOIN {t} ON {join}" for t in tables[1:]) + ")"


ON = "o_custkey = c_custkey"
BOTH = ["orders", "customer"]
#: Band rows: an order is a station's day.
SNAP = {
    "station_id": "CAST(o_custkey AS STRING)", "date": "CAST(o_orderdate AS DATE)", "band": "CASE WHEN o_orderkey % 2 = 0 THEN 'era5' ELSE 'lag_fill' END", "station_tmax_c": "o_totalprice / 10000 + (o_orderkey % 13 - 5) * CAST(0.1 AS DOUBLE)",
    "station_tmin_c": "o_totalprice / 20000 + (o_orderkey % 11 - 5) * CAST(0.1 AS DOUBLE)", "grid_tmax_c": "o_totalprice / 10000", "grid_tmin_c": "o_totalprice / 20000", "climate_zone": "c_mktsegment", "region": "substr(CAST(c_nationkey AS STRING), 1, 1)", "ord": "o_orderkey",
}


def snap(spark, d) -> DataFrame:
    return made(spark, d, BOTH, SNAP, ON)


SNAP_SQL = cte("snap", BOTH, SNAP, ON)
_OUT = "station_id, date, band, round(station_tmax_c, 8) AS station_tmax_c, round(grid_tmin_c, 8) AS grid_tmin_c, climate_zone"


@_query(f"WITH {SNAP_SQL} SELECT {_OUT} FROM snap WHERE band = 'era5' AND strftime(date, '%Y-%m') IN ('1995-03', '1996-07', '2050-01')")
def snapshot_rows(spark, d):
    path = store.scratch(spark)
    snapshot.write_rows(snap(spark, d), path)
    return _round(snapshot.read_rows(spark, path, "era5", ["1995-03", "1996-07", "2050-01"]).select("station_id", "date", "band", "station_tmax_c", "grid_tmin_c", "climate_zone"), 8)


@_query(f"WITH {SNAP_SQL} SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM snap WHERE band = 'lag_fill'")
def snapshot_months(spark, d):
    path = store.scratch(spark)
    snapshot.write_rows(snap(spark, d), path)
    return snapshot.months(spark, path, "lag_fill")


PRED = {
    "station_id": "CAST(o_custkey AS STRING)", "date": "CAST(o_orderdate AS DATE)", "target": "CASE WHEN o_orderkey % 3 = 0 THEN 'tmin' ELSE 'tmax' END", "delta_c": "CAST(o_orderkey % 9 * 0.1 AS DOUBLE)", "ci95_c": "CAST(o_orderkey % 7 * 0.5 AS DOUBLE)",
    "confidence": "CASE WHEN o_orderkey % 7 < 3 THEN 'high' ELSE 'medium' END", "applied": "o_orderkey % 5 <> 0", "out_of_distribution": "o_orderkey % 6 = 0", "gap": "o_orderkey % 10 = 0", "cv_gate_passed": "o_orderkey % 5 <> 1", "model_version": "'m1'", "band": "'era5'", "ord": "o_orderkey",
}


def preds(spark, d) -> DataFrame:
    return made(spark, d, ["orders"], PRED).withColumn("covariates_missing", F.expr("IF(gap, array('slope_deg', 'lat'), array())"))


PRED_SQL = cte("pred", ["orders"], PRED)


@_query(f"WITH {PRED_SQL} SELECT station_id, date, target, delta_c, confidence, applied, CASE WHEN gap THEN 'slope_deg,lat' ELSE '' END AS missing FROM pred WHERE strftime(date, '%Y-%m') = '1996-05'")
def snapshot_predictions(spark, d):
    path = store.scratch(spark)
    snapshot.write_predictions(preds(spark, d), path)
    got = snapshot.read_predictions(spark, path, "m1", "era5", ["1996-05"])
    return got.select("station_id", "date", "target", "delta_c", "confidence", "applied", F.array_join("covariates_missing", ",").alias("missing"))


@_query("SELECT CAST(c_custkey AS STRING) AS station_id, (c_custkey * 37 % 1200) / 10.0::DOUBLE - 60 AS lat, c_mktsegment AS climate_zone FROM customer")
def snapshot_stations(spark, d):
    path = store.scratch(spark)
    snapshot.write_stations(_t(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS station_id", "(c_custkey * 37 % 1200) / 10D - 60 AS lat", "c_mktsegment AS climate_zone"), path)
    return snapshot.read_stations(spark, path).select("station_id", "lat", "climate_zone")


@_query("SELECT CAST(c_custkey AS STRING) AS station_id FROM customer WHERE c_custkey % 4 = 1")
def snapshot_holdout(spark, d):
    path = store.scratch(spark)
    if snapshot.read_holdout(spark, path) is not None:
        raise AssertionError("a list that isn't published")
    snapshot.write_holdout(_t(spark, d, "customer").where("c_custkey % 4 = 1").selectExpr("CAST(c_custkey AS STRING) AS station_id"), path)
    return snapshot.read_holdout(spark, path)


@_query(f"WITH {SNAP_SQL}, {PRED_SQL}, p AS (SELECT 'bands' AS of, band, strftime(date, '%Y-%m') AS month FROM snap UNION ALL SELECT 'predictions', band, strftime(date, '%Y-%m') FROM pred) SELECT of, band, month, count(*) AS rows, 0 AS violations FROM p GROUP BY ALL")
def snapshot_manifest(spark, d):
    path = store.scratch(spark)
    snapshot.write_rows(snap(spark, d), path)
    snapshot.write_predictions(preds(spark, d), path)
    pinned = snapshot.write_manifest(spark, path, "v1", "0000", "1.0", "CC0")
    bad = snapshot.verify_snapshot(spark, path, pinned).count()
    listed = snapshot.read_manifest(spark, path).select(F.inline("partitions"))
    part = lambda k: F.regexp_extract("file", f"{k}=([^/]+)", 1).alias(k)
    return listed.select(F.split("file", "/")[0].alias("of"), part("band"), part("month"), "rows").groupBy("of", "band", "month").agg(F.sum("rows").alias("rows")).withColumn("violations", F.lit(bad))


@_query(f"WITH {SNAP_SQL}, f AS (SELECT min(station_id) AS s FROM snap WHERE CAST(station_id AS INT) % 4 <> 1) SELECT station_id, band, CAST(date AS STRING) AS date, climate_zone FROM snap, f WHERE station_id = s")
def snapshot_sample(spark, d):
    path, rows = store.scratch(spark), snap(spark, d)
    snapshot.sample_csv(rows, rows.where("CAST(station_id AS INT) % 4 = 1").select("station_id").distinct(), f"{path}/sample")
    return spark.read.option("header", True).csv(f"{path}/sample").select("station_id", "band", "date", "climate_zone")


@_query(f"WITH {SNAP_SQL} SELECT station_id, CAST(date AS STRING) AS date, 'lag_fill' AS band, round(grid_tmax_c, 7) AS grid_tmax_c FROM snap WHERE ord % 5 = 0")
def row_dumps(spark, d):
    path = store.scratch(spark)
    rows = snap(spark, d).where("ord % 5 = 0").select("station_id", "date", F.round("grid_tmax_c", 7).alias("grid_tmax_c"), F.pmod("ord", F.lit(16)).alias("file"))
    listed = rows.groupBy("file").agg(F.collect_list(F.struct("station_id", "date", "grid_tmax_c")).alias("rows"))
    text = F.when(F.col("file") % 2 == 0, F.to_json("rows")).otherwise(F.to_json(F.struct("rows")))
    listed.repartition(32, "file").select(text.alias("value"), "file").write.partitionBy("file").text(f"{path}/dumps")
    return snapshot.read_dump(spark, f"{path}/dumps/*/*.txt", "station_id string, date string, grid_tmax_c double", "lag_fill").select("station_id", "date", "band", "grid_tmax_c")


@_query(f"WITH {SNAP_SQL} SELECT station_id, CAST(date AS STRING) AS date, round(grid_tmax_c, 7) AS grid_tmax_c FROM snap")
def export_parts(spark, d):
    path = store.scratch(spark)
    snap(spark, d).select("station_id", "date", F.round("grid_tmax_c", 7).alias("grid_tmax_c")).select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(f"{path}/text")
    for f in spark.read.format("binaryFile").load(f"{path}/text/*.gz").select("path").collect():  # a row a part
        store.rename(spark, f.path, f.path.replace("/text/", "/export/").removesuffix(".txt.gz") + ".jsonl.gz")
    return snapshot.read_export(spark, f"{path}/export", "station_id string, date string, grid_tmax_c double")


# Logs: an event is a line.
CELL_SQL = "{'model_version': 'm1', 'band_key': 'era5', 'target': CASE WHEN event_id % 4 = 0 THEN 'tavg' ELSE 'tmax' END, 'zone': CASE WHEN event_id % 9 <> 0 THEN event_type END}"
_CELL = "named_struct('model_version', 'm1', 'band_key', 'era5', 'target', CASE WHEN event_id % 4 = 0 THEN 'tavg' ELSE 'tmax' END, 'zone', CASE WHEN event_id % 9 <> 0 THEN event_type END) AS cell"
CREDIT = {"line": "event_id", "ts": "'t'", "event": "CASE event_id % 3 WHEN 0 THEN 'tenure_start' WHEN 1 THEN 'tenure_end' ELSE 'note' END", "author_github": "nullif(event_type, 'login')", "submission_id": "CASE WHEN event_id % 6 = 0 THEN '2026-01-00' || event_id % 10 WHEN event_id % 2 = 0 THEN 'draft' END", "start_month": "CASE WHEN event_id % 5 <> 0 THEN '2026-01' END", "end_month": "CASE WHEN event_id % 7 = 0 THEN '2026-02' END"}


@_query(f"""WITH {cte('c', ['events'], CREDIT | {'target': "CASE WHEN event_id % 4 = 0 THEN 'tavg' ELSE 'tmax' END", 'zone': "CASE WHEN event_id % 9 <> 0 THEN event_type END"})}
SELECT line, 'author_github' AS violation FROM c WHERE author_github IS NULL UNION ALL SELECT line, 'word in event' FROM c WHERE event = 'note' UNION ALL SELECT line, 'submission_id' FROM c WHERE event = 'tenure_start' AND submission_id IS NULL
UNION ALL SELECT line, 'form of submission_id' FROM c WHERE event = 'tenure_start' AND submission_id = 'draft' UNION ALL SELECT line, 'form of start_month' FROM c WHERE event <> 'note' AND start_month IS NULL UNION ALL SELECT line, 'end_month' FROM c WHERE event = 'tenure_start' AND end_month IS NOT NULL
UNION ALL SELECT line, 'form of end_month' FROM c WHERE event = 'tenure_end' AND end_month IS NULL UNION ALL SELECT line, 'cell.zone' FROM c WHERE zone IS NULL UNION ALL SELECT line, 'word in cell.target' FROM c WHERE target = 'tavg'""")
def credit_violations(spark, d):
    lines = _t(spark, d, "events").selectExpr(*[f"{v} AS {k}" for k, v in CREDIT.items()], _CELL, "CAST(NULL AS STRING) AS superseded_by")
    return ledger.violations(lines, "credit")


SUBMITTED = {
    "line": "event_id", "ts": "'t'", "submission_id": "'2026-01-' || substr(CAST(1000 + event_id % 1000 AS STRING), 2, 3) || CASE WHEN event_id % 50 = 0 THEN 'x' ELSE '' END", "author_github": "event_type", "track": "CASE event_id % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'serving-ready' ELSE 'other' END", "rung": "CASE WHEN event_id % 11 <> 0 THEN 'A' END",
    "model_version": "'m1'", "band_key": "'era5'", "snapshot_version": "'v1'", "manifest_sha256": "md5(event_type) || md5(CAST(event_id AS STRING))", "claimed_report_sha256": "CASE WHEN event_id % 4 = 0 THEN 'short' ELSE md5(event_type) || md5(event_type) END", "reproduced": "event_id % 2 = 0", "pr": "'r#1'", "runner_commit": "CAST(NULL AS STRING)",
}


@_query(f"""WITH {cte('s', ['events'], SUBMITTED)} SELECT line, 'rung' AS violation FROM s WHERE rung IS NULL UNION ALL SELECT line, 'word in track' FROM s WHERE track = 'other' UNION ALL SELECT line, 'form of submission_id' FROM s WHERE line % 50 = 0 UNION ALL SELECT line, 'form of claimed_report_sha256' FROM s WHERE claimed_report_sha256 = 'short'""")
def submission_violations(spark, d):
    return ledger.violations(made(spark, d, ["events"], SUBMITTED), "submissions")


@_query(f"WITH {cte('s', ['events'], SUBMITTED)} SELECT submission_id, count(*) > 1 AS used FROM s GROUP BY submission_id")
def used_ids(spark, d):
    s = made(spark, d, ["events"], SUBMITTED)
    first = s.groupBy("submission_id").agg(F.min("line").alias("line"))
    return ledger.unused(s.select("submission_id").distinct(), s.join(first, ["submission_id", "line"], "left_anti"))


@_query("""WITH l AS (SELECT event_id AS line, event_type AS kind, '["' || user_id || '","' || coalesce(event_type, 'null') || '"]' AS id, props AS text FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY kind, CASE WHEN kind <> 'click' THEN id ELSE CAST(line AS STRING) END ORDER BY line) AS k FROM l WHERE line % 89 <> 0)
SELECT kind, line, 'deleted' AS violation FROM l WHERE line % 89 = 0 UNION ALL SELECT kind, line, CASE WHEN line % 97 = 0 THEN 'edited' ELSE 'duplicate' END FROM n WHERE line % 97 = 0 OR k > 1""")
def append_only_logs(spark, d):
    e = _t(spark, d, "events").selectExpr("event_type AS kind", "event_id AS line", "props AS text", "IF(event_type <> 'click', to_json(array(CAST(user_id AS STRING), event_type)), NULL) AS id")
    head = e.where("line % 89 <> 0").withColumn("text", F.expr("IF(line % 97 = 0, text || ' ', text)"))
    return ledger.append_only_logs(e, head)


@_query("""SELECT event_id AS line, '["' || (event_id % 3) || '","m1","era5","tmax",' || CASE WHEN event_id % 9 <> 0 THEN '"' || event_type || '"' ELSE '"null"' END || ',"s' || (event_id % 5) || '"]' AS id FROM events""")
def cycle_identities(spark, d):
    lines = _t(spark, d, "events").selectExpr("event_id AS line", "CAST(event_id % 3 AS STRING) AS cycle", "'s' || event_id % 5 AS submission_id", "named_struct('model_version', 'm1', 'band_key', 'era5', 'target', 'tmax', 'zone', CASE WHEN event_id % 9 <> 0 THEN event_type END) AS cell")
    return lines.select("line", ledger.identity("cycles").alias("id"))


@_query("""SELECT event_id AS line, '2026-01' AS cycle, event_type AS author_github, 'z' || (event_id % 4) AS zone, event_id % 50 AS n_forward, 'win' AS status, 'v1' AS snapshot_version, 0 AS violations FROM events WHERE event_id % 10 = 0""")
def cycle_log(spark, d):
    """Lines are built, appended to a log and read again."""
    path = store.scratch(spark)
    scored = _t(spark, d, "events").where("event_id % 10 = 0").selectExpr("'2026-01-001' AS submission_id", "event_type AS author_github", "'m1' AS model_version", "'era5' AS band_key", "'tmax' AS target", "'z' || event_id % 4 AS zone", "event_id AS line", "'2025-12' AS eval_month", "event_id % 50 AS n_forward", "3 AS n_stations", "CAST(NULL AS DOUBLE) AS rmse_grid_c", "'win' AS status")
    ledger.append_lines(ledger.cycle_lines(scored, "2026-01", "t", "v1", None, "1.0"), f"{path}/cycles", "cycles")
    got = store.read_log(spark, f"{path}/cycles", ledger.SCHEMAS["cycles"] + ", n bigint")
    again = spark.read.text(f"{path}/cycles").select(F.from_json("value", "line bigint, " + ledger.SCHEMAS["cycles"]).alias("v")).select("v.*")
    return again.select("line", "cycle", "author_github", "cell.zone", "n_forward", "status", "snapshot_version").withColumn("violations", F.lit(ledger.violations(got, "cycles").count()))


@_query("""WITH {log}, s AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY line) AS k FROM l WHERE event <> 'note') SELECT cell, line, CASE WHEN event = 'tenure_start' THEN '{{"ts":"t","event":"tenure_start","cell":{{"model_version":"m1","band_key":"era5","target":"tmax","zone":"' || author || '"}},"author_github":"' || author || '","author_name":null,"orcid":null,"submission_id":"' || submission || '","start_month":"2026-03","end_month":null}}'
  ELSE '{{"ts":"t","event":"tenure_end","cell":{{"model_version":"m1","band_key":"era5","target":"tmax","zone":"' || author || '"}},"author_github":"' || author || '","start_month":"' || start_month || '","end_month":"2026-03","superseded_by":null}}' END AS text FROM s""".format(log="l AS (SELECT user_id AS cell, event_id AS line, user_id % 3 + event_id % 2 AS submission, CASE event_id % 3 WHEN 0 THEN 'tenure_start' WHEN 1 THEN 'tenure_end' ELSE 'note' END AS event, event_type AS author, CAST(event_id % 2 AS VARCHAR) AS start_month FROM events)"))
def tenure_lines(spark, d):
    e = _t(spark, d, "events").where("event_id % 3 < 2").selectExpr("user_id", "event_id", "IF(event_id % 3 = 0, 'tenure_start', 'tenure_end') AS event", "'m1' AS model_version", "'era5' AS band_key", "'tmax' AS target", "event_type AS zone", "event_type AS author_github", "CAST(user_id % 3 + event_id % 2 AS STRING) AS submission_id", "CAST(event_id % 2 AS STRING) AS start_month", "CAST(NULL AS STRING) AS superseded_by")
    return ledger.tenure_lines(e, "2026-03", "t", ["user_id", "event_id"]).select(F.col("user_id").alias("cell"), F.col("event_id").alias("line"), "text")


@_query(f"WITH {SNAP_SQL} SELECT t.target AS target, climate_zone AS zone, count(*) AS n_forward, count(DISTINCT station_id) AS n_stations FROM snap, (VALUES ('tmax'), ('tmin')) AS t(target) WHERE date >= DATE '1998-01-01' GROUP BY ALL")
def forward_stations(spark, d):
    return ledger.forward_stations(report.by_target(snap(spark, d).where("date >= '1998-01-01'")))


# Gates.
_REPORTS = {"report_id": "c_custkey", "band": "CASE c_custkey % 3 WHEN 0 THEN 'era5' WHEN 1 THEN 'lag_fill' END", "variant": "CASE WHEN c_custkey % 2 = 0 THEN 'v' END", "z": "c_custkey % 5", "r": "c_custkey % 4", "x": "c_custkey % 7"}


def _reports(spark, d):
    texts = lambda c, n: f"transform(filter(sequence(1, 3), i -> i <= CASE WHEN {c} < {n} THEN {c} ELSE 0 END), i -> CAST(i AS STRING))"
    r = made(spark, d, ["customer"], _REPORTS)
    return r.selectExpr("report_id", "band", "variant", texts("z", 3) + " AS zones", texts("r", 3) + " AS regions", texts("x", 2) + " AS exclude_regions")


@_query(f"""WITH {cte('r', ['customer'], _REPORTS)} SELECT report_id, 'band' AS refusal FROM r WHERE band IS DISTINCT FROM 'era5' UNION ALL SELECT report_id, 'variant' FROM r WHERE variant IS NOT NULL UNION ALL SELECT report_id, 'zones_without_variant' FROM r WHERE z IN (1, 2) UNION ALL SELECT report_id, 'regions' FROM r WHERE r IN (1, 2) OR x = 1""")
def gate_refusals(spark, d):
    return gates.refusals(_reports(spark, d), "era5")


@_query(f"""WITH {cte('r', ['customer'], _REPORTS)} SELECT report_id, 'variant' AS refusal FROM r WHERE variant IS DISTINCT FROM 'v' UNION ALL SELECT report_id, 'no_region' FROM r WHERE r NOT IN (1, 2) UNION ALL SELECT report_id, 'several_regions' FROM r WHERE r = 2""")
def subzone_refusals(spark, d):
    return gates.refusals(_reports(spark, d), None, "v", subzone=True)


_TWO = "SELECT 'tmin' AS target, zone, station_id, grid, truth, delta * 0.5 AS delta, applied FROM one UNION ALL SELECT target, zone, station_id, grid, truth, delta, applied FROM one"


def two_targets(spark, d, **k) -> DataFrame:
    one = _band(spark, d, **k)
    return one.unionByName(one.withColumns({"target": F.lit("tmin"), "delta": F.col("delta") * 0.5}))


def two_sql(tail: str, delta: str = _DELTA, zone: str = "c_mktsegment", where: str = "") -> str:
    return "WITH " + _BAND.format(zone=zone, delta=delta, where=where).replace("band AS", "one AS", 1) + f", band AS ({_TWO})," + _SCORE + " " + tail


@_query(two_sql(_SCORES_OUT))
def band_score_targets(spark, d):
    return _round(score_band(two_targets(spark, d), "salt"))


_PATCH_OUT = "SELECT target, zone, subzone, round(bias_correction, 6) AS bias_correction, round(scale, 6) AS scale, round(\"offset\", 6) AS \"offset\" FROM "
_PATCH = "patch AS (SELECT target, zone, 'FR' AS subzone, bias_correction, scale, \"offset\" FROM gate WHERE bias_correction IS NOT NULL OR scale IS NOT NULL)"
_FR = "WHERE c_nationkey = 6"


@_query(two_sql(", " + _GATE + ", " + _PATCH + " " + _PATCH_OUT + "patch", _STEEP, where=_FR))
def subzone_patch(spark, d):
    return _round(gates.subzone_patch(score_band(two_targets(spark, d, delta=_STEEP, where="c_nationkey = 6"), "salt"), "FR"))


# A patch with a bias alone on one cell, a scale alone on another, and a cell that is new: other leaves stay.
@_query("""WITH g AS (SELECT 'tmax' AS target, zone, sub AS subzone, b AS bias_correction, s AS scale, o AS "offset" FROM (VALUES ('Cfb', 'FR', 0.1::DOUBLE, 1.1::DOUBLE, 0.2::DOUBLE), ('Cfb', 'DE', 0.3, NULL, NULL), ('Dfb', 'FR', NULL, 0.9, 0.0), ('Dfb', NULL, 0.4, NULL, NULL)) AS t(zone, sub, b, s, o)),
p AS (SELECT 'tmax' AS target, zone, sub AS subzone, b AS bias_correction, s AS scale, o AS "offset" FROM (VALUES ('Cfb', 'FR', 0.7::DOUBLE, NULL::DOUBLE, NULL::DOUBLE), ('Dfb', 'FR', NULL, 1.3, 0.5), ('Dfb', NULL, 0.6, NULL, NULL), ('BSk', 'ES', 0.2, NULL, NULL)) AS t(zone, sub, b, s, o))
SELECT coalesce(g.target, p.target) AS target, coalesce(g.zone, p.zone) AS zone, coalesce(g.subzone, p.subzone) AS subzone, coalesce(p.bias_correction, g.bias_correction) AS bias_correction, CASE WHEN p.scale IS NOT NULL THEN p.scale ELSE g.scale END AS scale, CASE WHEN p.scale IS NOT NULL THEN p."offset" ELSE g."offset" END AS "offset"
FROM g FULL JOIN p ON g.target = p.target AND g.zone = p.zone AND g.subzone IS NOT DISTINCT FROM p.subzone""")
def merge_subzone_patch(spark, d):
    schema = "target string, zone string, subzone string, bias_correction double, scale double, offset double"
    gate = spark.createDataFrame([("tmax", "Cfb", "FR", 0.1, 1.1, 0.2), ("tmax", "Cfb", "DE", 0.3, None, None), ("tmax", "Dfb", "FR", None, 0.9, 0.0), ("tmax", "Dfb", None, 0.4, None, None)], schema)
    patch = spark.createDataFrame([("tmax", "Cfb", "FR", 0.7, None, None), ("tmax", "Dfb", "FR", None, 1.3, 0.5), ("tmax", "Dfb", None, 0.6, None, None), ("tmax", "BSk", "ES", 0.2, None, None)], schema)
    return gates.merge_patch(gate, patch, ["target", "zone", "subzone"])


@_query(two_sql(", " + _GATE + ", " + _PATCH + ", e AS (SELECT target, zone FROM gate WHERE zone > 'C' AND target = 'tmax') SELECT target, zone, 'not_enabled' AS violation FROM patch WHERE (target, zone) NOT IN (SELECT target, zone FROM e)", _STEEP))
def patch_violations(spark, d):
    scores = score_band(two_targets(spark, d, delta=_STEEP), "salt")
    return gates.patch_violations(gates.subzone_patch(scores, "FR"), gates.build_gate(scores).where("zone > 'C' AND target = 'tmax'"))


@_query(two_sql(", " + _GATE + ", " + _PATCH + " SELECT DISTINCT target, zone FROM patch", _STEEP))
def patch_zones(spark, d):
    return gates.patch_zones(gates.subzone_patch(score_band(two_targets(spark, d, delta=_STEEP), "salt"), "FR"))


_CELLS = {"target": "CASE c_custkey % 3 WHEN 0 THEN 'tmax' WHEN 1 THEN 'tmin' ELSE 'tavg' END", "zone": "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || c_custkey ELSE '' END", "scale": "CASE WHEN c_custkey % 7 <> 0 THEN CAST(1.5 AS DOUBLE) END", "offs": "CASE WHEN c_custkey % 14 <> 0 THEN CAST(0.5 AS DOUBLE) END", "bias_correction": "CASE WHEN c_custkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) END"}


@_query(f"""WITH {cte('g', ['customer'], _CELLS)}, v AS (SELECT target, zone, CASE WHEN target = 'tavg' THEN 'target' WHEN zone = '' THEN 'zone' WHEN (scale IS NULL) <> (offs IS NULL) THEN 'scale' WHEN bias_correction IS NOT NULL THEN 'bias_correction' END AS violation FROM g) SELECT * FROM v WHERE violation IS NOT NULL""")
def gate_schema(spark, d):
    return gates.cell_schema_violations(made(spark, d, ["customer"], _CELLS).withColumnRenamed("offs", "offset"))


@_query("SELECT 'tmax' AS target, c_mktsegment AS zone, count(*) % 2 = 1 AS passes FROM customer GROUP BY ALL")
def cv_gate(spark, d):
    zones = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("zone")).agg((F.count("*") % 2 == 1).alias("b"))
    flag = F.struct(F.when(F.col("b"), True).alias("beats_grid"))
    return gates.cv_gate(zones.agg(F.lit("tmax").alias("target"), F.map_from_entries(F.collect_list(F.struct("zone", flag))).alias("by_zone")))


@_query(_with(tail=", " + _GATE + " SELECT target, zone, enabled, round(bias_correction, 6) AS bias_correction FROM gate"))
def published_gate(spark, d):
    gate = _gate(spark, d)
    text = gates.publish(gate, gate.limit(0))
    cells = text.select("target", F.explode(F.from_json("document", "array<struct<zone:string,enabled:boolean,bias_correction:double>>")).alias("c"))
    return _round(cells.select("target", "c.*"))


# The referee.
_MANIFEST = {"submission_id": "CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '2026-01-' || substr(CAST(1000 + c_custkey % 1000 AS STRING), 2, 3) END", "k": "c_custkey"}


@_query(f"""WITH {cte('m', ['customer'], _MANIFEST)} SELECT submission_id, 'submission_id' AS violation FROM m WHERE k % 5 = 0 UNION ALL SELECT submission_id, 'github' FROM m WHERE k % 7 = 0 UNION ALL SELECT submission_id, 'track' FROM m WHERE k % 11 = 0 UNION ALL SELECT submission_id, 'rung' FROM m WHERE k % 13 = 0 UNION ALL SELECT submission_id, 'manifest_sha256' FROM m WHERE k % 17 = 0 UNION ALL SELECT submission_id, 'claims' FROM m WHERE k % 19 = 0
UNION ALL SELECT submission_id, 'band_key' FROM m WHERE k % 19 <> 0 AND k % 3 = 0 UNION ALL SELECT submission_id, 'targets' FROM m WHERE k % 19 <> 0 AND k % 4 = 0 UNION ALL SELECT submission_id, 'zones' FROM m WHERE k % 19 <> 0 AND k % 6 = 0 UNION ALL SELECT submission_id, 'tolerance' FROM m WHERE k % 8 = 0 UNION ALL SELECT submission_id, 'tolerance above its ceiling' FROM m WHERE k % 9 = 0""")
def manifest_violations(spark, d):
    m = made(spark, d, ["customer"], _MANIFEST).selectExpr(
        "submission_id", "IF(k % 7 = 0, '', 'me') AS github", "IF(k % 11 = 0, NULL, 'research') AS track", "IF(k % 13 = 0, 'D', 'B') AS rung", "IF(k % 17 = 0, 'x', sha2('a', 256)) AS manifest_sha256",
        "filter(array(named_struct('model_version', 'm', 'band_key', IF(k % 3 = 0, 'era6', 'forecast_lead7'), 'targets', IF(k % 4 = 0, array('tmax', 'tmax'), array('tmin')), 'zones', IF(k % 6 = 0, CAST(array() AS array<string>), array('Cfb')))), x -> k % 19 <> 0) AS claims", "map('rmse_grid_c', IF(k % 9 = 0, 0.5D, 0.01D), 'other', IF(k % 8 = 0, 0D, 99D)) AS tolerance",
    )
    return report.manifest_violations(m)


@_query("""WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'elsewhere/' ELSE 'submissions/2026-01/' END || substr(CAST(1000 + c_custkey % 1000 AS STRING), 2, 3) || '-Me' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '-slug' END AS path FROM customer), f AS (SELECT *, k % 5 <> 0 AS found FROM s)
SELECT path, 'path' AS violation FROM f WHERE NOT found UNION ALL SELECT path, 'submission_id' FROM f WHERE found AND k % 4 = 0 UNION ALL SELECT path, 'author of the path' FROM f WHERE found AND k % 7 = 0 UNION ALL SELECT path, 'author' FROM f WHERE found AND k % 3 = 0 UNION ALL SELECT path, 'rung' FROM f WHERE k % 11 = 0 UNION ALL SELECT path, 'claims' FROM f WHERE k % 13 = 0
UNION ALL SELECT path, 'band_key' FROM f WHERE k % 13 <> 0 AND k % 6 = 0 UNION ALL SELECT path, 'model_version' FROM f WHERE k % 13 <> 0 AND k % 8 = 0 UNION ALL SELECT path, 'snapshot_version' FROM f WHERE k % 13 <> 0 AND k % 9 = 0 UNION ALL SELECT path, 'package_version' FROM f WHERE k % 10 = 0""")
def cross_check(spark, d):
    s = _t(spark, d, "customer").selectExpr(
        "IF(c_custkey % 5 = 0, 'elsewhere/', 'submissions/2026-01/') || right('000' || c_custkey % 1000, 3) || '-Me' || IF(c_custkey % 7 = 0, '', '-slug') AS path", "IF(c_custkey % 4 = 0, 'x', '2026-01-' || right('000' || c_custkey % 1000, 3)) AS submission_id", "'me' AS github",
        "CASE c_custkey % 3 WHEN 0 THEN 'you' WHEN 1 THEN 'ME' END AS pr_author", "IF(c_custkey % 11 = 0, 'B', 'A') AS rung", "IF(c_custkey % 10 = 0, '0.9', '1.0') AS package_version", "array_repeat(named_struct('band_key', 'era5', 'model_version', 'm1'), IF(c_custkey % 13 = 0, 2, 1)) AS claims",
        "'v1' AS snapshot_version", "IF(c_custkey % 6 = 0, NULL, 'era5') AS report_band", "IF(c_custkey % 8 = 0, 'm2', 'm1') AS report_model", "IF(c_custkey % 9 = 0, 'v2', 'v1') AS report_snapshot",
    )
    return report.cross_check(s, "1.0")


_FROZEN = f"""{SNAP_SQL}, {PRED_SQL}, p AS (SELECT station_id, date, target, arg_max(struct_pack(d := delta_c, a := applied), ord) AS p FROM pred GROUP BY ALL),
r AS (SELECT station_id, date, climate_zone AS zone, t.target AS target, CASE WHEN t.target = 'tmax' THEN station_tmax_c ELSE station_tmin_c END AS truth, CASE WHEN t.target = 'tmax' THEN grid_tmax_c ELSE grid_tmin_c END AS grid FROM snap, (VALUES ('tmax'), ('tmin')) AS t(target) WHERE band = 'lag_fill'),
band AS (SELECT r.target, r.zone, r.station_id, r.grid, r.truth, p.p.d AS delta, coalesce(p.p.a, false) AS applied FROM r LEFT JOIN p USING (station_id, date, target)),"""


def _reproduced(spark, d) -> DataFrame:
    s = snap(spark, d)
    return report.reproduce(s.where("band = 'lag_fill'"), preds(spark, d), s.where("band = 'era5'"), "m1", "lag_fill", "salt")


@_query("WITH " + _FROZEN + _SCORE + " " + _SCORES_OUT)
def reproduce(spark, d):
    return _round(report.cells_of(_reproduced(spark, d)))


@_query(f"""WITH {SNAP_SQL}, e AS (SELECT station_id, date, arg_max(struct_pack(x := grid_tmax_c, n := grid_tmin_c), ord) AS r FROM snap WHERE band = 'era5' GROUP BY ALL), b AS (SELECT * FROM snap WHERE band = 'lag_fill')
SELECT 1 AS report_schema_version, 'm1' AS model_version, 'lag_fill' AS band_key, (SELECT count(*) FROM b) AS rows_paired, count(*) AS n, round(avg(grid_tmax_c - e.r.x), 6) AS tmax_mean, round(stddev_pop(grid_tmin_c - e.r.n), 6) AS tmin_sd FROM b JOIN e USING (station_id, date)""")
def reproduce_envelope(spark, d):
    return _round(_reproduced(spark, d).select("report_schema_version", "model_version", "band_key", F.col("rows_paired").cast("long").alias("rows_paired"), "fidelity_check.n", "fidelity_check.tmax_mean", "fidelity_check.tmin_sd"))


@_query("WITH " + _FROZEN + _SCORE + """, w AS (SELECT max(abs(round(rmse_grid_c, 2) - rmse_grid_c)) AS g, max(abs(round(rmse_model_c, 2) - rmse_model_c)) AS m FROM scores) SELECT g <= 0.02 AND m <= 0.001 AS passed, round(g, 6) AS rmse_grid_c, round(m, 6) AS rmse_model_c FROM w""")
def referee_agreement(spark, d):
    cells = report.cells_of(_reproduced(spark, d))
    claimed = cells.withColumns({c: F.round(c, 2) for c in ("rmse_grid_c", "rmse_model_c")})
    tolerance = spark.createDataFrame([("rmse_grid_c", 0.02), ("rmse_model_c", 0.001)], "metric string, allowed double")
    got = report.agreement(claimed, cells, tolerance)
    return _round(got.selectExpr("passed", "max_abs_deviation['rmse_grid_c'] AS rmse_grid_c", "max_abs_deviation['rmse_model_c'] AS rmse_model_c"))


@_query(two_sql("SELECT target, zone, '| ' || target || ' | ' || zone || ' | ' || n_applied || ' | ' || coalesce(printf('%.4f', rmse_grid_c), 'None') || ' | ' || coalesce(printf('%.4f', rmse_model_c), 'None') || ' | ' || coalesce(printf('%.4f', gain_debiased_cv), 'None') || ' | ' || CASE WHEN beats_with_margin THEN 'True' WHEN NOT beats_with_margin THEN 'False' ELSE 'None' END || ' |' AS text FROM scores"))
def referee_comment(spark, d):
    return report.comment(score_band(two_targets(spark, d), "salt"))


@_query(two_sql("SELECT target, string_agg(zone || '=' || coalesce(beats_grid, false), ',' ORDER BY zone) AS beats, string_agg(zone || '=' || printf('%.6f', gain_model), ',' ORDER BY zone) FILTER (WHERE gain_model IS NOT NULL) AS gain FROM scores GROUP BY target"))
def spatial_ranking(spark, d):
    got = report.ranking(score_band(two_targets(spark, d), "salt"))
    text = lambda c, v: f"array_join(transform(map_entries({c}), e -> e.key || '=' || {v}), ',') AS {c}"
    return got.selectExpr("target", text("beats", "CAST(e.value AS STRING)"), text("gain", "format_string('%.6f', e.value)"))


@_query(two_sql("SELECT target, coalesce(string_agg(zone, ',' ORDER BY zone) FILTER (WHERE coalesce(beats_with_margin, false)), '') AS passing, coalesce(string_agg(zone, ',' ORDER BY zone) FILTER (WHERE NOT coalesce(beats_with_margin, false)), '') AS failing FROM scores GROUP BY target"))
def passing_zones(spark, d):
    return report.passing(score_band(two_targets(spark, d), "salt")).select("target", F.array_join("passing", ",").alias("passing"), F.array_join("failing", ",").alias("failing"))


@_query(two_sql("SELECT target, zone, round(coalesce(0.03 - coalesce(gain_debiased_cv, gain_model), 999), 6) AS headroom FROM scores WHERE NOT coalesce(beats_with_margin, false)", zone="CAST(c_nationkey AS VARCHAR)"))
def marginal_cells(spark, d):
    return _round(report.marginal(score_band(two_targets(spark, d, zone="c_nationkey"), "salt")))


@_query(two_sql("SELECT 'v' AS base_variant, 'Cfb' AS zones, '' AS regions, count(*) AS cells FROM scores"))
def live_report(spark, d):
    one = spark.range(1).select(F.lit(0).cast("long").alias("n"))
    got = report.live_report(two_targets(spark, d), "salt", one, {"model_version": "m1"}, variant="v", zones=["Cfb"])
    return got.select("base_variant", F.array_join("zones", ",").alias("zones"), F.array_join("regions", ",").alias("regions"), F.size("by_target").cast("long").alias("cells"))


@_query("""WITH r AS (SELECT c_custkey AS report_id FROM customer) SELECT report_id, 'band_key' AS violation FROM r WHERE report_id % 3 = 0 UNION ALL SELECT report_id, 'version' FROM r WHERE report_id % 4 = 0 UNION ALL SELECT report_id, 'fidelity_check.n' FROM r WHERE report_id % 5 = 0 UNION ALL SELECT report_id, 'cell without n_applied' FROM r WHERE report_id % 7 = 0 UNION ALL SELECT report_id, 'target' FROM r WHERE report_id % 11 = 0""")
def report_violations(spark, d):
    doc = "to_json(named_struct('report_schema_version', IF(c_custkey % 4 = 0, 2, 1), 'model_version', 'm', 'band_key', IF(c_custkey % 3 = 0, NULL, 'era5'), 'snapshot_version', 'v', 'sample_requested', 0, 'rows_sampled', 1, 'rows_paired', 1, 'fidelity_check', named_struct('x', 1, 'n', IF(c_custkey % 5 = 0, NULL, 3)), 'by_target', array(named_struct('target', IF(c_custkey % 11 = 0, 'tavg', 'tmax'), 'zone', 'Cfb', 'n_grid', 5, 'n_applied', IF(c_custkey % 7 = 0, NULL, 5))))) AS document"
    return report.report_violations(_t(spark, d, "customer").selectExpr("c_custkey AS report_id", doc))


@_query("""WITH l AS (SELECT event_id AS line, event_type AS author FROM events WHERE event_id % 3 = 0), b AS (SELECT author, count(*) AS n, min(line) AS f FROM l GROUP BY author), r AS (SELECT author, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM b)
SELECT '| rank | author | starts |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || rank || ' | ' || author || ' | ' || n || ' |', chr(10) ORDER BY rank) AS markdown FROM r""")
def leaderboard_markdown(spark, d):
    starts = _t(spark, d, "events").selectExpr("user_id AS cell", "event_id AS line", "IF(event_id % 3 = 0, 'tenure_start', 'note') AS event", "event_type AS author", "'2026-01' AS start_month")
    return ledger.leaderboard_documents(ledger.leaderboard(starts), ledger.active_tenures(starts).select("cell", "author", "start_month")).select("markdown")
