"""The snapshot: its tables and their schemas, the manifest that pins them, and the list of held-out stations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BANDS, manifest, verify, write_partitions

# Columns of band rows and of frozen predictions.
STATIC = ("lst_warm_season_anomaly_c", "canopy_height_mean_m", "canopy_frac_over_3m", "wc_built_frac", "wc_tree_frac", "wc_water_frac", "ghsl_urban_fraction", "pop_density_per_km2", "elevation_rel_to_gridcell_m", "elevation_mean_m", "slope_deg", "aspect_deg")
ROWS = (
    "station_id string, date date, station_tmax_c double, station_tmin_c double, grid_tmax_c double, grid_tmin_c double, grid_specific_humidity_kgkg double, nighttime_wind_ms double, base_source string, base_model string, humidity_source string, wind_source string, "
    "lon double, lat double, elevation_m double, region string, climate_zone string, koppen_main_group_code smallint, obs_window_shift_days smallint, " + ", ".join(f"{c} double" for c in STATIC) + ", pop_density_source string, pop_density_buffer_deg double, lst_reference_radius_km double, snapshot_version string"
)
PREDICTIONS = "station_id string, date date, target string, delta_c double, ci95_c double, confidence string, applied boolean, out_of_distribution boolean, covariates_missing string, cv_gate_passed boolean"
STATIONS = "station_id string, lon double, lat double, elevation_m double, region string, climate_zone string, koppen_main_group_code smallint"
MANIFEST = "schema_version int, snapshot_version string, generating_commit string, package_version string, partitions array<struct<file:string,sha256:string,bytes:bigint,rows:bigint>>, license string, release_url string, doi_url string"
VERSION = 1


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, cast; those that df lacks are null."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows with a column band, by band and month, sorted by station and day."""
    write_partitions(typed(rows, ROWS + ", band string").withColumn("month", F.date_format("date", "yyyy-MM")), f"{path}/bands", ["band", "month"], ["station_id", "date"])


def read_rows(spark: SparkSession, path: str, band: str, months: list[str] | None = None) -> DataFrame:
    """Rows of a band; months that aren't there give no rows."""
    if band not in BANDS:
        raise ValueError(f"unknown band {band}")
    got = spark.read.schema(ROWS + ", band string, month string").parquet(f"{path}/bands").where(F.col("band") == band)
    return got.where(F.col("month").isin(months)) if months is not None else got


def months(spark: SparkSession, path: str, band: str) -> DataFrame:
    """The months of a band, from the names of its partitions."""
    return read_rows(spark, path, band).select("month").distinct()


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Frozen predictions by model, band and month; covariates_missing is written as a JSON list."""
    missing = F.to_json(F.coalesce("covariates_missing", F.array().cast("array<string>")))
    got = predictions.withColumn("covariates_missing", missing)
    write_partitions(typed(got, PREDICTIONS + ", model_version string, band string").withColumn("month", F.date_format("date", "yyyy-MM")), f"{path}/predictions", ["model_version", "band", "month"], ["station_id", "date", "target"])


def read_predictions(spark: SparkSession, path: str, model_version: str, band: str, months: list[str] | None = None) -> DataFrame:
    got = spark.read.schema(PREDICTIONS + ", model_version string, band string, month string").parquet(f"{path}/predictions").where((F.col("model_version") == model_version) & (F.col("band") == band))
    got = got.where(F.col("month").isin(months)) if months is not None else got
    return got.withColumn("covariates_missing", F.from_json("covariates_missing", "array<string>"))


def write_stations(stations: DataFrame, path: str) -> None:
    """The station dimension: one sorted file."""
    typed(stations, STATIONS).coalesce(1).sortWithinPartitions("station_id").write.mode("overwrite").parquet(f"{path}/stations")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATIONS).parquet(f"{path}/stations")


def write_holdout(stations: DataFrame, path: str) -> None:
    """The sorted ids, one JSON list."""
    stations.agg(F.to_json(F.sort_array(F.collect_set("station_id"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/holdout")


def read_holdout(spark: SparkSession, path: str) -> DataFrame | None:
    """station_id of those held out; None, not an empty frame, where the list isn't published."""
    try:
        text = spark.read.text(f"{path}/holdout", wholetext=True)
    except AnalysisException:
        return None
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("station_id"))


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, bytes and rows of each file of bands and predictions."""
    parts = []
    for name in ("bands", "predictions"):
        try:
            files = manifest(spark, f"{path}/{name}")
            counted = spark.read.parquet(f"{path}/{name}").select(F.regexp_extract(F.input_file_name(), r"([^/]+=[^/]+/.*|[^/]+)$", 1).alias("f")).groupBy("f").agg(F.count("*").alias("rows"))
            parts.append(files.join(counted, F.col("file") == F.col("f"), "left").select(F.concat(F.lit(f"{name}/"), "file").alias("file"), "sha256", "bytes", F.coalesce("rows", F.lit(0)).cast("long").alias("rows")))
        except AnalysisException:
            continue
    if not parts:
        raise ValueError(f"no tables below {path}")
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def write_manifest(spark: SparkSession, path: str, snapshot_version: str, commit: str, package_version: str, license: str) -> str:
    """Writes the manifest as one JSON text and gives its sha256, which a submission pins. A row for each file meets here."""
    listed = partitions(spark, path).agg(F.sort_array(F.collect_list(F.struct("file", "sha256", "bytes", "rows"))).alias("partitions"))
    head = {"schema_version": VERSION, "snapshot_version": snapshot_version, "generating_commit": commit, "package_version": package_version}
    text = listed.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in head.items()], "partitions", F.lit(license).alias("license"))).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest_sha256(spark, path)


def manifest_sha256(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/manifest", wholetext=True).select(F.sha2(F.regexp_replace("value", "\n$", ""), 256)).first()[0]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row, with the list of partitions."""
    return spark.read.text(f"{path}/manifest", wholetext=True).select(F.from_json("value", MANIFEST).alias("m")).select("m.*")


def verify_snapshot(spark: SparkSession, path: str, pinned: str) -> DataFrame:
    """file and violation. A manifest of another hash is the only violation then: its list says nothing."""
    if manifest_sha256(spark, path) != pinned:
        return spark.createDataFrame([("manifest", "differs")], "file string, violation string")
    return verify(read_manifest(spark, path).select(F.inline("partitions")), partitions(spark, path))


def sample_csv(rows: DataFrame, held_out: DataFrame, path: str) -> None:
    """All bands' rows of the first station that isn't held out, by band and day, as one CSV file with a header."""
    first = rows.select("station_id").join(held_out, "station_id", "left_anti").agg(F.min("station_id").alias("station_id"))
    rows.join(F.broadcast(first), "station_id", "left_semi").coalesce(1).sortWithinPartitions("band", "date").write.mode("overwrite").option("header", True).csv(path)


def read_dump(spark: SparkSession, path: str, schema: str, band: str | None = None) -> DataFrame:
    """Rows of JSON documents, each a list or an object with a list `rows`; with band a column of that name."""
    one = f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in schema.split(','))}>>"
    text = spark.read.text(path, wholetext=True)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", one)).otherwise(F.from_json("value", f"struct<rows:{one}>")["rows"])
    got = text.select(F.inline(rows))
    return got.withColumn("band", F.lit(band)) if band else got


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of gzipped JSON lines; an error where there are no parts."""
    try:
        return spark.read.schema(schema).json(f"{path}/*.jsonl.gz")
    except AnalysisException as e:
        raise ValueError(f"no export parts in {path}") from e


def read_series(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """station_id, date, value of zipped series files: members named *_STAID<number>.txt whose lines have five fields, a
    number first, a day, a value in tenths and a quality of 0; -9999 is none. One task a zip file."""
    import io
    import re
    import zipfile

    import pandas as pd

    def lines(batches):
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if m := re.search(r"STAID0*(\d+)\.txt$", name):
                            yield pd.DataFrame({"station_id": m[1], "text": z.read(name).decode("latin-1").splitlines()})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "station_id string, text string")
    f = F.split("text", r"\s*,\s*")
    got = raw.where((F.size(f) == 5) & F.trim(f[0]).rlike("^[0-9]+$") & (F.trim(f[4]) == "0")).select("station_id", F.expr("try_to_date(trim(split(text, ',')[2]), 'yyyyMMdd')").alias("date"), F.try_divide(F.trim(f[3]).try_cast("double"), F.lit(10.0)).alias("value"))
    return got.where((F.col("value") != -999.9) & F.col("date").between(first, last))


def pair_series(tx: DataFrame, tn: DataFrame) -> DataFrame:
    """Days that both series of a station have."""
    return tx.withColumnRenamed("value", "tmax").join(tn.withColumnRenamed("value", "tmin"), ["station_id", "date"])
