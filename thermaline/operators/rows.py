"""Row construction: hourly to daily, shifted joins, holdouts, samples, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import doy_trig, finite, local_day, log_population


def daily_extremes(hourly: DataFrame) -> DataFrame:
    """hourly: station_id, ts, zone_name, t. Extremes of local days that have all 24 hours."""
    local = F.from_utc_timestamp("ts", F.col("zone_name"))
    got = hourly.where("t IS NOT NULL").groupBy("station_id", F.to_date(local).alias("day")).agg(F.max("t").alias("tmax"), F.min("t").alias("tmin"), F.countDistinct(F.hour(local)).alias("hours"))
    return got.where("hours = 24").drop("hours")


def daily_humidity(hourly: DataFrame) -> DataFrame:
    """Mean specific humidity of local days from six to six, of the rows that have both inputs (e and p in hPa)."""
    q = F.try_divide(0.622 * F.col("e"), F.col("p") - 0.378 * F.col("e"))
    return hourly.select("station_id", local_day(F.col("ts"), F.col("zone_name")).alias("day"), q.alias("q")).where("q IS NOT NULL").groupBy("station_id", "day").agg(F.avg("q").alias("q"))


def night_wind(hourly: DataFrame) -> DataFrame:
    """Mean wind of local hours 18 to 5, with 12 distinct hours and 12 valid values; flagged fallback values don't count."""
    local = F.from_utc_timestamp("ts", F.col("zone_name"))
    night = hourly.withColumn("h", F.hour(local)).where("h >= 18 OR h < 6").withColumn("day", local_day(F.col("ts"), F.col("zone_name")))
    ok = finite(F.col("wind")) & ~F.coalesce("is_fallback", F.lit(False))
    got = night.groupBy("station_id", "day").agg(F.avg(F.when(ok, F.col("wind"))).alias("wind"), F.countDistinct(F.when(ok, F.col("h"))).alias("hours"), F.count(F.when(ok, 1)).alias("n"))
    return got.where("hours >= 12 AND n >= 12").select("station_id", "day", "wind")


def shifted_join(obs: DataFrame, grid: DataFrame, shifts: DataFrame) -> DataFrame:
    """obs joined to the grid's day that lies `shift` days from it; an equality after projection."""
    moved = obs.join(shifts, "station_id").withColumn("grid_day", F.expr("date_add(day, shift)"))
    return moved.join(grid.withColumnRenamed("day", "grid_day"), ["station_id", "grid_day"])


def holdout(stations: DataFrame, share: float = 0.15) -> DataFrame:
    """station_id, zone of those held out: the least md5 of a zone, round half even of the share, one at least."""
    w = Window.partitionBy("zone")
    k = F.row_number().over(w.orderBy(F.md5(F.col("station_id").cast("string")), "station_id"))
    n = F.greatest(F.lit(1), F.bround(F.lit(share) * F.count("*").over(w)))
    return stations.distinct().withColumns({"_k": k, "_n": n}).where("_k <= _n").select("station_id", "zone")


def nearest_to_centre(stations: DataFrame, k: int) -> DataFrame:
    """The k stations nearest to the mean position, in squared degrees."""
    centre = stations.agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))
    d = F.pow(F.col("lat") - F.col("_lat"), 2) + F.pow(F.col("lon") - F.col("_lon"), 2)
    return stations.join(F.broadcast(centre), how="cross").orderBy(F.round(d, 9), "station_id").limit(k).select("station_id", "lat", "lon")  # one row


def chunks(stations: DataFrame, degrees: float) -> DataFrame:
    """Grid cells of a size: members and bounds."""
    return stations.groupBy(F.floor(F.col("lon") / degrees).alias("cell_x"), F.floor(F.col("lat") / degrees).alias("cell_y")).agg(F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def round_robin(stations: DataFrame, degrees: float, n: int) -> DataFrame:
    """A sample that takes one station from each cell in turn. Order within a turn is by cell, so the set isn't that of a
    cursor that skips on."""
    x, y = F.floor(F.col("lon") / degrees), F.floor(F.col("lat") / degrees)
    turn = F.row_number().over(Window.partitionBy("cell_x", "cell_y").orderBy(F.desc("station_id")))
    return stations.withColumns({"cell_x": x, "cell_y": y}).withColumn("turn", turn).orderBy("turn", "cell_x", "cell_y").limit(n).select("station_id", "turn")


def features(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the derived features, the names of those that are null, and whether the row is complete; nothing is imputed."""
    s, c = doy_trig(F.col("date"))
    got = rows.withColumns({"doy_sin": s, "doy_cos": c, "log_population": log_population(F.col("population")), "aspect_sin": F.sin(F.radians("aspect")), "aspect_cos": F.cos(F.radians("aspect")), "diurnal_range": F.col("grid_tmax") - F.col("grid_tmin")})
    missing = F.array_compact(F.array(*[F.when(F.col(x).isNull(), F.lit(x)) for x in columns]))
    return got.withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns])


def date_chunks(span: DataFrame, days: int) -> DataFrame:
    """span: first, last. Contiguous pieces of `days` days at most."""
    start = F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {days} DAYS")))
    return span.select("last", start.alias("start")).select("start", F.least(F.date_add("start", days - 1), F.col("last")).alias("end"))


def regions(rows: DataFrame, prefixes: list[str], exclude: bool = False) -> DataFrame:
    """Rows whose station_id starts with one of the prefixes, or with none of them; null ids are in neither."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.col("station_id").startswith(p)
    return rows.where(~found if exclude else found)


def bounds(stations: DataFrame, pad: float) -> DataFrame:
    """The padded bounding box and the mean position; one row, of nulls for an empty table."""
    return stations.agg(*[(f(c) + s * pad).alias(n) for f, c, s, n in ((F.min, "lat", -1, "south"), (F.max, "lat", 1, "north"), (F.min, "lon", -1, "west"), (F.max, "lon", 1, "east"))], F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def column_moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column, as mean_c and std_c."""
    return rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def first_outside(stations: DataFrame, held_out: DataFrame) -> DataFrame:
    """The first station_id that isn't held out."""
    return stations.join(held_out, "station_id", "left_anti").agg(F.min("station_id").alias("station_id"))


def common_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct days of both."""
    return a.select("day").intersect(b.select("day"))


def density(stations: DataFrame, attributes: DataFrame) -> DataFrame:
    """stations with the density of their attributes (name, population, area_km2); NULL without an area or a match."""
    area = F.nullif(F.col("area_km2"), F.lit(0.0))
    return stations.join(attributes.select("name", F.try_divide("population", area).alias("density")), "name", "left")


#: Columns of a fetched day: the band's value, or the reference's where the band has none.
FIELDS = (("grid_specific_humidity_kgkg", "humidity_source"), ("nighttime_wind_ms", "wind_source"))
COVERAGE_FLOOR = "2021-03-01"  # Fixed value: the first day of the lead archive.


def fetched(export: DataFrame, days: DataFrame, band: str, base_source: str, base_model: str | None, snapshot: str) -> DataFrame:
    """export rows joined to the fetched days (station_id, date, tmax, tmin and FIELDS): both temperatures are the band's, and
    of each other field its source says whether it is the band's or the reference's."""
    d = days.select("station_id", "date", "tmax", "tmin", *[F.col(c).alias(f"_{c}") for c, _ in FIELDS])
    got = export.join(d, ["station_id", "date"]).where("tmax IS NOT NULL AND tmin IS NOT NULL")
    sources = {s: F.when(F.col(f"_{c}").isNotNull(), "band").otherwise("era5_fallback") for c, s in FIELDS}
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c, _ in FIELDS}
    got = got.withColumns(sources | values | {"grid_tmax_c": F.col("tmax"), "grid_tmin_c": F.col("tmin"), "band": F.lit(band), "base_source": F.lit(base_source), "base_model": F.lit(base_model).cast("string"), "snapshot_version": F.lit(snapshot)})
    return got.drop("tmax", "tmin", *[f"_{c}" for c, _ in FIELDS])


def reference_band(export: DataFrame, snapshot: str) -> DataFrame:
    """The reference band, whose values the export has already; deltas aren't part of it."""
    marks = {"band": "era5", "base_source": "era5_land_cds", "humidity_source": "band", "wind_source": "band", "snapshot_version": snapshot}
    return export.drop("delta_tmax_c", "delta_tmin_c").withColumns({k: F.lit(v) for k, v in marks.items()} | {"base_model": F.lit(None).cast("string")})


def regrid(rows: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows on another grid, and the pairs that fidelity needs: one join, two projections. Humidity and wind are replaced
    where the other grid has them; days without both temperatures go."""
    d = days.select("station_id", "date", "tmax", "tmin", *[F.col(c).alias(f"_{c}") for c, _ in FIELDS])
    met = rows.join(d, ["station_id", "date"]).where("tmax IS NOT NULL AND tmin IS NOT NULL")
    paired = met.withColumns({"grid_tmax_c": F.col("tmax"), "grid_tmin_c": F.col("tmin")} | {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c, _ in FIELDS})
    ok = finite(F.col("grid_tmax_c")) & finite(F.col("grid_tmin_c")) & finite(F.col("tmax")) & finite(F.col("tmin"))
    return paired.select(*rows.columns), met.where(ok).select("station_id", "date", F.col("grid_tmax_c").alias("era5_tmax"), F.col("grid_tmin_c").alias("era5_tmin"), F.col("tmax").alias("nrt_tmax"), F.col("tmin").alias("nrt_tmin"))


def after_floor(rows: DataFrame, first: str = COVERAGE_FLOOR) -> DataFrame:
    return rows.where(F.col("date") >= F.lit(first).cast("date"))


def lead(hourly: DataFrame, n: int) -> DataFrame:
    """Hourly columns of a lead, named c_previous_dayN, under their plain names; other leads' columns go."""
    tail = f"_previous_day{n}"
    return hourly.select(*[c for c in hourly.columns if "_previous_day" not in c and c + tail not in hourly.columns], *[F.col(c).alias(c.removesuffix(tail)) for c in hourly.columns if c.endswith(tail)])


def daily(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """hourly: station_id, ts, zone_name, t, e, p, wind, is_fallback. Days with all extremes, and what humidity and wind
    there is of them."""
    return daily_extremes(hourly).join(daily_humidity(hourly), ["station_id", "day"], "left").join(night_wind(hourly), ["station_id", "day"], "left")


def merge_chunks(chunks_: DataFrame, order: str) -> DataFrame:
    """Days that several chunks bring (station_id, date): the one of the last chunk by `order` holds."""
    rest = [c for c in chunks_.columns if c not in ("station_id", "date", order)]
    return chunks_.groupBy("station_id", "date").agg(F.max_by(F.struct(*rest), order).alias("r")).select("station_id", "date", "r.*")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows of new in place of those of equal keys; of equal keys in new any one."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def update_column(table: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The table with a column's new values (station_id, date, column), where there is one."""
    new = values.select("station_id", "date", F.col(column).alias("_new")).dropDuplicates(["station_id", "date"])
    return table.join(new, ["station_id", "date"], "left").withColumn(column, F.coalesce("_new", column)).select(*table.columns)


def with_covariates(rows: DataFrame, covariates: list[DataFrame]) -> DataFrame:
    """rows with the columns of each covariate frame (station_id, ...); what a station lacks is null."""
    for c in covariates:
        rows = rows.join(c, "station_id", "left")
    return rows


def active(inventory: DataFrame, stations: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Inventory rows of active stations, and with wanted (station_id) those of them alone, and the wanted that aren't there."""
    got = inventory.join(stations.select("station_id"), "station_id", "left_semi")
    return (got, None) if wanted is None else (got.join(wanted, "station_id", "left_semi"), wanted.distinct().join(got, "station_id", "left_anti"))


def within(stations: DataFrame, south: float, north: float, west: float, east: float, half_degrees: float | None = None) -> DataFrame:
    """Stations of a box, and with half_degrees those that lie within it of their mean longitude and latitude."""
    got = stations.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if half_degrees is None:
        return got
    centre = got.agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))
    near = (F.abs(F.col("lat") - F.col("_lat")) <= half_degrees) & (F.abs(F.col("lon") - F.col("_lon")) <= half_degrees)
    return got.join(F.broadcast(centre), how="cross").where(near).select(*stations.columns)  # one row


def by_country(stations: DataFrame) -> DataFrame:
    """Stations counted by the two letters of their country and by zone, with their ids in order."""
    return stations.groupBy(F.substring("station_id", 1, 2).alias("country"), "zone").agg(F.count("*").alias("n"), F.min("station_id").alias("first"), F.max("station_id").alias("last"))


def first_rows(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each station by `order`."""
    rest = [c for c in rows.columns if c != "station_id"]
    return rows.groupBy("station_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("station_id", "r.*")


def resume_key(stations: DataFrame) -> DataFrame:
    """Ten digits of the sha1 of the sorted ids, which names an unfinished job. The ids of one job meet here."""
    return stations.agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_set("station_id")), ",")), 1, 10).alias("key"))


def squares(stations: DataFrame, half_degrees: float) -> DataFrame:
    """A square around each station as a GeoJSON feature."""
    corner = lambda x, y: F.array(F.round(F.col("lon") + x * half_degrees, 6), F.round(F.col("lat") + y * half_degrees, 6))
    ring = F.array(F.array(*[corner(x, y) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("station_id").alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    return stations.select("station_id", F.to_json(feature).alias("feature"))


def to_fetch(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of work that no checkpoint has."""
    return wanted.join(done, keys, "left_anti")


def replay(done: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What checkpoints hold of the pieces asked for now, and of no others."""
    return done.join(wanted.select(*keys).distinct(), keys, "left_semi")
