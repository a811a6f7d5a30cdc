"""Column expressions; every comparison of doubles that decides something goes through lt() or ge()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
EARTH_KM = 6371.0088


def _compare(a: Column, b: Column, result: Column) -> Column:
    """NULL with a NULL side, false with a NaN side: the engine itself would order NaN above all numbers."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(result)


def lt(a: Column, b: Column) -> Column:
    return _compare(a, b, a < b)


def ge(a: Column, b: Column) -> Column:
    return _compare(a, b, a >= b)


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def fold(station: Column, salt: str, folds: int = FOLDS) -> Column:
    """md5 of salt:station as a number, modulo folds; a null station is the text None. Digits are taken in 8-digit chunks."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(station.cast("string"), F.lit("None"))))
    rest = F.lit(0).cast("long")
    for i in range(4):
        chunk = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        rest = (rest * ((1 << 32) % folds) + chunk) % folds
    return rest.cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def doy_trig(date: Column) -> tuple[Column, Column]:
    angle = 2 * F.pi() * F.dayofyear(date) / 365.25
    return F.sin(angle), F.cos(angle)


def log_population(c: Column) -> Column:
    return F.when(c >= 0, F.log1p(c))


def latitude_band(lat: Column) -> Column:
    # The bands' upper limits in degrees.
    a = F.abs(lat)
    return F.when(a < 23.5, "tropical").when(a < 35, "arid").when(a < 55, "temperate").when(a < 90, "continental").otherwise("polar")


def zone_group(zone: Column) -> Column:
    """Letter A to E of a zone code, by band label otherwise, C if unknown."""
    letter = F.substring(zone, 1, 1)
    labels = F.create_map(*[F.lit(x) for pair in {"tropical": "A", "arid": "B", "temperate": "C", "continental": "D", "polar": "E"}.items() for x in pair])
    return F.coalesce(F.when(letter.isin(*"ABCDE"), letter).otherwise(F.try_element_at(labels, zone)), F.lit("C"))


def confidence(ci: Column, out_of_distribution: Column) -> Column:
    return F.when(ci.isNull() | F.coalesce(out_of_distribution, F.lit(False)), "low").when(ci <= 1.0, "high").when(ci <= 2.5, "medium").otherwise("low")


def dms_degrees(text: Column) -> Column:
    """[-]d:m:s as degrees; the sign is the text's."""
    part = F.split(F.regexp_replace(F.trim(text), "^[+-]", ""), ":")
    size = part[0].cast("double") + part[1].cast("double") / 60 + part[2].cast("double") / 3600
    return F.when(F.trim(text).startswith("-"), -size).otherwise(size)


def local_day(ts: Column, zone: Column, hours: int = 6) -> Column:
    """The local day that starts at `hours` o'clock."""
    return F.to_date(F.from_utc_timestamp(ts, zone) - F.expr(f"INTERVAL {hours} HOURS"))


def group_ordinal(group: Column) -> Column:
    """0 to 4 for the group letters A to E, NULL for others."""
    return F.nullif(F.instr(F.lit("ABCDE"), F.substring(group, 1, 1)) - 1, F.lit(-1))


def split_id(text: Column) -> tuple[Column, Column]:
    """Month and sequence of an id YYYY-MM-NNN; NULL for other texts."""
    form = r"^(\d{4}-\d{2})-(\d{3})$"
    return F.when(text.rlike(form), F.regexp_extract(text, form, 1)), F.when(text.rlike(form), F.regexp_extract(text, form, 2).cast("int"))


def broken(df: DataFrame, keys: list[str], rules: list[tuple[Column, str]], name: str = "violation") -> DataFrame:
    """keys and the text of each rule whose condition holds, one row each. The list is a column of its own before it is
    exploded: inside a generator the optimizer mixes up fields of structs."""
    listed = df.select(*keys, F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules])).alias("_rules"))
    return listed.where(F.size("_rules") > 0).select(*keys, F.explode("_rules").alias(name))
