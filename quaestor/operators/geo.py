"""Places: points, extents and searches."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.exprs import col, gps, number

# Names of place columns, most wanted first, and words in such names.
PLACE_NAMES = ("_geolocation", "geolocation", "gps", "location", "coordonnees")
PLACE_WORDS = re.compile(r"gps|g[ée]oloc|geopoint|coordonn|localisation", re.IGNORECASE)
LATITUDE, LONGITUDE = re.compile(r"(^|[_/ ])lat(itude)?$", re.IGNORECASE), re.compile(r"(^|[_/ ])(lon|lng|long|longitude)$", re.IGNORECASE)
# From which spread in degrees each map zoom holds.
ZOOMS = ((0.01, 14), (0.05, 12), (0.2, 10), (1.0, 8), (5.0, 6))


def latitude_longitude(names: list[str]) -> tuple[str, str] | None:
    lat, lon = next((n for n in names if LATITUDE.search(n)), None), next((n for n in names if LONGITUDE.search(n)), None)
    return (lat, lon) if lat and lon else None


def place_column(df: DataFrame, sample: int = 20, least: int = 2) -> str | None:
    """The place column by name, else the text column with the most places among ``sample`` rows, ``least`` or more."""
    low = {c.lower(): c for c in reversed(df.columns)}
    if found := next((low[n] for n in PLACE_NAMES if n in low), None) or next((c for c in df.columns if PLACE_WORDS.search(c)), None):
        return found
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return None
    hits = df.select(*map(col, texts)).limit(sample).agg(*[F.count(gps(col(c))).alias(str(k)) for k, c in enumerate(texts)]).first()
    best = max(range(len(texts)), key=lambda k: (hits[k], -k))
    return texts[best] if hits[best] >= least else None


# Patterns of the columns that describe a place, most wanted first, on names without marks in lower case.
CONTEXT = {
    "region": (r"region[_\s\-]?sanit", r"\bregion\b", r"\bprovince\b", r"zone[_\s\-]?admin"),
    "district": (r"district[_\s\-]?sanit", r"\bdistrict\b", r"\bdepartement\b", r"sous[_\s\-]?(region|prefecture)"),
    "aire": (r"aire[_\s\-]?(de[_\s\-]?)?sant", r"aire[_\s\-]?sanit", r"\baire\b", r"\bsecteur\b", r"\blocalite\b", r"\bvillage\b"),
    "superviseur": (r"\bsupervis(eur|euse|ion)?\b", r"supervis"),
    "enqueteur": (r"\benqueteur\b", r"\benquetrice\b", r"agent[_\s\-]?(de[_\s\-]?)?collect", r"\bcollecteur\b", r"\benquet"),
    "date": (r"date[_\s\-]?(de[_\s\-]?)?collect", r"date[_\s\-]?(de[_\s\-]?)?(enquet|interview)", r"^date\b"),
    "zone": (r"zone[_\s\-]?(d['_\s\-])?(habit|resid)", r"zone[_\s\-]?(rural|urbain)", r"\bzone\b", r"\bmilieu\b", r"\burbain\b", r"\brural\b"),
    "start": (r"^start$", r"^heure_debut$", r"^debut$", r"^start_time$"),
    "end": (r"^end$", r"^heure_fin$", r"^fin$", r"^end_time$"),
    "duration": (r"duree_entretien", r"duree_enquete", r"temps_enquete", r"interview_duration", r"survey_duration", r"duree_interview"),
}


def context_columns(names: list[str]) -> dict[str, str]:
    """The column that plays each part of CONTEXT: the first name that the most wanted pattern fits, whatever its marks and case."""
    plain = [("".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)).lower(), n) for n in names]
    found = {part: next((n for p in patterns for low, n in plain if re.search(p, low)), None) for part, patterns in CONTEXT.items()}
    return {part: n for part, n in found.items() if n}


def points(df: DataFrame, place: str | tuple[str, str], context: list[str] = ()) -> DataFrame:
    """(lat, lon, context...) of the rows that have a place; a pair of columns may write decimals with a comma."""
    return _placed(df, place).where("p is not null").select("p.lat", "p.lon", *map(col, context))


def _placed(df: DataFrame, place: str | tuple[str, str]) -> DataFrame:
    if isinstance(place, str):
        return df.withColumn("p", gps(col(place))).withColumn("raw", col(place).isNotNull() & (F.trim(col(place)) != ""))
    lat, lon = (number(F.replace(col(c).cast("string"), F.lit(","), F.lit("."))) for c in place)
    return df.withColumn("p", F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")))).withColumn("raw", col(place[0]).isNotNull() & col(place[1]).isNotNull())


def diagnostics(df: DataFrame, place: str | tuple[str, str]) -> DataFrame:
    """(total, points, empty, unread): rows, rows with a place, without one, and with one that can't be read or is out of range."""
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return _placed(df, place).agg(F.count("*").alias("total"), F.count("p").alias("points"), one(~F.coalesce("raw", F.lit(False))).alias("empty"), one(F.coalesce("raw", F.lit(False)) & F.col("p").isNull()).alias("unread"))


def extent(points: DataFrame) -> DataFrame:
    """(lat, lon, spread, zoom): the mean place, the wider range in degrees, and the zoom for it."""
    spread = F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"))
    zoom = F.lit(5)
    for limit, z in reversed(ZOOMS):
        zoom = F.when(spread < limit, z).otherwise(zoom)
    return points.agg(F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lon"), 5).alias("lon"), F.round(spread, 6).alias("spread"), zoom.alias("zoom"))


def statistics(points: DataFrame) -> DataFrame:
    """Range and mean of places; those on the equator or the meridian of 0 count as errors and are left out."""
    return points.where("lat != 0 and lon != 0").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)], F.round(F.avg("lat"), 5).alias("mean_lat"), F.round(F.avg("lon"), 5).alias("mean_lon"))


def colours(df: DataFrame, name: str, colours: int = 15) -> DataFrame:
    """(value, colour): distinct values in order take the colours in turn."""
    return df.select(col(name).alias("value")).where("value is not null").distinct().withColumn("colour", (F.dense_rank().over(Window.orderBy("value")) - 1) % colours)


def searched(df: DataFrame, text: str | None, fields: list[str], equal: dict[str, str] | None = None, hidden: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows where any field holds the text, whatever the case, the given columns are equal, and none of the hidden values occurs."""
    if text:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(F.lower(col(f)), F.lit(text.lower())), F.lit(False))
        df = df.where(hit)
    for c, v in (equal or {}).items():
        df = df.where(col(c) == v)
    for c, vs in (hidden or {}).items():
        df = df.where(~F.coalesce(col(c).isin(*vs), F.lit(False)))
    return df


def cascade(df: DataFrame, parent: str, value: str, child: str, none: str = "—") -> DataFrame:
    """The distinct children of a parent value, in order, without the sign for none."""
    return df.where((col(parent) == value) & col(child).isNotNull() & (col(child) != none)).select(col(child).alias("value")).distinct().orderBy("value")
