"""Parsing of free-form fields as Column expressions; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that speak for and against petroleum.
OIL_KEYWORDS = [
    "oil", "crude", "diesel", "petrol", "gasoline", "bunker", "fuel", "hydraulic", "lube", "condensate", "naphtha", "kerosene", "jet a", "bilge", "sheen", "tar", "asphalt", "bitumen", "hfo", "ifo",
]
NON_OIL_KEYWORDS = [
    "vegetable oil", "palm oil", "soybean", "canola", "corn oil", "fish oil", "molasses", "sulfuric", "caustic", "ammonia", "fertilizer", "coal", "plastic", "container", "chemical only",
]
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "MM/dd/yyyy HH:mm")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def is_petroleum(commodity: Column, name: Column) -> Column:
    """No word against petroleum, and one for it."""
    text = F.lower(F.concat_ws(" ", F.coalesce(commodity, F.lit("")), F.coalesce(name, F.lit(""))))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return ~has(NON_OIL_KEYWORDS) & has(OIL_KEYWORDS)


def to_timestamp(text: Column) -> Column:
    text = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS), F.try_to_timestamp(text))


def to_date(text: Column) -> Column:
    """The day of a date in any of the known forms, at midnight; time of day is left off."""
    day = F.substring(F.trim(text), 1, 10)
    return F.coalesce(*(F.try_to_timestamp(day, F.lit(f)) for f in DATE_FORMATS), F.date_trunc("day", F.try_to_timestamp(F.trim(text))))


def to_number(text: Column) -> Column:
    """A finite number, thousands separators allowed."""
    x = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def plain_number(text: Column) -> Column:
    """A number of digits with at most one point and one minus, as radio fields carry them."""
    return F.when(F.trim(text).rlike(r"^-?[0-9]*\.?[0-9]+$|^-?[0-9]+\.$"), F.trim(text).try_cast("double"))


def scene_time(name: Column) -> Column:
    """Noon of the day (or the month's first) that a file name's digits give."""
    digits = F.regexp_replace(name, "[^0-9]", "")
    day = F.coalesce(F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")), F.try_to_timestamp(F.substring(digits, 1, 6), F.lit("yyyyMM")))
    return day + F.expr("INTERVAL 12 HOURS")


def product_prefix(name: Column) -> Column:
    """Object-store prefix of a radar product from its name: mission product / year / month / day / mode / polarisation / name."""
    pattern = r"^S1[A-C]_(\w{2})_(\w{4})_\w{2}(\w{2})_(\d{4})(\d{2})(\d{2})T"
    part = lambda k: F.regexp_extract(name, pattern, k)
    path = F.concat_ws("/", F.substring(part(2), 1, 3), part(4), part(5).cast("int").cast("string"), part(6).cast("int").cast("string"), part(1), part(3), name)
    return F.when(name.rlike(pattern), path)


def day_url(base: str, day: Column) -> Column:
    """A daily file below a base address."""
    return F.concat(F.lit(f"{base.rstrip('/')}/aisdk-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".zip"))


def wkt_polygon(ring: Column) -> Column:
    """WKT of array<struct<lon, lat>>; fewer than four points are an empty polygon."""
    points = F.array_join(F.transform(ring, lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"])), ", ")
    return F.when(F.size(ring) >= 4, F.concat(F.lit("POLYGON (("), points, F.lit("))"))).otherwise("POLYGON EMPTY")


def parse_wkt(wkt: Column) -> Column:
    """array<struct<lon, lat>> of a polygon's WKT."""
    pairs = F.split(F.regexp_replace(wkt, r"^POLYGON \(\(|\)\)$", ""), ", ")
    ring = F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(" "), F.lit(1)).cast("double").alias("lon"), F.split_part(p, F.lit(" "), F.lit(2)).cast("double").alias("lat")))
    return F.when(wkt.startswith("POLYGON (("), ring)


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring."""
    sides = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.filter(sides, lambda s: ((s["a"]["lat"] > lat) != (s["b"]["lat"] > lat)) & (lon < (s["b"]["lon"] - s["a"]["lon"]) * (lat - s["a"]["lat"]) / (s["b"]["lat"] - s["a"]["lat"]) + s["a"]["lon"]))
    return F.size(crossed) % 2 == 1


def vertex_centroid(ring: Column) -> Column:
    """struct(lon, lat): the mean of a ring's corners; a closing point that repeats the first doesn't count."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    corners = F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    mean = lambda x: F.aggregate(corners, F.lit(0.0), lambda a, p: a + p[x]) / F.size(corners)
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))
