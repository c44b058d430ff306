"""Domain relations over the driver's star-schema tables, by integer arithmetic that any engine repeats exactly.

Each entry: table, filter, expressions. The same expressions build the DataFrame here and the WITH clause of the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PLACE = "{k} % 20", "{k} % 7"


def _lon(k: str, factor: str = "7919") -> str:
    return f"75e0 + ({_PLACE[0].format(k=k)}) * 1e-1 + (({_key(k)} * {factor}) % 1000) / 1e3"


def _lat(k: str) -> str:
    return f"9e0 + ({_PLACE[1].format(k=k)}) * 1e-1 + (({_key(k)} * 104729) % 1000) / 1e3"


def _key(k: str) -> str:
    return "event_id" if k == "user_id" else k


RELATIONS: dict[str, tuple[str, str | None, list[str]]] = {
    "pos": ("events", None, [
        "user_id AS mmsi", "event_id", "ts", f"{_lon('user_id')} AS lon", f"{_lat('user_id')} AS lat", "value / 1e1 AS sog", "CAST((event_id * 37) % 360 AS DOUBLE) AS cog",
        "CASE WHEN event_id % 3 = 0 THEN concat('V', CAST(user_id AS VARCHAR(20))) END AS name", "event_type AS vessel_type",
    ]),
    "slick": ("orders", None, [
        "o_orderkey AS candidate_id", "o_custkey AS scene_id", "o_orderkey % 720 AS obs_hour", f"{_lon('o_orderkey')} AS lon", f"{_lat('o_orderkey')} AS lat", "5e0 + (o_orderkey % 40) AS unc_km",
        "CAST(o_orderkey % 180 AS DOUBLE) AS axis_deg", "1e0 + (o_orderkey % 240) / 1e1 AS elongation", "((o_orderkey * 31) % 97) / 97e0 AS compactness", "((o_orderkey * 17) % 150) / 1e1 AS damping_db",
        "((o_orderkey * 13) % 170) / 1e1 AS wind_ms", "((o_orderkey * 7) % 300) / 1e2 AS area_km2", "((o_orderkey * 11) % 100) / 1e2 AS homogeneity", "((o_orderkey * 19) % 60) * 1e0 AS contrast",
        "CASE WHEN o_orderkey % 3 = 0 THEN ((o_orderkey * 23) % 50) / 1e2 END AS vh_vv",
    ]),
    "incident": ("customer", None, [
        "c_custkey AS incident_id", "c_name AS name", "c_custkey % 45 AS day", "65e0 + ((c_custkey * 7919) % 24000) / 1e3 AS lon", "((c_custkey * 104729) % 18000) / 1e3 AS lat",
        "c_custkey % 29 = 0 AS persistent", "c_custkey % 31 = 0 AS natural_seep", "CASE WHEN c_custkey % 11 = 0 THEN 30e0 ELSE 0e0 END AS duration_days", "c_custkey % 13 = 0 AS undated",
        "CASE c_custkey % 12 WHEN 0 THEN 'crude oil' WHEN 1 THEN 'Diesel' WHEN 2 THEN 'palm oil' WHEN 3 THEN 'bunker fuel' WHEN 4 THEN 'container' WHEN 5 THEN 'hydraulic fluid' WHEN 6 THEN 'caustic soda'"
        " WHEN 7 THEN 'HFO' WHEN 8 THEN 'unknown' WHEN 9 THEN 'sheen' WHEN 10 THEN 'vegetable oil' ELSE 'gasoline' END AS commodity",
        "CASE WHEN c_custkey % 5 <> 0 THEN abs(c_acctbal) END AS gallons", "c_mktsegment AS source",
    ]),
    "wind": ("events", None, ["user_id % 20 AS cell", "ts", "value / 1e1 AS speed", "CAST((event_id * 53) % 360 AS DOUBLE) AS direction"]),
}
#: 2024-01-01 00:00 UTC; observation times are hours from it, incident days count from 17 days before.
EPOCH = "2024-01-01 00:00:00"
#: The present of the queries that ask for one.
NOW = "2024-01-20 00:00:00"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain relation as a DataFrame."""
    table, where, columns = RELATIONS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return (df.where(where) if where else df).selectExpr(*(c.replace("VARCHAR(20)", "STRING") for c in columns))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, r, c, db): every embedding is an 8 x 8 tile of a mosaic 25 tiles wide; r and c are mosaic coordinates."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    flat = e.selectExpr("vec_id AS tile", "posexplode(embedding) AS (i, v)")
    return flat.selectExpr("tile", "i", "CAST(tile DIV 25 AS INT) * 8 + i DIV 8 AS r", "CAST(tile % 25 AS INT) * 8 + i % 8 AS c", "-17e0 + 1e1 * CAST(v AS DOUBLE) AS db").withColumns({"r": _bigint("r"), "c": _bigint("c")})


def _bigint(name: str):
    from pyspark.sql import functions as F

    return F.col(name).cast("long")


# Catalogued fixed sources (name, lon, lat, kind, radius km).
KNOWN_SOURCES = [
    ("Taylor Energy MC-20", -88.970, 28.936, "infrastructure", 15.0),
    ("Coal Oil Point seep field", -119.883, 34.391, "natural_seep", 12.0),
    ("Campeche Bay seeps", -92.200, 19.700, "natural_seep", 40.0),
    ("MSC ELSA 3 wreck", 76.136, 9.3125, "infrastructure", 10.0),
]
# Ports (name, flag, lon, lat).
PORTS = [
    ("Kochi", "IN", 76.267, 9.966),
    ("Vizhinjam", "IN", 76.983, 8.378),
    ("Thiruvananthapuram", "IN", 76.950, 8.487),
    ("Kollam", "IN", 76.580, 8.893),
    ("Beypore", "IN", 75.803, 11.170),
    ("New Mangalore", "IN", 74.802, 12.922),
    ("Mormugao", "IN", 73.803, 15.408),
    ("Jawaharlal Nehru (Nhava Sheva)", "IN", 72.949, 18.949),
    ("Mumbai", "IN", 72.842, 18.944),
    ("Kandla", "IN", 70.216, 23.017),
    ("Mundra", "IN", 69.703, 22.839),
    ("Tuticorin", "IN", 78.150, 8.755),
    ("Chennai", "IN", 80.300, 13.100),
    ("Colombo", "LK", 79.842, 6.951),
    ("Galle", "LK", 80.217, 6.033),
    ("Male", "MV", 73.509, 4.175),
    ("Salalah", "OM", 54.005, 16.940),
    ("Jebel Ali", "AE", 55.027, 25.011),
    ("Karachi", "PK", 66.975, 24.815),
    ("Chattogram", "BD", 91.804, 22.316),
    ("Port Klang", "MY", 101.392, 3.000),
    ("Singapore", "SG", 103.822, 1.264),
]


def known_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_SOURCES, "source_name string, source_lon double, source_lat double, source_kind string, radius_km double")


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{n} ({f})", x, y) for n, f, x, y in PORTS], "port string, port_lon double, port_lat double")
