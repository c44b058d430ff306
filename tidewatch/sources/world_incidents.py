"""Documented spills and lasting leaks around the world, as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, name, lon, lat, date, commodity, persistent, natural, days of release (0: one event or unknown).
WORLD_INCIDENTS = [
    ("msc-elsa-3", "MSC ELSA 3 sinking", 76.136, 9.3125, "2025-05-25", "furnace oil and diesel", False, False, 30),
    ("wakashio", "MV Wakashio grounding", 57.665, -20.435, "2020-07-25", "very low sulphur fuel oil", False, False, 0),
    ("x-press-pearl", "X-Press Pearl fire and sinking", 79.783, 6.983, "2021-05-20", "fuel oil and chemicals", False, False, 0),
    ("mumbai-2010", "MSC Chitra / MV Khalijia collision", 72.833, 18.883, "2010-08-07", "fuel oil", False, False, 0),
    ("ennore-2017", "Ennore oil spill", 80.333, 13.233, "2017-01-28", "heavy fuel oil", False, False, 0),
    ("taylor-mc20", "Taylor Energy MC-20", -88.970, 28.936, "2004-09-16", "crude oil", True, False, 0),
    ("coal-oil-point", "Coal Oil Point seep field", -119.883, 34.391, "1900-01-01", "natural crude seep", True, True, 0),
    ("campeche-seeps", "Campeche Bay natural seeps", -92.200, 19.700, "1900-01-01", "natural crude seep", True, True, 0),
    ("deepwater-horizon", "Deepwater Horizon", -88.366, 28.738, "2010-04-20", "crude oil", False, False, 87),
    ("prestige", "Prestige tanker sinking", -9.500, 42.200, "2002-11-13", "heavy fuel oil", False, False, 0),
    ("erika", "Erika tanker breakup", -4.250, 47.167, "1999-12-12", "heavy fuel oil", False, False, 0),
    ("sanchi", "Sanchi tanker collision", 124.950, 28.380, "2018-01-06", "condensate and bunker fuel", False, False, 0),
    ("exxon-valdez", "Exxon Valdez", -146.883, 60.840, "1989-03-24", "crude oil", False, False, 0),
    ("gulf-war", "Gulf War oil spill", 48.500, 28.500, "1991-01-19", "crude oil", False, False, 0),
    ("niger-delta", "Niger Delta chronic pollution", 6.500, 4.500, "1970-01-01", "crude oil", True, False, 0),
    ("bohai-2011", "Penglai 19-3 platform leak", 120.100, 38.400, "2011-06-04", "crude oil", False, False, 0),
    ("montara", "Montara wellhead blowout", 124.533, -12.683, "2009-08-21", "crude oil and condensate", False, False, 74),
    ("agia-zoni", "Agia Zoni II sinking", 23.583, 37.933, "2017-09-10", "fuel oil", False, False, 0),
    ("kerch-2007", "Volgoneft-139 breakup", 36.633, 45.283, "2007-11-11", "fuel oil", False, False, 0),
    ("principe-2024", "Trinidad Gulfstream barge spill", -61.450, 10.100, "2024-02-07", "fuel oil", False, False, 0),
    ("amoco-cadiz", "Amoco Cadiz grounding", -4.767, 48.583, "1978-03-16", "crude oil", False, False, 0),
    ("sea-empress", "Sea Empress grounding", -5.100, 51.683, "1996-02-15", "crude oil", False, False, 0),
    ("braer", "Braer grounding", -1.283, 59.883, "1993-01-05", "crude oil", False, False, 0),
    ("haven-1991", "Haven tanker explosion", 8.750, 44.383, "1991-04-11", "crude oil", False, False, 0),
    ("lebanon-2006", "Jiyeh power station spill", 35.400, 33.650, "2006-07-13", "fuel oil", False, False, 0),
    ("rena-nz", "MV Rena grounding", 176.433, -37.533, "2011-10-05", "heavy fuel oil", False, False, 0),
    ("baltic-butinge", "Butinge terminal releases", 21.050, 56.033, "2001-11-01", "crude oil", False, False, 0),
    ("tricolor", "MV Tricolor sinking", 1.900, 51.150, "2002-12-14", "bunker fuel", False, False, 0),
    ("hebei-spirit", "Hebei Spirit collision", 126.050, 36.900, "2007-12-07", "crude oil", False, False, 0),
    ("dalian-2010", "Dalian pipeline explosion", 121.900, 38.950, "2010-07-16", "crude oil", False, False, 0),
    ("qingdao-2013", "Huangdao pipeline blast", 120.200, 36.000, "2013-11-22", "crude oil", False, False, 0),
    ("singapore-2017", "Agile / Dominia collision", 103.750, 1.220, "2017-09-03", "marine fuel oil", False, False, 0),
    ("singapore-2024", "Marine Honour allision", 103.760, 1.253, "2024-06-14", "low-sulphur fuel oil", False, False, 0),
    ("guimaras", "Solar 1 sinking", 122.583, 10.550, "2006-08-11", "bunker fuel", False, False, 0),
    ("oriental-mindoro", "MT Princess Empress sinking", 121.300, 13.283, "2023-02-28", "industrial fuel oil", False, False, 0),
    ("sundarbans", "Southern Star VII sinking", 89.600, 22.150, "2014-12-09", "furnace oil", False, False, 0),
    ("karachi-2003", "Tasman Spirit grounding", 66.967, 24.800, "2003-07-27", "crude oil", False, False, 0),
    ("japan-nakhodka", "Nakhodka breakup", 135.000, 37.000, "1997-01-02", "heavy fuel oil", False, False, 0),
    ("wakayama-2021", "Wakayama refinery leak", 135.150, 34.183, "2021-04-01", "crude oil", False, False, 0),
    ("persian-gulf-seeps", "Persian Gulf chronic discharges", 51.500, 27.500, "1980-01-01", "crude oil", True, False, 0),
    ("malacca-strait", "Malacca Strait chronic discharges", 100.500, 3.500, "1990-01-01", "oily waste", True, False, 0),
    ("bonga-2011", "Bonga FPSO spill", 5.100, 4.500, "2011-12-20", "crude oil", False, False, 0),
    ("bodo-2008", "Bodo pipeline spills", 7.283, 4.617, "2008-08-28", "crude oil", False, False, 0),
    ("jebel-ali-2010", "Gulf of Oman sheen", 56.500, 25.500, "2010-08-01", "crude oil", False, False, 0),
    ("safer-tanker", "FSO Safer risk site", 42.700, 15.117, "2015-01-01", "crude oil", False, False, 0),
    ("suez-2010", "Jebel al-Zayt platform leak", 33.583, 27.783, "2010-06-16", "crude oil", False, False, 0),
    ("cape-town-2019", "Table Bay bunkering spill", 18.417, -33.900, "2019-07-05", "marine fuel oil", False, False, 0),
    ("algoa-bay", "Algoa Bay bunkering releases", 25.700, -33.950, "2019-01-01", "marine fuel oil", True, False, 0),
    ("peru-repsol", "La Pampilla refinery spill", -77.150, -11.900, "2022-01-15", "crude oil", False, False, 0),
    ("brazil-2019", "Northeast Brazil mystery spill", -37.000, -10.000, "2019-08-30", "crude oil", False, False, 0),
    ("campos-2011", "Frade field leak", -40.100, -22.400, "2011-11-07", "crude oil", False, False, 0),
    ("venezuela-2020", "El Palito refinery leak", -68.150, 10.483, "2020-07-22", "crude oil", False, False, 0),
    ("argentina-1999", "Estrella Pampeana collision", -57.900, -34.783, "1999-01-15", "crude oil", False, False, 0),
    ("newfoundland-2018", "SeaRose FPSO release", -48.500, 46.750, "2018-11-16", "crude oil", False, False, 0),
]


def world_incidents(spark: SparkSession) -> DataFrame:
    """incident_id, name, lon, lat, occurred, commodity, persistent, natural_seep, duration_days."""
    raw = spark.createDataFrame(WORLD_INCIDENTS, "incident_id string, name string, lon double, lat double, day string, commodity string, persistent boolean, natural_seep boolean, days int")
    return raw.select(F.concat(F.lit("world-"), "incident_id").alias("incident_id"), "name", "lon", "lat", F.col("day").cast("timestamp_ntz").alias("occurred"), "commodity", "persistent", "natural_seep", F.col("days").cast("double").alias("duration_days"))
