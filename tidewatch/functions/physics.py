"""Rules of the screening and scoring steps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.geo import axial_difference_deg, round_to

# Wind window (m/s), gates, weights of the logistic score, confidence points.
WIND_WINDOW = (2.0, 3.5, 7.5, 12.0)
GATE_WIND_MIN, GATE_WIND_MAX, GATE_DAMPING_DB, GATE_AREA_KM2 = 2.0, 15.0, 1.0, 0.05
WEIGHTS = {"wind": 1.60, "damping": 2.40, "elongation": 1.80, "roundness_penalty": -2.20, "homogeneity": 1.40, "contrast_penalty": -2.60, "size": 0.40, "vh_vv": 0.90}
BIAS = -4.40
PHRASES = {
    "roundness_penalty": "round",
    "contrast_penalty": "granular",
    "wind": "edge of the wind window",
    "damping": "weak damping",
    "elongation": "not elongated",
    "homogeneity": "patchy",
    "size": "small",
    "vh_vv": "cross-pol mismatch",
}
LINEAR_ELONGATION, LINEAR_COMPACTNESS, BLOB_COMPACTNESS = 6.0, 0.35, 0.45
SCORE_WEIGHTS = {"parity": 0.3, "proximity": 0.4, "temporality": 0.3}
DARK_BONUS, MIN_PROXIMITY, MIN_TEMPORALITY = 0.15, 1e-6, 0.05
ABSTAIN_MARGIN, MIN_TOP_SCORE, MIN_WINDOW_SCORE, MAX_UNCERTAINTY_KM = 0.08, 0.35, 0.15, 60.0


def finite(x: Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clean(x: Column) -> Column:
    """Null for what isn't a finite number."""
    return F.when(finite(x), x)


def trapezoid(x: Column, low: float, rise: float, fall: float, high: float) -> Column:
    """0 outside (low, high), 1 on [rise, fall], linear between; 0 for what isn't finite."""
    inner = F.when(x < rise, (x - low) / (rise - low)).when(x <= fall, 1.0).otherwise((high - x) / (high - fall))
    return F.when(~finite(x) | (x <= low) | (x >= high), 0.0).otherwise(inner)


def wind_window_score(speed: Column) -> Column:
    return trapezoid(speed, *WIND_WINDOW)


def gate(wind: Column, damping_db: Column, area_km2: Column) -> Column:
    """The first physical gate that a region fails, or null."""
    return (
        F.when(~finite(wind), "no_wind").when(wind < GATE_WIND_MIN, "wind_too_low").when(wind > GATE_WIND_MAX, "wind_too_high")
        .when(damping_db < GATE_DAMPING_DB, "insufficient_damping").when(area_km2 < GATE_AREA_KM2, "too_small")
    )


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def evidence(wind: Column, damping_db: Column, elongation: Column, compactness: Column, homogeneity: Column, contrast: Column, area_km2: Column, vh_vv: Column) -> dict[str, Column]:
    """The eight evidence terms, each about 0 to 1."""
    log_area = F.log10(F.greatest(area_km2, F.lit(1e-3)))
    return {
        "wind": 2.0 * wind_window_score(wind) - 1.0,
        "damping": trapezoid(damping_db, 1.0, 5.0, 12.0, 20.0),
        "elongation": F.least(F.least(elongation, F.lit(50.0)) / 12.0, F.lit(1.0)),
        "roundness_penalty": _unit(compactness),
        "homogeneity": _unit(homogeneity),
        "contrast_penalty": F.least(contrast / 50.0, F.lit(1.0)),
        "size": _unit((log_area + 1.0) / 2.0),
        "vh_vv": F.when(finite(vh_vv), 1.0 - _unit(vh_vv / 0.35)).otherwise(0.0),
    }


def contributions(terms: dict[str, Column]) -> Column:
    """map(term, weight x value)."""
    return F.create_map(*(x for name, value in terms.items() for x in (F.lit(name), F.lit(WEIGHTS[name]) * value)))


def logistic(contributed: Column) -> Column:
    total = F.aggregate(F.map_values(contributed), F.lit(BIAS), lambda a, x: a + x)
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def worst_term(contributed: Column) -> Column:
    """The most negative contribution, or the smallest one if none is negative; the first of equals."""
    return F.array_min(F.transform(F.map_entries(contributed), lambda e, i: F.struct(e["value"].alias("value"), i.alias("i"), e["key"].alias("key"))))["key"]


def morphology(source_kind: Column, elongation: Column, compactness: Column, recurring: Column | None = None) -> Column:
    """struct(morphology, source_type): catalogue, then recurrence, then shape."""
    pair = lambda m, s: F.struct(F.lit(m).alias("morphology"), (s if isinstance(s, Column) else F.lit(s)).alias("source_type"))
    chain = F.when(source_kind.isNotNull(), pair("blob", source_kind))
    if recurring is not None:
        chain = chain.when(recurring, pair("blob", "infrastructure"))
    return (
        chain.when((elongation >= LINEAR_ELONGATION) & (compactness <= LINEAR_COMPACTNESS), pair("linear", "vessel"))
        .when(compactness >= BLOB_COMPACTNESS, pair("blob", "unknown")).otherwise(pair("unknown", "unknown"))
    )


def confidence(p_oil: Column, damping_db: Column, window: Column, shape: Column, elongation: Column, area_km2: Column, rejected: Column, match: Column, source_type: Column) -> Column:
    """struct(tier, score) of one candidate; match is the confidence of the best documented incident, null if none."""
    points = (
        F.when(p_oil >= 0.75, 0.34).when(p_oil >= 0.50, 0.18).otherwise(0.0) + F.when(damping_db >= 5.0, 0.22).when(damping_db >= 2.5, 0.11).otherwise(0.0)
        + F.when(window >= 0.6, 0.20).when(window >= 0.25, 0.09).otherwise(0.0) + F.when((shape == "linear") & (elongation >= 8.0), 0.14).when(shape == "linear", 0.07).otherwise(0.0)
        + F.when(area_km2 >= 0.3, 0.10).otherwise(0.0)
    )
    score = F.when(match.isNotNull(), F.least(F.lit(1.0), points + 0.30 * F.least(F.lit(1.0), 0.4 + match))).otherwise(points)
    fixed = source_type.isin("natural_seep", "infrastructure")
    tier = F.when((match >= 0.35) & (score >= 0.55), "confirmed").when(score >= 0.62, "probable").when((score >= 0.38) & fixed, "probable").when(score >= 0.38, "possible").otherwise("insufficient")
    return F.when(rejected, F.struct(F.lit("insufficient").alias("tier"), F.lit(0.0).alias("score"))).otherwise(F.struct(tier.alias("tier"), score.alias("score")))


def corroboration_radius_km(days: Column, base: float = 30.0) -> Column:
    """How far oil could have drifted since an incident: 20 km a day on top of the base, at most 250 km."""
    return F.when(days > 0, F.least(F.lit(base) + 20.0 * days, F.lit(250.0))).otherwise(F.lit(base))


def parity_score(course: Column, axis: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - axial_difference_deg(course, axis) / 90.0), F.lit(0.0))


def proximity_score(km: Column, uncertainty_km: Column, search_km: float = 50.0) -> Column:
    return F.when(km <= search_km, F.exp(-0.5 * F.pow(km / F.greatest(uncertainty_km, F.lit(1.0)), 2.0))).otherwise(0.0)


def temporality_score(hours: Column, window_hours: float = 8.0) -> Column:
    """hours: closest approach minus release; late arrivals fade three times as fast."""
    scale = max(window_hours, 0.5)
    return F.when(hours <= 0, F.exp(-F.abs(hours) / scale)).when(hours > 0, F.exp(-3.0 * hours / scale)).otherwise(0.0)


def vessel_score(parity: Column, proximity: Column, temporality: Column, dark: Column) -> Column:
    base = SCORE_WEIGHTS["parity"] * parity + SCORE_WEIGHTS["proximity"] * proximity + SCORE_WEIGHTS["temporality"] * temporality
    return F.least(F.lit(1.0), base + F.when(dark, DARK_BONUS).otherwise(0.0))


def disqualified(proximity: Column, temporality: Column) -> Column:
    """Why a vessel can't be the source, or null."""
    return F.when(proximity <= MIN_PROXIMITY, "never within the search radius").when(temporality < MIN_TEMPORALITY, "passed after the slick")


def abstain_reason(rejected: Column, window: Column, source_type: Column, has_origin: Column, uncertainty_km: Column, vessels: Column, top: Column, second: Column) -> Column:
    """The first reason to withhold a ranking, or null."""
    return (
        F.when(rejected, "not classified as oil").when(window < MIN_WINDOW_SCORE, "wind at the edge of the detection window")
        .when(source_type.isin("natural_seep", "infrastructure"), F.concat(F.lit("source classified as "), F.replace(source_type, F.lit("_"), F.lit(" "))))
        .when(~has_origin, "no drift origin").when(uncertainty_km > MAX_UNCERTAINTY_KM, "drift origin too uncertain").when(vessels == 0, "no AIS tracks near the origin")
        .when(top < MIN_TOP_SCORE, "best candidate below threshold").when((vessels >= 2) & (top - second < ABSTAIN_MARGIN), "top two candidates too close")
    )


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def linear_to_db(x: Column) -> Column:
    return 10.0 * F.log10(F.greatest(x, F.lit(1e-12)))


def evidence_text(failed: Column, rejected: Column, shape: Column, wind: Column, area_km2: Column, p_oil: Column) -> Column:
    """A sentence on why a region was taken for oil or not; `failed` is its gate."""
    wind, area_km2, p_oil = round_to(wind, 1), round_to(area_km2, 1), round_to(p_oil, 2)
    return (
        F.when(failed == "wind_too_low", F.format_string("wind %.1f m/s is below what makes oil visible", wind)).when(failed == "wind_too_high", F.format_string("wind %.1f m/s mixes oil away", wind))
        .when(failed.isNotNull(), F.replace(failed, F.lit("_"), F.lit(" "))).when(rejected, F.format_string("likely a look-alike (p %.2f)", p_oil)).otherwise(F.format_string("%s slick of %.1f km2, p %.2f", shape, area_km2, p_oil))
    )
