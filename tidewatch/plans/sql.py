"""Pieces of DuckDB SQL for the oracles: the domain relations, from the same expressions as the plans' own, and the formulae, written out apart from the plans."""

from __future__ import annotations

from collections.abc import Callable

from tidewatch.sources.relations import EPOCH, KNOWN_SOURCES, PORTS, RELATIONS


def with_relations(*names: str, then: str = "") -> str:
    """WITH clause of domain relations, and further tables in `then`, recursive ones too."""
    parts = []
    for n in names:
        if n == "source":
            parts.append("source(source_name, source_lon, source_lat, source_kind, radius_km) AS (VALUES " + ", ".join(f"('{a}', {b}e0, {c}e0, '{d}', {e}e0)" for a, b, c, d, e in KNOWN_SOURCES) + ")")
        elif n == "port":
            parts.append("port(port, port_lon, port_lat) AS (VALUES " + ", ".join(f"('{a} ({f})', {x}e0, {y}e0)" for a, f, x, y in PORTS) + ")")
        elif n == "pix":
            parts.append(
                "flat AS (SELECT vec_id AS tile, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings), "
                "pix AS (SELECT tile, CAST(i AS BIGINT) AS i, CAST(tile // 25 * 8 + i // 8 AS BIGINT) AS r, CAST(tile % 25 * 8 + i % 8 AS BIGINT) AS c, -17e0 + 1e1 * CAST(v AS DOUBLE) AS db FROM flat)"
            )
        else:
            table, where, columns = RELATIONS[n]
            if n == "slick":
                columns = [*columns, f"TIMESTAMP '{EPOCH}' + (o_orderkey % 720) * INTERVAL 1 HOUR AS observed"]
            if n == "incident":
                columns = [*columns, f"CASE WHEN c_custkey % 13 <> 0 THEN TIMESTAMP '{EPOCH}' + (c_custkey % 45 - 17) * INTERVAL 1 DAY END AS occurred"]
            parts.append(f"{n} AS (SELECT {', '.join(columns)} FROM {table}{f' WHERE {where}' if where else ''})")
    return ("WITH RECURSIVE " if " UNION ALL SELECT" in then else "WITH ") + ", ".join(parts) + (f", {then}" if then else "")


def r(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 5e-1) / 1e{digits}"


def mod(x: str, n: str) -> str:
    return f"(({x}) - {n} * floor(({x}) / {n}))"


def km(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians(({d}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians(({c}) - ({a})) / 2), 2)))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    turn = f"radians(({c}) - ({a}))"
    y, x = f"sin({turn}) * cos(radians({d}))", f"cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos({turn})"
    return mod(f"degrees(atan2({y}, {x}))", "360e0")


def turn(a: str, b: str) -> str:
    return f"abs({mod(f'{a} - ({b}) + 180e0', '360e0')} - 180e0)"


def axial(a: str, b: str) -> str:
    return f"abs({mod(f'{a} - ({b}) + 90e0', '180e0')} - 90e0)"


def minutes(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 60e6)"


def ramp(x: str, low: str, rise: str, fall: str, high: str) -> str:
    return f"(CASE WHEN {x} <= {low} OR {x} >= {high} THEN 0e0 WHEN {x} < {rise} THEN ({x} - {low}) / ({rise} - {low}) WHEN {x} <= {fall} THEN 1e0 ELSE ({high} - {x}) / ({high} - {fall}) END)"


def window_score(x: str) -> str:
    return ramp(x, "2e0", "3.5e0", "7.5e0", "12e0")


def contribution(term: str) -> str:
    """Weighted evidence of a slick row."""
    return {
        "wind": f"1.6e0 * (2 * {window_score('wind_ms')} - 1)",
        "damping": f"2.4e0 * {ramp('damping_db', '1e0', '5e0', '12e0', '20e0')}",
        "elongation": "1.8e0 * least(least(elongation, 50e0) / 12, 1e0)",
        "roundness_penalty": "-2.2e0 * least(greatest(compactness, 0e0), 1e0)",
        "homogeneity": "1.4e0 * least(greatest(homogeneity, 0e0), 1e0)",
        "contrast_penalty": "-2.6e0 * least(contrast / 50, 1e0)",
        "size": "0.4e0 * least(greatest((log10(greatest(area_km2, 1e-3)) + 1) / 2, 0e0), 1e0)",
        "vh_vv": "CASE WHEN vh_vv IS NULL THEN 0e0 ELSE 0.9e0 * (1 - least(greatest(vh_vv / 0.35e0, 0e0), 1e0)) END",
    }[term]


TERMS = ("wind", "damping", "elongation", "roundness_penalty", "homogeneity", "contrast_penalty", "size", "vh_vv")
GATE = "CASE WHEN wind_ms < 2 THEN 'wind_too_low' WHEN wind_ms > 15 THEN 'wind_too_high' WHEN damping_db < 1 THEN 'insufficient_damping' WHEN area_km2 < 0.05e0 THEN 'too_small' END"


def judged() -> str:
    """CTE judged: slicks with gate, p_oil and whether they are rejected."""
    terms = " + ".join(contribution(t) for t in TERMS)
    return (
        f"scored AS (SELECT *, {GATE} AS gate, 1 / (1 + exp(-greatest(-30e0, least(30e0, -4.4e0 + {terms})))) AS raw FROM slick), "
        "judged AS (SELECT *, CASE WHEN gate IS NOT NULL THEN least(raw, 0.2e0) ELSE raw END AS p_oil, gate IS NOT NULL OR raw < 0.5e0 AS rejected FROM scored)"
    )


def trained() -> str:
    """CTEs train and screened: wave trains, scene by scene from the largest region down, and slicks that no train rejects; after judged().

    walk holds for each scene how many regions have been seeds (k), which are used up, and the train that the last seed made.
    """
    at = {"a": "s.lon", "b": "s.lat", "c": "x.lon", "d": "x.lat"}
    steps = [
        "SELECT *, r[k + 1] AS s FROM walk WHERE k < len(r)",
        f"SELECT *, CASE WHEN list_contains(used, s.id) THEN [] ELSE list_filter(r, lambda x: NOT list_contains(used, x.id) AND {axial('x.axis', 's.axis')} <= 20 AND greatest(x.area, s.area) <= 3 * least(x.area, s.area)) END AS near FROM ({{}}) AS w1",
        f"SELECT *, list_transform(near, lambda x: x.id) AS found, {mod('degrees(atan2(list_sum(list_transform(near, lambda x: sin(radians(2 * x.axis)))), list_sum(list_transform(near, lambda x: cos(radians(2 * x.axis)))))) / 2', '180e0')} AS mean_axis FROM ({{}}) AS w2",
        f"SELECT *, list_sort(list_transform(near, lambda x: {km(**at)} * cos(radians({bearing(**at)} - (mean_axis + 90))))) AS o FROM ({{}}) AS w3",
        "SELECT *, list_filter(list_transform(range(1, len(o)), lambda i: o[i + 1] - o[i]), lambda g: g > 1e-6) AS gaps FROM ({}) AS w4",
        "SELECT *, list_avg(gaps) AS mean_gap, list_aggregate(gaps, 'stddev_pop') / list_avg(gaps) AS uneven FROM ({}) AS w5",
        "SELECT *, len(near) >= 3 AND len(gaps) > 0 AND uneven <= 0.45e0 AS ok FROM ({}) AS w6",
    ]
    nested = steps[0]
    for step in steps[1:]:
        nested = step.format(nested)
    none = "CAST([] AS BIGINT[])"
    return (
        "scene_rows AS (SELECT scene_id, list({'id': candidate_id, 'lon': lon, 'lat': lat, 'axis': axis_deg, 'area': area_km2} ORDER BY area_km2 DESC, candidate_id) AS r FROM slick WHERE elongation >= 3 AND area_km2 > 0 GROUP BY scene_id), "
        f"walk AS (SELECT scene_id, r, CAST(0 AS BIGINT) AS k, {none} AS used, 0 AS train, {none} AS ids, 0e0 AS axis, 0e0 AS spacing, 0e0 AS cv FROM scene_rows UNION ALL SELECT scene_id, r, k + 1, CASE WHEN ok THEN list_concat(used, found) ELSE used END, "
        f"CASE WHEN ok THEN train + 1 ELSE train END, CASE WHEN ok THEN found ELSE {none} END, mean_axis, mean_gap, uneven FROM ({nested}) AS w7), "
        "train AS (SELECT scene_id, train - 1 AS train, unnest(ids) AS candidate_id, axis, spacing, cv FROM walk WHERE len(ids) > 0), "
        "marked AS (SELECT j.*, t.candidate_id IS NOT NULL AS in_train FROM judged j LEFT JOIN train t USING (candidate_id)), "
        "screened AS (SELECT * REPLACE (CASE WHEN in_train AND NOT rejected THEN 'internal_wave_train' ELSE gate END AS gate, CASE WHEN in_train AND NOT rejected THEN least(p_oil, 0.2e0) ELSE p_oil END AS p_oil, rejected OR in_train AS rejected) FROM marked)"
    )


def gapped() -> str:
    """CTE gap: AIS silences of 30 minutes and more."""
    lag = lambda c: f"lag({c}) OVER (PARTITION BY mmsi ORDER BY ts, event_id)"
    return (
        f"lagged AS (SELECT *, {lag('ts')} AS gap_start, {lag('lon')} AS last_lon, {lag('lat')} AS last_lat FROM pos), "
        f"timed AS (SELECT *, {minutes('gap_start', 'ts')} AS minutes, {km('last_lon', 'last_lat', 'lon', 'lat')} AS km FROM lagged WHERE gap_start IS NOT NULL), "
        "gap AS (SELECT *, ts AS gap_end, km / 1.852e0 / (minutes / 60) AS knots, (last_lon + lon) / 2 AS mid_lon, (last_lat + lat) / 2 AS mid_lat FROM timed WHERE minutes >= 30 AND km / 1.852e0 / (minutes / 60) <= 60)"
    )


def approached(of: str = "slick") -> str:
    """CTE near: the closest fix, within 50 km, of each vessel to each row of `of` from 8 hours before to 6 hours after its release."""
    d = km("s.lon", "s.lat", "p.lon", "p.lat")
    return (
        f"pair AS (SELECT s.candidate_id, p.mmsi, p.ts, p.event_id, {d} AS km, {minutes('s.observed', 'p.ts')} / 60 AS hours, "
        f"row_number() OVER (PARTITION BY s.candidate_id, p.mmsi ORDER BY {d}, p.ts, p.event_id) AS n "
        f"FROM {of} s JOIN pos p ON p.ts >= s.observed - INTERVAL 8 HOUR AND p.ts <= s.observed + INTERVAL 6 HOUR), "
        "near AS (SELECT candidate_id, mmsi, ts, km, hours FROM pair WHERE n = 1 AND km <= 50)"
    )


def ranked(of: str = "slick") -> str:
    """CTE ranked: vessels of each row of `of` by score, after approached() and gapped()."""
    axes = axial("c.course", "s.axis_deg")
    return (
        f"course AS (SELECT mmsi, {mod('degrees(atan2(sum(sin(radians(cog))), sum(cos(radians(cog)))))', '360e0')} AS course FROM pos GROUP BY mmsi), "
        f"dark AS (SELECT DISTINCT s.candidate_id, g.mmsi FROM {of} s JOIN gap g ON s.observed >= g.gap_start - INTERVAL 1 HOUR AND s.observed <= g.gap_end + INTERVAL 1 HOUR "
        f"WHERE {km('s.lon', 's.lat', 'g.mid_lon', 'g.mid_lat')} <= greatest(s.unc_km * 2, 10e0)), "
        f"termed AS (SELECT n.candidate_id, n.mmsi, n.km, CASE WHEN s.axis_deg IS NULL THEN 0e0 ELSE greatest(0e0, 1 - {axes} / 90) END AS parity, CASE WHEN n.km <= 50 THEN exp(-0.5e0 * pow(n.km / greatest(s.unc_km, 1e0), 2)) ELSE 0e0 END AS proximity, "
        "CASE WHEN n.hours <= 0 THEN exp(n.hours / 8) ELSE exp(-3 * n.hours / 8) END AS temporality, d.mmsi IS NOT NULL AS went_dark "
        f"FROM near n JOIN {of} s USING (candidate_id) JOIN course c USING (mmsi) LEFT JOIN dark d ON d.candidate_id = n.candidate_id AND d.mmsi = n.mmsi), "
        "summed AS (SELECT *, least(1e0, 0.3e0 * parity + 0.4e0 * proximity + 0.3e0 * temporality + CASE WHEN went_dark THEN 0.15e0 ELSE 0e0 END) AS score FROM termed WHERE proximity > 1e-6 AND temporality >= 0.05e0), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, mmsi) AS place FROM summed)"
    )


def matched() -> str:
    """CTE match: documented incidents near each slick; the cells of five degrees hold every radius up to 60 degrees of latitude."""
    d, days = km("s.lon", "s.lat", "i.lon", "i.lat"), "(epoch_us(s.observed) - epoch_us(i.occurred)) / 86400e6"
    return (
        f"paired AS (SELECT s.candidate_id, i.incident_id, i.persistent, i.natural_seep, i.duration_days, {d} AS km, CASE WHEN NOT i.persistent THEN {days} END AS days FROM slick s JOIN incident i "
        "ON abs(floor(s.lon / 5) - floor(i.lon / 5)) <= 1 AND abs(floor(s.lat / 5) - floor(i.lat / 5)) <= 1), "
        "ringed AS (SELECT *, CASE WHEN days IS NULL THEN CASE WHEN persistent THEN 100e0 ELSE 30e0 END WHEN days > 0 THEN least(30e0 + 20 * days, 250e0) ELSE 30e0 END AS radius, "
        "CASE WHEN days IS NOT NULL THEN exp(-greatest(days - duration_days, 0e0) / 7) WHEN persistent THEN 1e0 ELSE 0.4e0 END AS fresh FROM paired WHERE days IS NULL OR (days >= -2 AND days <= 14 + duration_days)), "
        "match AS (SELECT candidate_id, incident_id, km, days, persistent, natural_seep, 0.6e0 * greatest(0e0, 1 - km / radius) + 0.4e0 * fresh AS confidence FROM ringed WHERE km <= radius)"
    )


def rk4(velocity: Callable[[str, str, str], tuple[str, str]], of: str, dt: str, keep: str, then: str = "") -> str:
    """One fourth-order step over `of` (lon, lat, h, n) in SQL, stage by stage: keep, lon, lat, h, n + 1, then."""
    at = [("lon", "lat", "h"), *((f"lon + u{k} * ax * {s}e0", f"lat + v{k} * ay * {s}e0", f"h + d * {s}e0 / 3600") for k, s in ((1, 0.5), (2, 0.5), (3, 1.0)))]
    inner = f"SELECT *, d / (111320e0 * cos(radians(lat))) AS ax, d / 110574e0 AS ay FROM (SELECT *, {dt} AS d FROM {of}) AS a0"
    for k, place in enumerate(at, 1):
        u, v = velocity(*place)
        inner = f"SELECT *, {u} AS u{k}, {v} AS v{k} FROM ({inner}) AS a{k}"
    return f"SELECT {keep}, lon + (u1 + 2 * (u2 + u3) + u4) * ax / 6 AS lon, lat + (v1 + 2 * (v2 + v3) + v4) * ay / 6 AS lat, h + d / 3600 AS h, n + 1 AS n{", " + then if then else ""} FROM ({inner}) AS a9"


def eddy(lon: str, lat: str, h: str) -> tuple[str, str]:
    return f"0.25e0 + 0.18e0 * sin(2 * pi() / 0.6e0 * ({lat})) + 0.12e0 * cos(2 * pi() / 12.42e0 * ({h}))", f"-0.1e0 - 0.18e0 * sin(2 * pi() / 0.6e0 * ({lon}))"
