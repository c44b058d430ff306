"""Wave trains: groups of parallel, evenly spaced dark bands, which are waves rather than oil."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geo import axial_difference_deg

MIN_ELONGATION, MAX_AXIS, MAX_RATIO, MIN_MEMBERS, MAX_CV = 3.0, 20.0, 3.0, 3, 0.45


def parallel_pairs(regions: DataFrame) -> DataFrame:
    """Pairs of elongated regions of a scene with like axes and areas: scene_id, a, b (candidate ids, a < b)."""
    side = lambda p: regions.where(F.col("elongation") >= MIN_ELONGATION).select("scene_id", *(F.col(c).alias(f"{p}{c}") for c in ("candidate_id", "axis_deg", "area_km2")))
    pairs = side("a_").join(side("b_"), "scene_id").where("a_candidate_id < b_candidate_id")
    like = axial_difference_deg(F.col("a_axis_deg"), F.col("b_axis_deg")) <= MAX_AXIS
    size = F.greatest("a_area_km2", "b_area_km2") <= MAX_RATIO * F.least("a_area_km2", "b_area_km2")
    return pairs.where(like & size).select("scene_id", F.col("a_candidate_id").alias("a"), F.col("b_candidate_id").alias("b"))


def _offsets(lon: np.ndarray, lat: np.ndarray, lon0: np.ndarray, lat0: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Distance of each region from its seed (lon0, lat0), across the axis, in km; places in radians."""
    d = lon - lon0
    h = np.sin((lat - lat0) / 2) ** 2 + np.cos(lat) * np.cos(lat0) * np.sin(d / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, h)))
    bearing = np.arctan2(np.sin(d) * np.cos(lat), np.cos(lat0) * np.sin(lat) - np.sin(lat0) * np.cos(lat) * np.cos(d))
    return km * np.cos(bearing - np.radians(axis + 90))


def _trains(scene: np.ndarray, place: np.ndarray, lon: np.ndarray, lat: np.ndarray, axis: np.ndarray, area: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trains of whole scenes: row, train, axis, spacing and variation of each member.

    scene numbers the scenes from 0 and place the rows within each, largest region first. All scenes take their next seed at
    once, so the steps are as many as the largest scene has regions, however many scenes there are.
    """
    n = int(scene[-1]) + 1
    first, size = np.flatnonzero(place == 0), np.bincount(scene, minlength=n)
    double, x, y = np.radians(2 * axis), np.radians(lon), np.radians(lat)
    east, north = np.sin(double), np.cos(double)
    used, train = np.zeros(len(scene), dtype=bool), np.zeros(n, dtype=np.int32)
    rows, out = np.arange(len(scene)), []
    for k in range(int(size.max())):
        left = np.bincount(scene[rows], minlength=n)
        rows = rows[((left >= MIN_MEMBERS) & (size > k))[scene[rows]]]  # scenes with enough regions for one more train
        if not len(rows):
            break
        seed = first + np.minimum(k, size - 1)
        on = rows[~used[seed][scene[rows]]]
        at = seed[scene[on]]
        turned = np.abs((axis[on] - axis[at] + 90) % 180 - 90)
        on = on[(turned <= MAX_AXIS) & (np.maximum(area[on], area[at]) <= MAX_RATIO * np.minimum(area[on], area[at]))]
        on = on[(np.bincount(scene[on], minlength=n) >= MIN_MEMBERS)[scene[on]]]
        if not len(on):
            continue
        some, of = np.unique(scene[on], return_inverse=True)  # scenes that have a candidate, and each row's number among them
        mean_axis = np.degrees(np.arctan2(np.bincount(of, east[on]), np.bincount(of, north[on]))) / 2 % 180
        at = seed[scene[on]]
        across = _offsets(x[on], y[on], x[at], y[at], mean_axis[of])
        order = np.lexsort((across, of))
        gap, same = np.diff(across[order]), np.diff(of[order]) == 0
        wide = same & (gap > 1e-6)  # regions in line with each other are one band
        gap, held = gap[wide], of[order][1:][wide]
        gaps = np.bincount(held, minlength=len(some))
        with np.errstate(invalid="ignore", divide="ignore"):
            spacing = np.bincount(held, gap, minlength=len(some)) / gaps
            cv = np.sqrt(np.bincount(held, (gap - spacing[held]) ** 2, minlength=len(some)) / gaps) / spacing
            even = (gaps > 0) & ~(cv > MAX_CV)
        on, of = on[even[of]], of[even[of]]
        used[on] = True
        out.append((on, train[scene[on]], mean_axis[of], spacing[of], cv[of]))
        train[some[even]] += 1
        rows = rows[~used[rows]]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), *(np.zeros(0) for _ in range(4)))


_TRAIN = "scene_id long, train int, candidate_id long, axis double, spacing_km double, cv double"


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trains of rows sorted by scene; the last scene of a batch waits for the next one."""

    def trains(t: pa.Table) -> pa.RecordBatch:
        ids = t["scene_id"].combine_chunks()
        key, none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        begins = np.r_[True, (key[1:] != key[:-1]) | (none[1:] != none[:-1])]
        scene = np.cumsum(begins) - 1
        place = np.arange(len(scene)) - np.flatnonzero(begins)[scene]
        rows, train, axis, spacing, cv = _trains(scene, place, *(t[c].to_numpy().astype(float) for c in ("lon", "lat", "axis_deg", "area_km2")))
        found = pa.array(rows, pa.int64())
        columns = [ids.take(found).cast(pa.int64()), pa.array(train, pa.int32()), t["candidate_id"].combine_chunks().take(found).cast(pa.int64()), *(pa.array(c, pa.float64()) for c in (axis, spacing, cv))]
        return pa.RecordBatch.from_arrays(columns, ["scene_id", "train", "candidate_id", "axis", "spacing_km", "cv"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column("scene_id")
        key = last[0].as_py(), last[-1].as_py()
        if held and held[-1].column("scene_id")[-1].as_py() != key[0]:
            yield trains(pa.Table.from_batches(held))
            held = []
        if key[0] == key[1]:
            held.append(batch)
            continue
        same = pc.fill_null(pc.equal(last, last[-1]), False) if key[1] is not None else pc.is_null(last)
        begin = pc.index(same, True).as_py()
        yield trains(pa.Table.from_batches([*held, batch.slice(0, begin)]))
        held = [batch.slice(begin)]
    if held:
        yield trains(pa.Table.from_batches(held))


def wave_trains(regions: DataFrame) -> DataFrame:
    """(scene_id, train, candidate_id, axis, spacing_km, cv): greedy from the largest region of each scene.

    A seed gathers the unused regions with like axis and area; three or more of them with even gaps are a train. The
    choice depends on what earlier seeds used up, so a scene's elongated regions meet in one task, where many scenes
    are searched at once.
    """
    chosen = regions.where((F.col("elongation") >= MIN_ELONGATION) & (F.col("area_km2") > 0)).select("scene_id", "candidate_id", "lon", "lat", "axis_deg", "area_km2")
    tasks = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the search costs more than its rows' bytes say
    ordered = chosen.repartition(tasks, "scene_id").sortWithinPartitions("scene_id", F.desc("area_km2"), "candidate_id")
    return ordered.mapInArrow(_in_batches, _TRAIN)


def override(judged: DataFrame, trains: DataFrame) -> DataFrame:
    """Reject members of wave trains that weren't rejected yet; their p_oil is at most 0.2, and a gate (if there is such a column) says why."""
    marked = judged.join(trains.select("candidate_id").withColumn("in_train", F.lit(True)), "candidate_id", "left").withColumn("in_train", F.coalesce("in_train", F.lit(False)))
    fresh = F.col("in_train") & ~F.col("rejected")
    if "gate" in judged.columns:
        marked = marked.withColumn("gate", F.when(fresh, "internal_wave_train").otherwise(F.col("gate")))
    return marked.withColumns({"p_oil": F.when(fresh, F.least("p_oil", F.lit(0.2))).otherwise(F.col("p_oil")), "rejected": F.col("rejected") | F.col("in_train")})
