"""Queries that have to take in every row of their tables."""

from test_oracles import SF

from tidewatch.plans import catalog
from tidewatch.sources import relations


def test_every_order_is_a_slick(spark):
    keys = lambda df, c: sorted(r[0] for r in df.select(c).collect())
    orders = keys(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderkey")
    assert keys(relations.relation(spark, SF, "slick"), "candidate_id") == orders
    assert keys(catalog.queries()["p04_f12_lookalike"](spark, SF), "candidate_id") == orders


def test_the_registries_hold_every_incident(spark):
    got = catalog.queries()["u01_u02_registry_union"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_wave_trains_stay_within_a_scene(spark):
    scene = {r[0]: r[1] for r in relations.relation(spark, SF, "slick").select("candidate_id", "scene_id").collect()}
    trains = catalog.queries()["j12_wave_trains"](spark, SF).collect()
    assert trains and all(scene[r["candidate_id"]] == r["scene_id"] for r in trains)
    pairs = catalog.queries()["j12_parallel_pairs"](spark, SF).collect()
    assert pairs and all(scene[r["a"]] == scene[r["b"]] == r["scene_id"] for r in pairs)
    marked = {r["candidate_id"] for r in catalog.queries()["p05_wave_train_override"](spark, SF).where("in_train").collect()}
    assert marked == {r["candidate_id"] for r in trains}
