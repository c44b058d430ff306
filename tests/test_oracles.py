"""Every query with an oracle against DuckDB on sf0.001; of the others, what must hold of every result (brute force is in other modules)."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidewatch.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, pd.Timestamp):
            return x.isoformat()
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


def between(x, low, high):
    return bool(((x >= low) & (x <= high)).all())


#: Queries that SQL can't express: what their whole result, as pandas, must satisfy on tables with these numbers of rows.
EXPECTED = {
    "d01_d04_origins": lambda g, n: 0 < len(g) < n["orders"] and g.candidate_id.is_unique and (g.particles == 500).all() and (g.uncertainty_km >= 0.9 * 12).all() and g.reliable.all() and g.notna().all().all(),
    "d05_n07_timeline": lambda g, n: len(g) == 3 * n["orders"] and set(g.state) == {"origin", "observed", "now"} and (g.uncertainty_km.eq(g.spread_km) | g.particles.eq(0))[g.state == "observed"].all()
    and set(g.problem.dropna()) == {"too old for a forecast", "no particle falls into the polygon"} and (g.particles.eq(0) == g.wkt.isna()).all() and g.wkt.dropna().str.startswith("POLYGON ((").all(),  # a slick without area takes no particle
    "n06_backtrace": lambda g, n: (g.groupby("candidate_id").frame.max() == 25).all() and (g.groupby("candidate_id")["at"].max() - g.groupby("candidate_id")["at"].min()).eq(pd.Timedelta(hours=12)).all(),
    "j12_wave_trains": lambda g, n: (g.groupby(["scene_id", "train"]).candidate_id.nunique() >= 3).all() and g.candidate_id.is_unique and between(g.cv, 0, 0.45) and (g.spacing_km > 0).all(),
    "p05_wave_train_override": lambda g, n: len(g) == n["orders"] and g[g.in_train].rejected.all() and between(g.p_oil, 0, 1) and 0 < g.in_train.sum() < n["orders"],
    "r08_dark_patches": lambda g, n: len(g) == 64 * n["embeddings"] and between(g.p_dark, 0, 1) and not g.duplicated(["r", "c"]).any() and g.p_dark.std() > 0.01,
    "r11_regions": lambda g, n: len(g) > 10 and (g.pixels >= 8).all() and (g.damping_ratio.dropna() < 1).all() and between(g.compactness, 0, 1) and (g.mean_confidence > 0.4).all() and g.label.is_unique,
    "g03_contours": lambda g, n: len(g) == n["embeddings"] and (g.vertices > 2).all() and (g.wkt.eq("POLYGON EMPTY") == (g.vertices < 4)).all(),
    "l02_logistic_fit": lambda g, n: len(g) > 1 and g.select_dtypes("number").notna().all().all() and g.select_dtypes("float").abs().max().max() < 1e3,
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    if name not in catalog.oracles():
        sizes = {t: duck.sql(f"select count(*) from {t}").fetchall()[0][0] for t in TABLES}
        assert EXPECTED[name](got.toPandas(), sizes)
        return
    want = duck.sql(catalog.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)
