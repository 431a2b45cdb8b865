"""Every registered query with SQL gives the rows of its SQL; the others keep their invariants."""

import duckdb
import pandas as pd
import pytest

from voxframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries of many rounds, run by the others' parts or by their own tests below.
SLOW = {"me4_iso_surface", "me16_simplified", "pr13_mesh_band", "mt17_path_ends", "mt16_end_distance_ratio", "sj5_nearest_triangle"}


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted("|".join(map(str, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_calibration_settles(spark, sf):
    got = QUERIES["bt1_calibrated_iso"](spark, sf).toPandas()
    assert len(got) and got["settled"].all()


def test_cohort_holds_its_constraint(spark, sf):
    got = QUERIES["gn10_constrained_cohort"](spark, sf).toPandas()
    assert got["holds"].all() and (got["draw_no"] <= 100).all()


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
