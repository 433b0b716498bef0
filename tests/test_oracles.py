"""Every registered query of the core against its SQL, on the small tables."""

import pandas as pd
import pytest

from lumenlog.plans import catalog, catalog2, catalog3, catalog4, catalog_streams

ALL = {**catalog.QUERIES, **catalog2.QUERIES, **catalog3.QUERIES, **catalog4.QUERIES, **catalog_streams.QUERIES}
SQL = {**catalog.ORACLES, **catalog2.ORACLES, **catalog3.ORACLES, **catalog4.ORACLES, **catalog_streams.ORACLES}


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(lambda v: "null" if pd.isna(v) else (repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, sf, name):
    got = ALL[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    if name not in SQL:
        assert got.count() >= 0
        return
    want = duck.execute(SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got.toPandas()), normal(want))
