"""The SQL of the corpus queries gives their rows."""

import duckdb
import pandas as pd
import pytest

from tarnwork.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = duck.execute(Q.ORACLES[name]).df()
    got = Q.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    plain = lambda f: sorted(tuple(None if pd.isna(v) else (int(v) if isinstance(v, float) else v) for v in r) for r in f[columns].astype(object).itertuples(index=False))
    assert sorted(map(str, plain(got))) == sorted(map(str, plain(want)))
