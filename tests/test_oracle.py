"""Every query that has SQL, against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lectern.plans import queries as core


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1)
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6) + 0.0
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def duck_larger(data):
    larger = Path(data).parent / "sf0.01"
    if not larger.exists():
        pytest.skip("no larger tables")
    con = duckdb.connect()
    for p in larger.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, data, duck, name):
    ours, theirs = _plain(core.QUERIES[name](spark, data).toPandas()), _plain(duck.execute(core.SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


@pytest.mark.parametrize("name", sorted(core.QUERIES.keys() - core.SQL.keys()))
def test_without_sql(spark, data, name):
    """Rows come out, the same ones again, none of them twice; what they say is held against examples in test_operators."""
    rows = [sorted(map(str, core.QUERIES[name](spark, data).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1] and len(rows[0]) == len(set(rows[0]))


@pytest.mark.parametrize(("name", "column", "values"), [("w02_changes", "change", {"new", "modified", "deleted"}), ("h03_imported", "status", {"imported", "duplicate"}), ("a04_debate", "stance", {"correct", "defend"}), ("a13_looked_over", "action", {"thin", "empty", "orphan"})])
def test_all_cases_are_reached(duck_larger, name, column, values):
    assert values <= {r[0] for r in duck_larger.execute(f"SELECT DISTINCT {column} FROM ({core.SQL[name]})").fetchall()}
