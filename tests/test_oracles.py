"""Every plan with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from oddsmith.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


def canonical(rows):
    def value(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.5f}".replace("-0.00000", "0.00000")
        return str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = canonical([r[c] for c in columns] for r in got.collect())
    theirs = canonical(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert len(ours) == len(theirs)
    assert sum(a != b for a, b in zip(ours, theirs, strict=True)) == 0
