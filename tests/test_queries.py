"""Each query of the engine against DuckDB."""

import pytest

from sketchmeans.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        assert len(out)
        return
    expected = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(out.columns) == sorted(expected.columns)
    got, want = rows_of(out), rows_of(expected)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if any(abs(a - b) > 2e-6 if isinstance(a, float) and isinstance(b, float) else a != b for a, b in zip(g, w, strict=True))]
    assert not bad, bad[:5]
