"""Oracle parity inside the test suite (small scale): Spark query vs the DuckDB SQL."""

import math

import pytest

from conftest import SF_SMALL, duck_with_tables

NAMES = ["feature_table", "labels", "score_users", "sticky_decisions", "lookup_features",
         "unscorable_requests", "build_tier_config", "attribute_response", "feature_drift"]


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple("NaN" if isinstance(v, float) and math.isnan(v) else
                         (round(v, 9) if isinstance(v, float) else v) for v in r))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = _norm([tuple(r[c] for c in cols) for r in sdf.collect()])
    con = duck_with_tables(duck, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    want = _norm([tuple(row[dcols.index(c)] for c in cols) for row in res.fetchall()])
    assert sorted(dcols) == cols
    same = {("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"),
            ("boolean", "BOOLEAN")}
    dtypes = dict(zip(dcols, [str(t) for t in con.sql(E.oracle_sql()[name]).types]))
    assert all((f.dataType.simpleString(), dtypes[f.name]) in same for f in sdf.schema.fields)
    assert got == want
