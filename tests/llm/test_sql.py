"""Registered queries of the subpackage against their SQL over the whole small tables; the others must run."""

import pytest
from compare import compare

from weftline.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    if name in oracles.ORACLES:
        assert compare(df, oracles.ORACLES[name], small) == ""
    else:
        rows = df.collect()
        assert rows or name.startswith("p10_")
        if name.endswith("_found"):
            assert len({tuple(r) for r in rows}) == len(rows)
