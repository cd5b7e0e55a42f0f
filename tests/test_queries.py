"""Every registered query of the core against its SQL, over the whole small tables."""

import pytest
from compare import compare

from weftline.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        assert compare(df, ORACLES[name], small) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_optional():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "weftline"
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] != "llm":
            assert not re.search(r"weftline\.llm|from \.+llm", p.read_text()), p
