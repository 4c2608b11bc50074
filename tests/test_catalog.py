"""Every query with SQL gives the same rows as it; the others give rows."""

import pytest

from foliospark import catalog

MAY_BE_EMPTY = {"heading_like_lines", "page_links", "page_contents", "running_lines"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, same_rows):
    n = same_rows(catalog.QUERIES[name], catalog.ORACLES[name])
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() or name in MAY_BE_EMPTY


def test_entry_is_registered():
    import __spark_entry__ as entry

    assert catalog.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
