"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, key):
    outcome = check.compare(spark, "sf0.001", key, entry.queries()[key], entry.oracle_sql().get(key))
    assert not outcome.startswith("FAIL"), outcome
    assert "types differ" not in outcome, outcome


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
