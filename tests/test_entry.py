import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "delim_rollup" in entry.queries()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
