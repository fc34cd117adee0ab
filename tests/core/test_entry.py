import __spark_entry__ as entry


def test_every_sql_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 30


def test_flagship_finds_the_passages(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.hit1 for r in rows)
